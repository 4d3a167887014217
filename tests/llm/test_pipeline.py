"""The pipeline stage by stage against brute force, with nulls, copies and extra columns."""

import random
import re
import zlib
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(2)
    words = ["the", "of", "and", "to"] + ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(500)]

    def prose(n):
        return " ".join(rng.choice(words[:4]) if rng.random() < 0.4 else rng.choice(words) for _ in range(n)) + "."

    clean = [prose(rng.randrange(60, 140)) for _ in range(60)]
    passage = prose(30)
    rows = [(i, t) for i, t in enumerate(clean)]
    rows += [(100 + i, clean[i]) for i in range(10)]  # copies
    rows += [(200 + i, clean[20 + i].rsplit(" ", 1)[0] + " tail") for i in range(5)]  # near copies
    rows += [(300 + i, prose(60) + " " + passage + " " + prose(60)) for i in range(6)]  # contaminated
    rows += [(400, clean[0].upper()), (401, "too short"), (402, "word " * 200), (403, None), (404, "")]  # rejected
    rows += [(500, prose(80) + " Mail bob.stone77@mail.example.com now, or call +1 (935) 555-6637.")]
    root = str(tmp_path_factory.mktemp("pipeline"))
    df = spark.createDataFrame([(i, t, "en", "src", None if t is None else len(t), 7, "x") for i, t in rows],
                               "doc_id long, text string, lang string, source string, n_chars long, n int, kept string")
    df.repartition(3).write.parquet(f"{root}/documents.parquet")
    bench = spark.createDataFrame([(1, " ".join(passage.split()[3:25])), (2, None)], "item_id long, text string")
    bench.write.parquet(f"{root}/benchmark.parquet")
    return root, dict(rows)


def test_stages(spark, tables, tmp_path):
    import corpus_pipeline as P
    root, texts = tables
    docs = spark.read.parquet(f"{root}/documents.parquet")
    columns, seen = docs.columns, [set(texts)]
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, root)
        assert out.columns == columns and dict(out.dtypes) == dict(docs.dtypes)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
    quality, unique, clean, private = seen[1:]
    assert set(texts) - quality == {400, 401, 402, 403, 404}
    assert quality - unique == {100 + i for i in range(10)} | {200 + i for i in range(5)}
    assert unique - clean == {300 + i for i in range(6)}
    assert private == clean == set(range(60)) | {500}
    out = {r.doc_id: r for r in docs.collect()}
    assert "bob.stone77" not in out[500].text and "555-6637" not in out[500].text and out[500].n_chars == len(out[500].text)
    assert all(out[i].text == texts[i] for i in range(60))
    pieces = P.STAGES[-1][1](spark, docs, root).collect()
    from tokenizers import Tokenizer
    import numpy as np
    tok = Tokenizer.from_file(P.tokenizer())
    ids = {i: np.array(tok.encode(r.text, add_special_tokens=False).ids + [0], "<u4") for i, r in out.items()}
    assert Counter((p.doc_id, p.length, p.ids_crc32) for p in pieces) == Counter((i, len(x), zlib.crc32(x.tobytes())) for i, x in ids.items())


def test_rows_without_own_ids(spark, tables):
    """Null and repeated doc_ids: rows go one by one."""
    import corpus_pipeline as P
    root, texts = tables
    a, b, c, d, leak = texts[30], texts[31], texts[32], texts[33], texts[300]
    rows = [(None, a), (None, a), (None, b), (None, leak), (7, c), (7, c), (7, d), (7, leak), (8, b), (9, c), (None, ""), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "src", 1, 7, "x") for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, n int, kept string").repartition(4)
    got = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    rest = Counter([(None, ""), (None, None), (None, None)])
    unique = P.near_duplicate_stage(spark, docs, root)
    assert unique.columns == docs.columns
    assert got(unique) == rest + Counter([(None, a), (None, b), (None, leak), (7, c), (7, d)])
    clean = P.decontamination_stage(spark, docs, root)
    assert clean.columns == docs.columns
    assert got(clean) == Counter((i, t) for i, t in rows if t != leak)


def test_run(spark, tables):
    import corpus_pipeline as P
    root, _ = tables
    out = P.run(spark, root)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == set(range(60)) | {500}
    assert P.ORACLE_SQL is None and re.fullmatch("packing", P.STAGES[-1][0])


def test_empty_table(spark, tables, tmp_path):
    import corpus_pipeline as P
    root, _ = tables
    spark.read.parquet(f"{root}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{root}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
