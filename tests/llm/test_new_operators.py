"""Operators 11 to 13 against plain versions, on hard rows and small texts."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamfix.llm import bpe, divergence, infill, queries


# ------------------------------------------------------------------ operator 11
def plain_infill(doc_id, text, words=False):
    text = text or ""
    k = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(k[i:i + 8], 16) for i in range(0, 32, 8)]
    units = re.findall(r"^[ \t-\r]*[^ \t-\r]*[ \t-\r]*|[^ \t-\r]+[ \t-\r]*", text) if words and text else list(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted(x % (n + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", ["code_point", "word"])
def test_infill(spark, hard_docs, unit):
    got = infill.fill_in_middle(hard_docs, unit).withColumn("back", infill.restored(F.col("output"), F.col("form")))
    docs = [(r["doc_id"], r["text"]) for r in hard_docs.select("doc_id", "text").collect()]
    rows = [tuple(r) for r in got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "back").collect()]
    want = [(d, *plain_infill(d, t, unit == "word"), t or "") for d, t in docs]
    assert sorted(rows, key=str) == sorted(want, key=str)
    assert {r[2] for r in rows} == {"plain", "psm", "spm"}


def test_infill_marks_and_empty_table(spark, no_docs):
    texts = ["a <P> b", "<S>", "x<M>", "<P", "<<S", "", "<", "é<P>"] * 30
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = infill.fill_in_middle(df).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_infill(r["doc_id"], texts[r["doc_id"]])
        assert r["back"] == texts[r["doc_id"]]
    assert infill.fill_in_middle(no_docs).count() == 0


@pytest.mark.parametrize("unit", ["code_point", "word"])
def test_tree_finds_every_cut(unit):
    rng = random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice(["a", "é", "中", "😀", " ", "\n", "bc"]) for _ in range(rng.randrange(0, 80)))
        counts = infill.BlockCounts(text.encode(), unit, size=rng.choice([1, 2, 3, 7, 16]))
        if unit == "word":
            units = re.findall(r"^[ \t-\r]*[^ \t-\r]*[ \t-\r]*|[^ \t-\r]+[ \t-\r]*", text) if text else []
        else:
            units = list(text)
        assert counts.total == (len(units), len(text))
        for k in range(len(units) + 1):
            head = "".join(units[:k])
            assert counts.cut(k) == (len(head.encode()), len(head))


# ------------------------------------------------------------------ operator 12
def plain_divergence(docs, min_docs, top):
    docs = [(g or "", s or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))) for t, g, s in docs]
    seen = Counter((g, w) for g, _, ws in docs for w in set(ws))
    kept = {}
    for (g, w), n in seen.items():
        if n >= min_docs:
            kept.setdefault(g, []).append(w)
    counts = Counter((g, s, w) for g, s, ws in docs for w in ws)
    groups = sorted({(g, s) for g, s, _ in docs})
    totals = {(g, s): sum(counts[g, s, w] for w in kept.get(g, [])) for g, s in groups}
    share = lambda n, total, v: 1 + 10**9 * (n + 5) // (total + 5 * v)
    out = []
    for g, s in groups:
        terms = kept.get(g, [])
        v = len(terms)
        of = lambda x: {w: share(counts[g, x, w], totals[g, x], v) for w in terms}
        mine = of(s)
        pairs = [(o, sum(abs(mine[w] - p) for w, p in of(o).items())) for gg, o in groups if gg == g and o != s]
        whole = sum(t for (gg, _), t in totals.items() if gg == g)
        alls = {w: share(sum(counts[g, o, w] for gg, o in groups if gg == g), whole, v) for w in terms}
        over = [(w, mine[w] - alls[w]) for w in terms if counts[g, s, w] and mine[w] > alls[w]]
        for part, items, most in (("pair", pairs, None), ("term", over, top)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(g, s, part, w, f, i) for i, (w, f) in enumerate(items[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("held,block,pairs", [(1 << 20, 4096, 1 << 20), (40, 3, 4)])
def test_divergence(spark, held, block, pairs, monkeypatch):
    """Also with runs of 40 postings, blocks of 3 and pair sums of 4 (functions go by value)."""
    rng = random.Random(held)
    words = ["Ab", "cd", "É", "zoo", "x1y", "don't", "q"] + ["w" + chr(97 + i) for i in range(20)]
    sources = ["s%d" % i for i in range(9)] + [None, ""]
    docs = [(" ".join(rng.choice(words[:rng.randrange(3, len(words))]) for _ in range(rng.randrange(0, 30))), rng.choice(["en", "fr", None]), rng.choice(sources))
            for _ in range(260)]
    docs += [(None, "en", "s1"), ("", "xx", "lonely"), ("...", "xx", "other"), ("zoo " * 5000, "en", "s0")] + [("same words here", "en", "s0")] * 80
    monkeypatch.setattr(divergence, "BLOCK_ROWS", block)
    monkeypatch.setattr(divergence, "PAIRS_HELD", pairs)
    monkeypatch.setattr(divergence, "MERGE_ROWS", block)
    df = spark.createDataFrame([(i, *d, 1, 2, "y") for i, d in enumerate(docs)],
                               "doc_id long, text string, lang string, source string, n long, p long, item string").repartition(6)
    got = divergence.divergence(df, min_docs=12, top_terms=6, shards=5, held=held)
    rows = sorted(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect())
    assert rows == plain_divergence(docs, 12, 6)
    assert {r[0] for r in rows} == {"", "en", "fr", "xx"}


def test_divergence_of_empty_tables(spark, no_docs):
    assert divergence.divergence(no_docs).count() == 0


# ------------------------------------------------------------------ operator 13
@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(queries.bpe_tokenizer())


@pytest.fixture(scope="module")
def model():
    return bpe.Model(queries.bpe_tokenizer())


PIECES = ["a", "th", "the", " ", "  ", "\n", "\t", "'", "'l", "'re", "1", "23", "é", "中", "<|endoftext|>", "<|endo", "<|", "!", "?!", " ", "\x1c",
          "\x85", " ", "aa", "\U0001F600", "--", "====", "՘", "\U0003fc3b", "࢏", "s", "ll", "é"]


def test_encoder_equals_the_library(library, model, monkeypatch):
    """Blocks of one character to whole texts, long words in parts, special tokens cut by borders."""
    encoder, decoder, rng = bpe.Encoder(model, bpe.Classes(queries.bpe_tokenizer())), bpe.Decoder(model), random.Random(4)
    for i in range(1500):
        monkeypatch.setattr(bpe, "LONG", rng.choice([2, 5, 50, 4096]))
        monkeypatch.setattr(bpe, "BLOCK_CHARS", rng.choice([1, 2, 3, 7, 64, 1000]))
        if i % 5:
            text = "".join(rng.choice(PIECES) * rng.choice([1, 1, 1, 2, 30]) for _ in range(rng.randrange(0, 25)))
        else:  # long words of few characters: deep chains of merges
            signs = rng.choice(["ab", "abc", "etaoinshr", "-=", "a", " \n", "the"])
            text = "".join(rng.choice(signs) for _ in range(rng.randrange(1, 3000)))
        ids = np.frombuffer(encoder.whole(text), "<u4").tolist()
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == want, (i, text[:60])
        assert decoder.whole(bpe.as_bytes(ids)) == library.decode(want, skip_special_tokens=False) == text


def test_window_is_bounded(model):
    """A word of a million letters: no more than a window of it is held."""
    encoder, most = bpe.Encoder(model, bpe.Classes(queries.bpe_tokenizer())), 0
    rng = random.Random(5)
    for _ in range(250):
        encoder.feed("".join(rng.choice("etaoin") for _ in range(4000)))
        most = max(most, len(encoder.window) + len(encoder.rest))
    encoder.finish()
    assert most <= model.window + bpe.LONG + 4000


def test_lookahead_of_small_lists():
    """The bound holds for every text of small merge lists, by trying all of them."""
    import itertools
    for rules in (["a b", "b c", "ab c"], ["c d", "b c", "a b"], ["a a", "aa a", "b a", "aa b"], ["d e", "c d", "b c", "a b"]):
        pairs = [tuple(x.encode() for x in r.split()) for r in rules]
        far = bpe.lookahead(pairs)

        def encode(text):
            parts = [bytes([c]) for c in text]
            for u, v in pairs:
                i = 0
                while i + 1 < len(parts):
                    if (parts[i], parts[i + 1]) == (u, v):
                        parts[i:i + 2] = [u + v]
                    i += 1
            ends = list(itertools.accumulate(map(len, parts)))
            return ends
        letters = sorted({c for u, v in pairs for c in u + v})
        for n in range(1, 8 if len(letters) < 4 else 6):
            for text in itertools.product(letters, repeat=n):
                whole = encode(bytes(text))
                for cut in range(1, n):
                    stable = [e for e in encode(bytes(text[:cut])) if e <= cut - far]
                    assert whole[:len(stable)] == stable


def test_decoder_on_any_ids(library, model):
    """Broken characters and ids of no token."""
    decoder, rng = bpe.Decoder(model), random.Random(6)
    for _ in range(300):
        ids = [rng.choice([rng.randrange(256), rng.randrange(50257)]) for _ in range(rng.randrange(0, 40))]
        data = bpe.as_bytes(ids)
        parts = "".join(decoder.feed(data[i:i + 4]) for i in range(0, len(data), 4)) + decoder.finish()
        assert parts == library.decode(ids, skip_special_tokens=False)
    assert decoder.whole(bpe.as_bytes([2**31])) == ""


def test_coding_query(spark, library, hard_docs, no_docs):
    rows = bpe.bpe_decode(bpe.bpe_encode(hard_docs, queries.bpe_tokenizer()), queries.bpe_tokenizer()).collect()
    docs = hard_docs.select("doc_id", "text").collect()
    want = [(d["doc_id"], library.encode(d["text"] or "", add_special_tokens=False).ids, d["text"] or "") for d in docs]
    got = [(r["doc_id"], np.frombuffer(bytes(r["ids"]), "<u4").tolist(), r["decoded"]) for r in rows]
    assert (sorted(got, key=str) == sorted(want, key=str)) is True
    assert all(r["n_tokens"] == len(r["ids"]) // 4 for r in rows)
    assert bpe.bpe_encode(no_docs, queries.bpe_tokenizer()).count() == 0
