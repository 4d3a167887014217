"""Encoding end to end, drift without a baseline, exact casts, approvals bound to the
repaired texts, order statistics and streams that lose nothing."""

import os
import random
import shutil
import statistics

import pytest

from seamfix.operators import drift as C
from seamfix.operators import propose as P
from seamfix.operators.encoding import decode_lines, text_encoding
from seamfix.operators.observe import latency_summary
from seamfix.functions import text as T
from seamfix.plans import catalogue as Q
from seamfix.sources.lines import scan_lines
from seamfix.streaming import streams as S

NAME = "Jyväskylä;Ñandú;7"
FILES = {
    "utf8.csv": ("a;b;c\n" + NAME + "\n").encode(),
    "latin.csv": ("a;b;c\n" + NAME + "\n").encode("latin-1"),
    "cp.csv": ("a;b;c\n“" + NAME + "” €").encode("cp1252"),
    "bom.csv": b"\xef\xbb\xbf" + ("a;b;c\n" + NAME).encode(),
    "bom_crlf.csv": b"\xef\xbb\xbf" + b"a;b\r\n\r\n1;2\r\n",
    "ascii.csv": b"a;b\n\n1;2",
    "wide.csv": "a;b\n1;2\n".encode("utf-16"),
}


@pytest.fixture(scope="module")
def byte_files(tmp_path_factory):
    root = tmp_path_factory.mktemp("bytes")
    for name, data in FILES.items():
        (root / name).write_bytes(data)
    return str(root)


def name_of(path):
    from pyspark.sql import functions as F
    return F.regexp_extract(path, "([^/]+)$", 1)


def test_encoding_evidence_and_decoding(spark, byte_files):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16")  # several splits a file
    try:
        enc = text_encoding(spark, byte_files, name_of)
        got = {r.file_id: (r.encoding, r.wrong_encoding, r.bom_utf8) for r in enc.collect()}
        assert got == {"utf8.csv": ("utf-8", False, False), "latin.csv": ("iso-8859-1", True, False), "cp.csv": ("cp1252", True, False),
                       "bom.csv": ("utf-8-sig", False, True), "bom_crlf.csv": ("utf-8-sig", False, True),
                       "ascii.csv": ("utf-8", False, False), "wide.csv": ("utf-16-le", True, False)}
        lines = decode_lines(scan_lines(spark, byte_files, file_expr=name_of), enc)
        text = {(r.file_id, r.line_no): r.raw for r in lines.filter("file_id <> 'wide.csv'").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert text["latin.csv", 2] == text["utf8.csv", 2] == text["bom.csv", 2] == NAME
    assert text["cp.csv", 2] == "“" + NAME + "” €"
    assert text["bom_crlf.csv", 2] == "1;2"


def test_latin_and_bom_files_are_not_healthy(spark, byte_files):
    from seamfix.operators.detect import detect
    paths = [os.path.join(byte_files, n) for n in ("utf8.csv", "latin.csv", "bom.csv")]
    enc = text_encoding(spark, paths, name_of)
    d = detect(decode_lines(scan_lines(spark, paths, file_expr=name_of), enc), 3, enc, enc)
    got = {r.file_id: list(r.failure_classes) for r in d["classes"].collect()}
    assert got == {"utf8.csv": ["wrong_delimiter"], "latin.csv": ["wrong_delimiter", "wrong_encoding"],
                   "bom.csv": ["invisible_characters", "wrong_delimiter"]}


def test_no_baseline_gives_no_operations(spark):
    cols = "table string, ordinal long, name string, type string, nullable boolean"
    cur = spark.createDataFrame([("known", 1, "x", "int64", False), ("new", 1, "y", "string", True)], cols)
    base = spark.createDataFrame([("known", 1, "x", "int64", False), ("gone", 1, "z", "string", True)], cols)
    assert C.column_diff(cur, base).count() == 0
    assert [r.table for r in C.without_baseline(cur, base).collect()] == ["new"]


def test_exact_integer_casts(spark):
    values = ["9007199254740993", "-9223372036854775808", "12.0", "1e3", "1_000", "12.5", "1e-30", "x", None, "9223372036854775808"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(C._cast_expr("v", "int64")).collect()]
    assert got == [9007199254740993, -9223372036854775808, 12, 1000, 1000, None, None, None, None, None]


def test_apply_all_operations(spark):
    df = spark.createDataFrame([("1", "a", 9.0, "t"), ("2", "b", 8.0, "u")], "n string, old string, extra double, keep string")
    ops = [{"op": "rename", "column": "old", "target_column": "new", "target_type": None, "default": None},
           {"op": "cast", "column": "n", "target_column": None, "target_type": "int64", "default": None},
           {"op": "drop", "column": "extra", "target_column": None, "target_type": None, "default": None},
           {"op": "add_default", "column": "more", "target_column": None, "target_type": "int64", "default": "0"}]
    out, errors, _ = C.apply_operations(df, ops)
    assert not errors and C.cast_failures(df, ops) == {"n": 0}
    assert [tuple(r) for r in out.select("n", "new", "keep", "more").collect()] == [(1, "a", "t", 0), (2, "b", "u", 0)]


def test_rename_hints_match_ordered_choice(spark):
    rng = random.Random(4)
    rows = [(t, f"r{i}", f"a{j}", rng.choice([0.4, 0.5, 0.6, 0.9])) for t in ("p", "q") for i in range(7) for j in range(6) if rng.random() < 0.6]
    df = spark.createDataFrame(rows, "table string, removed_column string, added_column string, similarity double")
    want, used = set(), set()
    for t, r, a, s in sorted(rows, key=lambda x: (x[0], -x[3], x[1], x[2])):
        if not used & {(t, r), (t, a)}:
            used |= {(t, r), (t, a)}
            want.add((t, r, a, s))
    assert {tuple(x) for x in C.rename_hints(df).collect()} == want
    assert C.rename_hints(df.limit(0)).count() == 0


def test_approval_is_bound_to_the_repaired_texts(spark):
    params = spark.createDataFrame([(1, ",", "utf-8", 0, "python", 1)],
                                   "file_id long, delimiter string, encoding string, header_row long, engine string, n_row_repairs long")
    fix = lambda text: spark.createDataFrame([(1, 3, text)], "file_id long, row_number long, repaired_text string")
    h = [P.prescription_hash(params, f).first().prescription_hash for f in (fix("a,b"), fix("a,c"), fix("a,b"))]
    assert h[0] == h[2] != h[1]


def test_p95_rank_is_half_even(spark):
    rows = [("n", float(v)) for v in range(31)] + [("one", 5.0)] + [("hot", float(v % 3) if v else 1e9) for v in range(3001)]
    df = spark.createDataFrame(rows, "node string, latency_ms double")
    got = {r.node: r.p95 for r in latency_summary(df).collect()}
    for node in ("n", "one", "hot"):
        v = sorted(x for k, x in rows if k == node)
        assert got[node] == v[round(0.95 * (len(v) - 1))]
    assert abs({r.node: r["mean"] for r in latency_summary(df).collect()}["n"] - statistics.mean(range(31))) < 1e-4


@pytest.mark.parametrize("text,ok", [
    ("2026-01-01", True), ("20260101", True), ("2026-01-01T23:59:59.5Z", True), ("2026-01-01 10:20+02:00", True), ("20260101T102030", True),
    ("2026-01-01T99:99", False), ("2026-02-30", False), ("2026-1-1", False), ("today", False), ("20261301", False), ("2026-01-01T", False)])
def test_iso_datetime(spark, text, ok):
    df = spark.createDataFrame([(text,)], "v string")
    assert df.select(T.parses_iso_datetime(df.v)).first()[0] is ok


def write(folder, name, text, age=0):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        f.write(text)
    if age:
        old = os.path.getmtime(path) - age
        os.utime(path, (old, old))


def test_stream_volume_over_batches_and_restart(spark, tmp_path):
    src, state = str(tmp_path / "in"), str(tmp_path / "state")
    line = '{"event": "repair_completed", "trace_id": "%s", "timestamp": "2026-01-0%dT%02d:00:00.000000"}\n'
    write(src, "a.json", line % ("t1", 1, 1) + line % ("t2", 1, 2))
    S.stream_volume(spark, src, state=state)
    write(src, "b.json", line % ("t9", 2, 9))
    S.stream_volume(spark, src, state=state)
    write(src, "c.json", line % ("t3", 1, 3) + line % ("t1", 1, 4))  # the day before, late, one trace again
    got = {r.day: r.n_traces for r in S.stream_volume(spark, src, state=state).collect()}
    assert got == {"2026-01-01": 3, "2026-01-02": 1}


def test_stream_once_takes_old_files_and_survives_a_restart(spark, tmp_path):
    src, state = str(tmp_path / "in"), str(tmp_path / "state")
    write(src, "new.txt", "x")
    assert S.stream_once(spark, src, state=state).count() == 1
    write(src, "old.txt", "y", age=40 * 86400)
    assert sorted(os.path.basename(r.path) for r in S.stream_once(spark, src, state=state).collect()) == ["new.txt", "old.txt"]
    shutil.rmtree(os.path.join(state, "checkpoint"))  # the listing delivers all files once more
    assert S.stream_once(spark, src, state=state).count() == 2


def test_stream_batches_equal_batch_on_any_path(spark, tmp_path):
    src = str(tmp_path / "any place")
    for i in range(3):
        write(src, f"f{i}.csv", "p;q\n" + "\n".join(f"{i};{k}" for k in range(5)) + "\n\n")
    fn = lambda lines: lines.select("file_id", "line_no", "raw")
    got = S.for_each_file_batch(spark, src, fn, "any", max_files=1)
    assert {r.epoch for r in spark.read.parquet(got.inputFiles()[0].rsplit("/epoch=", 1)[0]).select("epoch").distinct().collect()} == {0, 1, 2}
    want = scan_lines(spark, src, file_expr=name_of)
    rows = lambda df: sorted((os.path.basename(r.file_id), r.line_no, r.raw) for r in df.collect())
    assert rows(got) == rows(want.select("file_id", "line_no", "raw"))


def test_encoded_queries_match_oracle(spark):
    import duckdb
    from seamfix.plans import oracle
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    for name in ("encoding_classes", "encoding_repaired", "publish_uri"):
        con = duckdb.connect()
        for t in ("documents", "pages", "orders"):
            con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
        want = con.execute(oracle.all_oracles()[name]).fetchall()
        cols = [d[0] for d in con.description]
        assert sorted(map(str, want)) == sorted(str(tuple(x)) for x in Q.QUERIES[name](spark, sf).select(*cols).collect())
