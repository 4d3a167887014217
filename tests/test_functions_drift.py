"""Scalar functions (F1-F11), similarity parity and drift fixtures."""

import difflib
import random

from pyspark.sql import functions as F

from seamfix.functions import text as T
from seamfix.operators import drift as C
from seamfix.operators.encoding import encoding_evidence


def _py_float(s):
    try:
        float(s)
        return True
    except ValueError:
        return False


def _py_int(s):
    try:
        int(s)
        return True
    except ValueError:
        return False


def test_number_grammar_matches_python(spark):
    random.seed(7)
    alphabet = "0123456789_.eE+- infa"
    samples = ["1_000", "1e5", " 30 ", "nan", "-inf", "Infinity", ".5", "5.", "1__0", "_1", "1_", "e5", "+.5e-3", ""]
    samples += ["".join(random.choice(alphabet) for _ in range(random.randint(1, 7))) for _ in range(3000)]
    df = spark.createDataFrame([(s,) for s in samples], "v string")
    got = {r["v"]: (r["f"], r["i"]) for r in
           df.select("v", T.parses_float(F.col("v")).alias("f"), T.parses_int(F.col("v")).alias("i")).collect()}
    bad = [s for s in samples if got[s] != (_py_float(s), _py_int(s))]
    assert not bad, bad[:10]


def test_csv_join_and_candidates(spark):
    df = spark.createDataFrame([(["a", "b,c", 'q"x', ""], "a;b|c-d_e@f.g h")], "f array<string>, s string")
    r = df.select(T.csv_join(F.col("f"), F.lit(",")).alias("j"), T.stray_candidates(F.col("s"), F.lit(",")).alias("c")).first()
    assert r["j"] == 'a,"b,c","q""x",'
    assert r["c"] == [";", "|"]


def test_wasbs_uri(spark):
    df = spark.createDataFrame([("https://acct.blob.core.windows.net/container/dir/file.csv?sig=x",)], "u string")
    assert df.select(T.wasbs_uri(F.col("u"))).first()[0] == "wasbs://container@acct.blob.core.windows.net/dir/file.csv"


def test_similarity_samples_match_difflib(spark):
    pairs = [("name", "customer_name"), ("name", "full_name"), ("age", "age_years"), ("city", "home_city"),
             ("name", "fullname"), ("name", "candidate_name"), ("age", "name")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(C.ratio_udf("a", "b")).collect()]
    assert [round(x, 4) for x in got] == [round(difflib.SequenceMatcher(None, a, b).ratio(), 4) for a, b in pairs]


def _drift(spark, current_cols, base_cols):
    cur = spark.createDataFrame([("t", i + 1, n, ty, True) for i, (n, ty) in enumerate(current_cols)],
                                "table string, ordinal long, name string, type string, nullable boolean")
    base = spark.createDataFrame([("t", 1, i + 1, n, ty, True) for i, (n, ty) in enumerate(base_cols)],
                                 "table string, version int, ordinal long, name string, type string, nullable boolean")
    return C.column_diff(cur, C.latest_baselines(base))


def test_multi_rename_hints(spark):
    diff = _drift(spark, [("id", "int64"), ("full_name", "string"), ("age_years", "int64"), ("home_city", "string")],
                  [("id", "int64"), ("name", "string"), ("age", "int64"), ("city", "string")])
    hints = {(r["removed_column"], r["added_column"]): round(r["similarity"], 4)
             for r in C.rename_hints(C.rename_candidates(diff)).collect()}
    assert hints == {("name", "full_name"): 0.6154, ("age", "age_years"): 0.5, ("city", "home_city"): 0.6154}


def test_operations_and_order(spark):
    diff = _drift(spark, [("id", "int64"), ("name", "string")], [("id", "int64"), ("name", "string"), ("age", "int64")])
    renames = spark.createDataFrame([], "table string, removed_column string, added_column string, similarity double, "
                                        "llm_confidence double, confidence double")
    ops = C.operations(diff, renames).collect()
    assert [(o["op"], o["column"], o["target_type"], o["default"]) for o in ops] == [("add_default", "age", "int64", "0")]
    diff2 = _drift(spark, [("id", "int64"), ("name", "string"), ("age", "int64"), ("country", "string")],
                   [("id", "int64"), ("name", "string"), ("age", "int64")])
    ops2 = C.operations(diff2, renames).collect()
    assert [(o["op"], o["column"]) for o in ops2] == [("drop", "country")]


def test_encoding_evidence(spark):
    rows = [(1, "id,name\n1,café".encode("utf-8")), (2, "id,name\n1,café".encode("latin-1")),
            (3, "\ufeffid,name".encode("utf-8")), (4, "x\u201cy".encode("cp1252"))]
    df = spark.createDataFrame(rows, "file_id long, content binary")
    got = {r["file_id"]: (r["encoding"], r["wrong_encoding"]) for r in encoding_evidence(df).collect()}
    assert got == {1: ("utf-8", False), 2: ("iso-8859-1", True), 3: ("utf-8-sig", False), 4: ("cp1252", True)}


def test_split_fields_literal_for_every_delimiter(spark):
    """splitting on any single character (regex metacharacters included,
    per-row or literal delimiter) equals a literal split, trailing empty
    fields kept."""
    delims = list(T.REGEX_META) + [",", ";", "\t", ":", " ", "#", "]", "}", "-", "a", "7", "é"]
    rnd = random.Random(11)
    rows = []
    for d in delims:
        for _ in range(20):
            parts = ["".join(rnd.choice("ab.$|()[{^?*+\\,;:#]}-7 é") for _ in range(rnd.randint(0, 4)))
                     for _ in range(rnd.randint(1, 5))]
            rows.append((d, d.join(parts)))
    df = spark.createDataFrame(rows, "d string, raw string")
    got = df.select("d", "raw", T.split_fields(F.col("raw"), F.col("d")).alias("f")).collect()
    assert all(r["f"] == r["raw"].split(r["d"]) for r in got)
    for d in ("|", ".", "\\", ","):
        lit = df.filter(F.col("d") == d).select("raw", T.split_fields(F.col("raw"), d).alias("f")).collect()
        assert all(r["f"] == r["raw"].split(d) for r in lit)
