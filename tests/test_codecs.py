"""Codec names: every alias of the registry, signs and case, and decoding under an alias."""

import codecs
import encodings.aliases

from pyspark.sql import functions as F

from seamfix.functions.codecs import codec_class, same_codec
from seamfix.operators.encoding import decode_lines


def known(name):
    try:
        return codecs.lookup(name).name
    except LookupError:
        return None


def test_all_aliases(spark):
    names = sorted(set(encodings.aliases.aliases) | set(encodings.aliases.aliases.values()))
    spelled = [v for n in names for v in (n, n.upper(), n.replace("_", "-"), f" {n.replace('_', ' ')} ")] + ["utf-8-sig", "nothing", "", None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(spelled)], "i long, name string")
    got = [r["c"] for r in df.select("i", codec_class(F.col("name")).alias("c")).orderBy("i").collect()]
    want = [known(names[i // 4]) for i in range(4 * len(names))] + ["utf-8-sig", None, None, None]
    assert got == want
    pairs = spark.createDataFrame([("latin-1", "L1", True), ("utf8", "U8", True), ("cp1252", "latin1", False), ("x", "x", False)], "a string, b string, same boolean")
    assert pairs.filter(same_codec(F.col("a"), F.col("b")) != F.col("same")).count() == 0


def test_lines_decode_under_an_alias(spark):
    lines = spark.createDataFrame([(1, 1, bytearray("é€".encode("cp1252"))), (2, 1, bytearray("é".encode("latin-1"))), (3, 1, bytearray("é".encode()))],
                                  "file_id long, line_no long, b binary").select("file_id", "line_no", F.col("b").cast("string").alias("raw"))
    enc = spark.createDataFrame([(1, "Windows-1252"), (2, "L1"), (3, "UTF8")], "file_id long, encoding string")
    assert {r["file_id"]: r["raw"] for r in decode_lines(lines, enc).collect()} == {1: "é€", 2: "é", 3: "é"}
