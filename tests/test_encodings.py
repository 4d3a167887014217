"""UTF-16 files over many splits, cuts across characters, broken characters; file digests."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from seamfix.operators.encoding import scan_decoded
from seamfix.operators.repair import source_unchanged
from seamfix.sources.lines import decode_utf16, file_digests

NAME = lambda p: F.regexp_extract(p, r"([^/]+)$", 1)


def wanted(text):
    lines = [ln[:-1] if ln.endswith("\r") else ln for ln in text.split("\n")]
    return [ln for ln in lines if ln.strip()]


@pytest.fixture(params=[None, 4096])
def split_bytes(spark, request):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    if request.param:
        spark.conf.set(key, str(request.param))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set(key, before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_utf16_and_others_in_one_scan(spark, tmp_path, split_bytes):
    """U+0A01 before U+0100 holds the bytes of a line feed across two characters."""
    rng, texts = random.Random(1), {}
    pieces = ["a", "b,c", "ਁĀ", "ਊ਀", "Ā", "\n", "\r\n", "\n\n", "\U0001F600", "é", '"x"', " ", "Ċ\u000a"]
    for name, charset in (("le", "utf-16-le"), ("be", "utf-16-be"), ("le2", "utf-16-le"), ("u8", "utf-8"), ("lat", "iso-8859-1")):
        text = "id,name\n" + "".join(rng.choice(pieces) for _ in range(6000 if name != "le2" else 7))
        if charset == "iso-8859-1":
            text = "id,name\né" + "".join(c for c in text if ord(c) < 128 or c == "é")
        texts[name] = text
        mark = b"" if name in ("u8", "lat", "le2") else "﻿".encode(charset)
        with open(tmp_path / name, "wb") as f:
            f.write(mark + text.encode(charset))
    lines, enc = scan_decoded(spark, str(tmp_path), NAME)
    got = {}
    for r in lines.orderBy("file_id", "line_no").collect():
        got.setdefault(r["file_id"], []).append((r["line_no"], r["raw"], r["n_lines"]))
    for name, text in texts.items():
        want = wanted(text)
        assert (got[name] == [(i, ln, len(want)) for i, ln in enumerate(want, 1)]) is True, name
    encodings = {r["file_id"]: (r["encoding"], r["wrong_encoding"]) for r in enc.collect()}
    assert encodings == {"le": ("utf-16-le", True), "be": ("utf-16-be", True), "le2": ("utf-16-le", True), "u8": ("utf-8", False), "lat": ("iso-8859-1", True)}


@pytest.mark.parametrize("endian", ["le", "be"])
def test_broken_utf16_characters(spark, endian):
    rng = random.Random(2)
    units = [0x41, 0xD83D, 0xDE00, 0x00E9, 0xDC00, 0xD800, 0x0A00]
    data = [b"".join(rng.choice(units).to_bytes(2, "little" if endian == "le" else "big") for _ in range(rng.randrange(0, 9))) + b"x" * (i % 2) for i in range(300)]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(data)], "i long, b binary")
    got = [r["t"] for r in df.select("i", decode_utf16(F.col("b"), endian).alias("t")).orderBy("i").collect()]

    def plain(b):
        out, us, i = "", [int.from_bytes(b[k:k + 2], "little" if endian == "le" else "big") for k in range(0, len(b) // 2 * 2, 2)], 0
        while i < len(us):
            if 0xD800 <= us[i] < 0xDC00 and i + 1 < len(us) and 0xDC00 <= us[i + 1] < 0xE000:
                out += chr(0x10000 + (us[i] - 0xD800) * 1024 + us[i + 1] - 0xDC00)
                i += 1
            else:
                out += "�" if 0xD800 <= us[i] < 0xE000 else chr(us[i])
            i += 1
        return out + ("�" if len(b) % 2 else "")
    assert got == [plain(b) for b in data]


def test_digest_tells_every_change(spark, tmp_path, split_bytes):
    text = b"".join(b"line %d of the file\n" % i for i in range(2000))
    changes = {"same": text, "byte": text.replace(b"line 7 ", b"line 8 ", 1), "order": text[21:] + text[:21], "end": text[:-1],
               "blank": text + b"\n", "cr": text.replace(b"\n", b"\r\n", 1), "bom": b"\xef\xbb\xbf" + text, "raw": text.replace(b"l", b"\xff", 1)}
    digests = {}
    for name, data in changes.items():
        os.makedirs(tmp_path / name)
        (tmp_path / name / "f.csv").write_bytes(data)
        digests[name] = file_digests(spark, str(tmp_path / name)).select(NAME(F.col("file_id")).alias("file_id"), "length", "digest")
    (tmp_path / "first").mkdir()
    (tmp_path / "first" / "f.csv").write_bytes(text)
    first = file_digests(spark, str(tmp_path / "first")).select(NAME(F.col("file_id")).alias("file_id"), "length", "digest")
    for name, after in digests.items():
        assert source_unchanged(first, after).first()["unchanged"] == (name == "same"), name


def test_repaired_lines_stay_in_place(spark, tmp_path):
    """whatever the planner guesses, only row fixes may be merged with the lines; per-file frames are sent to them."""
    from seamfix.plans.catalogue import QUERIES
    docs = spark.range(1600).select(F.col("id").alias("doc_id"), F.concat(F.lit("é, "), F.col("id").cast("string")).alias("text"), F.lit(5).alias("n_chars"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        df = QUERIES["encoding_repaired"](spark, str(tmp_path))
        plan = df._jdf.queryExecution().executedPlan().toString()
        rows = df.collect()
    finally:
        spark.conf.set(key, before)
    assert all("line_no" in keys for keys in re.findall(r"SortMergeJoin \[([^\]]*)\]", plan))
    per = {}
    for r in rows:
        per.setdefault(r["file_id"], []).append(r["line_no"])
    assert sorted(per) == [1, 2, 3, 4, 5, 6, 8, 9, 10, 11]
    assert all(sorted(v) == list(range(1, 130)) for v in per.values()) and all(r["verified"] for r in rows)
