"""Encoding evidence per file (D1, D2, D13) and decoding (R1), all native.

``scan_decoded`` reads files of mixed encodings as numbered lines, UTF-16 among them.
``text_encoding`` takes its evidence from the splits of a text scan (per-line
tests, combined per file), so a file of any size spreads over its splits;
``encoding_evidence`` judges contents that are given whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamfix.functions.codecs import codec_class
from seamfix.plans.joins import sized_broadcast
from seamfix.session import cut_lineage
from seamfix.sources.lines import scan_lines, scan_utf16

# --- fixed values (confidence per rule) ---------------------------------
CONF_BOM = 1.0
CONF_UTF8 = 1.0
CONF_C1 = 0.9
CONF_LATIN1 = 0.5

# A byte-aligned position in a hex string: an even number of hex digits.
_ALIGNED = "^(?:..)*?"


def encoding_evidence(files: DataFrame) -> DataFrame:
    """``files(file_id, content binary)`` -> encoding guess, confidence and
    ``wrong_encoding`` (D1: bytes are not valid UTF-8).

    Rules in order: a BOM; a NUL byte (UTF-16 without BOM); valid UTF-8;
    any byte 0x80-0x9F (cp1252); else ISO-8859-1. Confidence is fixed per
    rule (no statistical detector)."""
    hx = F.hex("content")
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    guess = F.when(F.substring(hx, 1, 6) == "EFBBBF", "utf-8-sig") \
        .when(F.substring(hx, 1, 4) == "FFFE", "utf-16-le") \
        .when(F.substring(hx, 1, 4) == "FEFF", "utf-16-be") \
        .when(hx.rlike(_ALIGNED + "00"), "utf-16") \
        .when(valid, "utf-8") \
        .when(hx.rlike(_ALIGNED + "[89][0-9A-F]"), "cp1252") \
        .otherwise("iso-8859-1")
    conf = F.when(guess.isin("utf-8-sig", "utf-16-le", "utf-16-be"), CONF_BOM) \
        .when(guess == "utf-8", CONF_UTF8).when(guess == "cp1252", CONF_C1).otherwise(CONF_LATIN1)
    return files.select("file_id", guess.alias("encoding"), conf.alias("confidence"), (~valid).alias("wrong_encoding"))


def path_encodings(spark: SparkSession, paths: list[str] | str,
                   file_expr: Callable[[Column], Column] | None = None) -> DataFrame:
    """(file_id, path, bom, utf16, valid, c1, nul): the evidence of each file, by one
    aggregate over a text scan.

    The line reader drops a UTF-8 BOM without a word, so it is inferred from sizes: a file
    is its lines, their line feeds (the last may lack one) and what the reader dropped.
    ``utf16`` is le or be by the BOM, or by the place of the NUL in the first character."""
    scan = spark.read.option("lineSep", "\n").text(paths)
    path = F.col("_metadata.file_path")
    hx, valid = F.hex(F.col("value").cast("binary")), F.is_valid_utf8("value")
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    rows = scan.select((file_expr(path) if file_expr else path).alias("file_id"), path.alias("path"), place.alias("_place"),
                       F.hex(F.substring(F.col("value").cast("binary"), 1, 4)).alias("_head"),
                       F.col("_metadata.file_size").alias("_size"), F.octet_length("value").alias("_n"), valid.alias("_valid"),
                       F.when(valid, F.lit(False)).otherwise(hx.rlike(_ALIGNED + "[89][0-9A-F]")).alias("_c1"),
                       (F.instr("value", "\0") > 0).alias("_nul"))
    per = rows.groupBy("file_id", "path").agg(
        (F.max("_size") - F.sum("_n") - F.count(F.lit(1)) >= 2).alias("bom"), F.min_by("_head", "_place").alias("_head"),
        F.bool_and("_valid").alias("valid"), F.bool_or("_c1").alias("c1"), F.bool_or("_nul").alias("nul"))
    utf16 = F.when(F.col("_head").startswith("FFFE"), "le").when(F.col("_head").startswith("FEFF"), "be") \
        .when(F.col("nul") & F.col("_head").rlike("^(?!00)..00"), "le").when(F.col("nul") & F.col("_head").startswith("00"), "be")
    return per.select("file_id", "path", "bom", utf16.alias("utf16"), "valid", "c1", "nul")


def text_encoding(spark: SparkSession, paths: list[str] | str,
                  file_expr: Callable[[Column], Column] | None = None, by_path: DataFrame | None = None) -> DataFrame:
    """(file_id, encoding, confidence, wrong_encoding, bom_utf8) of text files, from the
    evidence of their paths (``path_encodings``)."""
    by_path = by_path if by_path is not None else path_encodings(spark, paths, file_expr)
    per = by_path.groupBy("file_id").agg(F.bool_or("bom").alias("bom_utf8"), F.bool_and("valid").alias("valid"), F.bool_or("c1").alias("c1"),
                                         F.bool_or("nul").alias("nul"), F.min("utf16").alias("utf16"))
    guess = F.when(F.col("bom_utf8"), "utf-8-sig").when(F.col("utf16").isNotNull(), F.concat(F.lit("utf-16-"), "utf16")) \
        .when(F.col("nul"), "utf-16").when(F.col("valid"), "utf-8").when(F.col("c1"), "cp1252").otherwise("iso-8859-1")
    conf = F.when(F.col("bom_utf8") | F.col("utf16").isNotNull(), CONF_BOM).when(guess == "utf-8", CONF_UTF8).when(guess == "cp1252", CONF_C1) \
        .otherwise(CONF_LATIN1)
    wrong = ~F.col("valid") | F.col("nul") | F.col("utf16").isNotNull()
    return per.select("file_id", guess.alias("encoding"), conf.alias("confidence"), wrong.alias("wrong_encoding"), "bom_utf8")


def scan_decoded(spark: SparkSession, paths: list[str] | str,
                 file_expr: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(lines, encodings): numbered non-blank lines (S1) of files in any of the encodings,
    decoded, and the encoding of each file. Evidence is written once; no file is one row."""
    by_path = cut_lineage(path_encodings(spark, paths, file_expr), "path-encodings")
    encodings = text_encoding(spark, paths, by_path=by_path)
    bound = by_path.count()  # paths, not less than files
    # The paths of UTF-16 files, no more than the scan's own file listing holds.
    wide = {r["path"]: r["utf16"] for r in by_path.filter("utf16 is not null and not bom").select("path", "utf16").collect()}
    if not wide:
        return decode_lines(scan_lines(spark, paths, file_expr=file_expr), encodings, bound), encodings
    narrow = [r["path"] for r in by_path.filter("utf16 is null or bom").select("path").collect()]
    parts = [scan_utf16(spark, [p for p, e in wide.items() if e == end], end, file_expr=file_expr) for end in sorted(set(wide.values()))]
    if narrow:
        parts.append(decode_lines(scan_lines(spark, narrow, file_expr=file_expr), encodings, bound))
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part)
    return lines, encodings


def _cp1252_signs() -> tuple[str, str]:
    """The C1 controls that cp1252 uses and the characters it gives them."""
    pairs = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
    return "".join(c for c, s in pairs if s), "".join(s for _, s in pairs if s)


def decode_lines(lines: DataFrame, encodings: DataFrame, file_bound: int | None = None) -> DataFrame:
    """Lines with ``raw`` decoded where the file's encoding is a single-byte one
    (``encodings``: file_id, encoding, one row per file, at most ``file_bound``; UTF-16 is
    decoded by the scan)."""
    latin = F.decode(F.col("raw").cast("binary"), "ISO-8859-1")
    text = F.when(F.col("_enc") == "iso8859-1", latin) \
        .when(F.col("_enc") == "cp1252", F.translate(latin, *_cp1252_signs())).otherwise(F.col("raw"))
    # Supplied encodings come under any alias (latin-1, L1, windows-1252, ...).
    classes = encodings.select("file_id", codec_class(F.col("encoding")).alias("_enc"))
    joined = lines.join(sized_broadcast(classes, file_bound), "file_id", "left")
    return joined.withColumn("raw", text).drop("_enc")
