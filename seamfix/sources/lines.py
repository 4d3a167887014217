"""Line and byte sources.

``scan_lines`` reads delimited text files as numbered non-blank lines
without moving them: the text source gives ``_metadata.file_path`` and
``file_block_start``; lines are numbered by block counts plus prefix sums
(``seamfix.plans.numbering.number_scanned_lines``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seamfix import constants as K
from seamfix.functions import text as T
from seamfix.plans.numbering import block_offsets, number_scanned_lines
from seamfix.session import cut_lineage


def scan_lines(spark: SparkSession, paths: list[str] | str, file_col: str = "file_id",
               file_expr=None) -> DataFrame:
    """``lines(file_id, line_no, raw, n_lines, valid_utf8)`` of text files.

    ``file_expr`` maps the scanned file path to the logical file id (default:
    the path). Several part files of one logical file are ordered by path,
    then by block start, then by position in the block.
    """
    if isinstance(paths, str):
        paths = [paths]
    scan = spark.read.option("lineSep", "\n").text(paths)  # listed once, used for both below
    df = scan.select(
        F.col("value").alias("raw"),
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_block_start"),
    )
    fid = file_expr(F.col("_path")) if file_expr is not None else F.col("_path")
    df = df.select(
        fid.alias(file_col),
        # strip a trailing CR of CR LF files; keep the rest verbatim
        T.strip_cr(F.col("raw")).alias("raw"),
        F.concat(F.col("_path"), F.lit("#"), F.lpad(F.col("_block_start").cast("string"), 20, "0")).alias("_block"),
    ).filter(~T.is_blank(F.col("raw")))
    # One statistics row per file split. A split is a whole small file or a
    # piece of a large one; the pieces of a large file fill scan partitions
    # of their own, so splits <= listed files + scan partitions (both known
    # from planning the scan, no job runs).
    split_bound = len(scan.inputFiles()) + scan.rdd.getNumPartitions()
    out = number_scanned_lines(df, file_col, "_block", split_bound)
    return out.withColumn("valid_utf8", F.is_valid_utf8(F.col("raw")))


def scan_utf16(spark: SparkSession, paths: list[str], endian: str, file_col: str = "file_id", file_expr=None) -> DataFrame:
    """``scan_lines`` of UTF-16 files (``endian``: le or be), decoded to text.

    The text source cuts at the bytes of an encoded line feed wherever they stand, also
    across two characters. Such a cut leaves pieces of odd length, so the count of odd
    pieces before one (inside its split, plus the splits before) tells whether it goes on
    the line before; the rare lines in several pieces are put together again."""
    charset = "UTF-16" + endian.upper()
    scan = spark.read.option("encoding", charset).option("lineSep", "\n").text(paths)
    path = F.col("_metadata.file_path")
    block = F.concat(path, F.lit("#"), F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0"))
    rows = scan.select((file_expr(path) if file_expr else path).alias(file_col), block.alias("_block"),
                       F.monotonically_increasing_id().alias("_mid"), F.col("value").cast("binary").alias("_bytes")) \
        .withColumn("_odd", F.octet_length("_bytes") % 2)
    inside = Window.partitionBy(file_col, "_block").orderBy("_mid")
    before, upto = inside.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(Window.unboundedPreceding, 0)
    splits = Window.partitionBy(file_col).orderBy("_block")  # a row per split
    odds = rows.groupBy(file_col, "_block").agg(F.sum("_odd").alias("_n")).select(
        file_col, "_block", F.coalesce(F.sum("_n").over(splits.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    rows = rows.join(odds, [file_col, "_block"])
    rows = rows.withColumn("_starts", (F.coalesce(F.sum("_odd").over(before), F.lit(0)) + F.col("_off")) % 2 == 0)
    rows = rows.withColumn("_key", F.last(F.when(F.col("_starts"), F.struct("_block", "_mid")), ignorenulls=True).over(upto))
    lasts = rows.groupBy(file_col, "_block").agg(F.max("_key").alias("_k")).select(
        file_col, "_block", F.last("_k", ignorenulls=True).over(splits.rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    rows = cut_lineage(rows.join(lasts, [file_col, "_block"]).withColumn("_key", F.coalesce("_key", "_carried"))
                       .select(file_col, "_block", "_mid", "_bytes", "_starts", "_key"), "utf16-pieces")
    # Written, as they are few: the planner sees their size and leaves the other lines in place.
    several = cut_lineage(rows.filter("not _starts").select(file_col, "_key").distinct(), "utf16-several")
    feed = F.encode(F.lit("\n"), charset)
    pieces = rows.join(several, [file_col, "_key"], "left_semi").groupBy(file_col, "_key").agg(
        F.array_sort(F.collect_list(F.struct("_block", "_mid", "_bytes"))).alias("_parts"))
    joined = pieces.select(file_col, "_key", F.aggregate("_parts", F.unhex(F.lit("")),
                                                         lambda a, x: F.when(F.octet_length(a) == 0, x["_bytes"]).otherwise(F.concat(a, feed, x["_bytes"]))).alias("_bytes"))
    lines = rows.filter("_starts").join(several, [file_col, "_key"], "left_anti").select(file_col, "_key", "_bytes").unionByName(joined)
    text = F.regexp_replace(F.regexp_replace(decode_utf16(F.col("_bytes"), endian), "^\ufeff", ""), "\r$", "")
    lines = lines.select(file_col, F.col("_key._block").alias("_block"), F.col("_key._mid").alias("_mid"), text.alias("raw")).filter(~T.is_blank(F.col("raw")))
    stats = lines.groupBy(file_col, "_block").agg(F.count(F.lit(1)).alias("_cnt"), F.lit(0).alias("_mid0"))
    place = F.row_number().over(inside)
    numbered = lines.withColumn("_pos", place).join(block_offsets(stats, file_col, "_block"), [file_col, "_block"])
    return numbered.select(file_col, "raw", (F.col("_start") + F.col("_pos")).cast("long").alias("line_no"),
                           F.col("_total").cast("long").alias("n_lines"), F.lit(True).alias("valid_utf8"))


def decode_utf16(data, endian: str):
    """Text of UTF-16 bytes; a half character at the end and lone surrogates become U+FFFD."""
    low, high = ("..D[89AB]", "..D[C-F]") if endian == "le" else ("D[89AB]..", "D[C-F]..")
    charset = "UTF-16" + endian.upper()
    hx = F.hex(F.substr(data, F.lit(1), (F.floor(F.octet_length(data) / 2) * 2).cast("int")))
    sound = hx.rlike(f"^(?:{low}{high}|(?!{low}|{high})....)*+$")
    lone = "FDFF" if endian == "le" else "FFFD"

    def mended(units):
        unit = lambda i: F.try_element_at(units, i)
        pair = lambda x, i: (x.rlike(f"^{low}$") & F.coalesce(unit(i + 2).rlike(f"^{high}$"), F.lit(False))) | (
            x.rlike(f"^{high}$") & (i > 0) & F.coalesce(F.when(i > 0, unit(i)).rlike(f"^{low}$"), F.lit(False)))
        fixed = F.transform(units, lambda x, i: F.when(~x.rlike(f"^(?:{low}|{high})$") | pair(x, i), x).otherwise(lone))
        return F.decode(F.unhex(F.array_join(fixed, "")), charset)

    units = F.regexp_extract_all(hx, F.lit("(....)"), 1)
    whole = F.when(sound, F.decode(F.unhex(hx), charset)).otherwise(T.let(units, mended))
    return F.when(F.octet_length(data) % 2 == 1, F.concat(whole, F.lit("\ufffd"))).otherwise(whole)


def file_digests(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(file_id, length, digest) of files of any size (R12): no file is one row.

    A file is cut at its line feeds; 128 bits of each piece's hash with its number are
    summed over the file, so the sum changes with any byte or any order. The length tells
    a line feed at the end and a BOM."""
    scan = spark.read.option("lineSep", "\n").text([paths] if isinstance(paths, str) else paths)
    path, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    rows = scan.select(path.alias("file_id"), F.concat(path, F.lit("#"), F.lpad(start.cast("string"), 20, "0")).alias("_block"),
                       F.col("_metadata.file_size").alias("length"), F.col("value").cast("binary").alias("_bytes"))
    rows = number_scanned_lines(rows, "file_id", "_block", len(scan.inputFiles()) + scan.rdd.getNumPartitions())
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), "line_no", "_bytes").cast("decimal(38,0)"))
    return rows.groupBy("file_id").agg(F.max("length").alias("length"), F.concat_ws(":", total(1).cast("string"), total(2).cast("string")).alias("digest"))


def scan_bytes(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Raw byte evidence per file (S2): path, size, modified, head bytes,
    BOM flags. Only the first bytes are kept past the scan."""
    if isinstance(paths, str):
        paths = [paths]
    b = spark.read.format("binaryFile").load(paths)
    head = F.substring("content", 1, 4)
    return b.select(
        F.col("path").alias("file_id"),
        "length",
        "modificationTime",
        head.alias("head"),
        (F.hex(F.substring("content", 1, 3)) == "EFBBBF").alias("bom_utf8"),
        F.hex(F.substring("content", 1, 2)).isin("FFFE", "FEFF").alias("bom_utf16"),
        F.sha2("content", 256).alias("sha256"),
    )


def sample_head(lines: DataFrame, k: int = K.SAMPLE_LINES) -> DataFrame:
    """First ``k`` lines per file joined by newlines (S3); bounded per file."""
    head = lines.filter(F.col("line_no") <= k)
    return head.groupBy("file_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("line_no", "raw"))), lambda x: x["raw"]), "\n"
        ).alias("sample")
    )
