"""Skew-safe dense numbering of rows inside groups.

A ``row_number()`` window partitioned by the group puts a whole group in
one task; one group may hold a third of all rows. Both helpers here number
in two phases instead: counts per (group, split) on a tiny aggregate,
prefix sums over that aggregate, and a position inside the split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seamfix.plans.joins import sized_broadcast


def block_offsets(stats: DataFrame, group: str, split: str) -> DataFrame:
    """Prefix sums of ``_cnt`` per group in ``split`` order, plus totals."""
    before = Window.partitionBy(group).orderBy(split).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(group)
    return stats.select(
        group,
        split,
        "_mid0",
        F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_start"),
        F.sum("_cnt").over(whole).alias("_total"),
    )


def number_rows(
    df: DataFrame,
    group: str,
    key: str,
    out: str = "line_no",
    total: str | None = "n_lines",
    chunks: int | None = None,
    group_bound: int | None = None,
) -> DataFrame:
    """Number rows 1..n inside ``group`` by the integer ``key`` (unique
    inside a group), deterministically and skew-safe.

    The key range is cut into ``chunks`` equal value ranges; a window
    partitioned by (group, chunk) numbers inside a chunk, so a huge group is
    spread over many tasks. Chunk counts (at most groups x chunks rows) are
    prefix-summed per group and joined back.
    """
    spark = df.sparkSession
    n_chunks = chunks or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    lo, hi = df.agg(F.min(key), F.max(key)).first()
    if lo is None:
        lo, hi = 0, 0
    width = max(1, -(-(int(hi) - int(lo) + 1) // n_chunks))
    x = df.withColumn("_chunk", F.floor((F.col(key) - F.lit(int(lo))) / F.lit(width)).cast("long"))
    stats = x.groupBy(group, "_chunk").agg(F.count(F.lit(1)).alias("_cnt"), F.lit(0).alias("_mid0"))
    offs = block_offsets(stats, group, "_chunk")
    bound = None if group_bound is None else group_bound * n_chunks
    pos = F.row_number().over(Window.partitionBy(group, "_chunk").orderBy(key))
    joined = x.withColumn("_pos", pos).join(sized_broadcast(offs, bound), [group, "_chunk"])
    return joined.select(
        *df.columns,
        (F.col("_start") + F.col("_pos")).cast("long").alias(out),
        *([F.col("_total").cast("long").alias(total)] if total else []),
    )


def number_scanned_lines(lines: DataFrame, file_col: str, block_col: str, split_bound: int | None) -> DataFrame:
    """Number text lines without moving them.

    ``lines`` comes straight from a text scan with blank lines removed; a
    split of one file is read in order inside one task, so a
    ``monotonically_increasing_id`` taken right after the scan orders the
    lines of a (file, block). Block counts are summed per file and joined
    back by (file, block); the statistics have one row per file split.
    """
    tagged = lines.withColumn("_mid", F.monotonically_increasing_id())
    stats = tagged.groupBy(file_col, block_col).agg(F.count(F.lit(1)).alias("_cnt"), F.min("_mid").alias("_mid0"))
    offs = block_offsets(stats, file_col, block_col)
    joined = tagged.join(sized_broadcast(offs, split_bound), [file_col, block_col])
    return joined.select(
        *[c for c in lines.columns if c != block_col],
        (F.col("_start") + F.col("_mid") - F.col("_mid0") + 1).alias("line_no"),
        F.col("_total").alias("n_lines"),
    )
