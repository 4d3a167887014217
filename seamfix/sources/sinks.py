"""Sinks (S5, S8-S10, S12).

All sinks are ``DataFrameWriter`` calls under the job commit protocol
(output is visible only after ``_SUCCESS``); no driver-side file handling.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamfix import constants as K


def refuse_collision(output_root: str, source_paths: list[str]) -> None:
    """S5 precondition: the output root must not equal or sit inside a source."""
    out = os.path.normpath(output_root.replace("file:", ""))
    for src in source_paths:
        s = os.path.normpath(src.replace("file:", ""))
        if out == s or out.startswith(s.rstrip("/") + "/"):
            raise ValueError(K.ERR_OUTPUT_COLLIDES)


def write_canonical(out_lines: DataFrame, root: str, partitions: int | None = None) -> str:
    """Write repaired lines as one directory per file, in line order.

    Range partitioning on (file_id, line_no) keeps order and splits a huge
    file over many writers (part files of one directory are read back in
    name order, which is range order).
    """
    spark = out_lines.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (out_lines.repartitionByRange(n, "file_id", "line_no")
     .sortWithinPartitions("file_id", "line_no")
     .select("text", "file_id")
     .write.mode("overwrite").partitionBy("file_id").text(root))
    return root


def read_canonical(spark, root: str) -> DataFrame:
    """Scan canonical output back as numbered lines (S1 on the output)."""
    from seamfix.sources.lines import scan_lines
    fid = lambda p: F.regexp_extract(p, r"file_id=(-?\d+)", 1).cast("long")
    return scan_lines(spark, root, file_expr=fid).select("file_id", "line_no", F.col("raw").alias("text"), "n_lines")


def append_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Append-only Parquet table (an audit table or the history)."""
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def append_two_sinks(df: DataFrame, primary: str, mirror: str) -> bool:
    """The primary write must succeed; the mirror is best effort.
    Returns whether the mirror write succeeded."""
    append_table(df, primary)
    try:
        append_table(df, mirror)
        return True
    except Exception:  # noqa: BLE001 - best effort by design
        return False
