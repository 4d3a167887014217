"""Join helpers: broadcast only behind a proven size bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A per-file / per-block parameter row is well below this many bytes.
PARAM_ROW_BYTES = 256
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def sized_broadcast(df: DataFrame, row_bound: int | None, row_bytes: int = PARAM_ROW_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast when ``row_bound`` (an upper bound on its
    rows that the caller can prove, e.g. the number of listed input files)
    times ``row_bytes`` fits the limit; otherwise leave the choice to the
    optimizer and AQE (sort-merge join, runtime conversion when small)."""
    if row_bound is not None and row_bound * row_bytes <= BROADCAST_LIMIT_BYTES:
        return F.broadcast(df)
    return df


def measured_broadcast(df: DataFrame, array_col: str, row_bytes: int = PARAM_ROW_BYTES,
                       element_bytes: int = 16) -> DataFrame:
    """Broadcast a small per-key frame whose rows carry an array of unknown
    length only after measuring it: one aggregate job gives the row count
    and the longest array, which bound its size. Beyond the limit the join
    is left to the planner and AQE."""
    n, longest = df.agg(F.count(F.lit(1)), F.max(F.size(array_col))).first()
    bound = (n or 0) * (row_bytes + (longest or 0) * element_bytes)
    return F.broadcast(df) if bound <= BROADCAST_LIMIT_BYTES else df
