"""Log and dashboard analytics (O1-O5) over ingested log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seamfix import constants as K
from seamfix.session import cut_lineage


def volume_over_time(logs: DataFrame, approx: bool = False) -> DataFrame:
    """O1: distinct traces completing a repair per day (buckets with at
    least one document only)."""
    done = logs.filter(F.col("app_event") == "repair_completed")
    agg = F.approx_count_distinct("trace_id") if approx else F.count_distinct("trace_id")
    return done.groupBy(F.window("ts", "1 day").alias("w")).agg(agg.alias("n_traces")) \
        .select(F.date_format(F.col("w.start"), "yyyy-MM-dd").alias("day"), "n_traces")


def top_terms(logs: DataFrame, col: str, k: int, values: list[str] | None = None) -> DataFrame:
    """O2/O3: counts per term, top k descending, ties by term (unique)."""
    df = logs.filter(F.col(col).isNotNull())
    if values is not None:
        df = df.filter(F.col(col).isin(*values))
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(col)).limit(k)


def class_distribution(logs: DataFrame) -> DataFrame:
    return top_terms(logs, "failure_class", 10)


def outcome_breakdown(logs: DataFrame) -> DataFrame:
    return top_terms(logs, "node", 5, K.OUTCOME_NODES)


TRACE_COLUMNS = ["ts_text", "app_agent", "node", "app_event", "level", "table", "failure_class", "latency_ms"]


def trace_explorer(logs: DataFrame, trace_id: str) -> DataFrame:
    """The eight columns of one trace, oldest first."""
    df = logs.filter(F.col("trace_id") == trace_id).withColumn(
        "ts_text", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return df.orderBy("ts", "event_id").select(*TRACE_COLUMNS)


def kth_values(df: DataFrame, group: str, value: str, rank: DataFrame) -> DataFrame:
    """Exact k-th smallest ``value`` per group (0-based rank in ``rank``:
    group, k), skew-safe: duplicates are combined map-side into (group,
    value, count); the counts are range partitioned and written with their
    task, so a hot group spreads over many tasks whatever its values, and
    cumulative counts are sums inside (task, group) plus the sums of the
    tasks before."""
    counts = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("cnt"))
    dealt = cut_lineage(counts.repartitionByRange(group, value).withColumn("task", F.spark_partition_id()), "ranked-values")
    before = Window.partitionBy(group).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(group, "task").agg(F.sum("cnt").alias("tcnt")) \
        .select(group, "task", F.coalesce(F.sum("tcnt").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy(group, "task").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    cum = dealt.join(starts, [group, "task"]).withColumn("cum_end", F.col("start") + F.sum("cnt").over(within))
    hit = cum.join(rank, group).filter((F.col("cum_end") - F.col("cnt") <= F.col("k")) & (F.col("k") < F.col("cum_end")))
    return hit.select(group, F.col(value).alias("kth"))


def latency_summary(logs: DataFrame) -> DataFrame:
    """Per node n, mean, sample stdev and p95 by nearest rank
    ``round(0.95 * (n - 1))`` (half to even) on the sorted values."""
    base = logs.filter(F.col("latency_ms").isNotNull() & F.col("node").isNotNull())
    stats = base.groupBy("node").agg(
        F.count(F.lit(1)).alias("n"), F.avg("latency_ms").alias("mean"), F.stddev_samp("latency_ms").alias("stdev"))
    rank = stats.select("node", F.bround(F.lit(0.95) * (F.col("n") - 1)).cast("long").alias("k"))
    p95 = kth_values(base, "node", "latency_ms", rank)
    return stats.join(p95, "node").select(
        "node", "n", F.round("mean", 4).alias("mean"), F.round("stdev", 4).alias("stdev"), F.col("kth").alias("p95"))
