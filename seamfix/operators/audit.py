"""Append-only audit tables and their queries.

Episodes, events and migrations are plain append-only tables; current
state is derived (event sourcing), never updated in place. All roll-ups
are algebraic aggregates (sum/min/max/max_by) so a hot episode or trace
is combined map-side instead of landing whole in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamfix import constants as K

TS_FMT = "yyyy-MM-dd HH:mm:ss.SSSSSS"

# --- fixed values (workflow steps and their status words) -----------------
STEP_ORDER = ["propose", "validate", "human_approval", "apply", "reverify"]
TERMINAL_STATUS = ["verified", "verification_failed", "rejected", "apply_failed", "invalid"]


def ts_text(c) -> Column:
    return F.date_format(c, TS_FMT)


def step_status(node: Column, k: Column) -> Column:
    """Status word of a step; the outcome bit comes from the payload."""
    return F.when(node == "propose", "proposed") \
        .when(node == "validate", F.when(k % 2 == 0, "valid").otherwise("invalid")) \
        .when(node == "human_approval", F.when(k % 3 != 0, "approved").otherwise("rejected")) \
        .when(node == "apply", F.when(k % 5 != 0, "applied").otherwise("apply_failed")) \
        .when(node == "reverify", F.when(k % 7 != 0, "verified").otherwise("verification_failed"))


def payload(node: Column, status: Column, k: Column, classes: Column | None = None) -> Column:
    """Payload JSON per step; ``failure_classes`` only when more than one."""
    fields = [node.alias("step"), status.alias("status"), k.alias("k")]
    if classes is not None:
        fields.append(F.when(F.size(classes) > 1, classes).alias("failure_classes"))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "true"})


def episodes(classes: DataFrame, events: DataFrame) -> DataFrame:
    """One episode per non-healthy file; started at its first event."""
    start = events.groupBy("episode_id").agg(F.min("created_ts").alias("started_ts"))
    ep = classes.filter(F.size("failure_classes") > 0).select(
        F.concat(F.lit("ep-"), F.col("file_id").cast("string")).alias("episode_id"),
        "file_id", "primary_class", "failure_classes")
    return ep.join(start, "episode_id", "left")


def episode_state(eps: DataFrame, events: DataFrame) -> DataFrame:
    """U4: current state of each episode from its append-only events."""
    last = events.groupBy("episode_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.max_by(F.struct("node", "status"), F.struct("created_ts", "event_id")).alias("last"),
        F.max("created_ts").alias("last_ts"))
    df = eps.join(last, "episode_id", "left")
    done = F.col("last.status").isin(*TERMINAL_STATUS)
    return df.select(
        "episode_id", F.coalesce("n_events", F.lit(0)).alias("n_events"),
        F.col("last.node").alias("last_node"), F.col("last.status").alias("last_status"),
        ts_text(F.col("started_ts")).alias("started_at"), ts_text(F.col("last_ts")).alias("last_active_at"),
        (~F.coalesce(done, F.lit(False))).alias("is_active"))


def orphan_events(events: DataFrame, eps: DataFrame) -> DataFrame:
    """Events whose episode does not exist (referential check)."""
    return events.join(eps.select("episode_id"), "episode_id", "left_anti")


def token_rollup(spans: DataFrame) -> DataFrame:
    """Per trace over CHAT_MODEL spans: token sums; cost only where
    present (null when no span carries a cost)."""
    chat = spans.filter(F.col("span_type") == "CHAT_MODEL")
    return chat.groupBy("trace_id").agg(
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("total_tokens").alias("total_tokens"),
        F.sum("cost").alias("cost"))


def run_metrics(runs: DataFrame) -> DataFrame:
    """Long form; explicit token_usage wins over the split counts;
    absent metrics are omitted."""
    has_usage = F.col("token_usage").isNotNull()
    def m(name, value):
        return F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"))
    pairs = F.array(
        m("latency_ms", F.col("latency_ms")),
        m("token_usage", F.col("token_usage")),
        m("input_tokens", F.when(~has_usage, F.col("input_tokens"))),
        m("output_tokens", F.when(~has_usage, F.col("output_tokens"))),
        m("total_tokens", F.when(~has_usage, F.col("total_tokens"))),
        m("cost_usd", F.col("cost")),
    )
    return runs.select("run_id", F.inline(pairs)).filter(F.col("value").isNotNull())


def run_status(status: Column) -> Column:
    """Succeeded -> FINISHED, failed -> FAILED, anything else FINISHED."""
    expr = None
    for k, v in K.RUN_STATUS.items():
        expr = F.when(status == k, v) if expr is None else expr.when(status == k, v)
    return expr.otherwise(K.RUN_STATUS_DEFAULT)
