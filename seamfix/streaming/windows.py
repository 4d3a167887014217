"""Event-time windows over log streams (T4): O1 to O3 with a watermark and keyed state.

Two steps, both with a checkpoint of their own:

1. **Gate.** Each micro-batch of log lines is judged against the watermark (the latest
   event time of the batches before, less ``delay``): a line whose day has closed, or that
   has no event time, is *refused*. Accepted and refused lines land in the batch's own
   folder, with the running latest event time, so a batch reads one row of the past and a
   batch that runs again replaces its folder.
2. **Windows.** Stateful queries with the same watermark read what the gate accepted:
   distinct traces a day (state: the day's traces), lines per day and class or node (state:
   counts, update mode), and a mergeable sketch of the day's traces. A batch of this step
   holds whole batches of the gate, so its watermark never passes the gate's and Spark
   drops nothing; closed days leave the state. Every batch writes its own folder; the
   newest row of a key counts.

Accepted and refused lines together are all lines: nothing vanishes. All of a run lies
below a folder that names the gate's query; if the checkpoint is lost, the next run reads
all files into a new folder and the old one is no longer read."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seamfix import constants as K
from seamfix.streaming.streams import MAX_FILE_AGE, state_of

DELAY = "1 hour"
SKETCH_LG = 12  # 2**12 registers
#: Relative standard error of the sketch; three of them bound nearly all estimates.
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_LG / 2)
_DAY = "1 day"


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at ``path``, or an empty one where none was written."""
    try:
        return spark.read.option("basePath", path).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def run_query(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int, str], None], mode: str = "append") -> str:
    """Run all that is available now; ``write(batch, epoch, query id)``. Returns the query's id."""
    def handle(batch: DataFrame, epoch: int) -> None:
        write(batch, epoch, batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId"))
    query = (stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return str(query.id)


def gate(logs: DataFrame, base: str, checkpoint: str, delay: str) -> str:
    """Split a log stream (with ``ts``) into accepted and refused lines; returns the run's folder."""
    spark = logs.sparkSession

    def write(batch: DataFrame, epoch: int, query: str) -> None:
        run = os.path.join(base, f"run={query}")
        latest = F.lit(None).cast("timestamp")
        if epoch:
            past = spark.read.parquet(os.path.join(run, "latest", f"epoch={epoch - 1}")).first()
            latest = F.lit(past["latest"]).cast("timestamp")
        # The end of the window by hand: window() itself would leave out lines without a time.
        end = F.timestamp_seconds((F.floor(F.unix_seconds("ts") / 86400) + 1) * 86400)
        closed = end <= latest - F.expr(f"interval {delay}")
        reason = F.when(F.col("ts").isNull(), "no event time").when(closed, "late")
        here = os.path.join(run, "lines", f"epoch={epoch}")
        batch.withColumn("reason", reason).withColumn("refused", reason.isNotNull().cast("int")) \
            .write.mode("overwrite").partitionBy("refused").parquet(here)
        now = read_or_empty(spark, here, "ts timestamp").agg(F.max("ts").alias("ts"))
        now.select(F.greatest("ts", latest).alias("latest")).write.mode("overwrite").parquet(os.path.join(run, "latest", f"epoch={epoch}"))

    return os.path.join(base, "run=" + run_query(logs, checkpoint, write))


def accepted(spark: SparkSession, run: str, schema: StructType, delay: str) -> DataFrame:
    """Stream of the lines that the gate accepted, whole batches of it at a time."""
    return (spark.readStream.schema(schema).option("maxFileAge", MAX_FILE_AGE).parquet(os.path.join(run, "lines", "epoch=*", "refused=0"))
            .withWatermark("ts", delay).withColumn("w", F.window("ts", _DAY)))


def newest(spark: SparkSession, sink: str, keys: list[str], value: str, schema: str) -> DataFrame:
    """The row of each key that the latest batch wrote (update mode)."""
    rows = read_or_empty(spark, sink, schema + ", epoch int")
    return rows.groupBy(*keys).agg(F.max_by(value, "epoch").alias(value))


def stream_windows(spark: SparkSession, path: str, delay: str = DELAY, name: str = "windows", state: str | None = None,
                   max_files: int | None = None) -> dict[str, DataFrame]:
    """O1 to O3 over a folder of NDJSON log files, as far as they have arrived.

    volume (day, n_traces: exact), sketches (day, sketch), counts (day, kind, key, n; kind
    is class or node) and refused (the lines, with reason)."""
    from seamfix.sources.logs import read_logs
    checkpoint, sink = state_of(spark, name, state)
    run = gate(read_logs(spark, path, stream=True, max_files=max_files), sink, os.path.join(checkpoint, "gate"), delay)
    lines = read_or_empty(spark, os.path.join(run, "lines"), read_logs(spark, path).withColumn("reason", F.lit("")).schema.simpleString()[7:-1].replace(":", " "))
    out = {n: os.path.join(run, n) for n in ("volume", "sketches", "counts")}
    if "refused" in lines.columns and lines.filter("refused = 0").limit(1).count():
        schema = lines.drop("refused", "epoch", "reason").schema
        day = F.date_format("w.start", "yyyy-MM-dd").alias("day")

        def into(folder: str, shape: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int, str], None]:
            return lambda batch, epoch, _: shape(batch).write.mode("overwrite").parquet(os.path.join(folder, f"epoch={epoch}"))

        done = accepted(spark, run, schema, delay).filter("app_event = 'repair_completed' and trace_id is not null").select("w", "trace_id")
        # First sight of a trace in its day: the batch adds what is new.
        run_query(done.dropDuplicates(["w", "trace_id"]), os.path.join(run, "state-volume"),
                  into(out["volume"], lambda b: b.groupBy(day).agg(F.count(F.lit(1)).alias("n"))))
        run_query(done.groupBy("w").agg(F.hll_sketch_agg("trace_id", SKETCH_LG).alias("sketch")), os.path.join(run, "state-sketches"),
                  into(out["sketches"], lambda b: b.select(day, "sketch")), "update")
        kinds = F.inline(F.array(F.struct(F.lit("class").alias("kind"), F.col("failure_class").alias("key")),
                                 F.struct(F.lit("node").alias("kind"), F.col("node").alias("key"))))
        named = accepted(spark, run, schema, delay).select("w", kinds).filter("key is not null")
        run_query(named.groupBy("w", "kind", "key").agg(F.count(F.lit(1)).alias("n")), os.path.join(run, "state-counts"),
                  into(out["counts"], lambda b: b.select(day, "kind", "key", "n")), "update")
    volume = read_or_empty(spark, out["volume"], "day string, n long, epoch int").groupBy("day").agg(F.sum("n").alias("n_traces"))
    return {"volume": volume,
            "sketches": newest(spark, out["sketches"], ["day"], "sketch", "day string, sketch binary"),
            "counts": newest(spark, out["counts"], ["day", "kind", "key"], "n", "day string, kind string, key string, n long"),
            "refused": lines.filter("refused = 1").drop("refused", "epoch") if "refused" in lines.columns else lines}


def top_terms(counts: DataFrame, kind: str, column: str, k: int, values: list[str] | None = None) -> DataFrame:
    """O2 and O3 from the windows' counts: the k most frequent terms over all days."""
    rows = counts.filter(F.col("kind") == kind)
    if values is not None:
        rows = rows.filter(F.col("key").isin(*values))
    return rows.groupBy(F.col("key").alias(column)).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.asc(column)).limit(k)


def class_distribution(counts: DataFrame) -> DataFrame:
    return top_terms(counts, "class", "failure_class", 10)


def outcome_breakdown(counts: DataFrame) -> DataFrame:
    return top_terms(counts, "node", "node", 5, K.OUTCOME_NODES)


def distinct_estimate(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Distinct traces from the days' sketches, united over days (all, or by columns)."""
    united = F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate")
    return sketches.groupBy(*by).agg(united) if by else sketches.agg(united)
