"""Structured Streaming operators.

Files arrive whole, so detection and repair run per micro-batch in
``foreachBatch`` with the batch operators. Every batch writes its own
``run=/epoch=`` folder with overwrite, so a batch that is run again after a failure
replaces its rows instead of adding them. Checkpoints and sinks live in the
shared folder; a caller that passes a stable ``state`` folder resumes where the
last run stopped.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamfix.plans.numbering import number_scanned_lines
from seamfix.session import scratch_path

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
FILE_ID = lambda p: F.regexp_extract(p, r"file_id=(-?\d+)", 1).cast("long")
#: The file source forgets nothing: a file that is older than the newest one by
#: less than this is still taken.
MAX_FILE_AGE = "36500d"
LEDGER_BUCKETS = 256


def state_of(spark: SparkSession, name: str, state: str | None) -> tuple[str, str]:
    """(checkpoint folder, sink folder) below ``state`` (default: a fresh one)."""
    base = state or scratch_path(spark, f"stream-{name}")
    return os.path.join(base, "checkpoint"), os.path.join(base, "sink")


def run_batches(stream: DataFrame, checkpoint: str, sink: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    """Run ``fn`` on every micro-batch that is available now; its result is the
    batch's own folder of the sink."""
    def handle(batch: DataFrame, epoch: int) -> None:
        # The query's id lives in its checkpoint: a lost checkpoint starts a new run
        # next to the old one instead of overwriting its batches.
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "0"
        fn(batch).write.mode("overwrite").parquet(os.path.join(sink, f"run={run}", f"epoch={epoch}"))

    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start().awaitTermination()


def read_sink(spark: SparkSession, sink: str, empty: DataFrame | None = None) -> DataFrame | None:
    """All batches of a sink without run and epoch; ``empty`` where none ran yet."""
    try:
        return spark.read.option("basePath", sink).parquet(sink).drop("run", "epoch")
    except AnalysisException:
        return empty


def text_stream(spark: SparkSession, paths: str, max_files: int = 32) -> DataFrame:
    """Raw lines of newly arriving text files, with file path and split; lines
    end as in the batch scan (S1)."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).option("maxFileAge", MAX_FILE_AGE) \
        .option("lineSep", "\n").text(paths).select(
            F.col("value").alias("raw"), F.input_file_name().alias("_path"), F.input_file_block_start().alias("_block_start"))


def number_batch(batch: DataFrame, file_expr: Callable[[Column], Column] | None = None) -> DataFrame:
    """S1 numbering inside one micro-batch (files arrive whole). The file id is
    the path unless ``file_expr`` maps it."""
    from seamfix.functions.text import is_blank, strip_cr
    path = F.col("_path")
    df = batch.select((file_expr(path) if file_expr else path).alias("file_id"), strip_cr(F.col("raw")).alias("raw"),
                      F.concat(path, F.lit("#"), F.lpad(F.col("_block_start").cast("string"), 20, "0")).alias("_block")) \
        .filter(~is_blank(F.col("raw")))
    return number_scanned_lines(df, "file_id", "_block", None)


def for_each_file_batch(spark: SparkSession, paths: str, fn: Callable[[DataFrame], DataFrame], name: str,
                        file_expr: Callable[[Column], Column] | None = None, state: str | None = None,
                        max_files: int = 32) -> DataFrame:
    """T1/T2 skeleton: stream files, number lines per batch, run ``fn``; returns
    the sink's contents."""
    checkpoint, sink = state_of(spark, name, state)
    run_batches(text_stream(spark, paths, max_files), checkpoint, sink, lambda b: fn(number_batch(b, file_expr)))
    return read_sink(spark, sink, empty_result(spark, fn))


def empty_result(spark: SparkSession, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``fn`` gives for no lines: the shape of a sink that no batch has written yet."""
    lines = spark.createDataFrame([], "file_id long, line_no long, raw string, n_lines long, valid_utf8 boolean")
    return spark.createDataFrame([], fn(lines).schema)


def stream_logs(spark: SparkSession, path: str, name: str = "logs", state: str | None = None) -> DataFrame:
    """Continuous NDJSON log ingestion (S11 as a stream) into Parquet."""
    from seamfix.sources.logs import read_logs
    checkpoint, sink = state_of(spark, name, state)
    logs = read_logs(spark, path, stream=True)
    run_batches(logs, checkpoint, sink, lambda b: b)
    return read_sink(spark, sink, spark.createDataFrame([], logs.schema))


def stream_volume(spark: SparkSession, path: str, name: str = "volume", state: str | None = None) -> DataFrame:
    """O1 over arriving logs without a watermark (for windows with one: ``windows``). Each batch adds its
    distinct (day, trace) rows to the sink, and days are counted over all of
    them, so neither late rows nor batch borders lose or double a trace."""
    from seamfix.sources.logs import read_logs
    checkpoint, sink = state_of(spark, name, state)
    logs = read_logs(spark, path, stream=True).filter(F.col("app_event") == "repair_completed") \
        .select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "trace_id")
    run_batches(logs, checkpoint, sink, lambda b: b.distinct())
    return read_sink(spark, sink, spark.createDataFrame([], "day string, trace_id string")).filter(F.col("day").isNotNull()).groupBy("day").agg(F.count_distinct("trace_id").alias("n_traces"))


def stream_once(spark: SparkSession, paths: str, name: str = "once", state: str | None = None, max_files: int | None = None) -> DataFrame:
    """A file (same path, same modification time) is handled once, whatever its age
    and however often a listing delivers it.

    The files of a run are keyed state (deduplication in the state store, kept in RocksDB:
    a batch costs by its own files). Handled files are also listed in a ledger by run, batch
    and hash bucket of the path. A run whose checkpoint was lost starts with empty state; its
    batches leave out what the ledger's other runs hold, and read for that only the buckets
    of their own files."""
    checkpoint, sink = state_of(spark, name, state)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    listing = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", "*.txt").option("maxFileAge", MAX_FILE_AGE)
    if max_files:
        listing = listing.option("maxFilesPerTrigger", max_files)
    new = listing.load(paths).select("path", "modificationTime").dropDuplicates(["path", "modificationTime"])
    bucket = F.pmod(F.xxhash64("path"), F.lit(LEDGER_BUCKETS)).cast("int")
    empty = spark.createDataFrame([], "path string, modificationTime timestamp, bucket int, run string, epoch int")

    def handle(batch: DataFrame, epoch: int) -> None:
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "0"
        files = batch.withColumn("bucket", bucket)
        ledger = ledger_of(spark, sink, empty)
        others = ledger.filter(F.col("run") != run)
        if not others.limit(1).isEmpty():
            own = [r["bucket"] for r in files.select("bucket").distinct().collect()]  # at most LEDGER_BUCKETS
            files = files.join(others.filter(F.col("bucket").isin(own)).select("path", "modificationTime"), ["path", "modificationTime"], "left_anti")
        files.write.mode("overwrite").partitionBy("bucket").parquet(os.path.join(sink, f"run={run}", f"epoch={epoch}"))

    try:
        spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        new.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
    return ledger_of(spark, sink, empty).select("path", "modificationTime")


def ledger_of(spark: SparkSession, sink: str, empty: DataFrame) -> DataFrame:
    try:
        return spark.read.schema(empty.schema).option("basePath", sink).parquet(sink)
    except AnalysisException:
        return empty


def stream_drift(spark: SparkSession, root: str, baseline: DataFrame, table: str, name: str = "drift",
                 state: str | None = None) -> DataFrame:
    """T5: drift of each arriving Parquet extract against a static baseline
    (stream-static), per micro-batch; the distinct differences."""
    from seamfix.operators import drift as C
    checkpoint, sink = state_of(spark, name, state)
    diff = lambda b: C.column_diff(C.inspect_schema({table: b}), baseline.filter(F.col("table") == table))
    try:
        schema = spark.read.parquet(root).schema
    except AnalysisException:  # no extract has arrived yet
        return spark.createDataFrame([], diff(spark.createDataFrame([], "c string")).schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("maxFileAge", MAX_FILE_AGE).parquet(root)
    run_batches(stream, checkpoint, sink, diff)
    return read_sink(spark, sink, spark.createDataFrame([], diff(spark.createDataFrame([], "c string")).schema)).distinct()


def stage_files(lines: DataFrame, root: str, charset: str | None = None, dealt: bool = False) -> str:
    """Land rendered lines as one physical text file per file id (how files
    arrive in an intake folder); ``charset``: of the line feeds, next to earlier files;
    ``dealt``: a file's lines already lie in one partition."""
    placed = (lines if dealt else lines.repartition("file_id")).sortWithinPartitions("file_id", "line_no").select(F.col("raw").alias("value"), "file_id")
    writer = placed.write.mode("append" if charset else "overwrite").partitionBy("file_id")
    (writer.option("encoding", charset).option("lineSep", "\n") if charset else writer).text(root)
    return root
