"""Structured log lines: NDJSON sink and ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TS_FMT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"

LOG_SCHEMA = ("agent string, node string, table string, trace_id string, level string, timestamp timestamp, "
              "event string, failure_class string, latency_ms double, event_id bigint, _corrupt_record string")


def write_ndjson(logs: DataFrame, path: str) -> str:
    """Write log lines as NDJSON, keys as a structured logger emits them;
    every 997th line is truncated to exercise the parse-error path."""
    body = F.to_json(F.struct(
        F.col("app_agent").alias("agent"), "node", "table", "trace_id", "level",
        F.date_format("timestamp", TS_FMT).alias("timestamp"),
        F.col("app_event").alias("event"), "failure_class", "latency_ms", "event_id"))
    text = F.when(F.col("event_id") % 997 == 0, F.substring(body, 1, 20)).otherwise(body)
    logs.select(text.alias("value")).write.mode("overwrite").text(path)
    return path


def read_logs(spark: SparkSession, path: str, stream: bool = False, max_files: int | None = None) -> DataFrame:
    """S11 (``max_files``: of a micro-batch): keys to top level, ``event`` -> ``app_event``, ``agent`` ->
    ``app_agent``, parse-error marker, daily partition column."""
    reader = spark.readStream.option("maxFileAge", "36500d") if stream else spark.read
    if stream and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    raw = reader.schema(LOG_SCHEMA).option("mode", "PERMISSIVE") \
        .option("columnNameOfCorruptRecord", "_corrupt_record").option("timestampFormat", TS_FMT).json(path)
    return raw.withColumnsRenamed({"event": "app_event", "agent": "app_agent", "timestamp": "ts"}) \
        .withColumn("parse_error", F.col("_corrupt_record").isNotNull()) \
        .withColumn("log_date", F.to_date("ts")).drop("_corrupt_record")
