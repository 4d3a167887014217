"""Versioned schema baselines as JSON documents (S7), and the version valid at a run's time.

A file holds the versions of one table as a JSON array over many lines:
``{"table", "version", "valid_from", "columns": [{"name", "type", "nullable"}]}``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DOCUMENT = ("table string, version int, valid_from string, columns array<struct<name: string, type: string, nullable: boolean>>, "
            "_corrupt_record string")


def write_baselines(documents: DataFrame, path: str) -> str:
    """One file per table: its versions (table, version, valid_from, columns) as an array."""
    row = F.struct("table", "version", F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"), "columns")
    per = documents.groupBy("table").agg(F.sort_array(F.collect_list(F.struct("version", row.alias("doc")))).alias("docs"))
    text = F.to_json(F.col("docs.doc"), {"pretty": "true"})
    per.select(F.col("table").alias("of_table"), text.alias("value")).repartition("of_table") \
        .write.mode("overwrite").partitionBy("of_table").text(path)
    return path


def read_baselines(spark: SparkSession, path: str) -> DataFrame:
    """(table, version, valid_from, ordinal, name, type, nullable). A file that is no JSON, or
    a document without table, version or date, gives an error row: table null, its text in
    ``error``."""
    raw = spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    day = F.try_to_timestamp("valid_from", F.lit("yyyy-MM-dd")).cast("date")
    sound = F.col("table").isNotNull() & F.col("version").isNotNull() & day.isNotNull() & F.col("_corrupt_record").isNull()
    docs = raw.select(F.when(sound, F.col("table")).alias("table"), "version", day.alias("valid_from"), "columns",
                      F.when(~sound, F.coalesce("_corrupt_record", F.to_json(F.struct("table", "version", "valid_from")))).alias("error"))
    return docs.select("table", "version", "valid_from", "error", F.posexplode_outer("columns").alias("pos", "c")) \
        .select("table", "version", "valid_from", (F.col("pos") + 1).alias("ordinal"), F.col("c.name").alias("name"),
                F.col("c.type").alias("type"), F.col("c.nullable").alias("nullable"), "error")


def valid_versions(baselines: DataFrame, runs: DataFrame) -> DataFrame:
    """``runs`` (table, run_at) with the version valid then: of those that began by that
    time the latest (of one day the highest number), null where none had begun.

    Versions and runs of a table are one time line; each run takes the last version
    before it, so nothing is multiplied."""
    versions = baselines.filter("table is not null").select("table", "version", "valid_from").distinct()
    line = versions.select("table", F.col("valid_from").cast("timestamp").alias("at"), F.lit(0).alias("is_run"), "version") \
        .unionByName(runs.select("table", F.col("run_at").cast("timestamp").alias("at"), F.lit(1).alias("is_run"),
                                 F.lit(None).cast("int").alias("version")))
    before = Window.partitionBy("table").orderBy("at", "is_run", "version").rowsBetween(Window.unboundedPreceding, 0)
    return line.withColumn("version", F.last("version", ignorenulls=True).over(before)).filter("is_run = 1") \
        .select("table", F.col("at").alias("run_at"), "version")


def baselines_at(baselines: DataFrame, runs: DataFrame) -> DataFrame:
    """The columns of the baseline that each run (table, run_at) is judged by."""
    return valid_versions(baselines, runs).join(baselines.filter("name is not null"), ["table", "version"]) \
        .select("table", "run_at", "version", "ordinal", "name", "type", "nullable")
