"""Proposal, validation and gating.

Decisions that the reference takes from a person or a model enter here as
DataFrames (``proposals``, ``approvals``), so every decision is joinable and
auditable. Everything else is deterministic column logic over the
one-row-per-file detection frames.
"""

from __future__ import annotations

import encodings.aliases

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamfix import constants as K
from seamfix.functions import text as T
from seamfix.plans.joins import measured_broadcast, sized_broadcast

def default_prescriptions(spark: SparkSession) -> DataFrame:
    """P3 as a small constant frame (one row per class)."""
    return spark.createDataFrame(
        K.DEFAULT_PRESCRIPTIONS, "failure_class string, delimiter string, encoding string, header_row bigint, engine string")


def known_codecs(spark: SparkSession) -> DataFrame:
    """Codec names Python accepts, normalised (P4); built from the stdlib
    alias registry, a few hundred rows, broadcast."""
    names = set(encodings.aliases.aliases) | set(encodings.aliases.aliases.values())
    rows = sorted({n.lower().replace("-", "_").replace(" ", "_") for n in names})
    return F.broadcast(spark.createDataFrame([(r,) for r in rows], "codec string"))


def single_column_delimiter(lines: DataFrame, struct_df: DataFrame, file_bound: int | None = None) -> DataFrame:
    """P10: for single-column files, the one character outside the candidate
    list that splits every line to one common width >= 2; none or several
    such characters -> no proposal."""
    files = struct_df.filter(F.col("single_column") & (F.col("n_lines") >= 2)).select("file_id")
    first = lines.filter(F.col("line_no") == 1).join(sized_broadcast(files, file_bound), "file_id")
    # One row per file: the distinct non-alphanumeric characters of its
    # first line outside the candidate list. Its size is measured before it
    # is broadcast (the characters of a line have no fixed bound).
    cands = first.select("file_id", F.array_except(
        F.array_distinct(F.regexp_extract_all("raw", F.lit(r"([^\p{L}\p{N}])"), 1)),
        F.array(*[F.lit(c) for c in K.CANDIDATE_DELIMITERS])).alias("cands")).filter(F.size("cands") > 0)
    per_line = lines.join(measured_broadcast(cands, "cands"), "file_id").select(
        "file_id", F.explode(F.transform("cands", lambda c: F.struct(
            c.alias("c"), (T.occurrences(F.col("raw"), c) + 1).alias("w")))).alias("x")).select("file_id", "x.*")
    widths = per_line.groupBy("file_id", "c").agg(F.min("w").alias("lo"), F.max("w").alias("hi"))
    ok = widths.filter((F.col("lo") == F.col("hi")) & (F.col("lo") >= 2))
    return ok.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_ok"), F.max("c").alias("c")) \
        .filter(F.col("n_ok") == 1).select("file_id", F.col("c").alias("single_column_delimiter"))


def propose(classes: DataFrame, garbled: DataFrame, repairs: DataFrame, p10: DataFrame,
            encoding: DataFrame | None = None, proposals: DataFrame | None = None) -> DataFrame:
    """P1 + P2: final parameters per non-healthy file.

    ``proposals`` (optional) holds supplied raw parameters per file; each
    deterministic override touches only its own field.
    """
    has = lambda name: F.array_contains("failure_classes", name)
    n_rep = repairs.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_mixed_rows"))
    df = classes.filter(F.size("failure_classes") > 0) \
        .join(garbled.select("file_id", F.lit(True).alias("_garbled")), "file_id", "left") \
        .join(n_rep, "file_id", "left").join(p10, "file_id", "left")
    if proposals is None:
        df = df.withColumns({c: F.lit(None).cast(t) for c, t in
                             [("p_delimiter", "string"), ("p_encoding", "string"), ("p_header_row", "bigint"), ("p_engine", "string")]})
    else:
        df = df.join(proposals.select("file_id", *[F.col(c).alias("p_" + c) for c in
                                                   ["delimiter", "encoding", "header_row", "engine"]]), "file_id", "left")
    if encoding is not None:
        df = df.join(encoding.select("file_id", F.col("encoding").alias("_enc")), "file_id", "left")
    else:
        df = df.withColumn("_enc", F.lit(None).cast("string"))
    garbled_c = F.coalesce(F.col("_garbled"), F.lit(False))
    mixed_c = has("mixed_delimiter") & (F.coalesce(F.col("n_mixed_rows"), F.lit(0)) > 0)
    supplied_delim = F.coalesce(
        F.col("p_delimiter"),
        F.when(has("single_column_malformation"), F.col("single_column_delimiter")).otherwise(F.col("delimiter")))
    delimiter = F.when(mixed_c | garbled_c, F.col("delimiter")).otherwise(supplied_delim)
    encoding_c = F.when(has("wrong_encoding") & F.col("_enc").isNotNull(), F.col("_enc")) \
        .otherwise(F.coalesce(F.col("p_encoding"), F.lit("utf-8")))
    header_row = F.when(has("no_header"), F.lit(None).cast("bigint")) \
        .when(has("header_detection"), F.col("effective_offset")) \
        .otherwise(F.coalesce(F.col("p_header_row"), F.lit(0).cast("bigint")))
    n_rows = F.when(garbled_c, F.lit(1)).when(mixed_c, F.col("n_mixed_rows")).otherwise(F.lit(0))
    return df.select(
        "file_id", "primary_class", "failure_classes",
        delimiter.alias("delimiter"), encoding_c.alias("encoding"), header_row.cast("bigint").alias("header_row"),
        F.coalesce(F.col("p_engine"), F.lit("python")).alias("engine"),
        n_rows.cast("long").alias("n_row_repairs"),
    )


def row_repair_table(repairs: DataFrame, garbled: DataFrame) -> DataFrame:
    """All precomputed line replacements: mixed rows plus garbled headers."""
    g = garbled.select("file_id", F.col("line_no").alias("row_number"), "expected_field_count",
                       "actual_field_count", "observed_delimiter", "original_text", "repaired_text")
    r = repairs.select(*g.columns)
    return r.unionByName(g)


def validate(params: DataFrame, codecs: DataFrame) -> DataFrame:
    """Errors array (``field: message``) and ``valid`` per file."""
    enc_key = F.regexp_replace(F.lower(F.trim("encoding")), r"[-\s]", "_")
    df = params.withColumn("_enc_key", enc_key).join(
        codecs.withColumnRenamed("codec", "_enc_key").withColumn("_known", F.lit(True)), "_enc_key", "left")
    errs = F.array_compact(F.array(
        F.when(F.col("delimiter").isNull(), F.lit("delimiter: missing")),
        F.when(F.length("delimiter") != 1, F.lit("delimiter: must be exactly one character")),
        F.when(F.col("encoding").isNull() | (F.trim("encoding") == ""), F.lit("encoding: missing"))
         .when(F.col("_known").isNull(), F.concat(F.lit("encoding: unknown encoding "), F.trim("encoding"))),
        F.when(F.col("header_row") < 0, F.lit("header_row: must be >= 0 or null")),
        F.when(~F.col("engine").isin(*K.ENGINES), F.lit("engine: must be one of python, c, pyarrow")),
    ))
    return df.withColumn("errors", errs).drop("_enc_key", "_known").withColumn("valid", F.size("errors") == 0)


def prescription_hash(params: DataFrame, fixes: DataFrame | None = None) -> DataFrame:
    """Hash of exactly what is reviewed; an approval names this hash.

    ``fixes`` (file_id, row_number, repaired_text) binds it to every repaired
    row: 128 bits of each (row, text) are summed per file, which combines
    map-side and needs no order."""
    if fixes is None:
        digest = params.withColumn("_fixes", F.lit("0"))
    else:
        row = F.md5(F.to_json(F.struct("row_number", "repaired_text"), {"ignoreNullFields": "false"}))
        part = lambda a: F.sum(F.conv(F.substring(row, a, 15), 16, 10).cast("decimal(38,0)")).cast("string")
        per = fixes.groupBy("file_id").agg(F.concat_ws("-", part(1), part(16)).alias("_fixes"))
        digest = params.join(per, "file_id", "left").na.fill("0", ["_fixes"])
    body = F.to_json(F.struct("file_id", "delimiter", "encoding", "header_row", "engine", "n_row_repairs", "_fixes"))
    return digest.withColumn("prescription_hash", F.sha2(body, 256)).drop("_fixes")


def gate(validated: DataFrame, approvals: DataFrame) -> DataFrame:
    """Apply only when an approval row for the same prescription says
    true; a missing row is a rejection (fail safe)."""
    a = approvals.select("file_id", "prescription_hash", F.col("approved").alias("_approved"))
    df = validated.join(a, ["file_id", "prescription_hash"], "left")
    return df.withColumn("approved", F.coalesce("_approved", F.lit(False)) & F.col("valid")).drop("_approved")


def executor_path(gated: DataFrame) -> DataFrame:
    """Any row repairs -> row-level executor, else whole-file executor."""
    return gated.withColumn("executor", F.when(F.col("n_row_repairs") > 0, "row_level").otherwise("whole_file"))


def route_tier(classes: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """CSV damage first; drift only when a table is named; else healthy."""
    df = classes if tables is None else classes.join(tables, "file_id", "left")
    tbl = F.col("table_name") if "table_name" in df.columns else F.lit(None).cast("string")
    return df.select("file_id", F.when(F.col("primary_class").isNotNull(), "csv")
                     .when(tbl.isNotNull(), "drift").otherwise("healthy").alias("tier"))
