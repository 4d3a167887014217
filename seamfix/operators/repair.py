"""Repair execution and verification for delimited files.

Both executors work on numbered lines joined to one parameter row per file
(broadcast behind the file-count bound). Nothing is collected per file:
row-width errors stay a DataFrame (``errors``) and per-file verdicts are
algebraic aggregates (count, min), so a huge file never lands in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamfix import constants as K
from seamfix.functions import text as T
from seamfix.operators.detect import with_fields
from seamfix.plans.joins import sized_broadcast


def apply_repairs(lines: DataFrame, plan: DataFrame, row_fixes: DataFrame,
                  file_bound: int | None = None) -> dict[str, DataFrame]:
    """Run both executors for approved files.

    ``plan``: file_id, delimiter, header_row, executor, approved.
    ``row_fixes``: file_id, row_number, repaired_text (row-level path).
    Returns ``out`` (file_id, line_no, text: canonical output lines of
    files that passed), ``errors`` (file_id, row_number, error) and
    ``files`` (one verdict row per attempted file).
    """
    go = plan.filter("approved").select("file_id", "delimiter", "header_row", "executor")
    j = lines.join(sized_broadcast(go, file_bound), "file_id")
    fixes = row_fixes.select("file_id", F.col("row_number").alias("line_no"), F.col("repaired_text").alias("_fix"))
    j = j.join(fixes, ["file_id", "line_no"], "left")
    row_path = F.col("executor") == "row_level"
    j = j.withColumn("text", F.when(row_path, F.coalesce("_fix", "raw")).otherwise(F.col("raw")))
    skip = F.coalesce(F.col("header_row"), F.lit(0))
    kept = j.filter(F.col("line_no") > skip)  # R6: preamble lines dropped
    kept = with_fields(kept, raw="text", d="delimiter").withColumn("width", F.size("fields").cast("long"))

    per = kept.groupBy("file_id").agg(
        F.min_by("width", "line_no").alias("expected"),
        F.min("line_no").alias("first_line"),
        F.count(F.lit(1)).alias("n_kept"),
    )
    attempted = go.join(sized_broadcast(per, file_bound), "file_id", "left")
    k2 = kept.join(sized_broadcast(per, file_bound), "file_id")
    data_line = F.col("header_row").isNull() | (F.col("line_no") > F.col("first_line"))
    errors = k2.filter(data_line & (F.col("width") != F.col("expected"))).select(
        "file_id", F.col("line_no").alias("row_number"),
        F.format_string("row %d: expected %d fields, found %d", "line_no", "expected", "width").alias("error"))
    n_err = errors.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_errors"), F.min("row_number").alias("first_bad_row"))

    files = attempted.join(sized_broadcast(n_err, file_bound), "file_id", "left").select(
        "file_id", "executor", "header_row",
        F.coalesce("n_kept", F.lit(0)).alias("n_kept"), "expected",
        F.coalesce("n_errors", F.lit(0)).alias("n_errors"), "first_bad_row",
    ).withColumn("error", F.when(F.col("n_kept") == 0, F.lit(K.ERR_HEADER_OUT_OF_RANGE))
                 .when((F.col("executor") == "whole_file") & (F.col("expected") < 2), F.lit(K.ERR_SINGLE_COLUMN))
                 .when(F.col("n_errors") > 0, F.format_string("row %d: row width mismatch", "first_bad_row"))) \
        .withColumn("applied", F.col("error").isNull())

    ok = files.filter("applied").select("file_id")
    good = k2.join(sized_broadcast(ok, file_bound), "file_id", "left_semi")
    # Row path keeps repaired lines verbatim; whole-file path re-serialises
    # with a comma and strips invisible characters from the header names.
    is_header = F.col("header_row").isNotNull() & (F.col("line_no") == F.col("first_line"))
    names = F.when(is_header, F.transform("fields", lambda f: T.strip_invisible(f))).otherwise(F.col("fields"))
    whole_text = T.csv_join(names, F.lit(","))
    text = F.when(F.col("executor") == "row_level", F.col("text")).otherwise(whole_text)
    headerless = F.col("header_row").isNull()
    out_no = F.when(headerless, F.col("line_no") + 1).otherwise(F.col("line_no") - skip)
    out = good.select("file_id", out_no.cast("long").alias("line_no"), text.alias("text"))
    # Headerless files get positional names 0..w-1 as their header line.
    synth = files.filter(F.col("applied") & F.col("header_row").isNull()).select(
        "file_id", F.lit(1).cast("long").alias("line_no"),
        F.array_join(F.transform(F.sequence(F.lit(0), F.col("expected") - 1), lambda i: i.cast("string")), ",").alias("text"))
    return {"out": out.unionByName(synth), "errors": errors, "files": files}


def output_delimiters(gated: DataFrame) -> DataFrame:
    """(file_id, out_delimiter): row-level output keeps the file's delimiter,
    whole-file output is comma-separated."""
    return gated.select("file_id", F.when(F.col("executor") == "row_level", F.col("delimiter"))
                        .otherwise(F.lit(",")).alias("out_delimiter"))


def verify_output(out_lines: DataFrame, delimiters: DataFrame | None = None, file_bound: int | None = None) -> DataFrame:
    """R8/R9 on the output alone: >= 2 columns, no invisible characters in
    the names, every line as wide as the header under the delimiter it was
    written with (``delimiters``: file_id, out_delimiter; default comma),
    all of it valid UTF-8. One row per file."""
    if delimiters is None:
        lines = out_lines.withColumn("out_delimiter", F.lit(","))
    else:
        lines = out_lines.join(sized_broadcast(delimiters, file_bound), "file_id", "left").na.fill(",", ["out_delimiter"])
    w = lines.withColumn("width", T.field_count(F.col("text"), F.col("out_delimiter")))
    per = w.groupBy("file_id").agg(
        F.min_by("width", "line_no").alias("header_width"),
        F.min_by("text", "line_no").alias("header_text"),
        F.count_if(F.lit(True)).alias("n_lines"),
        F.min("width").alias("min_w"), F.max("width").alias("max_w"),
        F.bool_and(F.is_valid_utf8("text")).alias("utf8"),
    )
    errs = F.array_compact(F.array(
        F.when(F.col("header_width") < 2, F.lit(K.ERR_SINGLE_COLUMN)),
        F.when(T.has_invisible(F.col("header_text")), F.lit(K.ERR_INVISIBLE_IN_OUTPUT)),
        F.when(F.col("min_w") != F.col("max_w"), F.lit("row width mismatch")),
        F.when(~F.col("utf8"), F.lit("output is not valid UTF-8")),
    ))
    return per.select("file_id", "n_lines", "header_width", errs.alias("errors"),
                      (F.size(errs) == 0).alias("verified"))


def missing_output(files: DataFrame, verified: DataFrame) -> DataFrame:
    """An attempted file without output fails verification."""
    return files.join(verified.select("file_id"), "file_id", "left_anti") \
        .select("file_id", F.lit(K.ERR_NO_OUTPUT).alias("error"))


def file_status(classes: DataFrame, gated: DataFrame, files: DataFrame, verified: DataFrame) -> DataFrame:
    """Terminal status per file with its reason."""
    g = gated.select("file_id", "valid", "approved", F.col("errors").alias("validation_errors"))
    f = files.select("file_id", "applied", F.col("error").alias("apply_error"))
    v = verified.select("file_id", "verified")
    df = classes.select("file_id", "failure_classes").join(g, "file_id", "left").join(f, "file_id", "left") \
        .join(v, "file_id", "left")
    healthy = F.size("failure_classes") == 0
    status = F.when(healthy, "healthy").when(~F.col("valid"), "failed").when(~F.col("approved"), "rejected") \
        .when(~F.coalesce("applied", F.lit(False)), "failed") \
        .when(~F.coalesce("verified", F.lit(False)), "failed").otherwise("succeeded")
    reason = F.when(healthy, "no failure detected") \
        .when(~F.col("valid"), F.concat(F.lit("invalid: "), F.array_join("validation_errors", "; "))) \
        .when(~F.col("approved"), "not approved") \
        .when(~F.coalesce("applied", F.lit(False)), F.coalesce("apply_error", F.lit("not applied"))) \
        .when(~F.coalesce("verified", F.lit(False)), F.lit(K.ERR_NO_OUTPUT + " or verification failed")) \
        .otherwise("repaired and verified")
    return df.select("file_id", status.alias("status"), reason.alias("reason"),
                     (status == "succeeded").alias("success"))


def source_unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    """The sources before and after a repair run by length and content hash (column
    digest, or sha256): (file_id, before, after, unchanged), missing files included."""
    def content(df: DataFrame):
        return F.concat_ws("/", *[c for c in ("length", "digest", "sha256") if c in df.columns])
    b = before.select("file_id", content(before).alias("before"))
    a = after.select("file_id", content(after).alias("after"))
    return b.join(a, "file_id", "full_outer").withColumn("unchanged", F.col("before").eqNullSafe(F.col("after")))
