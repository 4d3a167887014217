"""The query catalogue: one Spark builder per operator family.

Each builder takes (spark, sf_dir) and returns a DataFrame whose column
names and types match the DuckDB oracle of the same name in
``seamfix.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamfix.operators import detect as D
from seamfix.plans.joins import sized_broadcast
from seamfix.session import cut_lineage
from seamfix.sources.render import render_order_lines

N_FILES = 64
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


_RENDERED: dict[tuple, str] = {}


class Lazy(dict):
    """Named steps of a run, each built (and its lineage cut written) on
    first use, so a query pays only for the steps it reads."""

    def __init__(self):
        super().__init__()
        self._steps: dict[str, Callable[[], DataFrame]] = {}

    def add(self, name: str, step: Callable[[], DataFrame]) -> None:
        self._steps[name] = step

    def __missing__(self, name: str) -> DataFrame:
        value = self[name] = self._steps[name]()
        return value


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The damaged files rendered from ``orders``, written once per session
    to the shared folder (test input derived from the driver table, not
    engine work) so queries do not repeat the rendering shuffle."""
    key = (spark.sparkContext.applicationId, sf_dir, N_FILES)
    path = _RENDERED.get(key)
    if path is not None:
        try:
            return spark.read.parquet(path)
        except Exception:  # noqa: BLE001 - folder cleaned up: render again
            _RENDERED.pop(key, None)
    df = cut_lineage(render_order_lines(spark, sf_dir, N_FILES).sortWithinPartitions("file_id", "line_no"), "rendered")
    _RENDERED[key] = df.inputFiles()[0].rsplit("/", 1)[0]
    return df


def detected(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return D.detect(rendered(spark, sf_dir), N_FILES, lines_materialized=True)


# ------------------------------------------------------------ detection
@query("scan_numbered_lines")
def q_scan_numbered_lines(spark, sf_dir):
    return rendered(spark, sf_dir).select("file_id", "line_no", "raw", "n_lines")


@query("sample_head")
def q_sample_head(spark, sf_dir):
    from seamfix.sources.lines import sample_head
    return sample_head(rendered(spark, sf_dir))


@query("delimiter_vote")
def q_delimiter_vote(spark, sf_dir):
    return D.delimiter_vote(D.shape_groups(rendered(spark, sf_dir))) \
        .select("file_id", "n_lines", "whole_delim", "tail_delim", "delimiter")


@query("field_count_histogram")
def q_field_count_histogram(spark, sf_dir):
    lines = rendered(spark, sf_dir)
    groups = D.shape_groups(lines)
    vote = D.delimiter_vote(groups)
    g = groups.join(vote.select("file_id", F.col("delimiter").alias("cand")), ["file_id", "cand"])
    return g.groupBy("file_id", F.col("fc").alias("field_count")).agg(F.sum("cnt").alias("n_rows"))


@query("detect_wrong_delimiter")
def q_detect_wrong_delimiter(spark, sf_dir):
    st = D.structure(rendered(spark, sf_dir))
    return st.filter((F.col("n_lines") >= 2) & (F.col("delimiter") != ",")).select("file_id", "delimiter")


@query("detect_single_column")
def q_detect_single_column(spark, sf_dir):
    st = D.structure(rendered(spark, sf_dir))
    return st.filter((F.col("n_lines") >= 2) & F.col("single_column")).select("file_id", "n_lines")


@query("header_offset")
def q_header_offset(spark, sf_dir):
    c = detected(spark, sf_dir)["classes"]
    return c.filter(F.col("effective_offset").isNotNull()).select(
        "file_id", F.col("offset").alias("header_offset"), "effective_offset",
        F.array_contains("failure_classes", "header_detection").alias("header_detection"))


@query("garbled_header")
def q_garbled_header(spark, sf_dir):
    lines = rendered(spark, sf_dir)
    g = D.garbled_header(lines, D.structure(lines), N_FILES)
    return g.select("file_id", F.col("line_no").cast("long").alias("line_no"), "observed_delimiter", "repaired_text")


@query("numeric_columns")
def q_numeric_columns(spark, sf_dir):
    lines = rendered(spark, sf_dir)
    return D.numeric_columns(lines, D.structure(lines), N_FILES)


def _class_files(spark, sf_dir, name):
    c = detected(spark, sf_dir)["classes"]
    return c.filter(F.array_contains("failure_classes", name)).select("file_id")


@query("detect_no_header")
def q_detect_no_header(spark, sf_dir):
    return _class_files(spark, sf_dir, "no_header")


@query("detect_invisible")
def q_detect_invisible(spark, sf_dir):
    return _class_files(spark, sf_dir, "invisible_characters")


@query("mixed_rows")
def q_mixed_rows(spark, sf_dir):
    d = detected(spark, sf_dir)
    return D.row_repairs(d["disagree"], d["classes"]).select(
        "file_id", "row_number", "expected_field_count", "actual_field_count",
        "observed_delimiter", "original_text", "repaired_text")


@query("failure_classes")
def q_failure_classes(spark, sf_dir):
    c = detected(spark, sf_dir)["classes"]
    return c.select("file_id", F.array_join("failure_classes", ",").alias("failure_classes"),
                    F.size("failure_classes").cast("long").alias("n_classes"))


@query("primary_class")
def q_primary_class(spark, sf_dir):
    c = detected(spark, sf_dir)["classes"]
    return c.filter(F.col("primary_class").isNotNull()).select("file_id", "primary_class")


# ------------------------------------------------- proposal, gate, repair
def repair_run(spark: SparkSession, sf_dir: str, with_defaults: bool = False,
               lines: DataFrame | None = None, encoding: DataFrame | None = None) -> dict[str, DataFrame]:
    """Detect -> propose -> validate -> approve -> apply, over all files.

    Approvals are data: the reviewer approves the reviewed prescription
    (by its hash) of every file except those with ``file_id % 8 = 7``.
    """
    from seamfix.operators import propose as P
    from seamfix.operators import repair as R
    given = lines is not None
    # Other inputs: their encodings have a row per file; else the planner and AQE judge sizes.
    bound = N_FILES if not given else encoding.count() if encoding is not None else None
    # Written once, as detection, proposal and repair all read them.
    lines = cut_lineage(lines.sortWithinPartitions("file_id", "line_no"), "lines") if given else rendered(spark, sf_dir)
    d = D.detect(lines, bound, encoding, encoding, lines_materialized=True)
    repairs = D.row_repairs(d["disagree"], d["classes"])
    p10 = P.single_column_delimiter(lines, d["structure"], bound)
    supplied = None
    if with_defaults:
        supplied = d["classes"].select("file_id", "primary_class").join(
            P.default_prescriptions(spark).withColumnRenamed("failure_class", "primary_class"), "primary_class") \
            .select("file_id", "delimiter", "encoding", "header_row", "engine")
    out = Lazy()
    out.update(d)
    out.update({"lines": lines, "p10": p10, "bound": bound})
    out.add("params", lambda: P.propose(d["classes"], d["garbled"], repairs, p10, encoding, supplied))

    def gated():
        hashed = P.prescription_hash(P.validate(out["params"], P.known_codecs(spark)), out["fixes"])
        approvals = hashed.select("file_id", "prescription_hash", (F.col("file_id") % 8 != 7).alias("approved"))
        return cut_lineage(P.executor_path(P.gate(hashed, approvals)))

    out.add("gated", gated)
    # Written, so the planner sees its real size: a small table is joined to
    # the lines by broadcast (no shuffle of the lines), a large one by a
    # merge join on (file_id, line_no), which no hot file can skew.
    out.add("fixes", lambda: cut_lineage(P.row_repair_table(repairs, d["garbled"]), "fixes"))
    out.add("applied", lambda: R.apply_repairs(lines, out["gated"], out["fixes"], bound))
    for key in ("out", "errors", "files"):
        out.add(key, lambda key=key: out["applied"][key])
    return out


def _params_cols(df):
    return df.select("file_id", "delimiter", "encoding", "header_row", "engine", "n_row_repairs")


@query("propose_params")
def q_propose_params(spark, sf_dir):
    return _params_cols(repair_run(spark, sf_dir)["params"])


@query("merge_proposals")
def q_merge_proposals(spark, sf_dir):
    return _params_cols(repair_run(spark, sf_dir, with_defaults=True)["params"])


@query("propose_single_column")
def q_propose_single_column(spark, sf_dir):
    return repair_run(spark, sf_dir)["p10"]


@query("validate_params")
def q_validate_params(spark, sf_dir):
    g = repair_run(spark, sf_dir)["gated"]
    return g.select("file_id", "valid", F.array_join("errors", "; ").alias("errors"))


@query("review_report")
def q_review_report(spark, sf_dir):
    g = repair_run(spark, sf_dir)["gated"]
    summary = F.concat(
        F.lit("classes="), F.array_join("failure_classes", ","),
        F.lit("; delimiter="), F.coalesce("delimiter", F.lit("?")),
        F.lit("; header_row="), F.coalesce(F.col("header_row").cast("string"), F.lit("none")),
        F.lit("; row_repairs="), F.col("n_row_repairs").cast("string"))
    return g.select("file_id", "primary_class", summary.alias("summary"))


@query("approval_gate")
def q_approval_gate(spark, sf_dir):
    return repair_run(spark, sf_dir)["gated"].select("file_id", "valid", "approved", "executor")


@query("route_tier")
def q_route_tier(spark, sf_dir):
    from seamfix.operators.propose import route_tier
    c = detected(spark, sf_dir)["classes"]
    tables = c.select("file_id", F.when(F.col("file_id") % 2 == 0, F.lit("orders")).alias("table_name"))
    return route_tier(c, tables)


def _out_for(spark, sf_dir, cond):
    r = repair_run(spark, sf_dir)
    files = r["gated"].filter(cond).select("file_id")
    return r["out"].join(files, "file_id", "left_semi").select("file_id", "line_no", "text")


@query("repair_rows")
def q_repair_rows(spark, sf_dir):
    return _out_for(spark, sf_dir, F.col("executor") == "row_level")


@query("repair_preamble")
def q_repair_preamble(spark, sf_dir):
    return _out_for(spark, sf_dir, F.col("header_row") > 0)


@query("repair_whole_file")
def q_repair_whole_file(spark, sf_dir):
    return _out_for(spark, sf_dir, F.col("executor") == "whole_file")


@query("repair_errors")
def q_repair_errors(spark, sf_dir):
    return repair_run(spark, sf_dir)["errors"]


@query("parse_repaired")
def q_parse_repaired(spark, sf_dir):
    out = repair_run(spark, sf_dir)["out"]
    parsed = out.withColumn("fields", F.split("text", ",", -1))
    return parsed.groupBy("file_id").agg(
        (F.count(F.lit(1)) - 1).alias("n_rows"),
        F.min_by(F.size("fields"), "line_no").cast("long").alias("n_cols"))


def _written_and_verified(spark, sf_dir):
    from seamfix.operators import repair as R
    from seamfix.session import scratch_path
    from seamfix.sources import sinks as S
    r = repair_run(spark, sf_dir)
    root = scratch_path(spark, "repaired")
    S.write_canonical(r["out"], root)
    back = S.read_canonical(spark, root)
    return r, back, R.verify_output(back, R.output_delimiters(r["gated"]))


@query("verify_widths")
def q_verify_widths(spark, sf_dir):
    _, _, v = _written_and_verified(spark, sf_dir)
    return v.select("file_id", "n_lines", "header_width", "verified")


@query("verify_missing_output")
def q_verify_missing_output(spark, sf_dir):
    from seamfix.operators import repair as R
    r, _, v = _written_and_verified(spark, sf_dir)
    return R.missing_output(r["files"].select("file_id"), v)


@query("file_status")
def q_file_status(spark, sf_dir):
    from seamfix.operators import repair as R
    r, _, v = _written_and_verified(spark, sf_dir)
    return R.file_status(r["classes"], r["gated"], r["files"], v).select("file_id", "status", "success")


@query("write_canonical")
def q_write_canonical(spark, sf_dir):
    _, back, _ = _written_and_verified(spark, sf_dir)
    return back.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_lines"))


@query("source_unchanged")
def q_source_unchanged(spark, sf_dir):
    """Render the sources to files, hash them, run the repair from the
    files, hash again; whether each file is unchanged (expected: all)."""
    from seamfix.session import scratch_path
    from seamfix.sources import sinks as S
    from seamfix.sources.lines import file_digests
    src_root = scratch_path(spark, "sources")
    S.write_canonical(rendered(spark, sf_dir).select("file_id", "line_no", F.col("raw").alias("text")), src_root)
    before = cut_lineage(file_digests(spark, src_root + "/*/*.txt"))
    lines = S.read_canonical(spark, src_root).select("file_id", "line_no", F.col("text").alias("raw"), "n_lines")
    out_root = scratch_path(spark, "repaired")
    S.refuse_collision(out_root, [src_root])
    S.write_canonical(repair_run(spark, sf_dir, lines=lines)["out"], out_root)
    after = file_digests(spark, src_root + "/*/*.txt")
    from seamfix.operators.repair import source_unchanged
    file_id = F.regexp_extract("file_id", r"file_id=(-?\d+)", 1).cast("long")
    return source_unchanged(before, after).groupBy(file_id.alias("file_id")).agg(F.bool_and("unchanged").alias("unchanged"))


# ------------------------------------------------------------- schema drift
def drift_run(spark: SparkSession, sf_dir: str, apply: bool = False) -> dict:
    """Inspect -> diff -> hints -> confirm -> operations -> gate -> apply.

    Decisions as data: the confirmer confirms a hint when similarity >= 0.6
    and the types agree (confidence 0.9); the episode history rejected any
    earlier ``drop`` of a column named like ``extra``; the approver approves
    every table whose prescription is valid and not escalated.
    """
    from seamfix.operators import drift as C
    from seamfix.sources.render import baselines, current_tables
    tables = current_tables(spark, sf_dir)
    out = Lazy()
    out.add("tables", lambda: tables)
    out.add("current", lambda: cut_lineage(C.inspect_schema(tables)))
    out.add("base", lambda: cut_lineage(C.latest_baselines(baselines(spark))))
    out.add("diff", lambda: cut_lineage(C.column_diff(out["current"], out["base"])))
    out.add("no_base", lambda: C.without_baseline(out["current"], out["base"]))
    out.add("sets", lambda: C.diff_sets(out["diff"], out["current"].select("table").distinct()))
    out.add("hints", lambda: cut_lineage(C.rename_hints(C.rename_candidates(out["diff"]))))

    def renames():
        hints = out["hints"]
        types = out["diff"].select("table", "column", F.coalesce("from_type", "to_type").alias("t"))
        conf = hints.join(types.withColumnRenamed("column", "removed_column").withColumnRenamed("t", "rt"),
                          ["table", "removed_column"]) \
            .join(types.withColumnRenamed("column", "added_column").withColumnRenamed("t", "at"), ["table", "added_column"]) \
            .select("table", "removed_column", "added_column",
                    ((F.col("similarity") >= 0.6) & (F.col("rt") == F.col("at"))).alias("confirmed"),
                    F.lit(0.9).alias("llm_confidence"))
        return C.confirm_renames(hints, conf)

    def kept():
        ops = out["ops"]
        rejected = ops.filter((F.col("op") == "drop") & F.col("column").contains("extra"))
        return C.drop_rejected(ops, rejected)

    out.add("renames", renames)
    out.add("ops", lambda: cut_lineage(C.operations(out["diff"], out["renames"])))
    out.add("kept", kept)
    out.add("ordered", lambda: cut_lineage(C.order_operations(C.op_errors(out["kept"]))))
    out.add("presc", lambda: cut_lineage(C.prescriptions(out["kept"], out["sets"].filter("has_changes").select("table"))
                                         .withColumn("approved", F.col("valid") & ~F.col("escalated"))))
    if apply:
        out.update(_apply_drift(spark, tables, out["ordered"], out["presc"]))
    return out


def _apply_drift(spark, tables, ordered, presc):
    """Apply the approved prescriptions table by table; the projection of
    each table is built from its few operation rows, the data work runs on
    Spark, and the output is written and re-read for verification."""
    from seamfix.operators import drift as C
    from seamfix.session import scratch_path
    approved = [r["table"] for r in presc.filter("approved").select("table").collect()]
    op_rows = [r.asDict() for r in ordered.filter(F.col("table").isin(approved or ["-"])).orderBy("table", "exec_order").collect()]
    schemas, checks, results = [], [], []
    for t in approved:
        ops = [o for o in op_rows if o["table"] == t]
        bad = C.cast_failures(tables[t], ops)
        for col, n in bad.items():
            target = next(o["target_type"] for o in ops if o["op"] == "cast" and o["column"] == col)
            checks.append((t, col, target, n))
        new, errors, _ = C.apply_operations(tables[t], ops)
        errors += [f"cast {c}: {n} values not parseable" for c, n in bad.items() if n > 0]
        if errors:
            results.append((t, False, "; ".join(errors)))
            continue
        path = scratch_path(spark, f"drift-{t}")
        new.write.mode("overwrite").parquet(path)
        back = spark.read.parquet(path)
        for i, f in enumerate(back.schema.fields):
            schemas.append((t, i + 1, f.name, C.spark_type_to_logical(f.dataType)))
        results.append((t, True, None))
    schema_df = spark.createDataFrame(
        schemas, "table string, ordinal long, name string, type string")
    check_df = spark.createDataFrame(checks, "table string, column string, target_type string, n_unparseable long")
    res_df = spark.createDataFrame(results, "table string, applied boolean, apply_error string")
    verify = C.verify_operations(schema_df, ordered.join(res_df.filter("applied").select("table"), "table", "left_semi"))
    return {"out_schema": schema_df, "cast_checks": check_df, "applied": res_df, "verify": verify}


@query("schema_inspect")
def q_schema_inspect(spark, sf_dir):
    return drift_run(spark, sf_dir)["current"].select("table", "ordinal", "name", "type", "nullable")


@query("schema_baseline")
def q_schema_baseline(spark, sf_dir):
    return drift_run(spark, sf_dir)["base"].select("table", F.col("version").cast("long").alias("version"),
                                                   "ordinal", "name", "type")


@query("schema_diff")
def q_schema_diff(spark, sf_dir):
    return drift_run(spark, sf_dir)["diff"]


@query("schema_sets")
def q_schema_sets(spark, sf_dir):
    s = drift_run(spark, sf_dir)["sets"]
    return s.select("table", *[F.col(c).cast("long").alias(c) for c in ["n_added", "n_removed", "n_type_changed"]],
                    "has_changes")


@query("rename_hints")
def q_rename_hints(spark, sf_dir):
    h = drift_run(spark, sf_dir)["hints"]
    return h.select("table", "removed_column", "added_column", F.round("similarity", 4).alias("similarity"))


@query("rename_blend")
def q_rename_blend(spark, sf_dir):
    r = drift_run(spark, sf_dir)["renames"]
    return r.select("table", "removed_column", "added_column", F.round("confidence", 4).alias("confidence"))


def _ops_cols(df):
    return df.select("table", "seq", "op", "column", "target_column", "target_type", "default",
                     F.round("confidence", 4).alias("confidence"))


@query("operations")
def q_operations(spark, sf_dir):
    return _ops_cols(drift_run(spark, sf_dir)["ops"])


@query("operations_kept")
def q_operations_kept(spark, sf_dir):
    return _ops_cols(drift_run(spark, sf_dir)["kept"])


@query("operations_ordered")
def q_operations_ordered(spark, sf_dir):
    o = drift_run(spark, sf_dir)["ordered"]
    return o.select("table", "exec_order", "op", "column", "in_order",
                    F.array_join("errors", "; ").alias("errors"))


@query("escalation")
def q_escalation(spark, sf_dir):
    p = drift_run(spark, sf_dir)["presc"]
    return p.select("table", "n_ops", F.round("confidence", 4).alias("confidence"), "valid", "escalated", "approved")


@query("drift_review")
def q_drift_review(spark, sf_dir):
    """Review text per drifted table, one line per difference."""
    d = drift_run(spark, sf_dir)["diff"]
    line = F.when(F.col("kind") == "type_changed",
                  F.concat(F.lit("~ "), F.col("column"), F.lit(": "), F.col("from_type"), F.lit(" -> "), F.col("to_type"))) \
        .when(F.col("kind") == "added", F.concat(F.lit("+ "), F.col("column"), F.lit(": "), F.col("to_type"))) \
        .otherwise(F.concat(F.lit("- "), F.col("column")))
    return d.groupBy("table").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("kind", "column", line.alias("l")))), lambda x: x["l"]), "\n").alias("review"))


@query("apply_operations")
def q_apply_operations(spark, sf_dir):
    return drift_run(spark, sf_dir, apply=True)["out_schema"]


@query("cast_check")
def q_cast_check(spark, sf_dir):
    return drift_run(spark, sf_dir, apply=True)["cast_checks"]


@query("verify_operations")
def q_verify_operations(spark, sf_dir):
    return drift_run(spark, sf_dir, apply=True)["verify"]


@query("drift_status")
def q_drift_status(spark, sf_dir):
    """Failed (no baseline), healthy (no drift), invalid, rejected,
    failed, succeeded."""
    r = drift_run(spark, sf_dir, apply=True)
    v = r["verify"].groupBy("table").agg(F.count_if(F.col("error").isNotNull()).alias("n_verify_errors"))
    df = r["sets"].select("table", "has_changes").join(r["presc"], "table", "left") \
        .join(r["applied"], "table", "left").join(v, "table", "left") \
        .join(r["no_base"].withColumn("no_base", F.lit(True)), "table", "left")
    status = F.when(F.col("no_base"), "failed").when(~F.col("has_changes"), "healthy").when(~F.col("valid"), "invalid") \
        .when(~F.col("approved"), "rejected").when(~F.coalesce("applied", F.lit(False)), "failed") \
        .when(F.coalesce("n_verify_errors", F.lit(0)) > 0, "failed").otherwise("succeeded")
    return df.select("table", status.alias("status"),
                     F.coalesce("applied", F.lit(False)).alias("applied"),
                     status.isin("healthy", "succeeded").alias("success"))


def _headerless(spark, sf_dir):
    from seamfix.operators import drift as C
    from seamfix.sources.render import baselines
    lines = rendered(spark, sf_dir)
    first = lines.filter(F.col("line_no") == 1).select("file_id", F.posexplode(F.split("raw", ",", -1)).alias("pos", "value"))
    hf = first.select("file_id", F.lit("orders").alias("table"), (F.col("pos") + 1).cast("long").alias("ordinal"), "value")
    base = C.latest_baselines(baselines(spark))
    return lines, base, C.looks_headerless(hf, base)


@query("headerless_check")
def q_headerless_check(spark, sf_dir):
    _, _, h = _headerless(spark, sf_dir)
    return h.select("file_id", "headerless")


@query("assign_header")
def q_assign_header(spark, sf_dir):
    """C17: headerless files get the baseline names by position; the first
    row stays data (confidence 1.0)."""
    lines, base, h = _headerless(spark, sf_dir)
    names = base.filter(F.col("table") == "orders").groupBy("table").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "name"))), lambda x: x["name"]), ",")
        .alias("header"))
    files = h.filter("headerless").select("file_id")
    counts = lines.join(files, "file_id", "left_semi").groupBy("file_id").agg(F.count(F.lit(1)).alias("n_rows")) \
        .withColumn("table", F.lit("orders"))
    return counts.join(F.broadcast(names), "table").select("file_id", "header", "n_rows", F.lit(1.0).alias("confidence"))


# ------------------------------------------------------- logs and dashboards
def ingested_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines derived from ``events`` written as NDJSON to the shared
    folder and ingested back (keys to top level, renames, parse errors)."""
    from seamfix.session import scratch_path
    from seamfix.sources.logs import read_logs, write_ndjson
    from seamfix.sources.render import event_logs
    path = write_ndjson(event_logs(spark, sf_dir), scratch_path(spark, "logs"))
    return cut_lineage(read_logs(spark, path))


@query("log_ingest")
def q_log_ingest(spark, sf_dir):
    g = ingested_logs(spark, sf_dir)
    return g.select("event_id", "trace_id", "node", "app_event", "app_agent", "level", "failure_class", "table",
                    "latency_ms", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts_text"),
                    F.date_format("log_date", "yyyy-MM-dd").alias("log_date"), "parse_error")


@query("volume_over_time")
def q_volume_over_time(spark, sf_dir):
    from seamfix.operators.observe import volume_over_time
    return volume_over_time(ingested_logs(spark, sf_dir))


@query("class_distribution")
def q_class_distribution(spark, sf_dir):
    from seamfix.operators.observe import class_distribution
    return class_distribution(ingested_logs(spark, sf_dir))


@query("outcome_breakdown")
def q_outcome_breakdown(spark, sf_dir):
    from seamfix.operators.observe import outcome_breakdown
    return outcome_breakdown(ingested_logs(spark, sf_dir))


@query("trace_explorer")
def q_trace_explorer(spark, sf_dir):
    from seamfix.operators.observe import trace_explorer
    return trace_explorer(ingested_logs(spark, sf_dir), "trace-7")


@query("latency_summary")
def q_latency_summary(spark, sf_dir):
    from seamfix.operators.observe import latency_summary
    return latency_summary(ingested_logs(spark, sf_dir))


# ------------------------------------------------------------ audit tables
def audit_run(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    from seamfix.operators import audit as U
    from seamfix.sources.render import audit_events
    out = Lazy()
    out.add("events", lambda: cut_lineage(audit_events(spark, sf_dir, N_FILES)))
    out.add("episodes", lambda: cut_lineage(U.episodes(detected(spark, sf_dir)["classes"], out["events"])))
    return out


@query("audit_events")
def q_audit_events(spark, sf_dir):
    from seamfix.operators.audit import ts_text
    ev = audit_run(spark, sf_dir)["events"]
    return ev.select("episode_id", "event_id", "node", "status", "latency_ms", ts_text(F.col("created_ts")).alias("created_at"))


@query("audit_payload")
def q_audit_payload(spark, sf_dir):
    ev = audit_run(spark, sf_dir)["events"]
    return ev.select("event_id", F.get_json_object("payload", "$.step").alias("step"),
                     F.get_json_object("payload", "$.status").alias("status"),
                     F.get_json_object("payload", "$.k").cast("long").alias("k"))


@query("episode_state")
def q_episode_state(spark, sf_dir):
    from seamfix.operators.audit import episode_state
    r = audit_run(spark, sf_dir)
    return episode_state(r["episodes"], r["events"])


@query("episode_history")
def q_episode_history(spark, sf_dir):
    from seamfix.operators.audit import ts_text
    ev = audit_run(spark, sf_dir)["events"]
    return ev.filter(F.col("episode_id") == "ep-1").orderBy("created_ts", "event_id").select(
        "episode_id", "event_id", "node", "status", ts_text(F.col("created_ts")).alias("created_at"))


@query("recent_episodes")
def q_recent_episodes(spark, sf_dir):
    from seamfix.operators.audit import ts_text
    eps = audit_run(spark, sf_dir)["episodes"]
    return eps.orderBy(F.desc("started_ts"), F.asc("episode_id")).limit(5).select(
        "episode_id", "primary_class", ts_text(F.col("started_ts")).alias("started_at"))


@query("orphan_events")
def q_orphan_events(spark, sf_dir):
    from seamfix.operators.audit import orphan_events
    r = audit_run(spark, sf_dir)
    return orphan_events(r["events"], r["episodes"]).select("event_id", "episode_id")


def _spans(spark, sf_dir):
    ev = audit_run(spark, sf_dir)["events"]
    return ev.select(
        F.concat(F.lit("trace-"), F.col("user_id").cast("string")).alias("trace_id"),
        F.when(F.col("node").isin("validate", "human_approval"), "CHAT_MODEL").otherwise("TOOL").alias("span_type"),
        F.col("k").alias("input_tokens"), F.round("latency_ms").cast("long").alias("output_tokens"),
        (F.col("k") + F.round("latency_ms").cast("long")).alias("total_tokens"),
        F.when(F.col("node") == "human_approval", F.col("latency_ms") / 1000).alias("cost"))


@query("token_rollup")
def q_token_rollup(spark, sf_dir):
    from seamfix.operators.audit import token_rollup
    t = token_rollup(_spans(spark, sf_dir))
    return t.withColumn("cost", F.round("cost", 6))


@query("run_metrics")
def q_run_metrics(spark, sf_dir):
    from seamfix.operators.audit import run_metrics
    ev = audit_run(spark, sf_dir)["events"]
    runs = ev.groupBy("episode_id").agg(
        F.sum("latency_ms").alias("latency_ms"),
        F.sum(F.when(F.col("node") == "validate", F.col("k"))).alias("token_usage"),
        F.sum("k").alias("input_tokens"), F.count(F.lit(1)).alias("output_tokens"),
        (F.sum("k") + F.count(F.lit(1))).alias("total_tokens"),
        F.sum(F.when(F.col("node") == "human_approval", F.col("latency_ms") / 1000)).alias("cost"))
    return run_metrics(runs.withColumnRenamed("episode_id", "run_id")).withColumn("value", F.round("value", 6))


@query("run_status")
def q_run_status(spark, sf_dir):
    from seamfix.operators import repair as R
    from seamfix.operators.audit import run_status
    r, _, v = _written_and_verified(spark, sf_dir)
    st = R.file_status(r["classes"], r["gated"], r["files"], v)
    return st.select("file_id", "status", run_status(F.col("status")).alias("run_status"))


@query("migration_entries")
def q_migration_entries(spark, sf_dir):
    """U6 + S8/S9: one entry per non-healthy drift attempt, appended to the
    authoritative history and (best effort) to the mirror, read back."""
    from seamfix.session import scratch_path
    from seamfix.sources.sinks import append_two_sinks
    r = drift_run(spark, sf_dir)
    review = q_drift_review(spark, sf_dir)
    entries = r["presc"].join(r["base"].groupBy("table").agg(F.max("version").alias("baseline_version")), "table", "left") \
        .join(review, "table", "left").select(
            "table", F.concat(F.lit("mig-"), F.col("table")).alias("episode_id"),
            F.coalesce(F.col("baseline_version").cast("long"), F.lit(0).cast("long")).alias("baseline_version"),
            "n_ops", F.round("confidence", 4).alias("confidence"),
            F.when(~F.col("valid"), "invalid").when(~F.col("approved"), "rejected").otherwise("proposed").alias("status"),
            F.coalesce("review", F.lit("")).alias("diff"))
    primary, mirror = scratch_path(spark, "migrations"), scratch_path(spark, "migrations-mirror")
    append_two_sinks(entries, primary, mirror)
    return spark.read.parquet(primary)


# --------------------------------------------------------------- publishing
@query("publish_selection")
def q_publish_selection(spark, sf_dir):
    """Healthy -> original, repaired and verified -> output, else none."""
    from seamfix.operators import repair as R
    r, _, v = _written_and_verified(spark, sf_dir)
    st = R.file_status(r["classes"], r["gated"], r["files"], v)
    path = F.when(F.col("status") == "healthy", F.format_string("source/file_%d.csv", "file_id")) \
        .when(F.col("status") == "succeeded", F.format_string("repaired/file_%d.csv", "file_id"))
    return st.filter(path.isNotNull()).select("file_id", path.alias("publish_path"), "status")


@query("baselines_at_run")
def q_baselines_at_run(spark, sf_dir):
    """Baselines written as JSON files, read back, and for each run the columns of the
    version that was valid at its time."""
    from seamfix.session import scratch_path
    from seamfix.sources import baselines as B
    from seamfix.sources.render import part_baselines, part_runs
    path = B.write_baselines(part_baselines(spark, sf_dir), scratch_path(spark, "baselines"))
    out = B.baselines_at(B.read_baselines(spark, path + "/*/*.txt"), part_runs(spark, sf_dir))
    return out.select("table", F.date_format("run_at", "yyyy-MM-dd").alias("run_at"), "version", "ordinal", "name", "type", "nullable")


@query("publish_uri")
def q_publish_uri(spark, sf_dir):
    """Credential-free ``wasbs://container@host/name`` per page with an
    outcome; pages without an http(s) address get no URI."""
    from seamfix.functions.text import wasbs_uri
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    uri = wasbs_uri(F.col("url"))
    return p.select("page_id", uri.alias("uri"), F.when(uri.isNotNull(), "uri").otherwise("no http address").alias("outcome"))


@query("encoding_evidence")
def q_encoding_evidence(spark, sf_dir):
    """D1/D2 on byte renderings of ``documents.text``: UTF-8 for even
    doc_id, ISO-8859-1 for odd (non-Latin-1 characters become '?')."""
    from seamfix.operators.encoding import encoding_evidence
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    latin = F.encode(F.regexp_replace("text", "[^\\x{0000}-\\x{00FF}]", "?"), "ISO-8859-1")
    raw = d.select(F.col("doc_id").alias("file_id"),
                   F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(latin).alias("content"))
    return encoding_evidence(raw)


def encoded_run(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Whole texts in files of six encodings, read as bytes, judged,
    decoded, repaired."""
    from seamfix.operators.encoding import scan_decoded
    from seamfix.session import scratch_path
    from seamfix.sources.render import encoded_lines
    from seamfix.streaming.streams import FILE_ID, stage_files
    # A run per line feed: the filter reaches the documents, so each text moves once.
    rendered_lines, root = encoded_lines(spark, sf_dir), scratch_path(spark, "encoded")
    stage_files(rendered_lines.filter("charset is null"), root, dealt=True)
    for charset in ("UTF-16LE", "UTF-16BE"):
        stage_files(rendered_lines.filter(F.col("charset") == charset), root, charset, dealt=True)
    lines, enc = scan_decoded(spark, root + "/*/*.txt", FILE_ID)
    enc = cut_lineage(enc, "encodings")
    run = repair_run(spark, sf_dir, lines=lines, encoding=enc)
    run["encoding"] = enc
    return run


@query("encoding_classes")
def q_encoding_classes(spark, sf_dir):
    r = encoded_run(spark, sf_dir)
    c = r["classes"].join(r["encoding"], "file_id")
    params = r["params"].select("file_id", F.col("encoding").alias("prescribed"))
    return c.join(params, "file_id", "left").select(
        "file_id", "encoding", F.array_join("failure_classes", ",").alias("failure_classes"), "prescribed")


@query("encoding_repaired")
def q_encoding_repaired(spark, sf_dir):
    """Repaired text of the approved files and whether its output verified."""
    from seamfix.operators import repair as R
    r = encoded_run(spark, sf_dir)
    ok = R.verify_output(r["out"], R.output_delimiters(r["gated"]), r["bound"]).select("file_id", "verified")
    return r["out"].join(sized_broadcast(ok, r["bound"]), "file_id").select("file_id", "line_no", "text", "verified")


# ---------------------------------------------------------------- streaming
def _staged(spark, sf_dir, name):
    from seamfix.session import scratch_path
    from seamfix.streaming.streams import stage_files
    return stage_files(rendered(spark, sf_dir), scratch_path(spark, name))


@query("stream_detect")
def q_stream_detect(spark, sf_dir):
    """Files arriving in an intake folder are classified per micro-batch."""
    from seamfix.streaming.streams import FILE_ID, for_each_file_batch

    def classify(lines):
        c = D.detect(lines, N_FILES)["classes"]
        return c.select("file_id", F.array_join("failure_classes", ",").alias("failure_classes"),
                        F.size("failure_classes").cast("long").alias("n_classes"))
    root = _staged(spark, sf_dir, "intake-detect")
    return for_each_file_batch(spark, root + "/*/", classify, "detect", FILE_ID)


@query("stream_repair")
def q_stream_repair(spark, sf_dir):
    """Arriving files are detected, gated and repaired per micro-batch;
    repaired lines are appended to the output table."""
    from seamfix.streaming.streams import FILE_ID, for_each_file_batch
    root = _staged(spark, sf_dir, "intake-repair")
    return for_each_file_batch(
        spark, root + "/*/", lambda lines: repair_run(spark, sf_dir, lines=lines)["out"], "repair", FILE_ID)


def _ndjson(spark, sf_dir):
    from seamfix.session import scratch_path
    from seamfix.sources.logs import write_ndjson
    from seamfix.sources.render import event_logs
    return write_ndjson(event_logs(spark, sf_dir), scratch_path(spark, "logs-stream"))


@query("stream_logs")
def q_stream_logs(spark, sf_dir):
    """Continuous log ingestion (batch equivalent: log_ingest)."""
    from seamfix.streaming.streams import stream_logs
    g = stream_logs(spark, _ndjson(spark, sf_dir))
    return g.select("event_id", "trace_id", "node", "app_event", "app_agent", "level", "failure_class", "table",
                    "latency_ms", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts_text"),
                    F.date_format("log_date", "yyyy-MM-dd").alias("log_date"), "parse_error")


#: The rendered log files hold events of all days each, so no day may close between two
#: of them.
LOG_DELAY = "3650 days"


@query("stream_volume")
def q_stream_volume(spark, sf_dir):
    """T4/O1: event-time windows with watermark and state: distinct traces per day."""
    from seamfix.streaming.windows import stream_windows
    return stream_windows(spark, _ndjson(spark, sf_dir), LOG_DELAY, max_files=4)["volume"]


@query("stream_classes")
def q_stream_classes(spark, sf_dir):
    """T4/O2 from the windows' counts."""
    from seamfix.streaming.windows import class_distribution, stream_windows
    return class_distribution(stream_windows(spark, _ndjson(spark, sf_dir), LOG_DELAY, max_files=4)["counts"])


@query("stream_outcomes")
def q_stream_outcomes(spark, sf_dir):
    """T4/O3 from the windows' counts."""
    from seamfix.streaming.windows import outcome_breakdown, stream_windows
    return outcome_breakdown(stream_windows(spark, _ndjson(spark, sf_dir), LOG_DELAY, max_files=4)["counts"])


@query("stream_refused")
def q_stream_refused(spark, sf_dir):
    """T4: lines that the windows refuse (here: the cut ones, which have no event time),
    counted by reason."""
    from seamfix.streaming.windows import stream_windows
    refused = stream_windows(spark, _ndjson(spark, sf_dir), LOG_DELAY, max_files=4)["refused"]
    return refused.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("volume_sketches")
def q_volume_sketches(spark, sf_dir):
    """O1, approximate: sketches per day from the stream, united over the days of a month;
    the exact counts, and whether the estimates are within three standard errors."""
    from seamfix.streaming.windows import SKETCH_ERROR, distinct_estimate, stream_windows
    path = _ndjson(spark, sf_dir)
    days = stream_windows(spark, path, LOG_DELAY, max_files=4)["sketches"]
    from seamfix.sources.logs import read_logs
    done = read_logs(spark, path).filter("app_event = 'repair_completed' and trace_id is not null and ts is not null")
    exact = done.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count_distinct("trace_id").alias("n_traces"))
    near = distinct_estimate(days.withColumn("month", F.substring("day", 1, 7)), ["month"])
    within = F.abs(F.col("estimate") - F.col("n_traces")) <= 1 + 3 * SKETCH_ERROR * F.col("n_traces")
    return exact.join(near, "month").select("month", "n_traces", within.alias("within_bound"))


@query("stream_drift")
def q_stream_drift(spark, sf_dir):
    """T5: drift of arriving customer extracts against the static baseline."""
    from seamfix.operators.drift import latest_baselines
    from seamfix.session import scratch_path
    from seamfix.sources.render import baselines, drifted_customer
    from seamfix.streaming.streams import stream_drift
    root = scratch_path(spark, "intake-customer")
    drifted_customer(spark, sf_dir).repartition(4).write.mode("overwrite").parquet(root)
    return stream_drift(spark, root, latest_baselines(baselines(spark)), "customer")


@query("stream_once")
def q_stream_once(spark, sf_dir):
    """The same file delivered twice is handled once."""
    from seamfix.streaming.streams import FILE_ID, stream_once
    root = _staged(spark, sf_dir, "intake-once")
    seen = stream_once(spark, root + "/*/")
    return seen.groupBy(FILE_ID(F.col("path")).alias("file_id")).agg(F.count(F.lit(1)).alias("n_seen"))
