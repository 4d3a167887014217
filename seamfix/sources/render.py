"""Render the driver's clean tables as damaged inputs.

The driver tables are Parquet; the engine works on raw text lines. These
functions turn ``orders`` into ``n_files`` delimited "files" with planted
faults chosen by ``file_id % 16``, and derive drift, log and audit inputs
from ``customer`` and ``events``. Everything here is a Spark job over the
whole table; nothing is sampled or capped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seamfix.plans.numbering import number_rows

ORDER_FIELDS = ["o_orderstatus", "o_orderkey", "o_custkey", "o_orderpriority"]
ZWSP = "\u200b"

# --- fixed values (rendered faults, by file_id % 16) ---------------------
# Whole-file delimiter per fault.
FAULT_DELIMITER = {1: ";", 2: "|", 8: " ", 9: "\t", 10: ":", 12: ";"}
# Preamble lines per fault.
FAULT_PREAMBLE = {
    3: ["Orders taken at the counter", "copied out by the evening shift", "northern branch"],
    11: ["Orders taken at the counter", "northern branch"],
    12: ["ledger pages of the quarter", "second copy"],
}
GARBLED_HEADER = "o_orderstatus;o_orderkey|o_custkey,o_orderpriority"
HEADERLESS_FAULTS = [4, 13]


def _case(key: Column, mapping: dict, default) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(key == k, F.lit(v)) if expr is None else expr.when(key == k, F.lit(v))
    return expr.otherwise(F.lit(default)) if expr is not None else F.lit(default)


def _join(cols: list[Column], d) -> Column:
    """Join columns with a (possibly per-row) delimiter."""
    if isinstance(d, str):
        return F.concat_ws(d, *cols)
    parts = [cols[0]]
    for c in cols[1:]:
        parts += [d, c]
    return F.concat(*parts)


def render_order_lines(spark: SparkSession, sf_dir: str, n_files: int = 64) -> DataFrame:
    """``lines(file_id bigint, line_no bigint, raw string, n_lines bigint)``.

    ``line_no`` counts non-blank lines from 1 (preamble and header
    included); ``n_lines`` is the file's total. Numbering is the two-phase
    skew-safe kind: one file may be a third of all orders.
    """
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(*ORDER_FIELDS)
    o = o.withColumn("file_id", F.col("o_custkey") % F.lit(n_files))
    numbered = number_rows(o, "file_id", "o_orderkey", out="k", total="n_data", group_bound=n_files)

    fault = F.col("file_id") % 16
    d = _case(fault, FAULT_DELIMITER, ",")
    s, ok, ck, p = (F.col(c).cast("string") for c in ORDER_FIELDS)
    k10 = F.col("k") % 10
    base = _join([s, ok, ck, p], d)
    text = (
        F.when((fault == 6) & (k10 == 3), F.concat_ws(";", s, ok, ck, p))
        .when((fault == 6) & (k10 == 5), F.concat(s, F.lit(","), ok, F.lit(";"), ck, F.lit(","), p))
        .when((fault == 7) & (k10 == 3), F.concat_ws(",", s, ok, ck, p, F.lit("extra")))
        .when((fault == 14) & (k10 == 3), F.concat_ws(",", s, ok, ck))
        .when((fault == 15) & (k10 == 3), F.concat_ws("|", s, ok, ck, p))
        .when((fault == 15) & (k10 == 5), F.concat_ws(";", s, ok, ck, p))
        .when((fault == 13) & (F.col("k") == 1), F.concat(F.lit(ZWSP), base))
        .otherwise(base)
    )
    n_pre = _case(fault, {f: len(v) for f, v in FAULT_PREAMBLE.items()}, 0)
    has_hdr = F.when(fault.isin(*HEADERLESS_FAULTS), 0).otherwise(1)
    data = numbered.select(
        "file_id",
        (F.col("k") + n_pre + has_hdr).cast("long").alias("line_no"),
        text.alias("raw"),
        (F.col("n_data") + n_pre + has_hdr).cast("long").alias("n_lines"),
    )

    # Header and preamble lines: one small row per file, exploded.
    files = numbered.groupBy("file_id").agg(F.max("n_data").alias("n_data"))
    header = (
        F.when(fault == 11, F.lit(GARBLED_HEADER))
        .when(fault == 5, F.concat(F.lit(ZWSP), _join([F.lit(c) for c in ORDER_FIELDS], d)))
        .otherwise(_join([F.lit(c) for c in ORDER_FIELDS], d))
    )
    pre_arr = F.lit(None).cast("array<string>")
    for f, pl in FAULT_PREAMBLE.items():
        pre_arr = F.when(fault == f, F.array(*[F.lit(x) for x in pl])).otherwise(pre_arr)
    pre_arr = F.coalesce(pre_arr, F.array().cast("array<string>"))
    heads = F.when(fault.isin(*HEADERLESS_FAULTS), pre_arr).otherwise(F.concat(pre_arr, F.array(header)))
    top = files.select(
        "file_id",
        F.posexplode(heads).alias("pos", "raw"),
        (F.col("n_data") + n_pre + has_hdr).cast("long").alias("n_lines"),
    ).select("file_id", (F.col("pos") + 1).cast("long").alias("line_no"), "raw", "n_lines")
    return top.unionByName(data)


ENCODINGS = ["utf-8", "iso-8859-1", "cp1252", "utf-8-sig", "utf-16-le", "utf-16-be"]  # by file_id % 6
DOCS_PER_FILE = 128


def encoded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as delimited files (file_id = doc_id div DOCS_PER_FILE) in six
    encodings: (file_id, line_no, raw, charset) with ``raw`` holding the bytes of a line.
    Whole texts, quoted, with their line ends written as \\n and \\r; every second half
    dozen of files is separated by semicolons. A file's lines lie together in their order
    (a file is written by one task), so ``stage_files(dealt=True)`` moves them no more."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "n_chars")
    d = d.withColumn("file_id", F.floor(F.col("doc_id") / DOCS_PER_FILE))
    own = Window.partitionBy("file_id").orderBy("doc_id")
    rows = d.filter("file_id is not null").repartition("file_id").withColumn("k", F.row_number().over(own).cast("long"))
    kind = F.col("file_id") % 6
    text = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit('"'), F.lit('""'))
    latin = F.regexp_replace(text, r"[^\x{0000}-\x{00FF}]", "?")
    text = F.when(kind == 1, F.regexp_replace(latin, r"[\x{0080}-\x{009F}]", "?")).when(kind == 2, F.concat(latin, F.lit(" \u0080"))).otherwise(text)
    sep = F.when(F.floor(F.col("file_id") / 6) % 2 == 0, ",").otherwise(";")
    body = F.concat(F.col("doc_id").cast("string"), sep, F.lit('"'), text, F.lit('"'), sep, F.col("n_chars").cast("string"))
    head = F.concat(F.when(kind >= 3, "\ufeff").otherwise(""), F.lit("doc_id"), sep, F.lit("name"), sep, F.lit("n_chars"))
    line = lambda no, x: F.struct(no.cast("long").alias("line_no"), x.alias("text"))
    body, head = line(F.col("k") + 1, body), line(F.lit(1), head)
    rows = rows.select("file_id", F.inline(F.when(F.col("k") == 1, F.array(head, body)).otherwise(F.array(body))))
    raw = F.when(kind.isin(1, 2), F.encode("text", "ISO-8859-1")).when(kind == 4, F.encode("text", "UTF-16LE")) \
        .when(kind == 5, F.encode("text", "UTF-16BE")).otherwise(F.col("text").cast("binary"))
    charset = F.when(kind == 4, "UTF-16LE").when(kind == 5, "UTF-16BE")
    return rows.select("file_id", "line_no", raw.cast("string").alias("raw"), charset.alias("charset"))


# --- drift inputs --------------------------------------------------------
# Versioned baselines as data: (table, version, ordinal, name, type, nullable)
BASELINE_ROWS = [
    ("customer", 1, 1, "c_custkey", "int64", False),
    ("customer", 1, 2, "c_name", "string", False),
    ("customer", 1, 3, "c_nationkey", "int64", True),
    ("customer", 1, 4, "c_acctbal", "float64", True),
    ("customer", 1, 5, "c_mktsegment", "string", True),
    ("orders", 1, 1, "o_orderkey", "int64", False),
    ("orders", 1, 2, "o_custkey", "int64", False),
    ("orders", 1, 3, "o_orderstatus", "string", True),
    ("orders", 1, 4, "o_clerk", "string", True),
    ("orders", 2, 1, "o_orderstatus", "string", True),
    ("orders", 2, 2, "o_orderkey", "int64", False),
    ("orders", 2, 3, "o_custkey", "int64", False),
    ("orders", 2, 4, "o_orderpriority", "string", True),
    ("part", 1, 1, "p_partkey", "int64", False),
    ("part", 1, 2, "p_name", "string", True),
    ("part", 1, 3, "p_size", "int64", True),
    ("part", 1, 4, "p_brand", "string", True),
]
BASELINE_SCHEMA = "table string, version int, ordinal int, name string, type string, nullable boolean"


def baselines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BASELINE_ROWS, BASELINE_SCHEMA)


def part_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline documents that derive from ``part``: a table per brand, a version per size
    (valid from that day of 2020 on), its columns the types of those parts, their types
    by the number of parts."""
    per = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy("p_brand", "p_size", "p_type").agg(F.count(F.lit(1)).alias("n"))
    kind = F.element_at(F.array(*[F.lit(t) for t in ("int64", "float64", "string")]), (F.col("n") % 3 + 1).cast("int"))
    column = F.struct(F.col("p_type").alias("name"), kind.alias("type"), (F.col("n") > 1).alias("nullable"))
    docs = per.groupBy("p_brand", "p_size").agg(F.sort_array(F.collect_list(column)).alias("columns"))
    return docs.select(F.col("p_brand").alias("table"), F.col("p_size").cast("int").alias("version"),
                       F.date_add(F.lit("2020-01-01").cast("date"), F.col("p_size").cast("int")).alias("valid_from"), "columns")


def part_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that derive from ``part``: a table (brand) is checked on days of 2020."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select(F.col("p_brand").alias("table"),
                    F.date_add(F.lit("2020-01-01").cast("date"), (F.col("p_partkey") % 60).cast("int")).alias("run_at")).distinct()


def drifted_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """"Current" customer extract: ``c_name`` renamed to ``c_full_name``,
    ``c_mktsegment`` dropped, ``c_extra`` added, ``c_nationkey`` as text
    with a prefix (so casting it back fails, C18)."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(
        "c_custkey",
        F.col("c_name").alias("c_full_name"),
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("c_nationkey"),
        "c_acctbal",
        F.concat(F.lit("x"), (F.col("c_custkey") % 7).cast("string")).alias("c_extra"),
    )


def current_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """One "current" frame per baselined table (customer drifted, others clean)."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(*ORDER_FIELDS)
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        "p_partkey", "p_name", F.col("p_size").cast("double").alias("p_size"), "p_brand")
    return {"customer": drifted_customer(spark, sf_dir), "orders": o, "part": p}


# --- audit / log inputs derived from events -------------------------------
# events.event_type -> workflow node of the rendered log line
EVENT_NODE = {
    "view": "propose",
    "click": "validate",
    "signup": "set_success",
    "purchase": "set_rejected",
    "error": "set_failure",
}
# events.event_type -> failure class carried by the rendered log line
EVENT_CLASS = {
    "view": "wrong_delimiter",
    "click": "header_detection",
    "signup": None,
    "purchase": "mixed_delimiter",
    "error": "engine_selection",
}


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured log lines derived from ``events`` (one per event)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    node = _case(F.col("event_type"), EVENT_NODE, None)
    klass = _case(F.col("event_type"), {k: v for k, v in EVENT_CLASS.items() if v}, None)
    return e.select(
        "event_id",
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("trace-"), F.col("user_id").cast("string")).alias("trace_id"),
        F.lit("csv_repair").alias("app_agent"),
        node.alias("node"),
        F.when(F.col("event_type") == "signup", F.lit("repair_completed")).otherwise(F.lit("node_finished")).alias("app_event"),
        klass.alias("failure_class"),
        F.when(F.col("event_type") == "error", F.lit("ERROR")).otherwise(F.lit("INFO")).alias("level"),
        F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("table"),
        F.col("value").alias("latency_ms"),
        "props",
    )


# events.event_type -> audited workflow step (audit tables, U1-U11)
AUDIT_STEP = {
    "view": "propose",
    "click": "validate",
    "purchase": "human_approval",
    "signup": "apply",
    "error": "reverify",
}


def audit_events(spark: SparkSession, sf_dir: str, n_files: int = 64) -> DataFrame:
    """Append-only repair events derived from ``events``: the trace of user
    u belongs to the episode of rendered file ``u % n_files``."""
    from seamfix.operators.audit import payload, step_status
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    node = _case(F.col("event_type"), AUDIT_STEP, None)
    k = F.get_json_object("props", "$.k").cast("long")
    df = e.select(
        "event_id", "user_id",
        F.concat(F.lit("ep-"), (F.col("user_id") % n_files).cast("string")).alias("episode_id"),
        node.alias("node"), k.alias("k"), F.col("value").alias("latency_ms"), F.col("ts").alias("created_ts"))
    st = step_status(F.col("node"), F.col("k"))
    return df.withColumn("status", st).withColumn("payload", payload(F.col("node"), st, F.col("k")))
