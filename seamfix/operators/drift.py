"""Schema drift against versioned baselines.

Data-sized work (type inference, cast checks) is Spark aggregation over the
tables; schema-sized work (diffs, hints, operations) is a handful of rows per
table and stays in DataFrames too, so many tables are handled at once.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from seamfix import constants as K
from seamfix.functions import text as T
from seamfix.session import cut_lineage

# ------------------------------------------------------------------ S6, S7
def to_long(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, ordinal, name, v) for every cell, values as text."""
    parts = []
    for t, df in tables.items():
        cells = F.array(*[
            F.struct(F.lit(i + 1).alias("ordinal"), F.lit(c).alias("name"), F.col(c).cast("string").alias("v"))
            for i, c in enumerate(df.columns)])
        parts.append(df.select(F.lit(t).alias("table"), F.inline(cells)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def inspect_schema(tables: dict[str, DataFrame]) -> DataFrame:
    """Ordered columns with inferred logical type and nullability.

    Null-tolerant inference (missing values do not turn int64 into
    float64); the empty string counts as missing.
    """
    long = to_long(tables).withColumn("v", F.when(F.col("v") != "", F.col("v")))
    agg = long.groupBy("table", "ordinal", "name").agg(
        F.count("v").alias("n_values"),
        F.bool_and(F.col("v").isNull() | T.parses_int(F.col("v"))).alias("all_int"),
        F.bool_and(F.col("v").isNull() | T.parses_float(F.col("v"))).alias("all_float"),
        F.bool_and(F.col("v").isNull() | T.parses_bool(F.col("v"))).alias("all_bool"),
        F.max(F.col("v").isNull()).alias("nullable"),
    )
    typ = F.when(F.col("n_values") == 0, "string").when(F.col("all_int"), "int64") \
        .when(F.col("all_float"), "float64").when(F.col("all_bool"), "bool").otherwise("string")
    return agg.select("table", F.col("ordinal").cast("long").alias("ordinal"), "name", typ.alias("type"), "nullable")


def latest_baselines(baselines: DataFrame) -> DataFrame:
    """The highest version per table."""
    latest = baselines.groupBy("table").agg(F.max("version").alias("version"))
    return baselines.join(latest, ["table", "version"]).select(
        "table", "version", F.col("ordinal").cast("long").alias("ordinal"), "name",
        F.lower(F.trim("type")).alias("type"), "nullable")


# -------------------------------------------------------------------- D21
def looks_headerless(header_fields: DataFrame, baseline: DataFrame) -> DataFrame:
    """Width equal to the baseline, the baseline has a non-string
    column, and every header *name* parses as its positional baseline type.

    ``header_fields``: (file_id, table, ordinal, value) of line 1.
    """
    b = baseline.select("table", "ordinal", F.col("type").alias("btype"))
    width = b.groupBy("table").agg(F.count(F.lit(1)).alias("bw"), F.bool_or(F.col("btype") != "string").alias("typed"))
    h = header_fields.join(b, ["table", "ordinal"], "left")
    parses = F.when(F.col("btype") == "int64", T.parses_int(F.col("value"))) \
        .when(F.col("btype") == "float64", T.parses_float(F.col("value"))) \
        .when(F.col("btype") == "bool", T.parses_bool(F.col("value"))) \
        .when(F.col("btype") == "datetime", T.parses_iso_datetime(F.col("value"))) \
        .when(F.col("btype").isNotNull(), F.lit(True)).otherwise(F.lit(False))
    per = h.groupBy("file_id", "table").agg(F.count(F.lit(1)).alias("hw"), F.bool_and(parses).alias("all_parse"))
    return per.join(width, "table").select(
        "file_id", "table", ((F.col("hw") == F.col("bw")) & F.col("typed") & F.col("all_parse")).alias("headerless"))


# ------------------------------------------------------------------ C1, C2
def column_diff(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Added / removed / type_changed per table (column order ignored),
    for tables that have both a current extract and a baseline; the others
    are C22's business and get no operations."""
    both = current.select("table").distinct().join(baseline.select("table").distinct(), "table")
    c = current.select("table", "name", F.col("type").alias("to_type")).join(both, "table", "left_semi")
    b = baseline.select("table", "name", F.col("type").alias("from_type")).join(both, "table", "left_semi")
    j = c.join(b, ["table", "name"], "full_outer")
    kind = F.when(F.col("from_type").isNull(), "added").when(F.col("to_type").isNull(), "removed") \
        .when(F.col("from_type") != F.col("to_type"), "type_changed")
    return j.select("table", kind.alias("kind"), F.col("name").alias("column"), "from_type", "to_type") \
        .filter(F.col("kind").isNotNull())


def without_baseline(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Tables of the current extracts that no baseline names."""
    return current.select("table").distinct().join(baseline.select("table"), "table", "left_anti")


def diff_sets(diff: DataFrame, tables: DataFrame) -> DataFrame:
    """Per-table set sizes and whether anything changed (hints ignored)."""
    counts = diff.groupBy("table").agg(
        F.count_if(F.col("kind") == "added").alias("n_added"),
        F.count_if(F.col("kind") == "removed").alias("n_removed"),
        F.count_if(F.col("kind") == "type_changed").alias("n_type_changed"))
    out = tables.join(counts, "table", "left").na.fill(0, ["n_added", "n_removed", "n_type_changed"])
    return out.withColumn("has_changes", (F.col("n_added") + F.col("n_removed") + F.col("n_type_changed")) > 0)


# ------------------------------------------------------------- C3, C4, C5
@F.pandas_udf(ST.DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp ratio 2M/T (stdlib difflib), Arrow-batched."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def rename_candidates(diff: DataFrame, floor: float = K.RENAME_HINT_FLOOR) -> DataFrame:
    """Removed x added pairs of a table with similarity >= floor.

    Pairs are generated by an equi-join on (table, character) instead of a
    cross join: a pair sharing no character has ratio 0. The multiset of
    shared characters bounds M from above, so pairs whose bound is already
    below the floor never reach the UDF. Exact, not a heuristic.
    """
    def chars(kind, col):
        d = diff.filter(F.col("kind") == kind).select("table", F.col("column").alias(col))
        ex = d.select("table", col, F.explode(F.split(F.col(col), "")).alias("ch"))
        return ex.groupBy("table", col, "ch").agg(F.count(F.lit(1)).alias("n_" + col))
    r = chars("removed", "removed_column")
    a = chars("added", "added_column")
    shared = r.join(a, ["table", "ch"]).groupBy("table", "removed_column", "added_column").agg(
        F.sum(F.least("n_removed_column", "n_added_column")).alias("common"))
    total = F.length("removed_column") + F.length("added_column")
    bounded = shared.filter(2 * F.col("common") >= floor * total)
    sims = bounded.withColumn("similarity", ratio_udf("removed_column", "added_column"))
    return sims.filter(F.col("similarity") >= floor).select("table", "removed_column", "added_column", "similarity")


def rename_hints(candidates: DataFrame) -> DataFrame:
    """One-to-one matching per table, most similar first, ties by
    removed then added name.

    Rounds of mutual-best selection: a pair that is the best left for both
    of its columns can't be displaced by any other, so it is taken, and the
    pairs of its columns go. Every round takes the best pair of each table
    at least; rounds stop when no pair is left."""
    order = [F.desc("similarity"), F.asc("removed_column"), F.asc("added_column")]
    best = lambda side: F.row_number().over(Window.partitionBy("table", side).orderBy(*order)) == 1
    left, taken = cut_lineage(candidates, "hints"), None
    while not left.isEmpty():
        pairs = cut_lineage(left.withColumn("_r", best("removed_column")).withColumn("_a", best("added_column"))
                            .filter("_r and _a").drop("_r", "_a"), "hints")
        taken = pairs if taken is None else taken.unionByName(pairs)
        for side in ("removed_column", "added_column"):
            left = left.join(pairs.select("table", side), ["table", side], "left_anti")
        left = cut_lineage(left.select(*candidates.columns), "hints")
    return candidates if taken is None else taken


# ------------------------------------------------------------------ C6, C7
def confirm_renames(hints: DataFrame, confirmations: DataFrame) -> DataFrame:
    """Only confirmed hints survive; confidence blends similarity and
    confirmation, clamped to [0, 1]."""
    c = confirmations.filter("confirmed").select("table", "removed_column", "added_column", "llm_confidence")
    blend = K.FUZZY_WEIGHT * F.col("similarity") + K.CONFIRMATION_WEIGHT * F.col("llm_confidence")
    return hints.join(c, ["table", "removed_column", "added_column"]).withColumn(
        "confidence", F.least(F.lit(1.0), F.greatest(F.lit(0.0), blend)))


# --------------------------------------------------------- C8, C9, C10, C13
def default_for(type_col) -> F.Column:
    t = F.lower(F.trim(type_col))
    expr = None
    for alias, canon in K.TYPE_ALIASES.items():
        v = K.TYPE_DEFAULTS[canon]
        cond = t == alias
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    return expr.otherwise(F.lit(None).cast("string"))


def operations(diff: DataFrame, renames: DataFrame) -> DataFrame:
    """Rename (current -> baseline name), cast (to the baseline type,
    SURVEY Q1), add_default for unmatched removed, drop for unmatched added.
    ``seq`` keeps the synthesis order."""
    ren = renames.select("table", F.lit(0).alias("grp"), F.lit("rename").alias("op"),
                         F.col("added_column").alias("column"), F.col("removed_column").alias("target_column"),
                         F.lit(None).cast("string").alias("target_type"), F.lit(None).cast("string").alias("default"),
                         "confidence")
    cast = diff.filter(F.col("kind") == "type_changed").select(
        "table", F.lit(1).alias("grp"), F.lit("cast").alias("op"), "column", F.lit(None).cast("string").alias("target_column"),
        F.col("from_type").alias("target_type"), F.lit(None).cast("string").alias("default"), F.lit(1.0).alias("confidence"))
    removed = diff.filter(F.col("kind") == "removed").join(
        renames.select("table", F.col("removed_column").alias("column")), ["table", "column"], "left_anti")
    add = removed.select("table", F.lit(2).alias("grp"), F.lit("add_default").alias("op"), "column",
                         F.lit(None).cast("string").alias("target_column"), F.col("from_type").alias("target_type"),
                         default_for(F.col("from_type")).alias("default"), F.lit(1.0).alias("confidence"))
    added = diff.filter(F.col("kind") == "added").join(
        renames.select("table", F.col("added_column").alias("column")), ["table", "column"], "left_anti")
    drop = added.select("table", F.lit(3).alias("grp"), F.lit("drop").alias("op"), "column",
                        F.lit(None).cast("string").alias("target_column"), F.lit(None).cast("string").alias("target_type"),
                        F.lit(None).cast("string").alias("default"), F.lit(1.0).alias("confidence"))
    ops = ren.unionByName(cast).unionByName(add).unionByName(drop)
    w = Window.partitionBy("table").orderBy("grp", "column")
    return ops.withColumn("seq", F.row_number().over(w).cast("long")).drop("grp")


def drop_rejected(ops: DataFrame, rejected: DataFrame) -> DataFrame:
    """Operations rejected earlier in the same episode are not proposed
    again; key (op, column, target_column, target_type), null-safe."""
    r = rejected.select("table", F.col("op").alias("r_op"), F.col("column").alias("r_column"),
                        F.col("target_column").alias("r_target_column"), F.col("target_type").alias("r_target_type"))
    cond = (ops["table"] == r["table"]) & (ops["op"] == r["r_op"]) & (ops["column"] == r["r_column"]) \
        & ops["target_column"].eqNullSafe(r["r_target_column"]) & ops["target_type"].eqNullSafe(r["r_target_type"])
    return ops.join(r, cond, "left_anti")


def op_errors(ops: DataFrame) -> DataFrame:
    """Required fields per operation kind."""
    errs = F.array_compact(F.array(
        F.when(F.col("op").isin("rename", "assign_header") & F.col("target_column").isNull(),
               F.concat(F.col("op"), F.lit(": target_column required"))),
        F.when(F.col("op").isin("cast", "add_default") & F.col("target_type").isNull(),
               F.concat(F.col("op"), F.lit(": target_type required")))))
    return ops.withColumn("errors", errs)


# ---------------------------------------------------- C11, C12, C14, C15
def rank_of(op) -> F.Column:
    expr = None
    for name, r in K.OPERATION_RANK.items():
        expr = F.when(op == name, F.lit(r)) if expr is None else expr.when(op == name, F.lit(r))
    return expr


def order_operations(ops: DataFrame) -> DataFrame:
    """C14: execution order assign_header, rename, cast, drop, add_default,
    stable on ``seq``; ``in_order`` checks the sequence is non-decreasing."""
    w = Window.partitionBy("table").orderBy(rank_of(F.col("op")), "seq")
    o = ops.withColumn("exec_order", F.row_number().over(w).cast("long"))
    w2 = Window.partitionBy("table").orderBy("exec_order")
    return o.withColumn("in_order", F.coalesce(rank_of(F.col("op")) >= F.lag(rank_of(F.col("op"))).over(w2), F.lit(True)))


def prescriptions(kept: DataFrame, drifted: DataFrame) -> DataFrame:
    """Overall confidence = min over kept operations (1.0
    when none), no operations -> invalid, escalated = confidence < 0.7."""
    agg = kept.groupBy("table").agg(F.count(F.lit(1)).alias("n_ops"), F.min("confidence").alias("min_conf"))
    df = drifted.join(agg, "table", "left")
    return df.select(
        "table",
        F.coalesce("n_ops", F.lit(0)).cast("long").alias("n_ops"),
        F.coalesce("min_conf", F.lit(1.0)).alias("confidence"),
        (F.coalesce("n_ops", F.lit(0)) > 0).alias("valid"),
        (F.coalesce("min_conf", F.lit(1.0)) < K.CONFIDENCE_THRESHOLD).alias("escalated"),
    )


# ------------------------------------------------------------ C16 - C20
_SPARK_TYPE = {"int64": "bigint", "float64": "double", "bool": "boolean", "string": "string", "datetime": "timestamp_ntz"}


def _cast_expr(col: str, target: str) -> F.Column:
    v = F.col(col).cast("string")
    t = K.TYPE_ALIASES.get(target.strip().lower(), "string")
    if t == "int64":
        # Integers are cast as such; other numbers only when they are whole,
        # through a decimal, so no digit is lost to a double.
        plain = F.regexp_replace(F.trim(v), "_", "")
        d = F.when(T.parses_float(v), plain.try_cast("double"))
        return F.when(T.parses_int(v), plain.try_cast("bigint")) \
            .when(d == F.floor(d), plain.try_cast("decimal(38,18)").try_cast("bigint"))
    if t == "float64":
        return F.when(T.parses_float(v), F.regexp_replace(F.trim(v), "_", "").try_cast("double"))
    if t == "bool":
        return F.when(T.parses_bool(v), F.lower(F.trim(v)) == "true")
    if t == "datetime":
        return F.when(T.parses_iso_datetime(v), F.try_to_timestamp(F.trim(v)).cast("timestamp_ntz"))
    return v


def apply_operations(df: DataFrame, ops: list[dict]) -> tuple[DataFrame, list[str], list[dict]]:
    """C16-C20 on one table, in execution order. The projection is built
    from the few operation rows; the data work (cast checks) is a Spark
    aggregate. Returns (frame, errors, cast checks)."""
    errors: list[str] = []
    checks = []
    for op in ops:
        kind, col = op["op"], op["column"]
        if kind in ("rename", "assign_header"):
            if col in df.columns:
                df = df.withColumnsRenamed({col: op["target_column"]})
        elif kind == "cast":
            if col not in df.columns:
                errors.append(f"cast: column {col} not found")
                continue
            new = _cast_expr(col, op["target_type"])
            checks.append({"column": col, "target_type": op["target_type"],
                           "bad": F.count_if(F.col(col).isNotNull() & new.isNull())})
            df = df.withColumn(col, new)
        elif kind == "drop":
            if col not in df.columns:
                errors.append(f"drop: column {col} not found")
                continue
            df = df.drop(col)
        elif kind == "add_default":
            t = _SPARK_TYPE.get(K.TYPE_ALIASES.get((op["target_type"] or "string").strip().lower(), "string"), "string")
            val = op["default"]
            lit = F.lit(None).cast(t) if val is None else (
                F.lit(val.lower() == "true") if t == "boolean" else F.lit(val).cast(t))
            df = df.withColumn(col, lit)
    return df, errors, checks


def cast_failures(source: DataFrame, ops: list[dict]) -> dict[str, int]:
    """Count values that a cast cannot parse, per cast column, in ONE
    aggregate over the source table (C18: any failure fails the cast)."""
    casts = [o for o in ops if o["op"] == "cast" and o["column"] in source.columns]
    if not casts:
        return {}
    aggs = [F.count_if(F.col(o["column"]).isNotNull() & _cast_expr(o["column"], o["target_type"]).isNull())
            .alias(o["column"]) for o in casts]
    row = source.agg(*aggs).first()
    return {o["column"]: int(row[o["column"]]) for o in casts}


# ------------------------------------------------------------------- C21
def verify_operations(out_schema: DataFrame, ops: DataFrame) -> DataFrame:
    """C21 on the output schema: renamed old absent and new present; cast
    column present with the target type; dropped absent; added present."""
    names = out_schema.select("table", F.col("name").alias("_n"), F.col("type").alias("_t"))
    o = ops.alias("o")
    has_col = names.select("table", F.col("_n").alias("column"), F.col("_t").alias("col_type"))
    has_tgt = names.select("table", F.col("_n").alias("target_column"), F.lit(True).alias("tgt_present"))
    j = o.join(has_col, ["table", "column"], "left").join(has_tgt, ["table", "target_column"], "left")
    present = F.col("col_type").isNotNull()
    tgt = F.coalesce(F.col("tgt_present"), F.lit(False))
    canon_t = F.coalesce(*[F.when(F.lower(F.trim("target_type")) == a, F.lit(c)) for a, c in K.TYPE_ALIASES.items()])
    err = F.when(F.col("op").isin("rename", "assign_header") & present,
                 F.concat(F.lit("column "), F.col("column"), F.lit(" still present"))) \
        .when(F.col("op").isin("rename", "assign_header") & ~tgt,
              F.concat(F.lit("column "), F.col("target_column"), F.lit(" missing"))) \
        .when((F.col("op") == "cast") & ~present, F.concat(F.lit("column "), F.col("column"), F.lit(" missing"))) \
        .when((F.col("op") == "cast") & (F.col("col_type") != canon_t),
              F.concat(F.lit("column "), F.col("column"), F.lit(" has type "), F.col("col_type"))) \
        .when((F.col("op") == "drop") & present, F.concat(F.lit("column "), F.col("column"), F.lit(" still present"))) \
        .when((F.col("op") == "add_default") & ~present, F.concat(F.lit("column "), F.col("column"), F.lit(" missing")))
    return j.select("table", "exec_order", "op", "column", err.alias("error"))


def spark_type_to_logical(dt: ST.DataType) -> str:
    if isinstance(dt, (ST.LongType, ST.IntegerType, ST.ShortType, ST.ByteType)):
        return "int64"
    if isinstance(dt, (ST.DoubleType, ST.FloatType, ST.DecimalType)):
        return "float64"
    if isinstance(dt, ST.BooleanType):
        return "bool"
    if isinstance(dt, (ST.TimestampType, ST.TimestampNTZType, ST.DateType)):
        return "datetime"
    return "string"
