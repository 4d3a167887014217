"""Side-by-side check of a Spark query and its DuckDB oracle.

Compares row count, column names and an order-insensitive hash of the
values (columns sorted by name, values rendered as text).
"""

from __future__ import annotations

import hashlib
import math

import duckdb
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "\\N"
    if isinstance(v, float):
        if math.isnan(v):
            return "\\N"
        return f"{v:.6g}"
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, pd.Timestamp):
        return v.tz_localize(None).isoformat() if v.tzinfo else v.isoformat()
    return str(v)


def digest(pdf: pd.DataFrame) -> tuple[int, list[str], str]:
    cols = sorted(pdf.columns)
    rows = sorted("\x1f".join(_norm(r[c]) for c in cols) for r in pdf.to_dict("records"))
    h = hashlib.sha256("\x1e".join(rows).encode()).hexdigest()
    return len(rows), cols, h


def compare(spark_df, sql: str, con) -> dict:
    s = spark_df.toPandas()
    o = con.execute(sql).df()
    ns, cs, hs = digest(s)
    no, co, ho = digest(o)
    return {"rows_spark": ns, "rows_oracle": no, "cols_match": cs == co, "hash_match": hs == ho,
            "cols_spark": cs, "cols_oracle": co}
