"""Helpers of several operators: written tables, membership filters, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamfix.session import scratch_path

FILTER_BITS = 20


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again (cuts the lineage)."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def release(*kept: DataFrame) -> None:
    """Remove tables of ``keep`` that no later step reads."""
    for df in kept:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.kept_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ids_and_texts(docs: DataFrame) -> DataFrame:
    """(did, text as bytes): a null doc_id counts as the smallest long."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("did"),
                       F.col("text").cast("string").cast("binary").alias("text"))


def list_column(values: np.ndarray, lengths, kind=pa.int64()) -> pa.Array:
    """Arrow lists from all values in a row and the length of each list."""
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def slots(df: DataFrame, column: str):
    return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(1 << FILTER_BITS)).cast("int")


def slot_table(ids: DataFrame, column: str) -> DataFrame:
    """The hashed slots of ids: at most 2**20 ints whatever the number of ids,
    so they may be broadcast."""
    return F.broadcast(ids.select(slots(ids, column).alias("__slot")).distinct())


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(did, text) of the documents whose id is in ``ids`` (column did, distinct).

    A broadcast slot table of fixed size keeps most other texts out of the
    shuffle; the join is exact."""
    rows = ids_and_texts(docs)
    near = rows.withColumn("__slot", slots(rows, "did")).join(slot_table(ids, "did"), "__slot", "left_semi")
    return near.drop("__slot").join(ids.select("did"), "did", "left_semi")


def without(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose ``column`` is in ``ids`` (column doc_id).

    Rows whose slot no id has need no shuffle; the others join exactly."""
    rows = docs.withColumn("__slot", slots(docs, column))
    table = slot_table(ids, "doc_id")
    clear = rows.join(table, "__slot", "left_anti")
    near = rows.join(table, "__slot", "left_semi")
    gone = ids.select(F.col("doc_id").alias("__gone")).distinct()
    near = near.join(gone, F.col(column).eqNullSafe(F.col("__gone")), "left_anti")
    return clear.unionByName(near).select(*[F.col(c) for c in docs.columns])


def stars(edges: DataFrame) -> bool:
    """Whether ``edges`` (u, v) form stars: no u has two v or is a v itself."""
    ends = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("low")).unionByName(
        edges.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("low")))
    return ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("low").alias("low")).filter("up + low > 1 and up > 0").isEmpty()


def components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """(node, root): smallest node reachable over ``edges`` (u, v).

    Alternating large-star and small-star rounds (Kiveris et al. 2014) until the edges are
    stars; each round is a min per node and a join, so a hub's edges are never gathered.
    The joins are hinted to merge: as broadcasts they would be jobs of their own, with
    their tables on the driver."""
    now = keep(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
               .distinct(), name)
    while not stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low.hint("merge"), "u")
        small = (joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        before, now = now, keep(small, name)
        release(before)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
