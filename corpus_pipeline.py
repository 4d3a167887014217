"""Corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the result is
written as Parquet and read again as the next stage's docs. All stages but the last
return the columns of documents.

1. quality: documents that the quality rules reject go.
2. near_duplicates: of each component of the Jaccard join one row stays, one with the
   smallest doc_id (a null id before all others); documents without words stay.
3. decontamination: documents that hold a window of a benchmark item go.
4. pii: personal data is replaced by surrogates; n_chars follows the new text.
5. packing: the texts become pieces of packed sequences.

Null and repeated doc_ids: every row is judged and kept or removed by itself. Stages 2
and 3 number the rows, written once, and the number stands for the doc_id inside."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from seamfix.llm.common import keep, without  # noqa: E402
from seamfix.llm.decontaminate import contamination  # noqa: E402
from seamfix.llm.jaccard import jaccard_join  # noqa: E402
from seamfix.llm.packing import pack  # noqa: E402
from seamfix.llm.pii import replace_pii  # noqa: E402
from seamfix.llm.quality import quality  # noqa: E402
from seamfix.llm.queries import tokenizer  # noqa: E402


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality(docs).filter("__q.kept").drop("__q")


def numbered(docs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(``docs`` with a number __row for each row, the numbers as doc_id with the texts)."""
    rows = keep(docs.withColumn("__row", F.monotonically_increasing_id()), name)
    return rows, rows.select(F.col("__row").alias("doc_id"), "text")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, texts = numbered(docs, "rows-near")
    linked = keep(jaccard_join(texts).filter("n_shingles > 0").select("doc_id", "component_id"), "rows-linked")
    # Components of two rows or more: some row's number is not the component's.
    moved = linked.filter("doc_id <> component_id")
    members = moved.union(moved.select(F.col("component_id").alias("doc_id"), "component_id").distinct())
    ids = rows.select(F.col("__row").alias("doc_id"), F.col("doc_id").cast("long").alias("did"))
    stays = (members.join(ids, "doc_id").groupBy("component_id")
             .agg(F.min(F.struct("did", "doc_id"))["doc_id"].alias("doc_id")).select("doc_id"))
    return without(rows, members.select("doc_id").join(stays, "doc_id", "left_anti"), "__row").drop("__row")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows, texts = numbered(docs, "rows-clean")
    return without(rows, contamination(texts, benchmark).filter("contaminated").select("doc_id"), "__row").drop("__row")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = replace_pii(docs).drop("__pii")
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*[F.col(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer())


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage),
          ("decontamination", decontamination_stage), ("pii", pii_stage), ("packing", packing_stage)]

#: Surrogate texts and the packing plan can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
