"""The registered queries of this package: each applies its operator, with
production parameters, to its whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_decode, bpe_encode
from .decontaminate import contamination
from .divergence import divergence
from .infill import fill_in_middle, restored
from .jaccard import jaccard_join
from .langid import language_id
from .licenses import scan
from .lm_scoring import FULL, lm_scores
from .oracles import ORACLES
from .packing import pack
from .pii import pii_report
from .quality import quality_report
from .substrings import substring_dedup
from .toxicity import toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> str:
    """Place of the tokenizer of op2 and the pipeline on this machine."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).drop("class_id")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer())


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return lm_scores(table(spark, sf_dir, "documents"), good, FULL, FULL)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("spans")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii_report(table(spark, sf_dir, "documents"))
    return out.withColumn("kinds", F.array_join("kinds", ","))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    back = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(back, 256).alias("restored_sha256"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


def bpe_tokenizer() -> str:
    """Place of the tokenizer of op13 on this machine."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op13_bpe_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_decode(bpe_encode(table(spark, sf_dir, "documents"), bpe_tokenizer()), bpe_tokenizer())
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_ngram_jaccard_join, op2_best_fit_packing, op3_lm_scoring, op4_toxicity, op5_license_scan,
    op6_benchmark_decontamination, op7_quality_rules, op8_substring_dedup, op9_language_id, op10_pii_surrogates,
    op11_fill_in_middle, op12_source_divergence, op13_bpe_coding)}

__all__ = ["ORACLES", "QUERIES"]
