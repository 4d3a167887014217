"""Skew-safe numbering, the text source, and Spark vs DuckDB oracles."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_mod
from seamfix.plans.compare import compare, duck
from seamfix.plans.numbering import number_rows
from seamfix.session import scratch_path
from seamfix.sources.lines import scan_lines

SF = "/root/testdata/sf0.001"


def test_number_rows_with_hot_group(spark):
    # one group holds most rows; numbering must still be dense and ordered
    df = spark.range(0, 5000).select(F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 5).alias("g"),
                                     (F.col("id") * 7).alias("k"))
    out = number_rows(df, "g", "k", out="n", total="tot", chunks=16, group_bound=5)
    rows = out.collect()
    by = {}
    for r in rows:
        by.setdefault(r["g"], []).append((r["k"], r["n"], r["tot"]))
    for g, items in by.items():
        items.sort()
        assert [n for _, n, _ in items] == list(range(1, len(items) + 1))
        assert {t for _, _, t in items} == {len(items)}


def test_text_scan_numbering_across_splits(spark):
    root = scratch_path(spark, "split-test")
    os.makedirs(root, exist_ok=True)
    with open(os.path.join(root, "big.csv"), "w") as fh:
        for i in range(1, 20001):
            fh.write(f"{i},row{i}\n")
            if i % 1000 == 0:
                fh.write("   \n")  # blank lines are not numbered
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        lines = scan_lines(spark, root)
        got = lines.select("line_no", "raw", "n_lines").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 20000
    assert all(r["raw"] == f"{r['line_no']},row{r['line_no']}" for r in got)
    assert {r["n_lines"] for r in got} == {20000}


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    assert df.count() == 64
    assert df.columns == ["file_id", "failure_classes", "n_classes"]


@pytest.mark.parametrize("name", ["failure_classes", "mixed_rows", "repair_rows", "schema_diff", "operations_kept",
                                  "latency_summary", "episode_state", "publish_uri", "encoding_evidence"])
def test_oracle(spark, name):
    r = compare(entry_mod.queries()[name](spark, SF), entry_mod.oracle_sql()[name], duck(SF))
    assert r["rows_spark"] == r["rows_oracle"] and r["cols_match"] and r["hash_match"], r
