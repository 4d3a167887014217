"""Streams with event-time windows and state: batch equality, restarts, late files, lost checkpoints."""

import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from seamfix.operators import observe as O
from seamfix.sources.logs import read_logs
from seamfix.streaming import streams as S
from seamfix.streaming import windows as W


def put(folder, name, lines, age=None):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        f.writelines((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in lines)
    if age:
        os.utime(path, (age, age))


def line(day, hour, trace, event="repair_completed", node="set_success", klass="wrong_delimiter"):
    return {"timestamp": f"2024-03-{day:02d}T{hour:02d}:10:00.000000", "trace_id": trace, "event": event, "node": node, "failure_class": klass, "event_id": 1}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_windows_equal_batch_with_restart_and_late_file(spark, tmp_path):
    src, state = str(tmp_path / "in"), str(tmp_path / "state")
    run = lambda: W.stream_windows(spark, src, "2 hours", state=state, max_files=1)
    put(src, "a.json", [line(1, 9, "t1"), line(1, 10, "t2"), line(1, 11, "t1"), line(1, 12, None), "{broken"], 1_000)
    put(src, "b.json", [line(2, 1, "t1", klass="no_header"), line(1, 23, "t3")], 2_000)  # day 1 still open
    got = run()
    assert rows(got["volume"]) == [("2024-03-01", 3), ("2024-03-02", 1)]
    got = run()  # nothing new
    assert rows(got["volume"]) == [("2024-03-01", 3), ("2024-03-02", 1)]
    put(src, "c.json", [line(2, 4, "t1"), line(2, 5, "t9", node="set_failure"), line(3, 1, "t1", event="other")], 3_000)
    put(src, "d.json", [line(1, 8, "late"), line(2, 23, "t4"), line(3, 6, "t5")], 4_000)  # day 1 has closed, day 2 not
    got = run()
    refused = {(r["trace_id"], r["reason"]) for r in got["refused"].collect()}
    assert refused == {(None, "no event time"), ("late", "late")}
    # The batch operators on all lines but the refused.
    batch = read_logs(spark, src).filter("ts is not null and (trace_id is null or trace_id <> 'late')").cache()
    assert rows(got["volume"]) == rows(O.volume_over_time(batch))
    assert rows(W.class_distribution(got["counts"])) == rows(O.class_distribution(batch))
    assert rows(W.outcome_breakdown(got["counts"])) == rows(O.outcome_breakdown(batch))
    total = read_logs(spark, src).count()
    assert batch.count() + got["refused"].count() == total
    traces = batch.filter("app_event = 'repair_completed'").select("trace_id").distinct().filter("trace_id is not null").count()
    assert W.distinct_estimate(got["sketches"]).first()["estimate"] == traces  # exact while few
    shutil.rmtree(os.path.join(state, "checkpoint"))  # a lost checkpoint: all files again, nothing twice
    again = run()
    assert rows(again["volume"]) == rows(O.volume_over_time(batch)) and again["refused"].count() == 2


def test_windows_without_files(spark, tmp_path):
    src = str(tmp_path / "none")
    os.makedirs(src)
    got = W.stream_windows(spark, src, state=str(tmp_path / "state"))
    assert got["volume"].count() == got["counts"].count() == got["refused"].count() == got["sketches"].count() == 0
    assert W.class_distribution(got["counts"]).count() == 0


def test_sketch_error(spark):
    df = spark.range(60_000).select(F.concat(F.lit("2024-01-"), (F.col("id") % 9 + 10).cast("string")).alias("day"),
                                    (F.col("id") % 41_000).cast("string").alias("trace_id"))
    days = df.groupBy("day").agg(F.hll_sketch_agg("trace_id", W.SKETCH_LG).alias("sketch"))
    for r in W.distinct_estimate(days, ["day"]).join(df.groupBy("day").agg(F.count_distinct("trace_id").alias("n")), "day").collect():
        assert abs(r["estimate"] - r["n"]) <= 3 * W.SKETCH_ERROR * r["n"]
    assert abs(W.distinct_estimate(days).first()["estimate"] - 41_000) <= 3 * W.SKETCH_ERROR * 41_000


def test_once_with_lost_checkpoint_and_old_file(spark, tmp_path):
    src, state = str(tmp_path / "in"), str(tmp_path / "state")
    names = lambda df: sorted(os.path.basename(r["path"]) for r in df.collect())
    for i in range(5):
        put(src, f"f{i}.txt", ["x"], 10_000 + i)
    assert names(S.stream_once(spark, src, state=state, max_files=2)) == [f"f{i}.txt" for i in range(5)]
    put(src, "old.txt", ["x"], 5)
    assert len(names(S.stream_once(spark, src, state=state, max_files=2))) == 6
    shutil.rmtree(os.path.join(state, "checkpoint"))
    put(src, "f1.txt", ["y"], 20_000)  # changed: handled again
    got = names(S.stream_once(spark, src, state=state, max_files=2))
    assert got == ["f0.txt", "f1.txt", "f1.txt", "f2.txt", "f3.txt", "f4.txt", "old.txt"]


def test_once_reads_only_its_buckets(spark, tmp_path, monkeypatch):
    """A batch after a lost checkpoint reads the ledger's buckets of its own files."""
    src, state = str(tmp_path / "in"), str(tmp_path / "state")
    for i in range(40):
        put(src, f"f{i}.txt", ["x"], 10_000 + i)
    S.stream_once(spark, src, state=state)
    sink = os.path.join(state, "sink")
    used = {d for _, dirs, _ in os.walk(sink) for d in dirs if d.startswith("bucket=")}
    assert 20 <= len(used) <= 40
    plan = S.ledger_of(spark, sink, spark.createDataFrame([], "path string, modificationTime timestamp, bucket int, run string, epoch int")) \
        .filter(F.col("bucket").isin([int(next(iter(used))[7:])]))
    assert "PartitionFilters: [isnotnull(bucket" in plan._jdf.queryExecution().toString()


@pytest.mark.parametrize("which", ["lines", "logs", "drift"])
def test_empty_intake(spark, tmp_path, which):
    src = str(tmp_path / "empty")
    os.makedirs(src)
    if which == "lines":
        out = S.for_each_file_batch(spark, src, lambda b: b.select("file_id", F.length("raw").alias("n")), "x", state=str(tmp_path / "s"))
        assert out.columns == ["file_id", "n"]
    elif which == "logs":
        out = S.stream_logs(spark, src, state=str(tmp_path / "s"))
    else:
        base = spark.createDataFrame([], "table string, version int, ordinal int, name string, type string, nullable boolean")
        out = S.stream_drift(spark, src, base, "customer", state=str(tmp_path / "s"))
    assert out.count() == 0
