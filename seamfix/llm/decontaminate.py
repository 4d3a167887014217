"""Operator 6: benchmark decontamination by winnowing.

A window is ``T`` = 10 consecutive words of an item (a shorter item is one window
of all its words). Of the k-gram hashes of a text every run of ``w = t - k + 1``
keeps its smallest (the rightmost of equals), so two texts that share ``t`` words
share a kept k-gram at the same place of the span. Documents' and items' kept
k-grams join on their hash; each row also carries the hashes of the ``w`` windows
around it, and a hit is extended to the windows that agree at the same offset.

Items of equal word sequences are one class until the end, so copies of items
don't multiply hits. The item side is broadcast only if its counted rows fit
``BROADCAST_ROWS``; beyond, the join shuffles both sides on the hash.

Defined cases: a null or blank document has no words and is clean; items without
words match nothing; a null item_id hits but adds no id; rows that repeat a doc_id
are judged one by one; extra columns are ignored; with an empty benchmark every
document is clean."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_and_texts, keep
from .words import ALNUM, Hasher, as_long, blocks, mix

T = 10
W = 6
BROADCAST_ROWS = 400_000


def shape(t: int) -> tuple[int, int]:
    """(k, w) for windows of ``t`` words: k + w - 1 = t."""
    k = max(1, t // 2)
    return k, t - k + 1


def kept_grams(hasher: Hasher, h: np.ndarray, doc: np.ndarray, t: int):
    """(positions, hashes, window hashes [W], their masks) of all kept k-grams.

    ``doc`` is each word's document; spans never cross documents."""
    k, w = shape(t)
    n = len(h) - t + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64), [], []
    g, whole = hasher.ngrams(h, k), hasher.ngrams(h, t)
    inside = doc[:n] == doc[t - 1:]
    runs = np.lib.stride_tricks.sliding_window_view(g, w)[:n][inside]
    place = np.unique(np.flatnonzero(inside) + w - 1 - runs[:, ::-1].argmin(axis=1))
    wins, gone = [], []
    for j in range(W):
        s = place - j
        ok = (s >= 0) & (s < n) if j < w else np.zeros(len(place), bool)
        s = np.where(ok, s, 0)
        ok &= inside[s] & (doc[s] == doc[place])
        wins.append(whole[s])
        gone.append(~ok)
    return place, mix(g[place] ^ np.uint64(t)), wins, gone


FIELDS = "uid long, did long, n_words long, t int, pos int, h long, " + ", ".join(f"w{j} long" for j in range(W))


def grams(rows: DataFrame, sizes: list[int] | None) -> DataFrame:
    """FIELDS rows of (did, text): a header (pos -1) per text and its kept k-grams
    for windows of each length in ``sizes`` (None: of its own length, at most T)."""
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def task(batches):
        hasher, uid = Hasher(), TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, texts in blocks(batch.column(1)):
                h, first = hasher.words(texts, ALNUM, lower=True)
                count = np.diff(first)
                own = np.arange(uid, uid + b - a)
                uid += b - a
                none = pa.nulls(b - a, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own), pa.array(ids[a:b]), pa.array(count, pa.int64()), pa.array(np.minimum(count, T), pa.int32()),
                     pa.array(np.full(b - a, -1), pa.int32()), pa.array(as_long(mix(own.astype(np.uint64)))), *[none] * W], names)
                doc = np.repeat(np.arange(b - a), count)
                for t in sizes or range(1, T + 1):
                    part = np.flatnonzero(np.minimum(count, T)[doc] == t) if sizes is None else slice(None)
                    place, hashes, wins, gone = kept_grams(hasher, h[part], doc[part], t)
                    if not len(place):
                        continue
                    of = doc[part][place]
                    at = (np.arange(len(h))[part][place] - first[of]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own[of]), pa.array(ids[a:b][of]), pa.nulls(len(of), pa.int64()),
                         pa.array(np.full(len(of), t), pa.int32()), pa.array(at), pa.array(as_long(hashes)),
                         *[pa.array(as_long(x), mask=m) for x, m in zip(wins, gone)]], names)

    return rows.mapInArrow(task, FIELDS)


def item_classes(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((cls, ids), (did = cls, text)): items of equal word sequences."""
    text = F.regexp_replace(F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
                            r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    rows = benchmark.select(F.col("item_id").cast("string").alias("id"), F.trim(text).alias("text")).filter("text <> ''")
    rows = keep(rows.groupBy("text").agg(F.collect_set("id").alias("ids"))
                .withColumn("cls", F.xxhash64("text")), "items")
    return rows.select("cls", "ids"), rows.select(F.col("cls").alias("did"), F.col("text").cast("binary").alias("text"))


def covered(spans) -> "F.Column":
    """Words in the union of sorted (start, end) spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, x: F.struct(
        F.greatest(acc["end"], x["end"]).alias("end"),
        (acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(acc["end"], x["start"]))).cast("long").alias("n"))
    return F.aggregate(F.sort_array(spans), start, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated, spans (start and end word of each occurring window)."""
    classes, items = item_classes(benchmark)
    index = keep(grams(items, None).filter("pos >= 0"), "item-grams")
    sizes = sorted(r.t for r in index.select("t").distinct().collect())
    rows = index.count()
    index = index.select(F.col("h").alias("ih"), F.col("did").alias("cls"), F.lit(True).alias("found"),
                         *[F.col(f"w{j}").alias(f"i{j}") for j in range(W)])
    if rows <= BROADCAST_ROWS:
        index = F.broadcast(index)
    starts = F.array_compact(F.array(*[F.when(F.col(f"w{j}") == F.col(f"i{j}"), F.col("pos") - j) for j in range(W)]))
    spans = F.transform(starts, lambda s: F.struct(s.alias("start"), (s + F.col("t")).alias("end")))
    hits = (grams(ids_and_texts(docs), sizes or [T])
            .join(index, (F.col("h") == F.col("ih")) & (F.col("pos") >= 0), "left")
            .filter("pos < 0 or found")
            .select("uid", "did", "n_words", F.when(F.size(starts) > 0, F.col("cls")).alias("cls"),
                    F.when(F.col("pos") >= 0, spans).alias("spans"))
            .filter("n_words is not null or cls is not null"))
    per = keep(hits.select("uid", "did", "n_words", "cls", F.explode_outer("spans").alias("span"))
               .groupBy("uid").agg(F.max("did").alias("did"), F.max("n_words").alias("n_words"),
                                   F.collect_set("cls").alias("cls"), F.collect_set("span").alias("spans")), "hits")
    ids = (per.select("uid", F.explode("cls").alias("cls")).join(classes, "cls")
           .select("uid", F.explode("ids").alias("id")).groupBy("uid").agg(F.sort_array(F.collect_set("id")).alias("ids")))
    ids = F.coalesce("ids", F.array().cast("array<string>")), per.join(ids, "uid", "left")
    return ids[1].select(
        F.when(F.col("did") != -(2**63), F.col("did")).alias("doc_id"), "n_words", covered(F.col("spans")).alias("n_hit"),
        F.size(ids[0]).cast("long").alias("n_items"), F.sha2(F.array_join(ids[0], ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"), F.sort_array("spans").alias("spans"))
