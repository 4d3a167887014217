"""Operator 8: substring dedup over a compacted de Bruijn graph.

A window is ``T`` = 50 consecutive words of a document; every word of a window whose
words also start in a document with a smaller doc_id is removed.

1. Token k-mers (k = 25) are the graph's edges. Of each run of 25 k-mers the smallest
   hash is kept (an anchor), so every window holds an anchor, chosen by its words
   alone, and neighbouring anchors overlap or touch: an anchor, the next one and
   their distance fix all words between. About one k-mer in 13 is kept.
2. Per distinct anchor Spark sums: occurrences, smallest and largest document, and its
   successor if all occurrences have the same. Anchors of one document only drop out.
3. Two anchors are on a nonbranching path if the second follows every occurrence of
   the first and both occur equally often. Paths are compacted by pointer doubling
   joins; all occurrences of a path have the same documents, so one smallest document.
4. Source coordinates: the runs of anchors of one path in a document are settled as a
   whole. Windows whose own anchors are repeated but that lie in no single run (at
   branches and at the ends of a shared span) are verified one by one: their 64-bit
   hashes are grouped and the smallest document of each decides.
5. The spans of both kinds are cut out of the whole texts.

Work is linear in the words, also for large groups of copies: nothing is paired.

Defined cases: null, empty or short texts keep all their words; repeated rows of a
doc_id don't count as smaller than each other; a null doc_id is smaller than all
others; extra columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

import re
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, list_column, slot_table, slots
from .words import NON_SPACE, Hasher, as_long, blocks

T = 50
K = 25
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
NO_ID = -(2**63)


def anchors(hasher: Hasher, texts: list, t: int, k: int):
    """(word hashes, first, positions, anchor hashes, choice): the kept k-mers of a
    block; choice is the position kept for the run from each word on.

    Hashes have their low 5 bits free for the distance to the next anchor."""
    w = t - k
    h, first = hasher.words(texts, NON_SPACE, lower=False)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    n = len(h) - (k + w - 1) + 1
    if n <= 0:
        return h, first, np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    g = hasher.ngrams(h, k)
    inside = doc[:n] == doc[k + w - 2:]
    runs = np.lib.stride_tricks.sliding_window_view(g, w)[:n][inside]
    choice = np.full(n, -1)
    choice[inside] = np.flatnonzero(inside) + w - 1 - runs[:, ::-1].argmin(axis=1)
    place = np.unique(choice[inside])
    return h, first, place, g[place] & ~np.uint64(31), choice


def rows_of(docs: DataFrame) -> DataFrame:
    """(did, sig, text): sig tells apart rows that share a doc_id."""
    text = F.col("text").cast("string").cast("binary")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"),
                       F.coalesce(F.xxhash64(text), F.lit(0)).alias("sig"), text.alias("text"))


def anchor_lists(docs: DataFrame, t: int, k: int) -> DataFrame:
    """(did, sig, at, anchor): the anchors of each document that has some, in order."""

    def task(batches):
        hasher = Hasher()
        for batch in batches:
            for a, b, texts in blocks(batch.column(2)):
                _, first, place, g, _ = anchors(hasher, texts, t, k)
                cut = np.searchsorted(place, first)
                own = np.repeat(np.arange(b - a), np.diff(cut))
                some = np.diff(cut)
                has = some > 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).filter(pa.array(has)), batch.column(1).slice(a, b - a).filter(pa.array(has)),
                     list_column((place - first[own]).astype(np.int32), some[has], pa.int32()), list_column(as_long(g), some[has])],
                    ["did", "sig", "at", "anchor"])

    return keep(rows_of(docs).mapInArrow(task, "did long, sig long, at array<int>, anchor array<long>"), "substring-anchors")


def repeated_anchors(lists: DataFrame) -> DataFrame:
    """(a, n, low, next): anchors of at least two documents; next (successor hash and
    distance) is 0 unless every occurrence has the same."""
    gap = F.get("at", F.col("i") + 1) - F.get("at", F.col("i"))
    each = (lists.select("did", "at", "anchor", F.posexplode("anchor").alias("i", "a"))
            .select("a", "did", F.coalesce(F.get("anchor", F.col("i") + 1).bitwiseOR(gap.cast("long")), F.lit(0)).alias("next")))
    stats = each.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("did").alias("low"), F.max("did").alias("high"),
                                  F.min("next").alias("next"), F.max("next").alias("last"))
    return keep(stats.filter("low < high").select("a", "n", "low", F.when(F.col("next") == F.col("last"), F.col("next"))
                                                  .otherwise(0).alias("next")), "substring-repeated")


def compact(edges: DataFrame) -> DataFrame:
    """(a, low, path, step): each repeated anchor's nonbranching path (its first
    anchor) and its place in it, by pointer doubling."""
    after = edges.select(F.col("next").bitwiseAND(F.lit(~31)).alias("a"), F.col("a").alias("before"), F.col("n").alias("m"))
    links = after.filter("a <> 0").join(edges.select("a", "n"), "a").filter("n = m and a <> before").select("a", "before")
    now = keep(edges.join(links, "a", "left").select("a", "low", F.coalesce("before", "a").alias("path"),
                                                     F.when(F.col("before").isNull(), 0).otherwise(1).alias("step")), "substring-paths")
    while not now.filter("step > 0").isEmpty():
        back = now.filter("step > 0").select(F.col("a").alias("path"), F.col("path").alias("p2"), F.col("step").alias("s2"))
        moved = now.join(back, "path", "left")
        done = moved.select("a", "low", F.coalesce("p2", "path").alias("path"),
                            (F.col("step") + F.coalesce("s2", F.lit(0))).alias("step"), F.col("p2").isNotNull().alias("moved"))
        now = keep(done, "substring-paths")
        if now.filter("moved").isEmpty():
            break
        now = now.drop("moved")
    return now.select("a", "low", "path", "step")


def path_runs(lists: DataFrame, paths: DataFrame) -> DataFrame:
    """(did, sig, runs): per document the runs (first anchor, last anchor, smallest
    document) of consecutive anchors of one path."""
    each = lists.select("did", "sig", F.posexplode("anchor").alias("i", "a")).join(paths, "a")
    runs = each.groupBy("did", "sig", "path", (F.col("i") - F.col("step")).alias("shift")).agg(
        F.min("i").alias("i"), F.max("i").alias("j"), F.min("low").alias("low"))
    return keep(runs.groupBy("did", "sig").agg(F.sort_array(F.collect_set(F.struct("i", "j", "low"))).alias("runs")), "substring-runs")


def near_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """rows_of(docs) joined to ``ids`` on (did, sig); other texts stay out of the shuffle."""
    rows = rows_of(docs)
    return (rows.withColumn("__slot", slots(rows, "did")).join(slot_table(ids, "did"), "__slot", "left_semi")
            .drop("__slot").join(ids, ["did", "sig"]))


def settle(docs: DataFrame, runs: DataFrame, t: int, k: int) -> DataFrame:
    """(did, sig, start, length, window): spans to remove (window null) and the
    hashes of the windows that need verification (length null)."""

    def task(batches):
        hasher = Hasher()
        for batch in batches:
            found = batch.column(3)
            dids, sigs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            offs = found.offsets.to_numpy()
            part = found.flatten()
            ri, rj, rl = (part.field(c).to_numpy() for c in range(3))
            offs = offs - offs[0]
            for a, b, texts in blocks(batch.column(2)):
                h, first, place, _, choice = anchors(hasher, texts, t, k)
                whole = hasher.ngrams(h, t)
                cut = np.searchsorted(place, first)
                for d in range(b - a):
                    n, lo = first[d + 1] - first[d], offs[a + d]
                    hi = offs[a + d + 1]
                    at = place[cut[d]:cut[d + 1]] - first[d]
                    if n < t or lo == hi:
                        continue
                    i, j, low = ri[lo:hi], rj[lo:hi], rl[lo:hi]
                    s, e = at[i], at[j] + k
                    cuts = (low < dids[a + d]) & (e - s >= t)
                    mark = np.zeros(len(at) + 1, np.int64)
                    np.add.at(mark, i, 1)
                    np.add.at(mark, j + 1, -1)
                    repeated = np.cumsum(mark[:-1]) > 0
                    # A window's own anchors are those of its two runs; others in it may
                    # owe their choice to words outside it.
                    own = repeated[np.searchsorted(place, choice[first[d]:first[d] + n - t + 2]) - cut[d]]
                    start = np.arange(n - t + 1)
                    open_ = own[:-1] & own[1:]
                    step = np.zeros(n + 1, np.int64)
                    inside = e - s >= t
                    np.add.at(step, s[inside], 1)
                    np.add.at(step, e[inside] - t + 1, -1)
                    open_ &= np.cumsum(step[:-1])[:n - t + 1] == 0
                    w = start[open_]
                    total = int(cuts.sum()) + len(w)
                    if total:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(total, dids[a + d])), pa.array(np.full(total, sigs[a + d])),
                             pa.array(np.concatenate((s[cuts], w)).astype(np.int32)),
                             pa.concat_arrays([pa.array((e - s)[cuts].astype(np.int32)), pa.nulls(len(w), pa.int32())]),
                             pa.concat_arrays([pa.nulls(int(cuts.sum()), pa.int64()), pa.array(as_long(whole[first[d] + w]))])],
                            ["did", "sig", "start", "length", "window"])

    near = near_texts(docs, runs).select("did", "sig", "text", "runs")
    return keep(near.mapInArrow(task, "did long, sig long, start int, length int, window long"), "substring-windows")


def removals(settled: DataFrame, t: int) -> DataFrame:
    """(did, sig, spans): all spans to remove of each document, by start."""
    windows = settled.filter("window is not null").select("did", "sig", "start", "window")
    low = windows.groupBy("window").agg(F.min("did").alias("low"), F.max("did").alias("high")).filter("low < high")
    # Written, so that both sides of the join are plain shuffles: a hot window is split.
    low = keep(low.select("window", "low"), "substring-low")
    more = (windows.join(low, "window").filter("low < did")
            .select("did", "sig", "start", F.lit(t).alias("length")))
    spans = settled.filter("length is not null").select("did", "sig", "start", "length").unionByName(more)
    return keep(spans.groupBy("did", "sig").agg(
        F.sort_array(F.collect_set(F.struct("start", "length"))).alias("spans")), "substring-spans")


def cut_texts(rows: DataFrame) -> DataFrame:
    """(did, n_words, n_removed, kept_sha256, spans) of (did, text, spans)."""

    def task(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = _WORD.findall(text or b"")
                kept, at, union = [], 0, []
                for span in spans or ():
                    a, b = span["start"], span["start"] + span["length"]
                    if union and a <= union[-1][1]:
                        union[-1][1] = max(b, union[-1][1])
                    else:
                        union.append([a, b])
                for a, b in union:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                out.append((len(words), len(words) - len(kept), sha256(b" ".join(kept)).hexdigest(),
                            [{"start": a, "end": b} for a, b in union]))
            cols = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()),
                 pa.array(cols[3], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                ["did", "n_words", "n_removed", "kept_sha256", "spans"])

    return rows.mapInArrow(task, "did long, n_words long, n_removed long, kept_sha256 string, "
                                 "spans array<struct<start:int,end:int>>")


def substring_dedup(docs: DataFrame, t: int = T, k: int = K) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, spans removed."""
    lists = anchor_lists(docs, t, k)
    runs = path_runs(lists, compact(repeated_anchors(lists)))
    spans = removals(settle(docs, runs, t, k), t)
    rows = rows_of(docs).withColumn("__slot", F.pmod(F.xxhash64("did"), F.lit(1 << 20)).cast("int"))
    table = slot_table(spans, "did")
    none = F.lit(None).cast("array<struct<start:int,length:int>>").alias("spans")
    clear = rows.join(table, "__slot", "left_anti").select("did", "text", none)
    near = rows.join(table, "__slot", "left_semi").join(spans, ["did", "sig"], "left").select("did", "text", "spans")
    done = cut_texts(clear).unionByName(cut_texts(near))
    return done.select(F.when(F.col("did") != NO_ID, F.col("did")).alias("doc_id"), "n_words", "n_removed", "kept_sha256", "spans")
