"""Operator 12: source divergence audit by single-pass in-memory indexing.

How the sources of a language differ in their use of terms: between each pair of sources,
and term by term against the whole language.

1. Each task indexes its documents in memory: (term, source) to occurrences and documents,
   arrays of a block of texts at a time. When ``HELD`` postings are held, they leave as a
   run: in order of their terms (63-bit hashes of them), dealt to hash shards, cut into blocks.
2. A shard's blocks arrive by their first term and wait on a heap. Each time, the blocks
   that begin below the next one's first term leave it and are merged up to there, so a
   task holds about a block of each run, and each term's postings come together as its
   frequencies; terms in fewer than ``min_docs`` documents of their language go.
3. Shares are exact integers, ``1 + floor(scale * (n + smooth) / (N + smooth * V))``. For a
   pair of sources the divergence is V times the distance of their shares of an absent
   term, plus corrections: for the terms that one of them has, from its counts alone, and
   for the terms that both have, streamed from the frequencies in one pass and summed by
   pair before they are shuffled.

Defined cases: null text, language and source count as empty; a group without terms, and a
language without kept terms, still has its rows (value 0 without kept terms); repeated rows
count one by one; doc_ids and extra columns are ignored; an empty table gives an empty
result. Terms of equal hash would count as one: about 1e-7 expected at 1e6 terms."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep
from .words import Hasher, blocks, word_table

#: Bytes of terms: all but the separators (letters are lower-cased first).
TERMS = word_table([(0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
HELD = 1 << 20  # postings of a run
BLOCK_ROWS = 4096  # postings of a block
MERGE_ROWS = 1 << 18  # postings that come in between two merges
PAIRS_HELD = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A block: its distinct terms by hash, its groups, and of each posting the places of both.
RUN = {"shard": pa.int32(), "first": pa.int64(), "hashes": pa.list_(pa.int64()), "terms": pa.list_(pa.binary()),
       "langs": pa.list_(pa.binary()), "sources": pa.list_(pa.binary()), "t": pa.list_(pa.int32()), "g": pa.list_(pa.int32()),
       "n": pa.list_(pa.int64()), "docs": pa.list_(pa.int64())}
RUN_SCHEMA = ("shard int, first long, hashes array<long>, terms array<binary>, langs array<binary>, sources array<binary>, "
              "t array<int>, g array<int>, n array<long>, docs array<long>")


def summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[list, list]:
    """Distinct keys in order (the first counts most) with the sums of their values."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(new)
    return [k[at] for k in keys], [np.add.reduceat(v[order], at) if len(at) else v[:0] for v in values]


class Index:
    """Postings of a task: (hash of the term, group) to occurrences and documents."""

    def __init__(self, shards: int) -> None:
        self.shards, self.hasher = shards, Hasher()
        self.clear()

    def clear(self) -> None:
        self.postings, self.names, self.groups, self.size = [], [], {}, 0

    def add(self, texts: list, langs: list, sources: list) -> None:
        h, first = self.hasher.words(texts, TERMS, lower=True)
        buf = _LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
        inside = np.diff(np.concatenate(([0], TERMS[buf].astype(np.int8), [0])))
        starts, ends = np.flatnonzero(inside == 1), np.flatnonzero(inside == -1)
        group = np.array([self.groups.setdefault(g, len(self.groups)) for g in zip(langs, sources)], np.int64)
        terms, at, code = np.unique(h >> np.uint64(1), return_index=True, return_inverse=True)
        many = max(1, len(terms))
        doc_term, n = np.unique(np.repeat(np.arange(len(texts)), np.diff(first)) * many + code, return_counts=True)
        keys, place = np.unique(group[doc_term // many] * many + doc_term % many, return_inverse=True)
        terms, data = terms.astype(np.int64), buf.tobytes()
        self.postings.append((terms[keys % many] if len(keys) else terms, keys // many,
                              np.bincount(place, n, len(keys)).astype(np.int64), np.bincount(place, minlength=len(keys))))
        self.names.append((terms, [data[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]))
        self.size += len(keys)

    def compact(self) -> None:
        h, g, n, d = (np.concatenate(x) for x in zip(*self.postings))
        (h, g), (n, d) = summed([h, g], [n, d])
        self.postings, self.names, self.size = [(h, g, n, d)], [named(self.names)], len(h)

    def run(self) -> pa.RecordBatch:
        """The postings in order of their terms, dealt to shards and cut into blocks."""
        self.compact()
        (h, g, n, d), (hashes, terms) = self.postings[0], self.names[0]
        names, t = list(self.groups), np.searchsorted(hashes, h)
        width = 2**63 // self.shards + 1
        cuts = np.unique(np.concatenate((np.arange(0, len(h), BLOCK_ROWS), np.searchsorted(h, np.arange(self.shards) * width), [len(h)])))
        columns: list[list] = [[] for _ in RUN]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            low, high = int(t[a]), int(t[b - 1]) + 1
            own, place = np.unique(g[a:b], return_inverse=True)
            row = (int(h[a]) // width, int(h[a]), hashes[low:high], terms[low:high], [names[i][0] for i in own], [names[i][1] for i in own],
                   t[a:b] - low, place, n[a:b], d[a:b])
            for c, v in zip(columns, row):
                c.append(v)
        self.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, RUN.values())], list(RUN))


def named(names: list) -> tuple[np.ndarray, list]:
    """Distinct hashes in order with a term of each."""
    hashes, at = np.unique(np.concatenate([h for h, _ in names]), return_index=True)
    terms = [t for _, part in names for t in part]
    return hashes, [terms[i] for i in at.tolist()]


def runs(docs: DataFrame, shards: int, held: int) -> DataFrame:
    """Term-sorted runs in blocks (``RUN``)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(*[text(c).alias(c) for c in ("lang", "source", "text")])

    def task(batches):
        index = Index(shards)
        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b, texts in blocks(batch.column(2)):
                index.add(texts, langs[a:b], sources[a:b])
                if index.size >= held:
                    index.compact()
                    if index.size >= held // 2:
                        yield index.run()
        if index.size:
            yield index.run()

    return rows.mapInArrow(task, RUN_SCHEMA)


class Merge:
    """Merges the blocks of a shard; they arrive by their first hash."""

    def __init__(self, min_docs: int) -> None:
        self.min_docs, self.heap, self.new, self.serial = min_docs, [], 0, 0
        self.langs: dict[bytes, int] = {}
        self.groups: dict[tuple[int, bytes], int] = {}

    def add(self, block: dict) -> None:
        hashes = block["hashes"]
        lang = np.array([self.langs.setdefault(x, len(self.langs)) for x in block["langs"]], np.int64)
        group = np.array([self.groups.setdefault(x, len(self.groups)) for x in zip(lang.tolist(), block["sources"])], np.int64)
        self.push((hashes[block["t"]], lang[block["g"]], group[block["g"]], block["n"], block["docs"]), hashes, block["terms"])
        self.new += len(block["n"])

    def push(self, postings: tuple, hashes: np.ndarray, terms: list) -> None:
        self.serial += 1
        heapq.heappush(self.heap, (int(postings[0][0]), self.serial, postings, hashes, terms))

    def below(self, bound: int | None) -> pa.RecordBatch:
        """Frequencies of the kept terms with a hash below ``bound``: blocks leave the heap
        as long as one begins below it, what reaches beyond goes back."""
        ready, names, back = [], [], []
        while self.heap and (bound is None or self.heap[0][0] < bound):
            _, _, postings, hashes, terms = heapq.heappop(self.heap)
            end = len(postings[0]) if bound is None else int(np.searchsorted(postings[0], bound))
            ready.append(tuple(x[:end] for x in postings))
            names.append((hashes, terms))
            if end < len(postings[0]):
                cut = int(np.searchsorted(hashes, bound))
                back.append((tuple(x[end:] for x in postings), hashes[cut:], terms[cut:]))
        for x in back:
            self.push(*x)
        self.new = 0
        kinds = [pa.binary(), pa.binary(), pa.binary(), pa.int64()]
        if not ready:
            return pa.RecordBatch.from_arrays([pa.array([], k) for k in kinds], FREQUENCIES)
        h, lang, group, n, d = (np.concatenate(x) for x in zip(*ready))
        (h, lang, group), (n, d) = summed([h, lang, group], [n, d])
        _, (docs,) = summed([h, lang], [d])
        sizes = np.diff(np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (lang[1:] != lang[:-1]), [True]))))
        keep_rows = np.repeat(docs >= self.min_docs, sizes)
        h, lang, group, n = (x[keep_rows] for x in (h, lang, group, n))
        hashes, terms = named(names)
        lang_names, group_names = list(self.langs), [s for _, s in self.groups]
        columns = [[lang_names[i] for i in lang.tolist()], [terms[i] for i in np.searchsorted(hashes, h).tolist()],
                   [group_names[i] for i in group.tolist()], n]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], FREQUENCIES)


FREQUENCIES = ["lang", "term", "source", "n"]


def frequencies(docs: DataFrame, min_docs: int, shards: int, held: int = HELD) -> DataFrame:
    """(lang, term, source, n) of the kept terms."""
    dealt = runs(docs, shards, held).repartition(shards, "shard").sortWithinPartitions("shard", "first")

    def task(batches):
        merge, shard = Merge(min_docs), None
        for batch in batches:
            for row in range(batch.num_rows):
                block = {}
                for i, name in enumerate(RUN):
                    value = batch.column(i)[row]
                    plain = name in ("shard", "first", "terms", "langs", "sources")
                    block[name] = value.as_py() if plain else value.values.to_numpy()
                if block["shard"] != shard:
                    yield merge.below(None)
                    shard = block["shard"]
                elif merge.new >= MERGE_ROWS:
                    yield merge.below(block["first"])
                merge.add(block)
        yield merge.below(None)

    out = dealt.mapInArrow(task, "lang binary, term binary, source binary, n long")
    return out.select(*[F.col(c).cast("string").alias(c) for c in FREQUENCIES[:3]], "n")


def pair_corrections(present: DataFrame) -> DataFrame:
    """(i, j, part): for i < j, what the terms that both groups have change, over
    ``present`` (ids, p, absent: lists of a term's groups); summed within the task."""

    def task(batches):
        held, size = [], 0

        def sums():
            key, of = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, of, np.concatenate([v for _, v in held]))
            return key, total

        def batch_of(key, total):
            return pa.RecordBatch.from_arrays([pa.array(key >> 32), pa.array(key & 0xFFFFFFFF), pa.array(total)], ["i", "j", "part"])

        for batch in batches:
            ids, ps, absents = (batch.column(c).flatten().to_numpy() for c in range(3))
            ends = np.cumsum(np.concatenate(([0], batch.column(0).value_lengths().to_numpy())))
            for a, b in zip(ends[:-1], ends[1:]):
                order = np.argsort(ids[a:b])
                g, p, p0 = ids[a:b][order], ps[a:b][order], absents[a:b][order]
                step = max(1, PAIRS_HELD // max(1, b - a))
                for k in range(0, b - a - 1, step):  # rows of the triangle, a bounded number at once
                    i, j = np.triu_indices(b - a - k, 1, b - a - k)
                    near = i < step
                    i, j = i[near] + k, j[near] + k
                    value = abs(p[i] - p[j]) - abs(p[i] - p0[j]) - abs(p0[i] - p[j]) + abs(p0[i] - p0[j])
                    held.append((g[i] << 32 | g[j], value))
                    size += len(i)
                    if size >= PAIRS_HELD:
                        held = [sums()]
                        size = len(held[0][0])
                        if size >= PAIRS_HELD // 2:
                            yield batch_of(*held[0])
                            held, size = [], 0
        if held:
            yield batch_of(*sums())

    return present.select("ids", "p", "absent").mapInArrow(task, "i long, j long, part long")


def one_sided(groups: DataFrame) -> DataFrame:
    """(i, j, part): for each group (its distinct shares ``ps`` of terms it has, ``hs`` how
    often each) and each other group of the language (``ids``, ``absents``)."""

    def task(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                gid, v, p0, ps, hs, ids, absents = (batch.column(c)[row].values.to_numpy() if c > 2 else batch.column(c)[row].as_py() for c in range(7))
                order = np.argsort(ps)
                p, h = ps[order], hs[order]
                count, total = np.concatenate(([0], np.cumsum(h))), np.concatenate(([0], np.cumsum(p * h)))
                at = np.searchsorted(p, absents)
                far = absents * count[at] - total[at] + (total[-1] - total[at]) - absents * (count[-1] - count[at])
                apart = abs(absents - p0)
                part = far - apart * count[-1] + np.where(ids > gid, apart * v, 0)
                other = ids != gid
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids, gid)[other]), pa.array(np.maximum(ids, gid)[other]),
                                                  pa.array(part[other])], ["i", "j", "part"])

    return groups.select("gid", "v", "p0", "ps", "hs", "ids", "absents").mapInArrow(task, "i long, j long, part long")


def share(n, total, scale: int, smooth: int):
    """1 + floor(scale * (n + smooth) / total) in exact integers."""
    return F.expr(f"1 + cast((cast({n} + {smooth} as decimal(38,0)) * {scale}) div cast({total} as decimal(38,0)) as long)")


def divergence(docs: DataFrame, min_docs: int = 30, smooth: int = 5, scale: int = 10**9, top_terms: int = 50,
               shards: int | None = None, held: int = HELD) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank.

    ``shards``: hash shards of the index (default: the session's shuffle partitions)."""
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = keep(frequencies(docs, min_docs, shards, held), "divergence-frequencies")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    kept = counts.groupBy("lang").agg(F.count_distinct("term").alias("v"), F.sum("n").alias("lang_total"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = (docs.select(blank("lang"), blank("source")).distinct().join(totals, ["lang", "source"], "left").join(kept, "lang", "left")
              .withColumn("v", F.coalesce("v", F.lit(0).cast("long")))
              .withColumn("below", F.coalesce("total", F.lit(0).cast("long")) + smooth * F.col("v"))
              .withColumn("p0", F.when(F.col("v") > 0, share("0L", "below", scale, smooth)).otherwise(F.lit(0).cast("long"))))
    groups = keep(numbered(groups), "divergence-groups")
    shares = keep(counts.join(groups.select("lang", "source", "gid", "p0", "below"), ["lang", "source"])
                  .withColumn("p", share("n", "below", scale, smooth)), "divergence-shares")

    # Pairs: one-sided parts, and corrections for terms that both groups have.
    present = shares.groupBy("lang", "term").agg(F.collect_list("gid").alias("ids"), F.collect_list("p").alias("p"), F.collect_list("p0").alias("absent"))
    none = F.array().cast("array<long>")
    used = (shares.groupBy("gid", "p").agg(F.count(F.lit(1)).alias("h")).groupBy("gid")
            .agg(F.collect_list("p").alias("ps"), F.collect_list("h").alias("hs")))
    peers = groups.groupBy("lang").agg(F.collect_list("gid").alias("ids"), F.collect_list("p0").alias("absents"))
    sided = groups.join(used, "gid", "left").withColumn("ps", F.coalesce("ps", none)).withColumn("hs", F.coalesce("hs", none)).join(peers, "lang")
    apart = one_sided(sided).unionByName(pair_corrections(present)).groupBy("i", "j").agg(F.sum("part").alias("value"))
    both = apart.unionByName(apart.select(F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    names = groups.select("gid", "lang", "source")
    pairs = (both.join(names.withColumnRenamed("gid", "i"), "i").join(names.select(F.col("gid").alias("j"), F.col("source").alias("item")), "j")
             .select("lang", "source", F.lit("pair").alias("part"), "item", "value"))

    # Terms against the language.
    whole = (counts.groupBy("lang", "term").agg(F.sum("n").alias("all")).join(kept, "lang")
             .withColumn("below", F.col("lang_total") + smooth * F.col("v")).withColumn("q", share("all", "below", scale, smooth)).select("lang", "term", "q"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = (shares.join(whole, ["lang", "term"]).filter("p > q")
             .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")))
    terms = terms.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top_terms)
    return pairs.withColumn("rank", F.row_number().over(by_value)).unionByName(terms)


def numbered(groups: DataFrame) -> DataFrame:
    """``groups`` with ``gid``, distinct and below 2**31: sorted ranges are numbered by
    task and place, the counts of the tasks before come by a small window."""
    rows = keep(groups.repartitionByRange("lang", "source").sortWithinPartitions("lang", "source")
                .withColumn("at", F.monotonically_increasing_id()), "divergence-order")
    tasks = rows.groupBy(F.shiftright("at", 33).alias("task")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select("task", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("before"))
    return (rows.withColumn("task", F.shiftright("at", 33)).join(tasks, "task")
            .withColumn("gid", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at", "task", "before"))
