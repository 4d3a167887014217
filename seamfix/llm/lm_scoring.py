"""Operator 3: language-model scoring by cross-entropy difference.

A target model (documents marked good) and a background model (all documents) of
the same order, smoothing and vocabulary score every document: the mean over its
tokens of background loss less target loss (nats; higher is closer to the target).

* Tokens are lower-cased words. Words and bigrams are keyed by hashes, by default in
  2**WORD_BITS and 2**PAIR_BITS slots. ``op3_lm_scoring`` passes ``FULL`` for both:
  64-bit keys, so the counts grow with the corpus and distinct bigrams stay apart.
* Documents are written once as runs of about ``RUN`` tokens, numbered by the run's own
  words. A run sends its distinct keys with their counts, one sorted block per shard of
  the keys; each shard adds up its blocks and sends the totals back in the order in which
  the keys came, so no key travels twice and no row is made for a bigram.
* The models are matched: the background's counts are scaled to the target's number
  of tokens, so both are smoothed alike.

Bigram probabilities are Dirichlet-smoothed with the unigram model, which is smoothed
with the uniform one over the slots, or with full keys over the corpus's distinct words
and one unseen word. Both losses are taken once for each distinct bigram of a run.

Defined cases: null, empty or blank text has no tokens, null losses and score 0; null
marks and null doc_ids are not target; repeated rows count and score one by one; extra
columns are ignored; without target documents every score is 0."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, list_column
from .words import NON_SPACE, Hasher, blocks, pair_hashes

WORD_BITS = 18
PAIR_BITS = 21
FULL = 64
MU = 200.0
#: Tokens and documents at which a run ends (a document is never cut).
RUN = 1 << 21
#: Tokens to a shard of the bigrams, and the most such shards, as a run has a block in each;
#: words have a quarter of the shards.
SHARD, MAX_SHARDS = 1 << 21, 1 << 13

RUN_COLUMNS = "run long, doc_ids array<long>, lengths array<long>, n_tokens long, n_words long, words binary, ids binary"
BLOCK_COLUMNS = "run long, shard long, size long, keys binary, n binary, t binary"
TOTAL_COLUMNS = "run long, shard long, size long, n binary, t binary, distinct long, all_n long, all_t long"
SCORE_COLUMNS = "doc_id long, n_tokens long, target_loss double, background_loss double"


def packed(values: np.ndarray) -> bytes:
    """64-bit numbers as compressed bytes: all first bytes, all second bytes and so on."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T), "zstd", asbytes=True)


def unpacked(data: bytes, size: int) -> np.ndarray:
    """The ``size`` numbers of ``packed``, as unsigned ones."""
    if not size:
        return np.empty(0, np.uint64)
    planes = np.frombuffer(pa.decompress(data, 8 * size, "zstd"), np.uint8).reshape(8, size)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel()


def steps(values: np.ndarray) -> np.ndarray:
    """Differences modulo 2**64; ``np.cumsum`` gives the values back."""
    return np.diff(values, prepend=np.uint64(0))


def joined(parts: list) -> np.ndarray:
    return np.concatenate([np.empty(0, np.uint64), *parts])


def first_seen(values: np.ndarray):
    """(distinct values by first place, the number of each value among them)."""
    coded = pa.array(values).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy()


def runs_of(rows: DataFrame) -> DataFrame:
    """RUN_COLUMNS over (text, doc_id): the documents of a run, their lengths, the hashes of
    the run's distinct words, frequent ones first, and each token's number among them."""
    names, limit = ["run", "doc_ids", "lengths", "n_tokens", "n_words", "words", "ids"], RUN

    def row(run, hashes, lengths, doc_ids):
        words, ids = first_seen(np.concatenate(hashes))
        order = np.lexsort((words, -np.bincount(ids)))  # small numbers, small steps of the hashes
        words, ids = words[order], np.argsort(order)[ids]
        doc_ids = pa.chunked_array(doc_ids).combine_chunks()
        offsets = pa.array([0, len(doc_ids)], pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array([run]), pa.ListArray.from_arrays(offsets, doc_ids), list_column(np.concatenate(lengths), [len(doc_ids)]),
             pa.array([len(ids)]), pa.array([len(words)]), pa.array([packed(steps(words))]), pa.array([packed(ids)])], names)

    def task(batches):
        hasher, run, held, size = Hasher(), TaskContext.get().partitionId() << 33, [], 0
        for batch in batches:
            for a, b, texts in blocks(batch.column(0)):
                h, first = hasher.words(texts, NON_SPACE, lower=True)
                held.append((h, np.diff(first), batch.column(1).slice(a, b - a)))
                size += len(h) + b - a
                if size >= limit:
                    yield row(run, *zip(*held))
                    run, held, size = run + 1, [], 0
        if held:
            yield row(run, *zip(*held))

    return rows.mapInArrow(task, RUN_COLUMNS)


class Run:
    """A row of ``runs_of`` with its bigrams: ``before`` and ``word`` of the distinct ones (as
    word numbers), ``of`` the bigram of each token that is ``inside``, not the first of a text;
    sorted distinct keys of words and bigrams, and the key of each word and bigram (``at``)."""

    def __init__(self, table: pa.Table, word_bits: int, pair_bits: int) -> None:
        row = table.drop_columns(["doc_ids", "lengths"]).to_pylist()[0]
        self.run, n = row["run"], row["n_words"]
        self.doc_ids, lengths = (table[c].combine_chunks().flatten() for c in ("doc_ids", "lengths"))
        self.lengths = lengths.to_numpy()
        words, self.ids = np.cumsum(unpacked(row["words"], n), dtype=np.uint64), unpacked(row["ids"], row["n_tokens"]).astype(np.int64)
        self.inside = np.ones(len(self.ids), bool)
        self.inside[(np.cumsum(self.lengths) - self.lengths)[self.lengths > 0]] = False
        pairs, self.of = first_seen((self.ids[:-1] * n + self.ids[1:])[self.inside[1:]])
        self.before, self.word = np.divmod(pairs, max(n, 1))
        hashes = pair_hashes(words[self.before], words[self.word])
        self.word_keys, self.word_at = np.unique(words >> np.uint64(64 - word_bits), return_inverse=True)
        self.pair_keys, self.pair_at = np.unique(hashes >> np.uint64(64 - pair_bits), return_inverse=True)


def block_rows(keys: np.ndarray, of: np.ndarray, marks: np.ndarray, bits: int, shards: int):
    """(shard, size, keys, n, t) for each shard: its keys as packed steps, the occurrences of
    each, and those in the target; ``of`` is the key of each token, ``marks`` the target's."""
    n, t = (np.bincount(of, x, len(keys)).astype(np.int64) for x in (None, marks))
    edges = np.array([(s << bits) // shards for s in range(1, shards)], np.uint64)
    ends = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
    for s, (a, b) in enumerate(zip(ends, ends[1:])):
        yield s, b - a, packed(steps(keys[a:b])), packed(n[a:b]), packed(t[a:b])


def key_blocks(runs: DataFrame, marks: DataFrame, bits: tuple[int, int], shards: tuple[int, int]) -> DataFrame:
    """BLOCK_COLUMNS: the keys of each run, by shard. ``bits``, ``shards``: of words and of bigrams.
    Words come first, with a block in each of their shards even without keys; bigrams have the
    shards after them. ``marks``: (run, places) of its target documents."""

    def task(left, right):
        rows = []
        for i in range(len(left)):
            run = Run(left.slice(i, 1), *bits)
            if not len(run.ids):
                continue
            target = np.zeros(len(run.lengths), np.int64)
            for places in right.column("places").to_pylist():
                target[places] = 1
            target = np.repeat(target, run.lengths)
            rows += [(run.run, *x) for x in block_rows(run.word_keys, run.word_at[run.ids], target, bits[0], shards[0])]
            rows += [(run.run, shards[0] + s, size, *x) for s, size, *x in block_rows(
                run.pair_keys, run.pair_at[run.of], target[run.inside], bits[1], shards[1]) if size]
        columns = zip(*rows) if rows else [[]] * 6
        types = [pa.int64()] * 3 + [pa.binary()] * 3
        return pa.table([pa.array(c, k) for c, k in zip(columns, types)], ["run", "shard", "size", "keys", "n", "t"])

    return runs.groupBy("run").cogroup(marks.groupBy("run")).applyInArrow(task, BLOCK_COLUMNS)


def shard_totals(key_rows: DataFrame) -> DataFrame:
    """TOTAL_COLUMNS: for each block, in the order of its keys, the totals over all blocks of its
    shard; besides, the shard's distinct keys and their totals."""

    def task(table):
        rows = table.to_pylist()
        keys = joined([np.cumsum(unpacked(r["keys"], r["size"]), dtype=np.uint64) for r in rows])
        distinct, of = np.unique(keys, return_inverse=True)
        n, t = (np.bincount(of, joined([unpacked(r[c], r["size"]) for r in rows]), len(distinct)).astype(np.int64) for c in "nt")
        ends = np.cumsum([r["size"] for r in rows])
        parts = [of[e - r["size"]:e] for e, r in zip(ends, rows)]
        every = [pa.array([int(x)] * len(rows)) for x in (len(distinct), n.sum(), t.sum())]
        return pa.table([table["run"], table["shard"], table["size"], pa.array([packed(n[p]) for p in parts], pa.binary()),
                         pa.array([packed(t[p]) for p in parts], pa.binary()), *every],
                        ["run", "shard", "size", "n", "t", "distinct", "all_n", "all_t"])

    return key_rows.groupBy("shard").applyInArrow(task, TOTAL_COLUMNS)


def run_losses(runs: DataFrame, totals: DataFrame, bits: tuple[int, int], word_shards: int) -> DataFrame:
    """SCORE_COLUMNS: a row per document, from its run and the totals of the run's keys."""
    names = ["doc_id", "n_tokens", "target_loss", "background_loss"]

    def task(left, right):
        tables = [scored(left.slice(i, 1), right) for i in range(len(left))]
        return pa.concat_tables(tables) if tables else pa.table([[]] * 4, names)

    def scored(row, totals):
        run = Run(row, *bits)
        rows = sorted(totals.to_pylist(), key=lambda r: r["shard"])
        of_words, of_pairs = [r for r in rows if r["shard"] < word_shards], [r for r in rows if r["shard"] >= word_shards]
        distinct, nb, nt = (float(sum(r[c] for r in of_words)) for c in ("distinct", "all_n", "all_t"))
        wb, wt = (joined([unpacked(r[c], r["size"]) for r in of_words]).astype(float)[run.word_at] for c in "nt")
        pb, pt = (joined([unpacked(r[c], r["size"]) for r in of_pairs]).astype(float)[run.pair_at] for c in "nt")
        size = float(2**bits[0]) if bits[0] < FULL else distinct + 1.0
        if not nt:  # no target: both models are the background
            nt, wt, pt = nb, wb, pb
        doc = np.repeat(np.arange(len(run.lengths)), run.lengths)
        losses = []
        for w, p, f in ((wt, pt, 1.0), (wb, pb, nt / max(nb, 1.0))):
            one = (w * f + 1.0) / (nt + size)
            two = (p * f + MU * one[run.word]) / (w[run.before] * f + MU)
            token = np.empty(len(run.ids))
            token[~run.inside] = -np.log(one[run.ids[~run.inside]])
            token[run.inside] = -np.log(two)[run.of]
            mean = np.bincount(doc, token, len(run.lengths)) / np.maximum(run.lengths, 1)
            losses.append(pa.array(mean, mask=run.lengths == 0))
        return pa.table([run.doc_ids, pa.array(run.lengths), *losses], names)

    return runs.groupBy("run").cogroup(totals.groupBy("run")).applyInArrow(task, SCORE_COLUMNS)


def lm_scores(docs: DataFrame, target_ids: DataFrame, word_bits: int = WORD_BITS, pair_bits: int = PAIR_BITS) -> DataFrame:
    """One row per document: doc_id, n_tokens, target_loss, background_loss, score.

    ``word_bits``, ``pair_bits``: both ``FULL``, or slots of at most 20 and 23 bits.
    ``target_ids``: column doc_id of the documents that make the target model."""
    if (word_bits, pair_bits) != (FULL, FULL) and (word_bits > 20 or pair_bits > 23):
        raise ValueError("slots have at most 20 and 23 bits")
    bits = (word_bits, pair_bits)
    ids = target_ids.select(F.col("doc_id").cast("long").alias("__id")).filter("__id is not null").distinct()
    rows = docs.select(F.col("text").cast("string").cast("binary").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    runs = keep(runs_of(rows), "lm-runs")
    tokens = runs.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    of_pairs = min(MAX_SHARDS, tokens // SHARD + 1)
    shards = (of_pairs // 4 + 1, of_pairs)
    # Marks come by a join on ids alone: a document's place in its run stands for its text.
    places = runs.select(F.col("run").alias("marked"), F.posexplode("doc_ids").alias("place", "doc_id"))
    marks = (places.join(ids, F.col("doc_id") == F.col("__id")).groupBy(F.col("marked").alias("run"))
             .agg(F.collect_list("place").alias("places")))
    totals = shard_totals(key_blocks(runs, marks, bits, shards))
    out = run_losses(runs, totals, bits, shards[0])
    return out.select("doc_id", "n_tokens", "target_loss", "background_loss",
                      F.coalesce(F.col("background_loss") - F.col("target_loss"), F.lit(0.0)).alias("score"))
