"""Operator 2: best-fit packing by length-histogram planning.

1. Documents are tokenised (ids, then the end id) and cut into pieces of at most
   ``capacity`` tokens; only longer documents are cut. The pieces are written once.
2. The counts of pieces by length (at most ``capacity`` rows) are planned on the
   driver by best-fit decreasing over counts: one step places a whole run of equal
   pieces into a whole run of equal sequences, so its cost depends on the number of
   lengths, not of documents.
3. Pieces are ranked within their length by one range shuffle and per-partition
   counts (a hot length spreads over many tasks), and take their planned slot by
   joining on length and rank.

Tokens of a text are those of its white-space separated chunks: the tokenizer drops
white space and none of its steps looks across it, so each task looks chunks up in a
bounded cache. New chunks of plain characters (``ODD``) are lower-cased and cut into
runs as the tokenizer's steps do (``STEPS``); runs have a cache of their own, and the
tokenizer is asked for new runs only, many in one text. Other chunks, and all of them
under a tokenizer of other steps, go to it whole.

Defined cases: null or empty text is the end id alone; rows that repeat a doc_id are
packed one by one; extra columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

import json
import os
import re
import sys
import types
from bisect import bisect_left, insort
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ids_and_texts, keep
from .words import blocks

CAPACITY = 2048
CACHE_ENTRIES = 400_000
RUN_ENTRIES = 600_000
CACHED_BYTES = 64
PLAN_BROADCAST_ROWS = 500_000
ENCODE_BLOCK = 4096
# --- fixed values: steps of the tokenizer before its merges, as its file has them ----
STEPS = [
    {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}]
# --------------------------------------------------------------------------------------
#: Plain characters are printable ASCII (but ' and <, which contractions and added tokens have)
#: and Latin-1 letters: NFC leaves them as they are, and each lower-cases to one of them.
#: Of lines, those with other characters.
ODD = re.compile(r"^[!-&(-;=-~\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]*[^\n!-&(-;=-~\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF].*", re.M).findall
#: What the split leaves of plain lower-case lines: letters, a digit or other signs; and line ends.
RUNS = re.compile(r"[a-z\u00DF-\u00F6\u00F8-\u00FF]+|[0-9]|\n|[^a-z0-9\n\u00DF-\u00F6\u00F8-\u00FF]+").findall
NO_ID = 2**32 - 1
BORDER = NO_ID.to_bytes(4, "little")


class ChunkEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self._tokenizer = Tokenizer.from_file(path)
        self._known: dict[bytes, bytes] = {}
        self._runs: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        suffix, vocab = data["model"].get("end_of_word_suffix"), data["model"]["vocab"]
        self._plain = bool(suffix and [data["normalizer"], data["pre_tokenizer"]] == STEPS
                           and all("<" in t["content"] for t in data["added_tokens"]))
        self._last = np.zeros(1 + max([*vocab.values(), *(t["id"] for t in data["added_tokens"])]), bool)
        self._last[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True

    def _encode(self, texts: list) -> list:
        return self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def _learn_runs(self, new: list) -> None:
        """Ids of runs: the last token of each says that it ends a run."""
        for i in range(0, len(new), ENCODE_BLOCK):
            part = new[i:i + ENCODE_BLOCK]
            ids = np.array(self._encode([" ".join(part)])[0].ids, dtype="<u4")
            ends = (4 * np.flatnonzero(self._last[ids]) + 4).tolist()
            if len(ends) != len(part):
                raise ValueError("the tokenizer does not give each run its own end")
            raw = ids.tobytes()
            self._runs.update(zip(part, map(raw.__getitem__, map(slice, [0, *ends], ends))))

    def _plain_ids(self, chunks: list) -> dict[bytes, bytes]:
        """Ids of chunks of plain characters, all of them cut at once."""
        runs = RUNS("\n".join(chunks).lower())
        wanted = set(runs)
        wanted.discard("\n")
        new = wanted.difference(self._runs)
        if len(self._runs) + len(new) > RUN_ENTRIES:
            self._runs.clear()
            new = wanted
        self._learn_runs(list(new))
        self._runs["\n"] = BORDER
        raw = b"".join(map(self._runs.__getitem__, runs))
        for r in [r for r in new if len(r) > CACHED_BYTES]:
            del self._runs[r]
        at = 4 * np.flatnonzero(np.frombuffer(raw, "<u4") == NO_ID)
        spans = map(slice, [0, *(at + 4).tolist()], [*at.tolist(), len(raw)])
        return dict(zip(map(str.encode, chunks), map(raw.__getitem__, spans)))

    def _ids(self, chunks: list) -> dict[bytes, bytes]:
        lines = b"\n".join(chunks).decode()
        whole = ODD(lines) if self._plain else lines.split("\n")
        plain = list(set(lines.split("\n")).difference(whole))
        found = self._plain_ids(plain) if plain else {}
        for i in range(0, len(whole), ENCODE_BLOCK):
            part = whole[i:i + ENCODE_BLOCK]
            found.update((s.encode(), np.array(e.ids, dtype="<u4").tobytes()) for s, e in zip(part, self._encode(part)))
        return found

    def all(self, texts: list) -> list[bytes]:
        """Ids of each text; what is new in all of them is asked for at once."""
        known, split = self._known, [(t or b"").split() for t in texts]
        here = set().union(*split)
        new = here.difference(known)
        if len(known) + len(new) > CACHE_ENTRIES:
            known.clear()
            new = here
        if new:
            known.update(self._ids(list(new)))
        out = [b"".join(map(known.__getitem__, chunks)) for chunks in split]
        for c in [c for c in new if len(c) > CACHED_BYTES]:
            del known[c]
        return out

    def __call__(self, text: bytes) -> bytes:
        return self.all([text])[0]


def encoder(path: str) -> ChunkEncoder:
    """The encoder of this worker process: later tasks find the chunks of earlier ones."""
    kept = sys.modules.setdefault("seamfix_chunk_encoders", types.ModuleType("seamfix_chunk_encoders")).__dict__
    if path not in kept:
        kept[path] = ChunkEncoder(path)
    return kept[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(did, piece, start, length, crc) of every document."""
    schema = "did long, piece int, start long, length int, crc long"

    def task(batches):
        encode, end = encoder(tokenizer_path), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            dids, kinds = batch.column(0).to_pylist(), [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
            for a, b, texts in blocks(batch.column(1)):
                rows = []
                for did, ids in zip(dids[a:b], encode.all(texts)):
                    ids += end
                    for start in range(0, len(ids) // 4, capacity):
                        part = ids[4 * start:4 * (start + capacity)]
                        rows.append((did, start // capacity, start, len(part) // 4, crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                 ["did", "piece", "start", "length", "crc"])

    return ids_and_texts(docs).mapInArrow(task, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Rows (length, rank_from, n_sequences, per_sequence, sequence_from, offset): the
    pieces of that length with ranks from rank_from on fill n_sequences consecutive
    sequences, per_sequence in each, from that offset on."""
    out, open_runs, rooms, new = [], {}, [], 0  # rooms: sorted free sizes that have runs of sequences

    def give(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in open_runs:
                open_runs[room] = []
                insort(rooms, room)
            open_runs[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = open_runs[room].pop()
                if not open_runs[room]:
                    del open_runs[room], rooms[at]
            else:
                room, first = capacity, new
                n = -(-left // (capacity // length))
                new += n
            each = room // length
            full = min(n, left // each)
            used = 0
            if full:
                out.append((length, rank, full, each, first, capacity - room))
                give(room - each * length, first, full)
                rank, left, used = rank + full * each, left - full * each, full
            if left and used < n:  # fewer than a sequence takes
                out.append((length, rank, 1, left, first + used, capacity - room))
                give(room - left * length, first + used, 1)
                left, used = 0, used + 1
            give(room, first + used, n - used)
    return out


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``rank``: the place within its length by (did, piece, start, crc).

    Sorted ranges are written with the place of each row in its task; ranks follow
    from the counts by (task, length)."""
    order = ["length", "did", "piece", "crc"]
    rows = (rows.repartitionByRange(*order).sortWithinPartitions(*order)
            .withColumn("at", F.monotonically_increasing_id()))
    rows = keep(rows, "packing-order").withColumn("task", F.shiftright("at", 33))
    runs = rows.groupBy("task", "length").agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return (rows.join(runs.drop("n"), ["task", "length"])
            .withColumn("rank", F.col("at") - F.col("low") + F.col("before")).drop("task", "at", "low", "before"))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    rows = keep(pieces(docs, tokenizer_path, capacity, end_id), "packing-pieces")
    counts = {r.length: r.n for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    steps = plan(counts, capacity)
    slots = spark.createDataFrame(pa.table(
        [pa.array(c, pa.int64()) for c in (zip(*steps) if steps else [[]] * 6)],
        names=["length", "rank_from", "n", "each", "first", "place"]))
    if len(steps) <= PLAN_BROADCAST_ROWS:
        slots = F.broadcast(slots)
    own = F.col("rank") - F.col("rank_from")
    return (ranked(rows).withColumn("length", F.col("length").cast("long"))
            .join(slots, "length").filter((own >= 0) & (own < F.col("n") * F.col("each")))
            .select(F.when(F.col("did") != -(2**63), F.col("did")).alias("doc_id"), "piece", "start", "length",
                    F.col("crc").alias("ids_crc32"),
                    (F.col("first") + F.floor(own / F.col("each"))).cast("long").alias("sequence_id"),
                    (F.col("place") + own % F.col("each") * F.col("length")).alias("offset")))
