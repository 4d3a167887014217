"""Operator 11: fill-in-middle transformation with a Fenwick tree over text blocks.

A text of n units is cut at two unit borders into prefix, middle and suffix and written
in the order of its form: plain (the text), psm or spm. The text's bytes are taken in
blocks of fixed size; a Fenwick tree over the blocks stores the units that begin in each
and its code points. A binary-lifting descent finds the block of a cut and the code
points before it, the bytes of that block alone give the border.

Units are code points, or words (a word with the white space behind it; white space at
the start belongs to the first). Cuts and form come from the hash of ``seed:doc_id``.

Defined cases: null text is empty; empty texts and texts that hold a marker are plain; a
null doc_id hashes as an empty number; repeated rows are transformed one by one; extra
columns are ignored; an empty table gives an empty result. Working memory is a small
multiple of the longest text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import blocks

MARKS = ("<P>", "<S>", "<M>")
BLOCK_BYTES = 1024
PLAIN_FROM = 90  # h3 % 100
SPM_BELOW = 20  # h4 % 100
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


class BlockCounts:
    """Fenwick tree over the blocks of a text: units and code points (two columns)."""

    def __init__(self, text: bytes, unit: str = "code_point", size: int = BLOCK_BYTES) -> None:
        buf = np.frombuffer(text, dtype=np.uint8)
        self.size, self.n_bytes = size, len(buf)
        self.points = (buf & 0xC0) != 0x80
        if unit == "code_point":
            self.units = self.points
        else:
            inside = ~_SPACE[buf]
            self.units = inside.copy()
            self.units[1:] &= ~inside[:-1]
            if len(buf):
                self.units[:max(1, int(np.argmax(inside)) + 1)] = False
                self.units[0] = True
        n = -(-len(buf) // size)
        sums = np.zeros((n + 1, 2), dtype=np.int64)
        if n:
            at = np.arange(0, len(buf), size)
            sums[1:, 0] = np.add.reduceat(self.units, at, dtype=np.int64)
            sums[1:, 1] = np.add.reduceat(self.points, at, dtype=np.int64)
        self.total = tuple(int(x) for x in sums.sum(axis=0))
        # Node i holds the sum of blocks i - (i & -i) + 1 to i.
        step = 1
        while step <= n:
            i = np.arange(2 * step, n + 1, 2 * step)
            sums[i] += sums[i - step]
            step *= 2
        self.tree = sums.tolist()

    def cut(self, units: int) -> tuple[int, int]:
        """(bytes, code points) before the border that ``units`` units end at."""
        if units >= self.total[0]:
            return self.n_bytes, self.total[1]
        n, at, left, points = len(self.tree) - 1, 0, units, 0
        step = 1 << n.bit_length()
        while step:
            if at + step <= n and self.tree[at + step][0] <= left:
                at += step
                left -= self.tree[at][0]
                points += self.tree[at][1]
            step >>= 1
        start = at * self.size
        place = int(np.flatnonzero(self.units[start:start + self.size])[left])
        return start + place, points + int(np.count_nonzero(self.points[start:start + place]))


def transform(text: bytes, h: list[int], unit: str) -> tuple:
    """(units, form, code points of the prefix, of the middle, output)."""
    counts = BlockCounts(text, unit)
    n = counts.total[0]
    if not text or any(m.encode() in text for m in MARKS) or h[2] % 100 >= PLAIN_FROM:
        return n, "plain", None, None, text
    (a, points_a), (b, points_b) = sorted(counts.cut(x % (n + 1)) for x in h[:2])
    prefix, middle, suffix = b"<P>" + text[:a], b"<M>" + text[a:b], b"<S>" + text[b:]
    spm = h[3] % 100 < SPM_BELOW
    out = suffix + prefix + middle if spm else prefix + suffix + middle
    return n, "spm" if spm else "psm", points_a, points_b - points_a, out


def restored(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` had, from output and form alone."""
    def between(after: int) -> Column:  # the part that the mark MARKS[after] opens
        rest = F.substring_index(F.concat(output, *[F.lit(m) for m in MARKS]), MARKS[after], 2)
        part = F.substr(rest, F.length(F.substring_index(rest, MARKS[after], 1)) + 4)
        for other in MARKS:
            if other != MARKS[after]:
                part = F.substring_index(part, other, 1)
        return part
    return F.when(form == "plain", output).otherwise(F.concat(between(0), between(2), between(1)))


def fill_in_middle(docs: DataFrame, unit: str = "code_point", seed: int = 1) -> DataFrame:
    """One row per document: doc_id, n (units), form, prefix_chars, middle_chars, output."""
    if unit not in ("code_point", "word"):
        raise ValueError("unit is code_point or word")
    did = F.col("doc_id").cast("long")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(did.cast("string"), F.lit(""))), 256)
    rows = docs.select(did.alias("doc_id"), F.substring(key, 1, 32).alias("key"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def task(batches):
        for batch in batches:
            keys = batch.column(1).to_pylist()
            for a, b, texts in blocks(batch.column(2)):
                done = [transform(t, [int(k[i:i + 8], 16) for i in range(0, 32, 8)], unit) for k, t in zip(keys[a:b], texts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *[pa.array(c, k) for c, k in zip(zip(*done), kinds[1:])]], names)

    out = rows.mapInArrow(task, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.col("output").cast("string"))
