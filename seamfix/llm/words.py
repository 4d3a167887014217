"""Word spans and n-gram hashes of UTF-8 texts, vectorised over blocks of bytes.

Used inside Arrow batches. A block joins consecutive texts up to ``BLOCK``
bytes (at least one text), so working memory is a fixed multiple of the block
or of the longest single text. Hashes are 64-bit: a polynomial over bytes (or
over word hashes) modulo 2**64, finished by an integer mixer."""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc

BLOCK = 1 << 19
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93


def word_table(separators: list[tuple[int, int]]) -> np.ndarray:
    """Truth table of the bytes that belong to words: all but the ranges."""
    t = np.ones(256, dtype=bool)
    for lo, hi in separators:
        t[lo:hi + 1] = False
    return t


#: Words of ``[^\x20\x09-\x0D]+``.
NON_SPACE = word_table([(0x20, 0x20), (0x09, 0x0D)])
#: Words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (after lower-casing).
ALNUM = word_table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (shift, multiply; public splitmix constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n + 1, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """``Hasher.ngrams`` of two words, from the hashes of both."""
    return mix(first + second * np.uint64(_WORD_BASE) + np.uint64(2))


class Hasher:
    """Holds the power tables of one task; they grow to the longest block."""

    def __init__(self) -> None:
        self._tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _pow(self, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        t = self._tables.get(base)
        if t is None or len(t[0]) <= n:
            t = self._tables[base] = _powers(base, max(n, 1 << 16))
        return t

    def words(self, texts: list, table: np.ndarray, lower: bool):
        """(word hashes, first): document ``i`` owns words ``first[i]:first[i+1]``.

        ``texts`` are bytes or None (no words)."""
        joined = b"\n".join(t or b"" for t in texts)
        buf = np.frombuffer(joined, dtype=np.uint8)
        if lower:
            buf = _LOWER[buf]
        inside = np.zeros(len(buf) + 2, dtype=np.int8)
        inside[1:-1] = table[buf]
        step = np.diff(inside)
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        up, down = self._pow(_BYTE_BASE, len(buf) + 1)
        total = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:len(buf)], out=total[1:])
        h = mix((total[ends] - total[starts]) * down[starts])
        lengths = np.fromiter((len(t or b"") + 1 for t in texts), dtype=np.int64, count=len(texts))
        bounds = np.concatenate(([0], np.cumsum(lengths)))
        return h, np.searchsorted(starts, bounds)

    def ngrams(self, h: np.ndarray, k: int) -> np.ndarray:
        """Hash of the ``k`` words from each position on (ignores documents)."""
        n = len(h) - k + 1
        if n <= 0:
            return np.empty(0, dtype=np.uint64)
        up, down = self._pow(_WORD_BASE, len(h) + 1)
        total = np.zeros(len(h) + 1, dtype=np.uint64)
        np.cumsum(h * up[:len(h)], out=total[1:])
        return mix((total[k:] - total[:n]) * down[:n] + np.uint64(k))


def blocks(*columns, limit: int = BLOCK):
    """(from, to, texts of each column): slices of consecutive rows of binary Arrow
    columns with at most ``limit`` bytes together (one row at least). Only the
    slice at hand is copied into Python objects."""
    sizes = sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    ends = np.cumsum(sizes)
    a, n = 0, len(sizes)
    while a < n:
        b = max(a + 1, int(np.searchsorted(ends, limit + (ends[a - 1] if a else 0), side="right")))
        yield (a, b, *[c.slice(a, b - a).to_pylist() for c in columns])
        a = b


def as_long(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark longs."""
    return x.view(np.int64)
