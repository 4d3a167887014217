"""Operator 13: byte-level BPE encoding and decoding as bounded-lookahead transducers.

Encoder. Text comes in blocks; three stages each keep a bounded rest:

1. special tokens are cut out; an end of the block that may begin one waits;
2. the pattern of the tokenizer splits into words; the word at the end of the block and
   words that a contraction may still claim wait. A word longer than ``LONG`` passes on in
   parts, as the class of its characters alone decides where it ends;
3. the merges run over a window of bytes. A token is sent on once no text to come can
   change it: when it ends ``lookahead`` bytes or more before the end of the window. Words
   that fit a window come from a bounded cache.

Lookahead of the merge list. Text behind a border changes what lies before it only by a
chain of merges of rising rank: rule (u, x) takes the last token u in one course and not
in the other, then a later rule (w, y), whose y begins with u, does so with the token w
before it, and so on. The longest chain, in bytes of the left parts, is the lookahead; one
pass over the rules in order finds it. (It needs a list in which every part is made before
it is used and pairs merge in order of rank, from the left: trained lists are so; others
are refused.)

Decoder. Ids become bytes, and a byte-to-text state machine emits characters once they are
complete; broken bytes become U+FFFD, as the library does.

Defined cases: null or empty text has no tokens; unknown ids are left out in decoding;
repeated rows are coded one by one; extra columns are ignored; an empty table gives an
empty result."""

from __future__ import annotations

import codecs
import heapq
import json
import sys
import types

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import blocks

BLOCK_CHARS = 1 << 16
LONG = 1 << 12
CACHE_ENTRIES = 300_000
CACHED_CHARS = 40
# --- fixed values: the split pattern of this family of tokenizers ------------
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CLASSES = {"L": r"\p{L}+", "N": r"\p{N}+", "S": r"\s+", "O": r"[^\s\p{L}\p{N}]+"}
CONTRACTION = 3  # characters of the longest contraction
# ------------------------------------------------------------------------------
_STAND_IN = {"L": "Q", "N": "7", "O": "#", "S": " "}


def byte_signs() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file: itself
    for printable Latin-1 bytes, the next ones from U+0100 on for the others."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Model:
    """Vocabulary, merges and special tokens of a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        signs, vocab = byte_signs(), data["model"]["vocab"]
        raw = lambda t: bytes(signs[c] for c in t)
        self.bytes_of = {i: raw(t) for t, i in vocab.items()}
        self.byte_ids = [vocab[s] for _, s in sorted((b, s) for s, b in signs.items())]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.merges: dict[tuple[int, int], int] = {}  # rank of a pair
        self.made: list[int] = []  # token that each rank makes
        made = {vocab[s] for s in signs}
        rules = []
        for rank, pair in enumerate(data["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            if a not in made or b not in made:
                raise ValueError(f"merge {rank} uses a token that no earlier merge makes")
            made.add(c)
            self.merges[a, b] = rank
            self.made.append(c)
            rules.append((self.bytes_of[a], self.bytes_of[b]))
        self.lookahead = lookahead(rules)
        self.window = 4 * self.lookahead

    def encode(self, data: bytes) -> list[int]:
        """Ids of one word (or window): the pair of lowest rank first, leftmost first."""
        ids, rank_of, none = [self.byte_ids[b] for b in data], self.merges.get, len(self.made)
        if len(ids) > 64:
            return self._encode_long(ids)
        ranks = [rank_of(p, none) for p in zip(ids, ids[1:])]
        while ranks and (r := min(ranks)) < none:
            i = ranks.index(r)
            ids[i:i + 2] = [self.made[r]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank_of((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = rank_of((ids[i], ids[i + 1]), none)
        return ids

    def _encode_long(self, ids: list[int]) -> list[int]:
        """The same by a queue of pairs over a linked list: n log n."""
        n, merges = len(ids), self.merges
        ahead, back = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := merges.get((a, b))) is not None]
        heapq.heapify(queue)

        def look(i: int) -> None:
            if i >= 0 and (j := ahead[i]) < n and (r := merges.get((ids[i], ids[j]))) is not None:
                heapq.heappush(queue, (r, i, ids[i], ids[j]))

        while queue:
            r, i, a, b = heapq.heappop(queue)
            j = ahead[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.made[r], -1
            ahead[i] = ahead[j]
            if ahead[j] < n:
                back[ahead[j]] = i
            look(back[i])
            look(i)
        return [x for x in ids if x >= 0]


def lookahead(rules: list[tuple[bytes, bytes]]) -> int:
    """Bytes before the end of a text in which later text can change tokens."""
    reach: dict[bytes, int] = {}  # longest chain that ends by taking this left part
    for left, right in rules:
        before = max((reach.get(right[:i], 0) for i in range(1, len(right) + 1)), default=0)
        reach[left] = max(reach.get(left, 0), len(left) + before)
    return max(reach.values(), default=1)


class Classes:
    """Classes of characters (L, N, S, O) as the library's splitter has them; its Unicode
    version may differ from that of the ``regex`` module. Each character is probed once
    per worker: between a known and a tested character the splitter sets a border or not."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.own = {k: regex.compile(p) for k, p in CLASSES.items()}
        self.known = {chr(c) for c in range(128)}
        self.odd: dict[str, str] = {}  # characters of another class, with a stand-in of theirs

    def probe(self, c: str) -> None:
        joined = lambda known, behind: len(self.split(known + c + behind)[0][0]) > 1
        kind = "L" if joined("a", "!") else "N" if joined("1", "!") else "O" if joined("!", "a") else "S"
        if not self.own[kind].match(c):
            self.odd[c] = _STAND_IN[kind]
        self.known.add(c)

    def seen(self, text: str) -> str:
        """``text`` with a stand-in of the library's class for each odd character."""
        if text.isascii():
            return text
        chars = set(text)
        for c in chars - self.known:
            self.probe(c)
        if self.odd and not self.odd.keys().isdisjoint(chars):
            return text.translate({ord(c): s for c, s in self.odd.items() if c in chars})
        return text


class Encoder:
    """A transducer: ``feed`` text in parts, each gives ids as bytes; ``finish`` the rest."""

    def __init__(self, model: Model, classes: Classes) -> None:
        self.model, self.seen = model, classes.seen
        self.pattern = regex.compile(PATTERN)
        self.runs = {k: regex.compile(p) for k, p in CLASSES.items()}
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(model.special, key=len, reverse=True))) if model.special else None
        self.words, self.older = {}, {}
        self.reset()

    def reset(self) -> None:
        self.rest, self.open, self.window = "", None, b""

    # -- stage 3: merges
    def word(self, w: str) -> bytes:
        known = self.words.get(w)
        if known is None:
            known = self.older.get(w)
            if known is None:
                known = self.push(w.encode()) + self.flush()
            if len(w) <= CACHED_CHARS:
                if len(self.words) >= CACHE_ENTRIES:
                    self.words, self.older = {}, self.words
                self.words[w] = known
        return known

    def push(self, data: bytes) -> bytes:
        """Part of a word: the tokens that are stable by now."""
        out = []
        for i in range(0, len(data), self.model.window):
            self.window += data[i:i + self.model.window]
            if len(self.window) < 2 * self.model.lookahead:
                continue
            ids, stable, end = self.model.encode(self.window), 0, 0
            for k in ids:
                size = len(self.model.bytes_of[k])
                if end + size > len(self.window) - self.model.lookahead:
                    break
                end, stable = end + size, stable + 1
            out.append(as_bytes(ids[:stable]))
            self.window = self.window[end:]
        return b"".join(out)

    def flush(self) -> bytes:
        out, self.window = as_bytes(self.model.encode(self.window)), b""
        return out

    # -- stage 2: words
    def split(self, text: str, last: bool) -> tuple[list[bytes], str]:
        """(ids of the words that are settled, rest of the text)."""
        out, seen = [], self.seen(text)
        if self.open:  # a long word goes on
            run = self.runs[self.open].match(seen)
            end = run.end() if run else 0
            if end == len(seen) and not last:
                give = end - (self.open == "S" and end > 0)  # the last white space may belong to the next word
                return [self.push(text[:give].encode())], text[give:]
            if self.open == "S" and end < len(seen) and end:
                end -= 1
            out += [self.push(text[:end].encode()), self.flush()]
            self.open, text, seen = None, text[end:], seen[end:]
        words = self.pattern.findall(seen)
        if not last:  # keep what text to come may change
            kept = len(seen)
            while words and (kept == len(seen) or kept - len(words[-1]) > len(seen) - CONTRACTION):
                kept -= len(words.pop())
        else:
            kept = len(seen)
        if seen is not text:
            ends = np.cumsum([0] + [len(w) for w in words]).tolist()
            words = [text[a:b] for a, b in zip(ends, ends[1:])]
        known = self.words
        try:
            out += [known[w] for w in words]
        except KeyError:
            out += [self.word(w) for w in words]
        text, seen = text[kept:], seen[kept:]
        if len(text) > LONG and not last:
            kind = next(k for k, p in self.runs.items() if p.match(seen[1:]))
            if self.runs[kind].fullmatch(seen, 1) and (seen[0] == " " or self.runs[kind].match(seen)):
                give = len(text) - (kind == "S")
                self.open = kind
                out.append(self.push(text[:give].encode()))
                text = text[give:]
        return out, text

    # -- stage 1: special tokens
    def feed(self, text: str, last: bool = False) -> bytes:
        text, out = self.rest + text, []
        while self.special and (m := self.special.search(text)):
            out += self.split(text[:m.start()], True)[0] + [as_bytes([self.model.special[m.group()]])]
            text = text[m.end():]
        wait = 0
        if not last:
            wait = max((n for s in self.model.special for n in range(1, len(s)) if text.endswith(s[:n])), default=0)
        more, rest = self.split(text[:len(text) - wait], last)
        self.rest = rest + text[len(text) - wait:]
        return b"".join(out + more)

    def finish(self) -> bytes:
        out = self.feed("", last=True)
        self.reset()
        return out

    def whole(self, text: str) -> bytes:
        parts = [self.feed(text[i:i + BLOCK_CHARS]) for i in range(0, len(text), BLOCK_CHARS)]
        return b"".join(parts) + self.finish()


def as_bytes(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


class Decoder:
    """The way back: ``feed`` ids (bytes), each gives the characters that are complete."""

    def __init__(self, model: Model) -> None:
        self.bytes_of, self.state = model.bytes_of, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: bytes, last: bool = False) -> str:
        known = self.bytes_of
        return self.state.decode(b"".join([known.get(i, b"") for i in np.frombuffer(ids, "<u4").tolist()]), last)

    def finish(self) -> str:
        out = self.feed(b"", last=True)
        self.state.reset()
        return out

    def whole(self, ids: bytes) -> str:
        step = 4 * BLOCK_CHARS
        return "".join([self.feed(ids[i:i + step]) for i in range(0, len(ids), step)]) + self.finish()


def of_worker(path: str, kind: str, make):
    """What tasks of one worker process share: model, encoder with its cache, decoder."""
    kept = sys.modules.setdefault("seamfix_bpe", types.ModuleType("seamfix_bpe")).__dict__
    if (kind, path) not in kept:
        kept[kind, path] = make()
    return kept[kind, path]


def bpe_encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (little-endian unsigned 32-bit)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))

    def task(batches):
        model = of_worker(tokenizer_path, "model", lambda: Model(tokenizer_path))
        encoder = of_worker(tokenizer_path, "encoder", lambda: Encoder(model, Classes(tokenizer_path)))
        for batch in batches:
            for a, b, texts in blocks(batch.column(1)):
                ids = [encoder.whole(t.decode("utf-8", "replace")) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(x) // 4 for x in ids], pa.int64()),
                                                  pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return rows.mapInArrow(task, "doc_id long, n_tokens long, ids binary")


def bpe_decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """``encoded`` (doc_id, n_tokens, ids) with the column ``decoded``."""

    def task(batches):
        decoder = Decoder(of_worker(tokenizer_path, "model", lambda: Model(tokenizer_path)))
        for batch in batches:
            for a, b, ids in blocks(batch.column(2)):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([decoder.whole(x or b"") for x in ids], pa.string())],
                                                 ["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(task, "doc_id long, n_tokens long, ids binary, decoded string")
