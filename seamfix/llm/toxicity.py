"""Operator 4: toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models of the characters inside words (order
``ORDER``), one of toxic and one of ordinary documents. The upper orders count per
class; the lower ones (up to ``SHARED`` characters) are continuation counts over
both classes, so a rare or new spelling backs off to shared counts and scores about
zero unless its longer parts are typical of a class. A word counts once a document.

A document's evidence is length-normalised: the mean log-likelihood difference per
word over the whole text, over its best window of ``WINDOW`` words and over its
most telling words; a logistic fit, on documents scored by the counts of the other
half of the sample, maps them to a score of 0 to 1.

The classifier is fitted on a bounded sample of labelled rows, at most
``MAX_PER_CLASS`` documents of each label by hash order; n-grams are counted by
Spark, the tables (bounded by the sample) are broadcast. Scoring covers every whole
text in one scan without a shuffle.

Defined cases: null, empty or wordless text scores with no evidence; null labels are
not learned from; a null doc_id is not held out and not learned from; repeated rows
score alike; extra columns are ignored; if one of the labels has no row, every score
is 0 (no toxic rows) or 1 (no ordinary rows)."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

ORDER = 6
SHARED = 3
MAX_PER_CLASS = 2000
WINDOW = 12
CACHE_ENTRIES = 200_000
FOLDS = 5
_WORD = re.compile(r"[^\W_]+")
_FEATURES = 4


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0 (a null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, column: str, most: int) -> DataFrame:
    """(doc_id, label, half): at most ``most`` labelled ids of each label by hash
    order, dealt into halves 0 and 1."""
    rows = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
            .filter("doc_id is not null and label in (0, 1)").filter(~held_out(F.col("doc_id")))
            .groupBy("doc_id").agg(F.max("label").alias("label"))
            .join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    order = F.xxhash64("doc_id", F.lit(7))
    parts = [rows.filter(F.col("label") == c).orderBy(order, "doc_id").limit(most) for c in (0, 1)]
    return keep(parts[0].unionByName(parts[1]).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(2)).cast("int")),
                "toxicity-sample")


def gram_counts(texts: DataFrame) -> DataFrame:
    """(g, c00, c10, c01, c11: counts by label and half): documents' distinct words, as
    n-grams of 1 to ORDER characters of ``^word$``, each counted once per word and
    document."""

    def words(batches):
        for batch in batches:
            own = [set(_WORD.findall((text or "").lower())) for text in batch.column(0).to_pylist()]
            n = [len(x) for x in own]
            yield pa.RecordBatch.from_arrays([pa.array([w for x in own for w in x], pa.string()),
                                              *[pa.array(np.repeat(batch.column(i).to_numpy(), n)) for i in (1, 2)]], ["w", "label", "half"])

    sums = [F.sum(F.when((F.col("label") == c) & (F.col("half") == h), 1).otherwise(0)).alias(f"c{c}{h}") for h in (0, 1) for c in (0, 1)]
    counted = texts.select("text", "label", "half").mapInArrow(words, "w string, label int, half int").groupBy("w").agg(*sums)
    marked = counted.withColumn("m", F.concat(F.lit("^"), "w", F.lit("$")))
    ends = F.sequence(F.lit(2), F.length("m"))
    grams = F.flatten(F.transform(ends, lambda e: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(ORDER), e)), lambda n: F.substring("m", e - n + 1, n))))
    return (marked.withColumn("g", F.explode(grams)).groupBy("g")
            .agg(*[F.sum(c).alias(c) for c in ("c00", "c10", "c01", "c11")]))


def smoothed(counts: dict[str, int], shared: dict[str, int]):
    """(probability of a gram's last character after the others, backing-off weight of
    a context): interpolated Kneser-Ney over a class's ``counts`` (grams longer than
    SHARED) and the continuation counts ``shared`` of both classes."""
    kinds: dict[tuple[bool, str], list[int]] = {}  # (own, context) -> total, types seen once, twice, more
    ones = [0, 0, 0, 0]
    for own, table in ((True, counts), (False, shared)):
        for g, c in table.items():
            k = kinds.setdefault((own, g[:-1]), [0, 0, 0, 0])
            k[0] += c
            k[min(c, 3)] += 1
            ones[min(c, 3)] += own
    y = ones[1] / max(1, ones[1] + 2 * ones[2])
    cut = [0.0, min(max(1 - 2 * y * ones[2] / max(1, ones[1]), 0.4), 0.95),
           min(max(2 - 3 * y * ones[3] / max(1, ones[2]), 0.6), 1.4), 1.5]

    def weight(own: bool, context: str) -> float:
        k = kinds.get((own, context))
        return sum(cut[i] * k[i] for i in (1, 2, 3)) / k[0] if k else 1.0

    def prob(g: str) -> float:
        own = len(g) > SHARED
        below = prob(g[1:]) if len(g) > 1 else 1e-3
        k = kinds.get((own, g[:-1]))
        if not k:
            return below
        c = (counts if own else shared).get(g, 0)
        return max(c - cut[min(c, 3)], 0.0) / k[0] + weight(own, g[:-1]) * below

    return prob, weight


def differences(grams: list[str], c0: list[int], c1: list[int]) -> tuple[dict[str, float], dict[str, float]]:
    """(log-likelihood difference, toxic less ordinary, of each gram's last character;
    difference of the backing-off weights of each context)."""
    own = [{g: int(c) for g, c in zip(grams, cs) if c and len(g) > SHARED} for cs in (c0, c1)]
    shared: dict[str, int] = {}  # in how many different left contexts a short gram occurs
    for g, a, b in zip(grams, c0, c1):
        if 2 <= len(g) <= SHARED + 1 and (a or b):
            shared[g[1:]] = shared.get(g[1:], 0) + 1
    (p0, w0), (p1, w1) = (smoothed(c, shared) for c in own)
    diff = {g: math.log(p1(g) / p0(g)) for g in own[0].keys() | own[1].keys()}
    return diff, {x: math.log(w1(True, x) / w0(True, x)) for x in {g[:-1] for g in diff}}


def word_difference(word: str, diff: dict[str, float], back: dict[str, float]) -> float:
    """Log-likelihood difference of a whole word."""
    m, total = f"^{word}$", 0.0
    for end in range(2, len(m) + 1):
        for a in range(max(0, end - ORDER), end - SHARED):
            g = m[a:end]
            if g in diff:
                total += diff[g]
                break
            total += back.get(g[:-1], 0.0)
    return total


def evidence(values: np.ndarray) -> list[float]:
    """Length-normalised evidence of a document's word differences."""
    n = len(values)
    if not n:
        return [0.0] * _FEATURES
    w = min(WINDOW, n)
    total = np.concatenate(([0.0], np.cumsum(values)))
    top = np.sort(np.partition(values, n - 3)[-3:] if n > 3 else values)[::-1]
    return [float(total[-1] / n), float((total[w:] - total[:-w]).max() / w), float(top[0]), float(top[:2].mean())]


def described(rows: DataFrame, model, others: list[str]) -> DataFrame:
    """``others`` and the evidence f0.. of each text (first column: text)."""
    kinds = dict(rows.dtypes)

    def task(batches):
        known: dict[str, float] = {}
        diff, back = model.value
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                words = _WORD.findall((text or "").lower())
                for w in set(words):
                    if w not in known:
                        if len(known) >= CACHE_ENTRIES:
                            known.clear()
                            break
                        known[w] = word_difference(w, diff, back)
                try:
                    values = [known[w] for w in words]
                except KeyError:
                    own = {w: word_difference(w, diff, back) for w in set(words)}
                    values = [own[w] for w in words]
                out.append(evidence(np.array(values)))
            f = np.array(out, dtype=np.float64).reshape(-1, _FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(i + 1) for i in range(len(others))] + [pa.array(f[:, i].copy()) for i in range(_FEATURES)],
                                             others + [f"f{i}" for i in range(_FEATURES)])

    schema = ", ".join([f"{c} {kinds[c]}" for c in others] + [f"f{i} double" for i in range(_FEATURES)])
    return rows.select("text", *others).mapInArrow(task, schema)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (last: bias) by Newton steps on standardised, ridge-penalised evidence."""
    mean, sd = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack(((x - mean) / sd, np.ones(len(x))))
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + ridge * np.append(w[:-1], 0)
        hess = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)) * np.append(np.ones(len(w) - 1), 1e-6)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    out = np.append(w[:-1] / sd, w[-1] - (w[:-1] * mean / sd).sum())
    return out


def toxicity(docs: DataFrame, labels: DataFrame, most: int = MAX_PER_CLASS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    picked = sample(docs, labels, "toxic", most)
    texts = keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
                 .join(picked, "doc_id"), "toxicity-texts")
    out = docs.select(F.col("text").cast("string").alias("text"), "doc_id", held_out(F.col("doc_id")).alias("held_out"))
    sizes = {r.label: r.n for r in picked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        score = F.lit(1.0 if 1 in sizes else 0.0)
        return out.select("doc_id", "held_out", score.alias("score"), F.when(score >= 0.5, 1).otherwise(0).alias("predicted"))
    t = gram_counts(texts).toArrow()
    grams, counts = t["g"].to_pylist(), {c: t[c].to_numpy() for c in t.column_names[1:]}
    # Each half is scored by the other's counts to fit the logistic map; all counts score the corpus.
    share = lambda tables: spark.sparkContext.broadcast(tables)
    crossed = [described(texts.filter(F.col("half") == 1 - h), share(differences(grams, counts[f"c0{h}"], counts[f"c1{h}"])), ["label"])
               for h in (0, 1)]
    fit = crossed[0].unionByName(crossed[1]).toPandas()
    model = share(differences(grams, counts["c00"] + counts["c01"], counts["c10"] + counts["c11"]))
    w = logistic(fit[[f"f{i}" for i in range(_FEATURES)]].to_numpy(), fit["label"].to_numpy().astype(float))
    scored = described(out, model, ["doc_id", "held_out"])
    logit = sum((F.col(f"f{i}") * float(w[i]) for i in range(_FEATURES)), F.lit(float(w[-1])))
    score = 1 / (1 + F.exp(-F.least(F.greatest(logit, F.lit(-500.0)), F.lit(500.0))))
    return (scored.select("doc_id", "held_out", score.alias("score"))
            .withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0)))
