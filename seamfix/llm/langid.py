"""Operator 9: language identification.

Sparse multinomial logistic regression on TF-IDF of hashed character n-grams (1 to 3
characters of the lower-cased text), trained with follow-the-regularised-leader
(FTRL-proximal) under an elastic-net penalty, then calibrated by one temperature.

* Document frequencies are counted over all rows that may be learned from.
* The classifier is fitted on a bounded sample: at most ``MAX_PER_LANGUAGE``
  documents of each language by hash order, taken in one pass over all rows, dealt to ``SHARDS`` tasks that train on
  their share; Spark averages their sparse weights. A fifth of the sample is kept out
  and fits the temperature.
* Every whole text is scored in one scan without a shuffle; the weights (features x
  languages, a fixed size) are broadcast.

Defined cases: null text or text without a letter is ``und`` with score 0; null
languages and null doc_ids are not learned from; repeated rows score alike, and of the
rows of one doc_id and language only the smallest text is in the sample; extra columns
are ignored; with nothing to learn from everything is ``und``."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep
from .toxicity import held_out

BITS = 16
MAX_PER_LANGUAGE = 2000
SHARDS = 6
#: Tasks that bring the tasks' shares of the sample together.
DEALT = 64
EPOCHS = 2
DOUBT = 0.01
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-4


def counts(text: str) -> np.ndarray:
    """Slots of all character 1-, 2- and 3-grams of a text."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    parts, h = [], np.zeros(len(c), np.uint64)
    for n in range(3):
        if len(c) <= n:
            break
        h = h[:len(c) - n] * np.uint64(0x100000001B3) + c[n:] + np.uint64(n + 1)
        x = h * np.uint64(0x9E3779B97F4A7C15)
        parts.append((x >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values): (1 + log tf) * idf, of length 1."""
    tf = np.bincount(counts(text), minlength=1 << BITS)
    at = np.flatnonzero(tf)
    v = (1 + np.log(tf[at])) * idf[at]
    norm = np.sqrt((v * v).sum())
    return at, v / norm if norm else v


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """FTRL-proximal weights; the L1 part sets small ones to exactly 0."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def train(texts: list[str], y: np.ndarray, classes: int, idf: np.ndarray) -> np.ndarray:
    """FTRL-proximal over one share of the sample: weights (classes x (slots + bias))."""
    z = np.zeros((classes, (1 << BITS) + 1))
    n = np.zeros_like(z)
    rows = [features(t, idf) for t in texts]
    for _ in range(EPOCHS):
        for (at, v), label in zip(rows, y):
            at, v = np.append(at, 1 << BITS), np.append(v, 1.0)
            w = weights_of(z[:, at], n[:, at])
            s = w @ v
            p = np.exp(s - s.max())
            p /= p.sum()
            p[label] -= 1
            g = p[:, None] * v
            sigma = (np.sqrt(n[:, at] + g * g) - np.sqrt(n[:, at])) / ALPHA
            z[:, at] += g - sigma * w
            n[:, at] += g * g
    return weights_of(z, n)


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Documents of each slot, and of all, summed over tasks' sparse counts."""

    def task(batches):
        df, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                df += np.bincount(counts(text), minlength=1 << BITS) > 0
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["slot", "n"])

    t = rows.select("text").mapInArrow(task, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    slot, n = t["slot"].to_numpy(), t["n"].to_numpy()
    df = np.zeros(1 << BITS, np.int64)
    df[slot[slot >= 0]] = n[slot >= 0]
    return df, int(n[slot < 0].sum())


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the scores of least log loss, by golden section of its log.

    A share ``DOUBT`` of each target is spread over all languages, so that scores
    stay finite where the sample has no error."""

    def loss(log_t: float) -> float:
        s = scores / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        hit = (1 - DOUBT) * s[np.arange(len(y)), y] + DOUBT * s.mean(axis=1)
        return float((np.log(np.exp(s).sum(axis=1)) - hit).mean())

    a, b, r = -5.0, 3.0, (5 ** 0.5 - 1) / 2
    while b - a > 1e-4:
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def lowest(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` (doc_id, lang, place) with at most ``most`` documents of a language from
    each task, those that come first by place: one pass for all languages."""

    def best(frames):
        out = pd.concat(frames).drop_duplicates(["doc_id", "lang"]).sort_values(["place", "doc_id"])
        return out.groupby("lang").head(most)

    def task(frames):
        held, size, limit = [], 0, 0
        for frame in frames:
            held.append(frame)
            size += len(frame)
            if size > limit:
                held = [best(held)]
                size = len(held[0])
                limit = 2 * size + 50_000
        if held:
            yield best(held)

    return rows.mapInPandas(task, rows.schema)


def language_id(docs: DataFrame, most: int = MAX_PER_LANGUAGE) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    lettered = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    learn = (docs.select("doc_id", text.alias("text"), F.col("lang").cast("string").alias("lang"), lettered.alias("ok"))
             .filter("doc_id is not null and lang is not null and ok").filter(~held_out(F.col("doc_id"))))
    out = docs.select(F.when(lettered, text).alias("text"), "doc_id", held_out(F.col("doc_id")).alias("held_out"))
    langs = sorted(r.lang for r in learn.select("lang").distinct().collect())
    if not langs:
        return out.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    df, n = document_frequencies(learn)
    idf = spark.sparkContext.broadcast(np.log((n + 1) / (df + 1)) + 1)
    order = F.xxhash64("doc_id", F.lit(13))
    place = Window.partitionBy("lang").orderBy("place", "doc_id")
    # Taken again over DEALT tasks, so that a language has DEALT * most rows at last, whatever the input.
    first = lowest(learn.select("doc_id", "lang", order.alias("place")), most)
    picked = (lowest(first.repartition(DEALT, "doc_id"), most).dropDuplicates(["doc_id", "lang"])
              .withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= most)
              .withColumn("y", F.array_position(F.array(*[F.lit(v) for v in langs]), F.col("lang")).cast("int") - 1)
              .select("doc_id", "lang", "y"))
    picked = keep(picked, "langid-sample")
    # One text of each picked document, also where its id is in many rows.
    rows = keep(learn.join(picked, ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"), F.first("y").alias("y"))
                .withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(5 * SHARDS)))
                .select("text", "y", "doc_id", (F.col("part") % SHARDS).alias("shard"), (F.col("part") >= 4 * SHARDS).alias("held")),
                "langid-texts")
    classes = len(langs)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("doc_id", key=lambda c: (c * 2654435761) % (2**32))
        w = train(list(part["text"]), part["y"].to_numpy(), classes, idf.value)
        c, at = np.nonzero(w)
        return pd.DataFrame({"c": c, "slot": at, "w": w[c, at]})

    fitted = rows.filter("not held").groupBy("shard").applyInPandas(fit, "c long, slot long, w double")
    fitted = keep(fitted, "langid-weights")
    shards = max(1, rows.filter("not held").select("shard").distinct().count())
    t = fitted.groupBy("c", "slot").agg(F.sum("w").alias("w")).toArrow()
    w = np.zeros((classes, (1 << BITS) + 1), np.float32)
    w[t["c"].to_numpy(), t["slot"].to_numpy()] = t["w"].to_numpy() / shards
    model = spark.sparkContext.broadcast(w)

    def scores(text: str) -> np.ndarray:
        at, v = features(text, idf.value)
        m = model.value
        return m[:, at] @ v + m[:, -1]

    def calibrate(batches):
        for batch in batches:
            s = [scores(t).tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(s, pa.list_(pa.float64()))], ["y", "s"])

    held = rows.filter("held").select("text", "y").mapInArrow(calibrate, "y int, s array<double>").toPandas()
    heat = temperature(np.array(held["s"].tolist()), held["y"].to_numpy()) if len(held) and classes > 1 else 1.0

    def predict(batches):
        for batch in batches:
            best, sure = [], []
            for text in batch.column(0).to_pylist():
                if text is None:
                    best.append("und")
                    sure.append(0.0)
                    continue
                s = scores(text) / heat
                p = np.exp(s - s.max())
                best.append(langs[int(p.argmax())])
                sure.append(float(p.max() / p.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(best, pa.string()), pa.array(sure, pa.float64())],
                                             ["doc_id", "held_out", "lang_pred", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return out.mapInArrow(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
