"""Operator 7 [native]: quality rules by distribution divergence.

Base rules count words, symbols, repeated lines and repeated three-word windows.
The verdict compares two histograms of a document with the references of its
language by Jensen-Shannon distance (base 2, 0 to 1):

* character classes: lower case, white space, beyond ASCII, upper case,
  punctuation, digits, other signs;
* common words: the language's ``BANDS[-1]`` most frequent words, in bands of rank, and
  all others as one bin. The limit is a share of the distance that a text without any
  common word has, so such a text is rejected, in whatever letters it is.

References are sums over every document of the language that passes the base
rules; both guards are minimum lengths: a document below ``MIN_CHARS`` characters
or ``MIN_WORDS`` words, or a language with fewer than ``MIN_REFERENCE`` words,
is judged by the base rules only.

All of it is row-local column expressions and sums per language; the sums of a row per
language are joined on it, which the planner broadcasts while they are small. The common
words of languages with ``MIN_REFERENCE`` words or more become sets in the expressions
(``BANDS[-1]`` words a language pass through the driver). No text is ever shuffled.

Defined cases: null or blank text has no words and fails the base rules; a null
language is a language of its own; repeated rows are judged one by one; extra
columns are carried through (names that begin with __ are the operator's own); an empty
table gives an empty result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, release

SPACES = r"[\x20\x09-\x0D]+"
#: Last rank of each band of common words.
BANDS = (8, 64, 512)
MIN_CHARS = 100
MIN_WORDS = 50
MIN_REFERENCE = 2000
MAX_CHAR_DISTANCE = 0.27
#: Of the distance that a text without common words has.
MAX_WORD_SHARE = 0.8
#: Removed one after the other; what is left are other signs.
CLASSES = {"lower": "[a-z]+", "space": SPACES, "wide": r"[^\x00-\x7F]+", "upper": "[A-Z]+",
           "punct": r"[.,;:'\"()?\-]+", "digit": "[0-9]+"}
SIGNS = "[#*$%&|<>]+"
_MARKS = ".ABCDEFGH"[:len(BANDS) + 1]


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more."""

    def at(i: Column) -> Column:
        return F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

    def covered(p: Column) -> Column:  # p: sorted starts of repeated windows
        return F.aggregate(F.sequence(F.lit(1), F.size(p)), F.lit(0),
                           lambda acc, j: acc + F.least(F.lit(3), F.coalesce(F.get(p, j) - F.get(p, j - 1), F.lit(3))))

    def starts(s: Column) -> Column:  # s: (hash, start), sorted
        twin = F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]))
        return F.sort_array(F.transform(twin, lambda x: x["i"]))

    windows = F.sequence(F.lit(0), F.size(words) - 3)
    some = let(F.transform(windows, at),
               lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h),
                                let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
                                    lambda s: let(starts(s), covered))).otherwise(0))
    return F.when(F.size(words) >= 4, some).otherwise(0)


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with a struct ``__m`` (base counts and the class histogram) and
    the array ``__w`` of its words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.withColumn("__w", words_of(F.col("text"))).withColumn("__r0", text)
    left = "__r0"
    for i, pattern in enumerate(CLASSES.values(), 1):
        df = df.withColumn(f"__r{i}", F.regexp_replace(left, pattern, ""))
        left = f"__r{i}"
    size = [F.length(f"__r{i}") for i in range(len(CLASSES) + 1)]
    signs = F.length("__r4") - F.length(F.regexp_replace("__r4", SIGNS, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, SPACES, "")) > 0)
    df = df.withColumn("__m", F.struct(
        F.size("__w").cast("long").alias("n_words"),
        (size[0] - (size[1] - size[2])).cast("long").alias("word_chars"),
        signs.cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(F.col("__w"), repeat_words).cast("long").alias("n_repeat_words"),
        size[0].cast("long").alias("n_chars"),
        F.array(*[a - b for a, b in zip(size, size[1:])], size[-1]).alias("classes")))
    return df.drop(*[f"__r{i}" for i in range(len(CLASSES) + 1)])


def base_failed(m: str = "__m") -> Column:
    return F.expr(f"{m}.n_words < 50 or 100 * {m}.n_repeat_words > 50 * {m}.n_words")


def language() -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit(""))


def common_words(docs: DataFrame) -> list[list[str]]:
    """The common words of each band, each behind its language (``key_of``)."""
    counts = (docs.select(language().alias("__lang"), F.explode(words_of(F.col("text"))).alias("w"))
              .groupBy("__lang", F.lower("w").alias("w")).agg(F.count(F.lit(1)).alias("n")))
    rank = F.row_number().over(Window.partitionBy("__lang").orderBy(F.desc("n"), "w"))
    counts = keep(counts, "quality-words")
    large = counts.groupBy("__lang").agg(F.sum("n").alias("all")).filter(F.col("all") >= MIN_REFERENCE)
    top = counts.withColumn("r", rank).filter(F.col("r") <= BANDS[-1]).join(large, "__lang", "left_semi")
    rows = top.select(key_of(F.col("__lang"), F.col("w")).alias("key"), "r").collect()
    release(counts)
    edges = (0, *BANDS)
    return [sorted(x["key"] for x in rows if low < x["r"] <= high) for low, high in zip(edges, edges[1:])]


def key_of(lang: Column, word: Column) -> Column:
    return F.concat(lang, F.lit("\u0001"), word)


def with_common_histogram(df: DataFrame, bands: list[list[str]]) -> DataFrame:
    """Adds ``__h``: occurrences of common words of each band, the others first."""
    def mark(key: Column) -> Column:
        out = F.lit(_MARKS[0])
        for sign, words in reversed(list(zip(_MARKS[1:], bands))):
            out = F.when(key.isin(words), sign).otherwise(out) if words else out
        return out

    marks = F.transform(F.transform("__w", lambda w: key_of(F.col("__lang"), F.lower(w))), mark)
    df = df.withColumn("__s", F.array_join(marks, ""))
    return df.withColumn("__h", F.array(*[F.length("__s") - F.length(F.replace("__s", F.lit(c), F.lit(""))) for c in _MARKS])).drop("__s")


def references(rows: DataFrame) -> DataFrame:
    """(__lang, __ref_words, __ref_classes, __ref_n): sums over all measured rows of a
    language that pass the base rules."""
    words, classes = range(len(_MARKS)), range(len(CLASSES) + 1)
    sums = [F.sum(F.get("__h", F.lit(i))).alias(f"h{i}") for i in words] + [F.sum(F.get("__m.classes", F.lit(i))).alias(f"c{i}") for i in classes]
    per = rows.filter(~base_failed()).groupBy("__lang").agg(F.sum("__m.n_words").alias("__ref_n"), *sums)
    return per.select("__lang", "__ref_n", F.array(*[f"h{i}" for i in words]).alias("__ref_words"), F.array(*[f"c{i}" for i in classes]).alias("__ref_classes"))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of counts (each with a sum)."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    share = lambda a: F.transform(a, lambda x: x / total(a))

    def part(a, b):
        m = (a + b) / 2
        one = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
        return (one(a) + one(b)) / 2

    d = let(share(p), lambda a: let(share(q), lambda b: total(F.zip_with(a, b, part))))
    return F.sqrt(F.greatest(d, F.lit(0.0)))


def quality(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (default: all) with a struct ``__q``: the base
    counts, base_failed, the two distances (null where a guard holds them back), kept.

    Texts are measured once; the measured rows are written, as both the references and
    the verdicts read them."""
    carry = docs.columns if carry is None else carry
    rows = with_common_histogram(measured(docs.withColumn("__lang", language())), common_words(docs))
    rows = keep(rows.select(*carry, "__lang", "__m", "__h"), "quality-measured")
    refs = keep(references(rows), "quality-references")
    df = rows.join(refs, "__lang", "left")
    judged = ((F.col("__m.n_chars") >= MIN_CHARS) & (F.col("__m.n_words") >= MIN_WORDS)
              & (F.col("__ref_n") >= MIN_REFERENCE))
    df = df.withColumn("__c", F.when(judged, distance(F.col("__m.classes"), F.col("__ref_classes"))))
    df = df.withColumn("__d", F.when(judged, distance(F.col("__h"), F.col("__ref_words"))))
    nothing = F.when(judged, distance(F.array(F.lit(1), *[F.lit(0)] * len(BANDS)), F.col("__ref_words")))
    far = (F.coalesce("__c", F.lit(0.0)) > MAX_CHAR_DISTANCE) | F.coalesce(F.col("__d") > MAX_WORD_SHARE * nothing, F.lit(False))
    m = [F.col(f"__m.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return (df.withColumn("__q", F.struct(*m, base_failed().alias("base_failed"), F.col("__c").alias("class_distance"),
                                          F.col("__d").alias("word_distance"), (~base_failed() & ~far).alias("kept")))
            .select(*carry, "__q"))


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, kept, distances."""
    return quality(docs.select("doc_id", "text", "lang"), ["doc_id"]).select("doc_id", "__q.*")
