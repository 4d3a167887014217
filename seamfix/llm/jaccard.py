"""Operator 1: n-gram Jaccard join with adaptive multi-match prefixes.

Documents are sets of distinct word n-grams. Two sets link when
``100 * |x & y| >= threshold * |x | y|``. Method (after adaptive prefix
filtering, AdaptJoin, 2012):

* equal sets are one class (128-bit digest of the sorted set); the join works
  on one row per class, so a group of exact copies costs one row;
* shingles are ordered by a count sketch over all documents, then by hash; a
  set's ``l``-prefix is its first ``n - ceil(0.8 n) + l`` shingles, and two
  similar sets share at least ``l`` shingles of their ``l``-prefixes;
* every set picks its own ``l`` (1 to 8) by estimated cost: postings read plus
  the candidates that could still reach ``l`` matches, times a verification
  cost. A pair must share ``min(l_x, l_y)`` prefix shingles before it is verified,
  and as many as the overlap it needs leaves outside the longer rest of the two;
* leader rounds first link each set to the leaders of its posting lists and merge
  components, so groups of near copies cost rows in proportion to their members. The
  last round takes every remaining pair of different components, with length and
  position filters, so no link between components is lost. There each set also shows
  the parities of its shingles in 512 cells: two sets differ in no more cells than in
  shingles, which keeps large groups of not quite similar sets from becoming pairs.

Sketch, bits, parities and rounds change the work only, never the result.

Defined cases: null, empty or blank text has no shingles, links with nothing
and is its own component; fewer than ``k`` words make one shingle of the whole
sequence; rows that repeat a doc_id are each judged by their own text; a null
doc_id counts as smaller than all others and is returned as null; extra columns
are ignored; an empty table gives an empty result."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, ids_and_texts, keep, list_column, release, texts_of
from .words import NON_SPACE, Hasher, as_long, blocks

SKETCH_BITS = 20
PARTS = 64
MAX_MATCHES = 8
VERIFY_COST = 32.0
LEADER_ROUNDS = 2
LEADERS = 2
NO_ID = -(2**63)
#: Longs with the parities of a set's shingles.
PARITY_LONGS = 8


def shingle_sets(hasher: Hasher, texts: list, k: int):
    """Sorted distinct shingle hashes of each text."""
    h, first = hasher.words(texts, NON_SPACE, lower=True)
    g = hasher.ngrams(h, k)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= k:
            s = np.sort(g[a:b - k + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        else:
            yield hasher.ngrams(h[a:b], b - a) if b > a else np.empty(0, np.uint64)


def digest(s: np.ndarray) -> tuple[int, int]:
    two = np.frombuffer(blake2b(s.tobytes(), digest_size=16).digest(), dtype=np.int64)
    return int(two[0]), int(two[1])


def describe(docs: DataFrame, k: int) -> DataFrame:
    """One row per document (did, n, hi, lo) and, with hi null, the parts of the
    task's count sketch (did: part, part: 32-bit counters)."""

    def task(batches):
        hasher, sketch = Hasher(), np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        names = ["did", "n", "hi", "lo", "part"]
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, texts in blocks(batch.column(1)):
                rows = []
                for did, s in zip(ids[a:b], shingle_sets(hasher, texts, k)):
                    np.add.at(sketch, (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
                    rows.append((did, len(s), *digest(s)))
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in zip(*rows)], pa.nulls(b - a, pa.binary())], names)
        parts = sketch.reshape(PARTS, -1)
        used = np.flatnonzero(parts.any(axis=1))
        none = pa.nulls(len(used), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), none, none, none,
                                          pa.array([parts[i].tobytes() for i in used], pa.binary())], names)

    return keep(ids_and_texts(docs).mapInArrow(task, "did long, n long, hi long, lo long, part binary"), "jaccard-sets")


def parities(s: np.ndarray) -> np.ndarray:
    """The parity of the number of shingles in each of 64 * PARITY_LONGS cells."""
    cells = (s >> np.uint64(20)) & np.uint64(64 * PARITY_LONGS - 1)
    odd = np.bincount(cells.astype(np.int64), minlength=64 * PARITY_LONGS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def load_of(described: DataFrame) -> np.ndarray:
    """The summed sketch: 2**20 counters, whatever the input."""

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[i] = sums.get(i, 0) + np.frombuffer(part, np.uint32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())],
                                         ["did", "part"])

    t = (described.filter("hi is null").select("did", "part").repartition(PARTS, "did")
         .mapInArrow(total, "did long, part binary")).toArrow()
    load = np.zeros((PARTS, (1 << SKETCH_BITS) // PARTS), dtype=np.int64)
    for i, part in zip(t["did"].to_pylist(), t["part"].to_pylist()):
        load[i] += np.frombuffer(part, np.int64)
    return load.reshape(-1)


def matches_wanted(others: np.ndarray, p1: int, most: int) -> int:
    """The l of least estimated cost; others: expected other postings of the
    set's shingles in order."""
    read = np.cumsum(others)[p1 - 1:p1 - 1 + most]
    ls = np.arange(1, len(read) + 1)
    return int(np.argmin(p1 + ls + read + VERIFY_COST * read / ls)) + 1


def prefixes(docs: DataFrame, k: int, threshold: int, shared) -> DataFrame:
    """One row per class: hi, lo, did (smallest id), n, ell, toks (prefix), end (where
    the prefix ends in the order of all shingles), own (share, of 255, of the prefix that
    the sketch takes for the set's own), odd (parities), c (number of the class).
    ``shared``: the summed sketch, sent to the tasks."""

    def task(batches):
        hasher, load = Hasher(), shared.value
        base = load.mean() + 2 * np.sqrt(load.mean())
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, texts in blocks(batch.column(1)):
                rows, toks, odd = [], [], []
                for did, s in zip(ids[a:b], shingle_sets(hasher, texts, k)):
                    n = len(s)
                    if not n:
                        continue
                    heavy = load[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                    t = -(-threshold * n // 100)
                    p1 = n - t + 1
                    most = min(MAX_MATCHES, t)
                    order = np.lexsort((s, heavy))[:p1 - 1 + most]
                    ell = matches_wanted(np.maximum(heavy[order] - base, 0.0), p1, most)
                    order = order[:p1 - 1 + ell]
                    toks.append(s[order])
                    odd.append(parities(s))
                    end = min(int(heavy[order[-1]]), 2**31 - 1) << 32 | int(s[order[-1]]) >> 32
                    own = 255 * int(np.count_nonzero(heavy[order] <= base)) // len(order)
                    rows.append((did, n, *digest(s), ell, end, own))
                if rows:
                    cols = [pa.array(c, pa.int64()) for c in zip(*rows)]
                    yield pa.RecordBatch.from_arrays(
                        [*cols, list_column(as_long(np.concatenate(toks)), [len(x) for x in toks]),
                         list_column(np.concatenate(odd), [PARITY_LONGS] * len(odd))],
                        ["did", "n", "hi", "lo", "ell", "end", "own", "toks", "odd"])

    each = ids_and_texts(docs).mapInArrow(task, "did long, n long, hi long, lo long, ell long, end long, own long, toks array<long>, odd array<long>")
    return (each.groupBy("hi", "lo").agg(F.min("did").alias("did"), F.first("n").cast("int").alias("n"),
                                         F.first("ell").cast("int").alias("ell"), F.first("end").alias("end"), F.first("own").alias("own"),
                                         F.first("toks").alias("toks"), F.first("odd").alias("odd"))
            .withColumn("c", F.monotonically_increasing_id()))


def verified(docs: DataFrame, pairs: DataFrame, reps: DataFrame, k: int, threshold: int) -> DataFrame:
    """(u, v): the pairs (a, b) of classes that link, by their whole texts."""
    names = reps.select("c", "did", "hi")
    pairs = (pairs.join(names.toDF("a", "da", "ha"), "a").join(names.toDF("b", "db", "hb"), "b"))
    pairs = keep(pairs.select("a", "da", "ha", "b", "db", "hb"), "jaccard-pairs")
    texts = texts_of(docs, pairs.select(F.col("da").alias("did")).union(pairs.select("db")).distinct())

    def exact(batches):
        hasher = Hasher()
        for batch in batches:
            ha, hb = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for a, b, left, right in blocks(batch.column(4), batch.column(5)):
                xs, ys = shingle_sets(hasher, left, k), shingle_sets(hasher, right, k)
                ok = []
                for x, y, hx, hy in zip(xs, ys, ha[a:b], hb[a:b]):
                    both = np.sort(np.concatenate((x, y)))
                    common = int(np.count_nonzero(both[1:] == both[:-1]))
                    # A row that only shares its id with a class's smallest row is not of the class.
                    ok.append(100 * common >= threshold * (len(both) - common) and digest(x)[0] == hx and digest(y)[0] == hy)
                yield batch.slice(a, b - a).filter(pa.array(ok)).select([0, 1])

    out = (pairs.join(texts.select(F.col("did").alias("db"), F.col("text").alias("tb")), "db")
           .join(texts.select(F.col("did").alias("da"), F.col("text").alias("ta")), "da")
           .select("a", "b", "ha", "hb", "ta", "tb").mapInArrow(exact, "a long, b long"))
    return keep(out.select(F.col("a").alias("u"), F.col("b").alias("v")), "jaccard-links")


def packed(postings: DataFrame) -> DataFrame:
    """(tok, c, meta, pos): n (31 bits), ell and own in one long keep the shuffle of the
    postings narrow; pos is an int of its own, so no size of a set is cut."""
    return postings.select("tok", "c", F.expr("(cast(n as bigint) << 4 | ell) << 8 | own").alias("meta"), F.col("pos").cast("int").alias("pos"))


def unpacked(rows: DataFrame) -> DataFrame:
    part = lambda shift, bits: F.shiftright("meta", shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    return rows.select("tok", "c", part(12, 31).alias("n"), part(8, 4).alias("ell"), part(0, 8).alias("own"), "pos")


def link_components(docs: DataFrame, reps: DataFrame, k: int, threshold: int) -> DataFrame | None:
    """(node, root) of the classes that have links, or None."""
    lo, hi = threshold, 100
    tok = Window.partitionBy("tok")
    rows = (packed(reps.select("c", "n", "ell", "own", F.posexplode("toks").alias("pos", "tok")))
            .withColumn("cnt", F.count(F.lit(1)).over(tok)).filter("cnt > 1"))
    index = unpacked(rows)
    live = keep(index.withColumn("comp", F.col("c")), "jaccard-index")
    def wanted(n, ell, m, ell2):  # shared prefix shingles a pair needs
        rest = lambda a, l: f"(ceil({a} * {lo} / {hi}.0) - {l})"
        return (f"greatest(least({ell}, {ell2}), ceil(({n} + {m}) * {lo} / {hi + lo}.0) "
                f"- greatest({rest(n, ell)}, {rest(m, ell2)}))")

    close = lambda n, m: f"{lo} * greatest({n}, {m}) <= {hi} * least({n}, {m})"
    roots = None
    for turn in range(LEADER_ROUNDS + 1):
        if roots is not None:
            joined = (live.drop("comp").join(roots.withColumnRenamed("node", "c"), "c", "left")
                      .withColumn("comp", F.coalesce("root", "c")).drop("root")
                      .withColumn("x", F.min("comp").over(tok)).withColumn("y", F.max("comp").over(tok))
                      .filter("x <> y").drop("x", "y"))
            old, live = live, keep(joined, "jaccard-index")
            release(old)
        if turn < LEADER_ROUNDS:
            # A list's leader is a set with the fewest shingles of its own, next to which
            # near copies lie; the order is the same in all lists.
            seeds = [0] if turn == 0 else [LEADERS * turn + i for i in range(LEADERS)]
            lead = [F.min(F.struct("own", F.xxhash64("c", F.lit(i)), F.col("c").alias("lc"), F.col("n").alias("ln"),
                                   F.col("ell").alias("lell"), F.col("comp").alias("lcomp"), F.lit(i).alias("seed"))).over(tok) for i in seeds]
            led = live.withColumn("leads", F.array(*lead)).withColumn("lead", F.explode("leads")).select(
                "c", "n", "ell", "comp", *[f"lead.{x}" for x in ("lc", "ln", "lell", "lcomp", "seed")])
            pairs = (led.filter("comp <> lcomp").filter(close("n", "ln")).groupBy("c", "lc", "seed")
                     .agg(F.count(F.lit(1)).alias("m"), *[F.first(x).alias(x) for x in ("n", "ell", "ln", "lell")])
                     .filter("m >= " + wanted("n", "ell", "ln", "lell"))
                     .groupBy("c", "seed").agg(F.max_by("lc", F.struct("m", "lc")).alias("lc"))
                     .select(F.least("c", "lc").alias("a"), F.greatest("c", "lc").alias("b")).distinct())
        else:
            # In each list the rows outside its most frequent component meet all others.
            # A shared shingle of two components is in their live postings: ``rank`` counts
            # the postings of a set before this one, ``alone`` its prefix shingles without
            # one. Of two sets the one whose prefix ends first shares none of the latter.
            own = Window.partitionBy("c")
            odd = [F.col("odd")[i].alias(f"odd{i}") for i in range(PARITY_LONGS)]
            each = (live.join(reps.select("c", "end", *odd), "c").withColumn("rank", F.row_number().over(own.orderBy("pos")) - 1)
                    .withColumn("cnt", F.count(F.lit(1)).over(own))
                    .withColumn("alone", F.expr(f"n - ceil(n * {lo} / {hi}.0) + ell - cnt")))
            each = each.withColumn("in_comp", F.count(F.lit(1)).over(Window.partitionBy("tok", "comp")))
            each = each.withColumn("major", F.max(F.struct("in_comp", "comp")).over(tok)["comp"])
            cols = ["c", "n", "ell", "comp", "pos", "rank", "cnt", "end", "alone", *[f"odd{i}" for i in range(PARITY_LONGS)]]
            x = each.filter("comp <> major").select("tok", *[F.col(c).alias("x" + c) for c in cols])
            y = each.select("tok", "major", *[F.col(c).alias("y" + c) for c in cols])
            room = "1 + least(xn - xpos - 1, yn - ypos - 1) + least(xrank, yrank)"
            of_first = lambda a: f"case when xend < yend then x{a} when yend < xend then y{a} else greatest(x{a}, y{a}) end"
            x, y = (df.withColumn(f"{side}most", F.expr(f"{side}n - {side}alone")).withColumn(
                f"{side}rest", F.expr(f"ceil({side}n * {lo} / {hi}.0) - {side}ell")) for side, df in (("x", x), ("y", y)))
            # A pair with ``need`` shared postings has one with need - 1 postings of both
            # sets after it: such rows find the pairs, the postings' arrays count for them.
            differ = " + ".join(f"bit_count(xodd{i} ^ yodd{i})" for i in range(PARITY_LONGS))
            need = f"greatest(least(xell, yell), ceil((xn + yn) * {lo} / {hi + lo}.0) - ({of_first('rest')}))"
            pairs = (x.join(y, "tok").filter("xcomp <> ycomp and (ycomp = major or xc < yc)").filter(close("xn", "yn"))
                     .filter(f"{hi + lo} * ({of_first('most')}) >= {lo} * (xn + yn)")
                     .filter(f"{hi + lo} * ({room}) >= {lo} * (xn + yn)")
                     .filter(f"xrank <= xcnt - ({need}) and yrank <= ycnt - ({need})")
                     .filter(f"{hi + lo} * ({differ}) <= {hi - lo} * (xn + yn)")
                     .groupBy(F.least("xc", "yc").alias("a"), F.greatest("xc", "yc").alias("b"))
                     .agg(F.first(F.expr(need)).alias("need")))
            lists = live.groupBy("c").agg(F.collect_list("tok").alias("toks"))
            pairs = (pairs.join(lists.toDF("a", "ta"), "a").join(lists.toDF("b", "tb"), "b")
                     .filter("size(array_intersect(ta, tb)) >= need").select("a", "b"))
        pairs = keep(pairs, "jaccard-candidates")
        if pairs.isEmpty():
            continue
        found = verified(docs, pairs, reps, k, threshold)
        release(pairs)
        if roots is not None:
            found = found.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v")))
        roots = components(found, "jaccard-edges")
    release(live)
    return roots


def jaccard_join(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, class_id.

    class_id identifies equal sets; component_id is the smallest doc_id
    reachable over links (a document without shingles: its own id)."""
    described = describe(docs, k)
    shared = docs.sparkSession.sparkContext.broadcast(load_of(described))
    reps = keep(prefixes(docs, k, threshold, shared), "jaccard-prefixes")
    shared.destroy()
    roots = link_components(docs, reps, k, threshold)
    classes = reps.select("hi", "did", "c").withColumn("root", F.col("c"))
    if roots is not None:
        classes = (reps.select("hi", "did", "c").join(roots.withColumnRenamed("node", "c"), "c", "left")
                   .withColumn("root", F.coalesce("root", "c")))
    small = classes.groupBy("root").agg(F.min("did").alias("component"))
    classes = classes.join(small, "root").select("hi", "component")
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return (described.filter("hi is not null")
            .join(classes, "hi", "left")
            .withColumn("component", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("did")))
            .select(real("did").alias("doc_id"), F.col("n").alias("n_shingles"),
                    real("component").alias("component_id"), F.col("hi").alias("class_id")))
