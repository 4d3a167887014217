"""Operators 1, 6, 7 and 8 against brute force on rows with nulls, empty and long texts,
copies, ties, clashing columns and empty tables."""

import hashlib
import os
import re
from collections import Counter, defaultdict

import pytest

from seamfix.llm import jaccard
from seamfix.llm.decontaminate import contamination
from seamfix.llm.jaccard import jaccard_join, matches_wanted
from seamfix.llm.quality import quality_report, quality
from seamfix.llm.substrings import substring_dedup

SPACED = re.compile(rb"[^\x20\x09-\x0D]+")
PLAIN = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def spaced(text, lower=False):
    raw = (text or "").encode()
    if lower:
        raw = bytes(c + 32 if 65 <= c <= 90 else c for c in raw)
    return SPACED.findall(raw)


def plain(text):
    return PLAIN.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))


def brute_components(rows):
    """(n_shingles, component) of each row, by comparing all pairs that share a shingle."""
    sets = []
    for _, t, _ in rows:
        w = spaced(t, lower=True)
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = {(a, b) for l in where.values() for a in l for b in l if a < b}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    key = lambda d: (d is not None, d or 0)
    low = {}
    for i, (d, _, _) in enumerate(rows):
        r = root(i)
        low[r] = min(low.get(r, d), d, key=key) if r in low else d
    return [(d, len(s), low[root(i)] if s else d) for i, ((d, _, _), s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("rounds", [0, 1, jaccard.LEADER_ROUNDS])
def test_jaccard_components(hard_docs, hard_rows, monkeypatch, rounds):
    monkeypatch.setattr(jaccard, "LEADER_ROUNDS", rounds)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join(hard_docs).collect()]
    assert Counter(got) == Counter(brute_components(hard_rows))


def test_jaccard_postings_of_huge_sets(spark):
    """Sets of more than 2**24 shingles keep their size and their places."""
    rows = [(5, 6, 2**31 - 1, 8, 255, 2**31 - 2), (7, 8, 20_000_000, 1, 0, 17_000_000), (-9, 1, 1, 1, 1, 0)]
    df = spark.createDataFrame(rows, "tok long, c long, n int, ell int, own int, pos int")
    assert [tuple(r) for r in jaccard.unpacked(jaccard.packed(df)).collect()] == rows


def test_jaccard_multi_match():
    import numpy as np
    assert matches_wanted(np.zeros(30), 10, 8) == 1  # nothing else in the lists: the shortest prefix
    assert matches_wanted(np.full(30, 50.0), 10, 8) > 1  # costly lists: a longer one


def test_jaccard_parities():
    """Two sets differ in no more cells than in shingles, whatever their sizes."""
    import numpy as np
    rng = np.random.default_rng(5)
    for n in (1, 7, 200, 5000):
        s = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        gone = max(1, n // 9)
        other = np.unique(np.concatenate((s[gone:], rng.integers(0, 2**63, gone).astype(np.uint64))))
        cells = sum(int(x).bit_count() for x in (jaccard.parities(s) ^ jaccard.parities(other)).view(np.uint64))
        assert cells <= len(np.setxor1d(s, other))
        assert not (jaccard.parities(s) ^ jaccard.parities(s)).any()
    assert len(jaccard.parities(s)) == jaccard.PARITY_LONGS


@pytest.mark.parametrize("rounds", [0, 2])
def test_jaccard_group_around_the_threshold(spark, monkeypatch, rounds):
    """Sets of one shared passage with own tails, so that pairs lie on both sides of 0.8 and on it."""
    monkeypatch.setattr(jaccard, "LEADER_ROUNDS", rounds)
    base = [f"w{i}" for i in range(84)]  # 80 shingles
    rows = [(i, " ".join(base + [f"t{i}x{j}" for j in range(9 + i % 4)]), None) for i in range(40)]
    rows += [(100 + i, " ".join(base[:84 - i] + [f"u{i}x{j}" for j in range(12)]), None) for i in range(12)]
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join(docs).collect()]
    want = brute_components(rows)
    assert Counter(got) == Counter(want)
    assert 1 < len({c for _, _, c in want}) < len(rows)


def test_jaccard_empty(no_docs):
    assert jaccard_join(no_docs).count() == 0


ITEMS = [(1, "passage"), (2, "short one"), (3, "Short, ONE!"), (4, "la"), (5, None), (6, ""), (None, "edit7"), (7, "passage")]


def test_contamination(spark, hard_docs, hard_rows):
    shared = next(t for _, t, _ in hard_rows if t and "\n" in t and len(t.split()) == 140).split()
    items = [(i, " ".join(shared[35:60]) if t == "passage" else t) for i, t in ITEMS]
    items += [(20, " ".join(shared[30:40])), (21, " ".join(shared[31:40]))]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, h string")
    wins = defaultdict(set)
    for i, t in items:
        w = plain(t)
        for p in range(len(w) - min(10, len(w)) + 1) if w else ():
            wins[tuple(w[p:p + min(10, len(w))])] |= set() if i is None else {str(i)}
    want = []
    for d, t, _ in hard_rows:
        w = plain(t)
        hit, ids = bytearray(len(w)), set()
        for n in {len(k) for k in wins}:
            for p in range(len(w) - n + 1):
                k = tuple(w[p:p + n])
                if k in wins:
                    hit[p:p + n] = b"\1" * n
                    ids |= wins[k]
        want.append((d, len(w), sum(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), sum(hit) > 0))
    got = [tuple(r) for r in contamination(hard_docs, bench).drop("spans").collect()]
    assert Counter(got) == Counter(want)
    assert sum(x[-1] for x in want) > 20


def test_contamination_empty(spark, hard_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(no_docs, none).count() == 0
    assert not any(r.contaminated for r in contamination(hard_docs, none).collect())


def brute_base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(zip(w, w[1:], w[2:]))
    covered = {p for i in range(len(w) - 2) if seen[w[i], w[i + 1], w[i + 2]] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_quality_base(hard_docs, hard_rows):
    got = [tuple(r)[:7] for r in quality_report(hard_docs).collect()]
    assert Counter(got) == Counter((d, *brute_base(t)) for d, t, _ in hard_rows)


def test_quality_verdict(spark):
    """Few texts hold a rare word more than once, as in prose; common words make up half."""
    import random
    rng = random.Random(1)
    rare = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    common = ["the", "of", "and", "to"] + [rare() for _ in range(40)]
    clean = [" ".join(rng.choice(common[:4]) if rng.random() < 0.3 else rng.choice(common) if rng.random() < 0.5 else rare() for _ in range(120)) + "."
             for _ in range(200)]
    junk = [clean[0].upper(), " ".join(rare() for _ in range(120)), " ".join(w + "$$$###" for w in clean[1].split()),
            " ".join(rng.choice(common[:4]) + " " + rng.choice(common[:4]) for _ in range(60))]
    df = spark.createDataFrame([(i, t, "en", 1, 2, ["x"]) for i, t in enumerate(clean + junk)],
                               "doc_id long, text string, lang string, classes int, ref_n int, common array<string>")
    kept = {r.doc_id: r.kept for r in quality_report(df).collect()}
    assert all(kept[i] for i in range(200))
    assert not any(kept[i] for i in range(200, 204))
    assert quality(df).drop("__q").columns == df.columns


def test_quality_of_planted_texts_in_the_given_table(spark):
    """Letters at random go, texts under another language are far off; nearly all others stay."""
    import random
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables")
    rng = random.Random(3)
    docs = spark.read.parquet(path).select("doc_id", "text", "lang")
    langs = ["en", "de", "fr", "es"]
    planted = [(10_000 + i, " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 9))) for _ in range(300)), x) for i, x in enumerate(langs)]
    other = {"en": "de", "de": "fr", "fr": "en", "es": "de"}
    own = [docs.filter(f"lang = '{x}' and length(text) between 900 and 1500 and text not like '%|%'").orderBy("doc_id").first() for x in langs]
    wrong = [(20_000 + r["doc_id"], r["text"], other[r["lang"]]) for r in own]
    got = {r["doc_id"]: r for r in quality_report(docs.unionByName(spark.createDataFrame(planted + wrong, "doc_id long, text string, lang string"))).collect()}
    assert not any(got[d]["kept"] for d, _, _ in planted)
    assert all(got[r["doc_id"]]["kept"] for r in own)
    assert all(got[d]["word_distance"] > 3 * got[d - 20_000]["word_distance"] for d, _, _ in wrong), [(got[d], got[d - 20_000]) for d, _, _ in wrong]
    sound = [r for d, r in got.items() if d < 10_000 and not r["base_failed"] and (r["class_distance"] or 0) <= 0.27]
    assert sum(r["kept"] for r in sound) >= 0.99 * len(sound)


def test_quality_empty(no_docs):
    assert quality_report(no_docs).count() == 0


def brute_removal(rows, t=50):
    key = lambda d: -(2**63) if d is None else d
    low = {}
    for d, text, _ in rows:
        w = spaced(text)
        for i in range(len(w) - t + 1):
            k = tuple(w[i:i + t])
            low[k] = min(low.get(k, key(d)), key(d))
    for d, text, _ in rows:
        w = spaced(text)
        gone = bytearray(len(w))
        for i in range(len(w) - t + 1):
            if low[tuple(w[i:i + t])] < key(d):
                gone[i:i + t] = b"\1" * t
        kept = [x for x, g in zip(w, gone) if not g]
        yield d, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()


def test_substrings(hard_docs, hard_rows):
    got = [tuple(r) for r in substring_dedup(hard_docs).drop("spans").collect()]
    assert Counter(got) == Counter(brute_removal(hard_rows))


def test_substrings_branching(spark):
    """Shared spans that begin, end and branch at different places in many documents."""
    import random
    rng = random.Random(3)
    pool = [str(i) for i in range(40)]
    spans = [[rng.choice(pool) for _ in range(rng.randrange(40, 160))] for _ in range(12)]
    rows = []
    for d in range(150):
        w = []
        for _ in range(rng.randrange(1, 5)):
            s = rng.choice(spans)
            a = rng.randrange(0, 20)
            w += s[a:len(s) - rng.randrange(0, 20)] + [rng.choice(pool) for _ in range(rng.randrange(0, 30))]
        rows.append((d, " ".join(w), "en"))
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = [tuple(r) for r in substring_dedup(df).drop("spans").collect()]
    assert Counter(got) == Counter(brute_removal(rows))


def test_substrings_empty(no_docs):
    assert substring_dedup(no_docs).count() == 0


def test_components_end_with_stars(spark, monkeypatch):
    """Edges that are stars need no round, others as many as it takes; no join sends a table through the driver."""
    from seamfix.llm import common
    written = []
    monkeypatch.setattr(common, "keep", lambda df, name, keep=common.keep: (written.append(df._jdf.queryExecution().executedPlan().toString()), keep(df, name))[1])
    rows = [(5, 1), (7, 1), (9, 2), (1, 7)]
    got = common.components(spark.createDataFrame(rows, "u long, v long")).collect()
    assert sorted((r.node, r.root) for r in got) == [(5, 1), (7, 1), (9, 2)] and len(written) == 1
    rows = [(i, i + 1) for i in range(40)] + [(60, 50), (60, 51), (61, 51), (61, 70), (80, 80)]
    got = common.components(spark.createDataFrame(rows, "u long, v long")).collect()
    assert sorted((r.node, r.root) for r in got) == [(i, 0) for i in range(1, 41)] + [(i, 50) for i in (51, 60, 61, 70)]
    assert len(written) > 2 and not any("BroadcastExchange" in plan for plan in written)
