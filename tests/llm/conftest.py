"""Fixtures of the training-data operators: a session and tables with hard rows."""

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns that clash with names the operators use inside.
EXTRA = ", n long, hi long, tok long, did string, spans string, kept string, words string, score string"


def make_text(rng: random.Random, n: int, size: int = 300) -> str:
    words = ["".join(rng.choice("abcdeé") for _ in range(1 + i % 7)) for i in range(size)]
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def hard_rows():
    """Nulls, empty, blank and very long texts, copies, near copies, shared passages,
    hot groups and short texts: (doc_id, text, lang)."""
    rng = random.Random(5)
    base = [make_text(rng, n) for n in (1, 2, 4, 5, 6, 49, 50, 51, 60, 90, 120, 200, 400)]
    passage = make_text(rng, 70)
    rows = [(None, None), (None, base[6]), (1, None), (2, ""), (3, " \n\t "), (4, "...")]
    i = 10
    for t in base:
        for _ in range(3):
            rows.append((i, t))
            i += 1
    for _ in range(60):  # near copies of one text, in a hot group
        w = base[11].split()
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(1000))
        rows.append((i, " ".join(w)))
        i += 1
    for _ in range(25):  # a passage inside different texts
        rows.append((i, make_text(rng, 30) + " " + passage + "\n" + make_text(rng, 40)))
        i += 1
    rows.append((i, make_text(rng, 30000, 3000)))
    rows.append((i + 1, make_text(rng, 12, 4) + " " + "la la la " * 3000))
    rows.append((i + 2, "É" * 5000))
    rows += [(i + 3, "Upper CASE words only count once here ok"), (i + 3, "Upper CASE words only count once here ok")]
    return [(d, t, ["en", "fr", None][k % 3]) for k, (d, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def hard_docs(spark, hard_rows):
    values = [(d, t, g, "src0", None if t is None else len(t), 1, 2, 3, "x", "y", "z", "w", "s") for d, t, g in hard_rows]
    return spark.createDataFrame(values, COLUMNS + EXTRA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
