import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ("doc_id long, text string, lang string, source string, n_chars long, size long, row string, key long, part int, h long, "
           "host string, id long, target double, fp long, node long, label int, raw string, bin int, quality string")


def make(spark, rows):
    """A documents table of (doc_id, text, lang, source) rows, with extra columns whose names operators use inside."""
    extra = (1, "r", 2, 3, 4, "h", 5, 0.5, 6, 7, 1, "w", 8, "q")
    return spark.createDataFrame([(i, t, l, s, None if t is None else len(t), *extra) for i, t, l, s in rows], COLUMNS)


def random_rows(n=150, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 12, 60, 200]))]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\n", "\t"]) for w in words)
        if rows and rng.random() < 0.3:
            old = rng.choice(rows)[1] or ""
            text = old if rng.random() < 0.5 else old + " " + rng.choice(vocabulary)
        rows.append((i * 3, text, rng.choice(["aa", "bb", None]), rng.choice(["s1", "s1", "s1", "s2", "s3", None])))
    return rows


EDGES = [
    (None, "a b c d e f", "aa", "s1"), (None, None, None, None), (1, None, "aa", "s1"), (2, "", None, "s2"), (3, " \n\t ", "bb", None),
    (4, "word", "aa", "s1"), (5, "one two three four five six seven", "aa", "s1"), (5, "one two three four five six seven", "aa", "s1"),
    (5, "other text with the same id here", "bb", "s2"), (6, "x " * 30_000, "aa", "s1"), (7, "y" * 50_000, "bb", "s1"),
    (8, "Über 中文 😀 é z", "bb", "s2"), (9, "one two three four five six seven", None, "s4"),
]


@pytest.fixture(scope="session")
def edge_rows():
    return EDGES


@pytest.fixture(scope="session")
def edges(spark):
    return make(spark, EDGES)


@pytest.fixture(scope="session")
def nothing(spark):
    return make(spark, [])


@pytest.fixture(scope="session")
def rows():
    return random_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return make(spark, rows)
