import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from postwatch.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, queries, top=10):
    """Rows (item, rank, doc, score) by the rules alone, every document scored for every query."""
    counts = [(i, Counter(TERM.findall(fold(t)))) for i, t in docs]
    n_docs, n_all = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in queries:
        found = []
        for doc_id, c in counts:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // max(n_all, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in TERM.findall(fold(text)) if t in c)
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0))
        out += [(item, rank + 1, None if none else doc_id, -s) for rank, (s, none, doc_id) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    word = lambda: vocabulary[int(400 * rng.random() ** 3)]
    docs = [(i, " ".join(word() for _ in range(rng.choice([0, 2, 10, 50, 300])))) for i in range(300)]
    docs += [(1000 + i, docs[i][1]) for i in range(0, 300, 7)]  # ties
    queries = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 30])))) for i in range(25)]
    return docs, queries + [(100, docs[8][1]), (101, "nothing here at all zzz"), (102, None), (103, "")]


@pytest.mark.parametrize("coordinates", [1, 64, 4096])
def test_against_brute_force(spark, corpus, coordinates):
    """Any number of coordinates gives the same result; with one, each bound is the largest impact of the document."""
    docs, queries = corpus
    found = search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(queries, "item_id long, text string"),
                          coordinates=coordinates)
    assert rows_of(found) == brute(docs, queries)


def test_blocks_of_queries(spark, corpus):
    docs, queries = corpus
    found = search.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string"), query_bytes=1500)
    assert rows_of(found) == brute(docs, queries)


def test_bounds_hold_and_prune(corpus):
    docs, queries = corpus
    counts = [search.term_counts(t.encode()) for _, t in docs]
    n_docs, n_all = sum(map(bool, counts)), sum(c.total() for c in counts)
    df = Counter(t for c in counts for t in c)
    norms = search.length_norm(np.array([c.total() for c in counts]), n_docs, n_all)
    sketch, rescored = search.sketches(counts, norms, 4096), 0
    for _, text in queries[:25]:
        terms = {t: k * search.weight(n_docs, df[t]) for t, k in search.term_counts(text.encode()).items() if df[t]}
        q = search.Query(terms, 4096, 10)
        bounds = q.weights @ sketch[q.at]
        exact = [sum(w * search.impact(c[t], int(m)) for t, w in terms.items() if t in c) for c, m in zip(counts, norms)]
        assert (bounds >= exact).all()
        rescored += q.search(sketch, counts, norms.tolist(), list(range(len(counts))))
    assert rescored < 0.3 * 25 * len(docs)


def test_terms():
    text = "A-b_C9\x00é\x7fÜ中文 \t\n[z]`{0}"
    assert search.term_counts(text.encode()) == Counter(t.encode() for t in TERM.findall(fold(text)))
    assert search.term_counts("ÀÉ".encode()) == {"ÀÉ".encode(): 1}


def test_edges(spark, edges, nothing, edge_rows):
    docs = [(i, t) for i, t, *_ in edge_rows]
    queries = [(1, "one two word"), (2, "x"), (None, "Über 中文"), (4, None), (5, "a b"), (5, "a b")]
    asked = spark.createDataFrame(queries, "item_id long, text string")
    assert rows_of(search.search(edges, asked)) == brute(docs, queries)
    assert search.search(nothing, asked).count() == search.search(edges, asked.limit(0)).count() == 0
    long = [(1, "y" * 2_000_000), (2, "q " * 1_000_000), (3, " " * 2_000_000 + "q")]
    assert rows_of(search.search(spark.createDataFrame(long, "doc_id long, text string"), spark.createDataFrame([(1, "q")], "item_id long, text string"))) == brute(long, [(1, "q")])
