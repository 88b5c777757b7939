import random
import re
from collections import Counter
from zlib import crc32

import pytest

from postwatch.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def brute_words(rows, letters=6, least=5):
    found = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            found[run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run] += 1
    return {w: n for w, n in found.items() if len(w) >= letters and n >= least}


def distance_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    n, out = brute_words(rows), {}
    forms = {}
    for w in n:
        near = [v for v in n if abs(len(v) - len(w)) < 2 and v != w and distance_one(v, w)]
        form = min(near, key=lambda v: (-n[v], v), default=None)
        forms[w] = form if form and n[form] >= 5 * n[w] else None
        out[w] = [n[w], len(near)]
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (w, *out[w], forms[w], n.get(forms[w]), root)
    return out


def corpus(seed=3, docs=400):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeéßÀ÷") for _ in range(rng.randint(5, 9))) for _ in range(60)]
    rows = []
    for i in range(docs):
        words = []
        for _ in range(40):
            w = base[int(60 * rng.random() ** 2)]
            for _ in range(rng.choice([0, 0, 0, 1, 2])):
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice("abé") + w[at:], w[:at] + rng.choice("abé") + w[at + 1:]])
            words.append(w.title() if rng.random() < 0.1 else w)
        rows.append((i, rng.choice([" ", ", ", "\n", "1"]).join(words)))
    return rows


@pytest.mark.parametrize("options", [{}, {"leaves": 5}, {"leaves": 3, "searchers": 4}, {"groups": ["abcdeéßÀ÷"]}, {"leaves": 4, "searchers": 7, "groups": ["ab", "cdeé"]}], ids=range(5))
def test_against_brute_force(spark, options):
    """Whole tries, small subtries, chunks of equal counts, and groups that tell nothing all give the same words."""
    rows = corpus()
    found = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), **options).collect()
    want = brute(rows)
    assert {r.word: (r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in found} == want and len(found) == len(want)
    assert sum(1 for r in found if r.root != r.word) > 20


def test_chains(spark):
    rows = [(i, "abcdefgh " * 1000 + "abcdefg " * 100 + "abcdefgx " * 20 + "abcdef " * 5) for i in range(1, 2)]
    found = {r.word: r for r in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (found["abcdef"].form, found["abcdef"].root) == ("abcdefg", "abcdefgh") and found["abcdefgh"].form is None
    assert found["abcdefgx"].form == "abcdefgh" and found["abcdefgh"].n_near == 2


def test_walk_finds_all_within_budget_and_prunes():
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcdefgh") for _ in range(rng.randint(6, 8))) for _ in range(3000)})
    raw, groups = [w.encode() for w in words], list("abcdefgh")
    trie, counts = spelling.Trie(spelling.count_matrix(raw, groups)), spelling.count_matrix(raw, groups)
    pairs = {(i, j) for a, b in trie.walk(counts) for i, j in zip(a.tolist(), b.tolist())}
    budget = lambda x, y: max((y - x).clip(0).sum(), (x - y).clip(0).sum()) <= 1
    for i in rng.sample(range(len(words)), 60):
        assert {j for j in range(len(words)) if budget(counts[i], counts[j])} == {j for a, j in pairs if a == i}
    assert len(pairs) < 0.02 * len(words) ** 2


def test_one_edit_many_and_long():
    rng = random.Random(8)
    words = ["".join(rng.choice("ab") for _ in range(rng.choice([1, 2, 3, 5, 63, 64, 65, 66, 67]))) for _ in range(120)]
    words += [w[:i] + c + w[i + k:] for w in words[:40] for i, c, k in ((0, "", 1), (len(w), "b", 0), (len(w) // 2, "a", 1))]
    raw = [w.encode() for w in words if w]
    a = spelling.Letters(raw)
    import numpy as np

    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(raw)), np.arange(len(raw))))
    want = [x != y and distance_one(x.decode(), y.decode()) for x, y in ((raw[p], raw[q]) for p, q in zip(i, j))]
    assert a.near(i, a, j).tolist() == want == [spelling.one_edit(raw[p], raw[q]) for p, q in zip(i, j)]
    assert a.near(i[:50], spelling.Letters(raw[:3]), j[:50] * 0).tolist() == [spelling.one_edit(raw[p], raw[0]) for p in i[:50]]


def test_edges(spark, edges, nothing):
    assert spelling.variants(edges).count() == spelling.variants(nothing).count() == 0
    assert {r.word for r in spelling.variants(edges, least_letters=5, least_count=1, modulus=1 << 40).collect()} >= {"y" * 50_000, "three", "seven"}
    long = "y" * 1_000_000
    rows = [(i, t) for i in range(6) for t in (long, long[:-1] + " abcdef", None, "", " \n" * 1_000_000, "abcdeÉ÷")] + [(None, "abcdef " * 4)]
    found = {r.word: r for r in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {w: r.n for w, r in found.items()} == brute_words(rows)
    assert found[long].n_near == found[long[:-1]].n_near == 1
