import hashlib
import random

import numpy as np
import pytest

from postwatch.llm import minhash

from .conftest import WORD, make


def brute(rows):
    hasher = minhash.MinHash()
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for (i, text, *_), (_, after, *_) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        own, other, following = (hasher.signature(t.encode()) for t in (text, edited, after))
        out[i] = (i, len(text), hashlib.sha256(edited.encode()).hexdigest(), minhash.hexadecimal(own), minhash.hexadecimal(other),
                  minhash.likeness(own, other), minhash.likeness(own, following))
    return out


@pytest.mark.parametrize("partition_bytes", [1 << 30, 500])
def test_compare_with_next(docs, rows, partition_bytes):
    found = minhash.compare_with_next(docs, partition_bytes=partition_bytes).collect()
    assert {r.doc_id: tuple(r) for r in found} == brute(rows) and len(found) == len(rows)


def test_small_tables_and_edges(spark, edges, nothing, edge_rows):
    assert minhash.compare_with_next(nothing).count() == 0
    one = minhash.compare_with_next(make(spark, [(7, "a b c d e f", "aa", "s")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    found = minhash.compare_with_next(edges, partition_bytes=1000).collect()
    assert len(found) == len(edge_rows)
    unique = [r for r in edge_rows if r[0] not in (None, 5)]
    want = brute(unique)
    assert all(tuple(r) == want[r.doc_id] for r in found if r.doc_id in (9, 8, 7, 4, 3, 2))
    assert sorted(r.n_chars for r in found) == sorted(len(t or "") for _, t, *_ in edge_rows)


def test_likeness_estimates_jaccard():
    rng = np.random.default_rng(0)
    hasher, errors = minhash.MinHash(), []
    for share in (0.1, 0.5, 0.8, 0.95):
        for _ in range(20):
            n = 400
            same = int(2 * n * share / (1 + share))
            a = rng.integers(0, 1 << 63, n, np.uint64)
            b = np.concatenate([a[:same], rng.integers(0, 1 << 63, n - same, np.uint64)])
            errors.append(minhash.likeness(hasher.of(a), hasher.of(b)) - same / (2 * n - same))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_shingles():
    assert len(minhash.shingles(b"")) == len(minhash.shingles(b" \n")) == 0
    assert len(minhash.shingles(b"a b c")) == len(minhash.shingles(b"a b c d e")) == 1
    assert len(minhash.shingles(b"a b c d e f")) == 2
    assert (minhash.shingles(b"A  b\tc d E") == minhash.shingles(b"a b c d e")).all()
    text = " ".join(f"w{i}" for i in range(5000)).encode()
    assert len(np.unique(minhash.shingles(text))) == 4996


@pytest.mark.parametrize("chunk", [256, 2])
def test_near_duplicates(docs, rows, chunk):
    sets = {}
    for i, text, *_ in rows:
        words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
        sets[i] = {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}
    for _ in range(len(root)):
        before = dict(root)
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if a < b and (sets[a] == sets[b] or both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both)):
                    root[a] = root[b] = min(root[a], root[b])
        if before == root:
            break
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, chunk=chunk).collect()} == root


def test_near_duplicates_edges(edges, nothing, edge_rows):
    found = minhash.near_duplicates(edges).collect()
    assert len(found) == len(edge_rows)
    assert {r.component_id for r in found if r.doc_id in (1, 2, 3)} == {1} and {r.component_id for r in found if r.doc_id == 9} == {5}
    assert minhash.near_duplicates(nothing).count() == 0


def graded_copies(n=60, seed=3):
    """Pairs of random texts of 100 and 300 words with edited copies, and their five-word Jaccard similarity."""
    rng = random.Random(seed)
    word = lambda: f"v{rng.randrange(50_000)}"
    rows, alike, sets = [], {}, {}
    for i in range(n):
        words = [word() for _ in range((100, 300)[i % 2])]
        other = list(words)
        for k in rng.sample(range(len(words)), rng.randint(1, max(1, len(words) // 40))):
            other[k] = word()
        for k, w in ((2 * i, words), (2 * i + 1, other)):
            sets[k] = {tuple(w[p:p + 5]) for p in range(len(w) - 4)}
            rows.append((k, " ".join(w), "aa", "s"))
        both = len(sets[2 * i] & sets[2 * i + 1])
        alike[2 * i] = both / (len(sets[2 * i]) + len(sets[2 * i + 1]) - both)
    return rows, alike


def test_stage_against_brute_force_jaccard(spark):
    """The pipeline's stage drops the second of a pair just when the similarity is 0.8 or more."""
    import corpus_pipeline

    rows, alike = graded_copies()
    assert sum(0.8 <= x < 0.95 for x in alike.values()) > 15 and sum(x < 0.8 for x in alike.values()) > 3
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, make(spark, rows), "").collect()}
    assert kept == {i for i, *_ in rows if i % 2 == 0 or alike[i - 1] < 0.8}


def test_group_that_its_smallest_node_does_not_hold_together(spark):
    """A chain of texts: neighbours are alike, but most are too far from the smallest doc_id."""
    rng = random.Random(8)
    words, rows = [f"q{i}" for i in range(200)], []
    for i in range(12):
        rows.append((i, " ".join(words), "aa", "s"))
        for k in rng.sample(range(200), 2):
            words[k] = f"z{i}x{k}"
    for chunk in (256, 3):
        assert {r.component_id for r in minhash.near_duplicates(make(spark, rows), chunk=chunk).collect()} == {0}
