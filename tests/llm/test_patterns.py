import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from postwatch.llm import packing, patterns


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.VOCABULARY)


def held(pieces, texts, tokenizer, length):
    """Every id once, cut only where it must be; sequences gapless and no longer than ``length``; returns the sequences' sizes."""
    want = Counter()
    for doc_id, text in texts:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
        n = len(ids) // 4
        first = n if n <= length else n % length or length
        for piece, (a, b) in enumerate([(0, first), *((s, s + length) for s in range(first, n, length))]):
            want[doc_id, piece, a, b - a, zlib.crc32(ids[4 * a:4 * b])] += 1
    assert Counter((p.doc_id, p.piece, p.start, p.length, zlib.crc32(p.ids)) for p in pieces) == want
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= length
    return [sum(p.length for p in own) for own in sequences.values()]


@pytest.mark.parametrize("length, starts", [(64, 10**6), (64, 0), (1024, 10**6)])
def test_round_trip(docs, rows, tokenizer, length, starts):
    """The same by a broadcast of the ranks' starts and by a join."""
    pieces = patterns.pack_by_patterns(docs.repartition(7), length=length, small_starts=starts).collect()
    sizes = held(pieces, [(r[0], r[1]) for r in rows], tokenizer, length)
    assert len(sizes) <= 1.05 * -(-sum(sizes) // length) + 1


def histograms():
    rng = np.random.default_rng(2)
    yield "even", rng.integers(1, 1024, 20_000)
    yield "skewed", np.clip(rng.lognormal(5.5, 1, 100_000).astype(int), 1, 1024)
    yield "short", rng.integers(1, 40, 20_000)
    yield "few", np.array([1000, 30, 5, 1024])
    yield "long", rng.integers(520, 1024, 3_000)
    yield "one length", np.full(10_000, 300)


@pytest.mark.parametrize("name, lengths", list(histograms()), ids=[n for n, _ in histograms()])
def test_plans(name, lengths):
    """Each document once; near the bound by tokens, or by documents longer than half a sequence, and near plain best fit."""
    histogram = np.bincount(lengths, minlength=1025)
    plan, used = patterns.plan(histogram), np.zeros(1025, np.int64)
    for n, own in plan:
        assert n > 0 and sum(own) <= 1024
        used[list(dict.fromkeys(own))] += [n * own.count(x) for x in dict.fromkeys(own)]
    assert (used == histogram).all()
    total = sum(n for n, _ in plan)
    plain = sum(n for n, _ in patterns.pack_histogram(histogram, 1024))
    assert total <= 1.01 * plain + 1
    if name == "skewed":
        assert total < plain and total < 1.001 * (histogram * np.arange(1025)).sum() / 1024 + 1
    table = patterns.slots(plan)
    assert (np.diff(table["length"] << 44 | table["first"]) > 0).all()


def test_fit_is_a_minimum():
    """No pattern's repeats can be moved to lower the weighted squares: the conditions of Karush, Kuhn and Tucker, nearly."""
    rng = np.random.default_rng(3)
    histogram = np.bincount(rng.integers(1, 64, 5000), minlength=65)
    found = patterns.enumerate_patterns(np.flatnonzero(histogram), 64)
    assert len(found) == sum(1 for a in range(64) for b in range(a, 64) if b <= 64 - a - b <= 63 and (a > 0 or b >= 0) and 64 - a - b > 0)
    repeats = patterns.fit_repeats(found, histogram, 4000)
    weigh = np.arange(65) / 65
    rest = np.bincount(found.ravel(), np.repeat(repeats, 3), 65) - histogram
    slope = (weigh * rest)[found].sum(1)
    assert slope.min() > -0.05 and abs(slope[repeats > 0.01]).max() < 0.05
    _, whole = patterns.whole_repeats(found, repeats)
    assert abs(whole.sum() - repeats.sum()) <= 1


def test_edges(spark, edges, nothing, edge_rows, tokenizer):
    pieces = patterns.pack_by_patterns(edges).collect()
    held(pieces, [(i, t) for i, t, *_ in edge_rows], tokenizer, 1024)
    assert patterns.pack_by_patterns(nothing).count() == 0
    long = [(1, "a" + " " * 2_000_000 + "b"), (2, "y" * 2_000_000), (3, "\n" * 1_000_000), (4, "b " * 1_000_000)]
    held(patterns.pack_by_patterns(spark.createDataFrame(long, "doc_id long, text string")).collect(), long, tokenizer, 1024)


def test_equal_documents_over_many_tasks(spark, tokenizer):
    """A length that nearly all documents have is ranked within tasks and by their counts, not by one task."""
    docs = spark.range(0, 3000, 1, 12).select(F.col("id").alias("doc_id"), F.lit("the same text " * 20).alias("text"))
    sizes = held(patterns.pack_by_patterns(docs).collect(), [(i, "the same text " * 20) for i in range(3000)], tokenizer, 1024)
    each = len(tokenizer.encode("the same text " * 20, add_special_tokens=False).ids) + 1
    assert len(sizes) == -(-3000 // (1024 // each))
