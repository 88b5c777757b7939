import random
import zlib
from collections import defaultdict

import pytest

from postwatch.llm import sharding

from .conftest import make


def held(found, rows, shards):
    """Sizes and checksums, gapless slots; returns the bytes of each shard."""
    want = sorted((i if i is not None else -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32) for r in found) == want
    slots, size = defaultdict(list), dict.fromkeys(range(shards), 0)
    for r in found:
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    return size


@pytest.mark.parametrize("hot", [0, 0.5])
def test_near_equal_bytes(spark, hot):
    rng = random.Random(5)
    rows = [(i, "copy of one text " * 8 if rng.random() < hot else f"{i} " * rng.randint(1, 60), "aa", "s1") for i in range(4000)]
    found = sharding.shard(make(spark, rows), shards=8).collect()
    size = held(found, rows, 8)
    mean = sum(size.values()) / 8
    assert all(abs(s - mean) < 0.06 * mean for s in size.values())
    assert len({r.shard for r in found}) == 8


def test_equal_texts_stay_together(spark):
    rows = [(i, f"text number {i % 700} " * 5, "aa", "s1") for i in range(2100)]
    found = sharding.shard(make(spark, rows), shards=8).collect()
    assert all(len(s) == 1 for s in _shards_of(found, rows).values())


def _shards_of(found, rows):
    texts, out = {i: t for i, t, *_ in rows}, defaultdict(set)
    for r in found:
        out[texts[r.doc_id]].add(r.shard)
    return out


def test_reruns_agree(docs, rows):
    run = lambda: sorted(tuple(r) for r in sharding.shard(docs).collect())
    assert run() == run()
    held(sharding.shard(docs).collect(), rows, 24)


def test_edges(edges, nothing, edge_rows):
    held(sharding.shard(edges).collect(), edge_rows, 24)
    assert sharding.shard(nothing).count() == 0


def test_splitters_and_ranges(spark):
    from pyspark.sql import functions as F

    keys = spark.range(-50, 50).select("id")
    for cuts in ([], [0], [-10, 0, 7], list(range(-40, 41, 3))):
        got = {r.id: r.n for r in keys.select("id", sharding.range_of(F.col("id"), cuts).alias("n")).collect()}
        assert got == {i: sum(c <= i for c in cuts) for i in range(-50, 50)}
