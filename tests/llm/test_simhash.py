import random

import pytest
import xxhash
from pyspark.sql import functions as F

from postwatch.llm import simhash
from postwatch.llm.components import components

from .conftest import WORD, make


def brute_fingerprint(text, width=4):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, near):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in near:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def test_fingerprint(rows):
    for _, text, *_ in rows:
        assert simhash.simhash((text or "").encode()) == brute_fingerprint(text)
    assert simhash.simhash(b"A bC d e f") == simhash.simhash(b"a\tbc  d e f\n")


def test_native_hash_agrees(spark):
    word = spark.range(1).select(F.xxhash64(F.lit("one two thrée four")).alias("h")).first().h
    assert word & (1 << 64) - 1 == xxhash.xxh64_intdigest("one two thrée four".encode(), 42)


@pytest.mark.parametrize("chunk,blocks", [(1024, 7), (3, 5), (8, 6)])
def test_links_lose_nothing(spark, chunk, blocks):
    rng = random.Random(chunk)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 7))) for b in base for _ in range(60)} | {rng.getrandbits(64) for _ in range(100)}
    nodes = dict(enumerate(sorted(fps)))
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in nodes.items()]
    links = simhash.links(spark.createDataFrame(signed, "node long, fp long"), blocks=blocks, chunk=chunk)
    got = {r.node: r.root for r in components(links).collect()}
    near = [(i, j) for i in nodes for j in nodes if i < j and (nodes[i] ^ nodes[j]).bit_count() <= 4]
    want = brute_components(nodes, near)
    assert {i: got.get(i, i) for i in nodes} == want


def test_components_of_a_long_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {1000 + i: 1000 for i in range(1, 200)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(docs, rows):
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    fps = {i: brute_fingerprint(t) for i, t, *_ in rows}
    near = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4]
    assert got == brute_components(fps, near)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))


def test_edges(spark, edges, nothing, edge_rows):
    found = simhash.near_duplicates(edges).collect()
    assert len(found) == len(edge_rows)
    zero = {r.component_id for r in found if r.fp == 0}
    assert zero == {1}
    kept = simhash.drop_near_duplicates(edges)
    assert kept.where("doc_id = 5").count() == 1 and kept.where("doc_id IS NULL").count() == 2 and kept.where("doc_id = 9").count() == 0
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.drop_near_duplicates(nothing).count() == 0
    only_null = simhash.near_duplicates(make(spark, [(None, "a b c d e", "aa", "s")])).collect()
    assert [r.component_id for r in only_null] == [None]


def test_no_table_of_documents_or_their_keys_is_broadcast(spark, docs, monkeypatch):
    """Spark takes the keys of a fingerprint, 35 to each, for as small as the table that they are exploded from."""
    from postwatch.llm import components

    plans, write = [], simhash.store
    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()

    def noted(df, name):
        plans.append(plan_of(df))
        return write(df, name)

    for module in (simhash, components):
        monkeypatch.setattr(module, "store", noted)
    plans.append(plan_of(simhash.drop_near_duplicates(docs)))
    assert sum("SortMergeJoin" in p for p in plans) >= 4 and not any("Broadcast" in p for p in plans)
