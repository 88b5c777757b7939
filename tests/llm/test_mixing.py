import pytest
from pyspark.sql import functions as F

from postwatch.llm import mixing

from .conftest import WORD, make


def water_fill(sizes, weights=(5, 2, 1), most=3):
    """Targets by the rule itself: stop at ``most`` times the size and reshare the excess until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        above = {s: most * sizes[s] for s in free if share[s] > most * sizes[s]}
        if not above:
            return fixed | share
        fixed |= above


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 500, "c": 1}, {"a": 1, "b": 2, "c": 1000, None: 7}, {"a": 5}, {"a": 0, "b": 9}, {"z": 3, "Z": 3, "é": 900, "y": 2, "b": 1, None: 4},
])
def test_targets(spark, sizes):
    table = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(table).collect()}
    assert got == pytest.approx(water_fill(sizes))


@pytest.mark.parametrize("bins", [4096, 2])
def test_taken_words_meet_targets(docs, rows, bins):
    got = mixing.mix(docs, bins=bins).select("row.doc_id", "row.source", "row.text", "size", "source_size", "target", "epochs", "part", "taken").collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text))
    want = water_fill(sizes)
    for source in sizes:
        own = [r for r in got if r.source == source]
        assert sum(r.taken for r in own) == pytest.approx(want[source], abs=0.51)
        assert {r.source_size for r in own} == {sizes[source]}
        assert sum(0 < r.part < r.size for r in own) <= 1
    for r in got:
        assert r.size == len(WORD.findall(r.text)) and r.taken == r.epochs * r.size + r.part and 0 <= r.taken <= 3 * r.size


def test_reruns_agree_and_bins_do_not_matter(docs):
    run = lambda bins: sorted(mixing.mix(docs, bins=bins).select("row.doc_id", "taken").collect())
    assert run(4096) == run(4096) == run(64)


def test_quality_raises_the_chance(spark):
    docs = make(spark, [(i, "a b c d", "aa", "s1") for i in range(2000)] + [(9000 + i, "a b c d", "aa", "s2") for i in range(8000)])
    good = F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.2)
    got = mixing.mix(docs, quality=good, weights=(1, 9)).where("row.source = 's1'").select("row.doc_id", "part").collect()
    even = sum(r.part for r in got if r.doc_id % 2 == 0)
    assert even > 2 * sum(r.part for r in got if r.doc_id % 2)


def test_mixed_documents(docs):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(F.size(F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)"))).alias("n")).collect()}
    taken = {r["source"]: r["n"] for r in mixing.mix(docs).groupBy("row.source").agg(F.sum("taken").alias("n")).collect()}
    assert words == taken


def test_edges(edges, nothing, edge_rows):
    assert mixing.mix(edges).count() == len(edge_rows)
    assert mixing.mixed_documents(edges).where("text IS NULL OR text = ''").count() == 0
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0
