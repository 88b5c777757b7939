import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postwatch.llm import toxicity

from .conftest import make


def pair_corpus(spark, n=3000):
    """Toxic only where both an insult and a group stand: no weight of a single word can tell."""
    rng = random.Random(6)
    filler, insults, groups = [f"w{i}" for i in range(400)], ["badone", "badtwo"], ["folka", "folkb"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(filler) for _ in range(rng.randint(5, 60))]
        kind = rng.randrange(4)
        words += [rng.choice(insults)] * (kind in (1, 3)) + [rng.choice(groups)] * (kind in (2, 3))
        rng.shuffle(words)
        rows.append((i, " ".join(words), "aa", "s"))
        labels.append((i, 1, int(kind == 3)))
    return make(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def trained(spark):
    docs, labels = pair_corpus(spark)
    return docs, labels, toxicity.train(docs, labels, F.col("doc_id") % 5 != 0, epochs=40)


def test_learns_pairs(trained):
    docs, labels, machine = trained
    found = toxicity.predict(docs, machine).join(labels, "doc_id").where("doc_id % 5 = 0").collect()
    assert np.mean([r.predicted == r.toxic for r in found]) > 0.97
    alone = [machine.score("w1 badone w2"), machine.score("w1 folka w2")]
    assert max(alone) < 0.5 < machine.score("w1 badone folkb w2")


def test_score_is_the_sum_over_pairs(trained):
    machine = trained[2]
    text = "w1 w2 badone folka folkb w77 badtwo"
    at = machine.terms(text)
    z = machine.bias + sum(machine.weights[i] for i in at) + sum(machine.vectors[i] @ machine.vectors[j] for i in at for j in at if i < j)
    assert machine.score(text) == pytest.approx(1 / (1 + np.exp(-z)))


def test_held_out_labels_are_not_used(spark, trained):
    docs, labels, machine = trained
    wrong = labels.withColumn("toxic", F.when(F.col("doc_id") % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = toxicity.train(docs, wrong, F.col("doc_id") % 5 != 0, epochs=40)
    assert (machine.weights == other.weights).all() and (machine.vectors == other.vectors).all()


def test_edges(spark, edges, nothing, trained, edge_rows):
    docs, labels, machine = trained
    found = toxicity.predict(edges, machine).collect()
    assert len(found) == len(edge_rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert len({r.score for r in found if r.doc_id in (1, 2, 3)}) == 1
    assert toxicity.predict(nothing, machine).count() == 0
    none = toxicity.train(docs, labels.limit(0), F.lit(True))
    assert {r.predicted for r in toxicity.predict(edges, none).collect()} == {0}
    only = toxicity.train(docs, labels.where("toxic = 1"), F.lit(True))
    assert {r.predicted for r in toxicity.predict(edges, only).collect()} == {1}
    repeated = labels.union(labels).union(labels.withColumn("toxic", F.lit(None).cast("int")))
    assert (toxicity.train(docs, repeated, F.col("doc_id") % 5 != 0, epochs=40).weights == machine.weights).all()


def test_learns_pairs_of_terms_that_are_neutral_alone(spark):
    """Toxic where both or neither of two terms stand: each is as frequent in either class."""
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(4000):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randint(5, 20))]
        kind = i // 5 % 4
        words += ["thing"] * (kind in (1, 3)) + ["folka"] * (kind in (2, 3))
        rng.shuffle(words)
        rows.append((i, " ".join(words), "aa", "s"))
        labels.append((i, 1, int(kind in (0, 3))))
    docs, labels = make(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    machine = toxicity.train(docs, labels, F.col("doc_id") % 5 != 0, epochs=40)
    found = toxicity.predict(docs, machine).join(labels, "doc_id").where("doc_id % 5 = 0").collect()
    assert np.mean([r.predicted == r.toxic for r in found]) > 0.97


def test_every_slot_of_the_sample_is_learned(spark):
    rows = [(i, f"only{i} also{i}", "aa", "s") for i in range(6000)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(6000)], "doc_id long, quality int, toxic int")
    machine = toxicity.train(make(spark, rows), labels, F.lit(True), epochs=1)
    want = {t for _, text, *_ in rows for w in text.split() for t in toxicity.word_terms(w)}
    assert set(machine.place) == want and len(machine.weights) == len(machine.vectors) == len(want) > 4096
