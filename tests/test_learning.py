import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from postwatch.operators import bayes, classify, models, pooling, splits, stats
from postwatch.operators import vocabulary as voc


def docs(spark, rows):
    return spark.createDataFrame(
        [(str(i), float(y), " ".join(ws), ["t"]) for i, (y, ws) in enumerate(rows)],
        "id_str STRING, irrelevant DOUBLE, full_text_preprocessed STRING, trigger ARRAY<STRING>")


def brute_bayes(train, words):
    """Log odds of class 1 from the definition."""
    n = [sum(1 for y, _ in train if y == c) for c in (0, 1)]
    odds = math.log((n[1] + .5) / (n[0] + .5))
    for v in {w for _, ws in train for w in ws}:
        k = [sum(1 for y, ws in train if y == c and v in ws) for c in (0, 1)]
        bins = 1 if sum(k) == sum(n) else 2
        hit = k if v in words else [n[0] - k[0], n[1] - k[1]]
        odds += math.log((hit[1] + .5) / (n[1] + .5 * bins)) - math.log((hit[0] + .5) / (n[0] + .5 * bins))
    return odds


SMALL = [(1, ["a", "b"]), (1, ["a"]), (0, ["c"]), (0, ["b", "c"]), (0, ["c", "d"])]


def test_bayes_small(spark):
    model = bayes.fit_bayes(docs(spark, SMALL))
    gaps = {r["token"]: r["gap"] for r in model.weights.collect()}
    absent_a = math.log(.5 / 3 / (3.5 / 4))
    assert gaps["a"] == pytest.approx(math.log(2.5 / 3 / (.5 / 4)) - absent_a)
    probe = docs(spark, [(0, ["a", "zz"]), (0, []), (1, ["c", "c"])])
    got = {r["id_str"]: r["log_odds"] for r in bayes.log_odds(probe, model).collect()}
    assert got == pytest.approx({str(i): brute_bayes(SMALL, set(ws)) for i, ws in enumerate([["a"], [], ["c"]])})
    model.unpersist()


def test_bayes_word_in_every_post(spark):
    rows = [(y, [*ws, "all"]) for y, ws in SMALL]
    model = bayes.fit_bayes(docs(spark, rows))
    got = {r["id_str"]: r["log_odds"] for r in bayes.log_odds(docs(spark, [(0, ["a", "all"]), (0, ["b"])]), model).collect()}
    assert got == pytest.approx({"0": brute_bayes(rows, {"a", "all"}), "1": brute_bayes(rows, {"b"})})


def random_rows(n, seed=3):
    rng = random.Random(seed)
    return [(rng.random() < .4, rng.sample("abcdefgh", rng.randint(0, 5))) for _ in range(n)]


def test_bayes_weights_above_the_broadcast_bound(spark, monkeypatch):
    """Weights of frequent tokens are broadcast, rare ones joined, and none is repeated for salts; the scores stay."""
    rng = random.Random(5)
    rows = [(i % 2, rng.sample(["often", "b", *[f"w{j}" for j in range(40)]], 6) + ["often"] * (i % 3)) for i in range(60)]
    model = bayes.fit_bayes(docs(spark, rows))
    probe = docs(spark, [*rows, (0, []), (1, ["unknown"])])
    scores = lambda df: {r["id_str"]: r["log_odds"] for r in df.collect()}
    want = scores(bayes.log_odds(probe, model))
    monkeypatch.setattr(bayes, "MAX_BROADCAST_BYTES", 5 * 128)
    monkeypatch.setattr("postwatch.functions.lookup.MAX_BROADCAST_BYTES", 5 * 128)
    split = bayes.log_odds(probe, model)
    assert "_salt" not in split._jdf.queryExecution().optimizedPlan().toString()
    assert len(want) == 62 and scores(split) == pytest.approx(want)


def test_bayes_folds_equal_brute_force(spark):
    rows = [(int(y), ws) for y, ws in random_rows(60)]
    folded = splits.stratified_folds(docs(spark, rows)).persist()
    fold_of = {r["id_str"]: r["fold"] for r in folded.collect()}
    got = {r["id_str"]: r["predicted_irrelevant"] for r in classify.bayes_fold_predictions(folded).collect()}
    want = {}
    for i, (_, ws) in enumerate(rows):
        train = [r for j, r in enumerate(rows) if fold_of[str(j)] != fold_of[str(i)]]
        want[str(i)] = int(brute_bayes(train, set(ws)) >= 0)
    assert got == want
    scores = classify.cross_validate(docs(spark, rows), "bayes")
    assert scores.count() == 5 and 0 < classify.summarise_folds(scores).first()["mean_score"] <= 1


def test_model_round_trip_and_empty_gate(spark, tmp_path):
    clf = classify.fit(docs(spark, SMALL), "bayes")
    classify.save_classifier(clf, str(tmp_path), "en")
    again = classify.load_classifier(spark, str(tmp_path), "bayes", "en")
    posts = docs(spark, SMALL).drop("irrelevant")
    assert sorted(clf.predict(posts).collect()) == sorted(again.predict(posts).collect())
    none = posts.withColumn("trigger", F.array().cast("array<string>"))
    assert again.predict(none).count() == 0
    clf.release()


def test_hash_rank_is_the_global_order(spark):
    ids = [str(i) for i in range(500)]
    frame = spark.createDataFrame([(i, float(int(i) % 3 == 0)) for i in ids], "id_str STRING, irrelevant DOUBLE")
    order = sorted(ids, key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
    for prefix in (1, 3):
        got = {r["id_str"]: r["_rank"] for r in splits.hash_rank(frame, [], prefix=prefix).collect()}
        assert got == {i: n + 1 for n, i in enumerate(order)}
    split = splits.stratified_split(frame)
    assert {(r["irrelevant"], r["n"]) for r in split.where("is_test").groupBy("irrelevant").agg(F.count("*").alias("n")).collect()} == {
        (1.0, math.ceil(.2 * 167)), (0.0, math.ceil(.2 * 333))}
    per_fold = splits.stratified_folds(frame).groupBy("irrelevant", "fold").count().collect()
    for label in (0.0, 1.0):
        counts = [r["count"] for r in per_fold if r["irrelevant"] == label]
        assert len(counts) == 5 and max(counts) - min(counts) <= 1
    assert sorted(r["row_index"] for r in splits.shuffle_rows(frame).collect()) == list(range(500))


@pytest.fixture(scope="module")
def embedding(spark):
    return spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "token STRING, vector ARRAY<FLOAT>")


@pytest.mark.parametrize("block", [1 << 20, 8, 4])
def test_mean_pool(spark, embedding, block):
    posts = spark.createDataFrame([("1", ["a", "a", "b", "zz"]), ("2", ["zz"]), ("3", []), ("4", ["b"])], "id_str STRING, t ARRAY<STRING>")
    got = {r["id_str"]: r["features"] for r in pooling.mean_pool(posts, embedding, "t", broadcast_bytes=block).collect()}
    assert got == {"1": pytest.approx([5 / 3, 8 / 3]), "2": [0, 0], "3": [0, 0], "4": [3, 4]}


def test_mean_pool_sums_in_hash_tables(spark, embedding, monkeypatch):
    """Sums are no objects, which Spark would sort with the vector of every token; frequent tokens are broadcast, rare ones joined."""
    posts = spark.createDataFrame([(str(i), ["a"] * 9 + ["b"] * (i % 3) + ["zz"]) for i in range(300)], "id_str STRING, t ARRAY<STRING>")
    for block, head in ((1 << 20, 1), (4, 8), (4, 1 << 20), (4, 1)):
        monkeypatch.setattr(pooling, "HEAD_BYTES", head)
        pooled = pooling.mean_pool(posts, embedding, "t", broadcast_bytes=block)
        got = {r["id_str"]: r["features"] for r in pooled.collect()}
        assert got == {str(i): pytest.approx([(9 + 3 * b) / (9 + b), (18 + 4 * b) / (9 + b)]) for i in range(300) for b in [i % 3]}
        plan = pooled._jdf.queryExecution().executedPlan().toString()
        assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan


def test_dense_features_with_flag(spark, embedding):
    posts = spark.createDataFrame([("1", "a", True), ("2", "", None)], "id_str STRING, full_text_preprocessed STRING, verified BOOLEAN")
    got = {r["id_str"]: list(r["features"]) for r in pooling.dense_features(posts, embedding, verified_col="verified").collect()}
    assert got == {"1": [1, 2, 1], "2": [0, 0, 0]}
    assert {len(r["features"]) for r in pooling.dense_features(posts, embedding).collect()} == {2}


def ring(spark, n=200):
    rng = np.random.RandomState(0)
    x = rng.normal(size=(n, 2))
    y = ((x ** 2).sum(axis=1) > 1.2).astype(float)
    rows = [(str(i), x[i].tolist(), float(y[i])) for i in range(n)]
    frame = spark.createDataFrame(rows, "id_str STRING, v ARRAY<DOUBLE>, irrelevant DOUBLE")
    return frame.select("id_str", array_to_vector("v").alias("features"), "irrelevant").coalesce(1).persist()


def accuracy(df):
    return df.agg(F.avg((F.col("prediction") == F.col("irrelevant")).cast("int"))).first()[0]


def test_families(spark, tmp_path):
    data = ring(spark)
    scores = {}
    few = {"max_iter": 10}
    for family in ("linear", "svm", "randomforest"):
        params = {**models.model_parameters(family), **few}
        scores[family] = accuracy(models.build_model(family, params).fit(data).transform(data))
    assert scores["svm"] > .9 > scores["linear"] and scores["randomforest"] > .7
    fitted = models.build_model("svm", few).fit(data)
    clf = classify.Classifier("svm", fitted)
    classify.save_classifier(clf, str(tmp_path), "en")
    again = classify.load_classifier(spark, str(tmp_path), "svm", "en").model.transform(data)
    assert again.select("id_str", "prediction").exceptAll(fitted.transform(data).select("id_str", "prediction")).count() == 0
    halves = data.withColumn("irrelevant", (F.get(vector_to_array("features"), 0) > 0).cast("double"))
    for loss in ("log", "hinge"):
        assert accuracy(models.build_model("linear", {"loss": loss, **few}).fit(halves).transform(halves)) > .9


def test_gamma(spark):
    data = ring(spark)
    x = np.array([list(r["features"]) for r in data.collect()])
    gamma, dim = models.scale_gamma(data)
    assert dim == 2 and gamma == pytest.approx(1 / (2 * x.var()))


def test_both_halves_are_scored_in_one_table(spark, tmp_path):
    """Vectors made by nested lambdas, each half scored by a model of the other, in a union; vectors may come twice."""
    from postwatch.plans import queries

    rng = np.random.RandomState(4)
    rows = [(i % 110, rng.normal(size=3).astype(float).tolist(), i % 10) for i in range(120)]
    spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT").write.parquet(f"{tmp_path}/embeddings.parquet")
    scored = queries._ml_scores(spark, str(tmp_path), "svm", {"max_iter": 10}, ring=True).collect()
    assert sorted(r["id_str"] for r in scored) == sorted(str(i) for i, *_ in rows)
    assert np.mean([r["irrelevant"] == r["predicted_irrelevant"] for r in scored]) > .9


def test_all_families_are_scored_in_one_table(spark, tmp_path, monkeypatch):
    """Rows of three families, each of two models, in one union."""
    from postwatch.plans import queries

    rng = np.random.RandomState(5)
    rows = [(i, rng.normal(size=3).astype(float).tolist(), i % 10) for i in range(80)]
    spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT").write.parquet(f"{tmp_path}/embeddings.parquet")
    given = models.model_parameters
    monkeypatch.setattr(models, "model_parameters", lambda name: {**given(name), **({} if name == "randomforest" else {"max_iter": 5})})
    scored = queries.build_model(spark, str(tmp_path)).collect()
    assert sorted((r["family"], int(r["id_str"])) for r in scored) == [(f, i) for f in ("linear", "randomforest", "svm") for i in range(80)]
    assert np.mean([r["irrelevant"] == r["predicted_irrelevant"] for r in scored]) > .9


def test_model_search_is_bounded(spark):
    search = models.build_model("tpot", {"population_size": 2})
    assert len(search.candidates()) == 2 and len({type(e) for e, _ in search.candidates()}) == 2
    assert len(models.build_model("tpot").candidates()) == 15
    with pytest.raises(ValueError):
        models.build_model("tpot", {"generations": 5})
    search.candidates = lambda: [(models.RandomForestClassifier(labelCol="irrelevant", seed=1), {})]
    assert accuracy(search.fit(ring(spark)).transform(ring(spark))) > .7


def test_model_search_halves_and_repeats(spark):
    """Every candidate is tried on the small sample, a third of them on more rows; a second search tries the same and finds the same."""
    data = ring(spark).coalesce(2).persist()
    first, second = models.build_model("tpot", {"population_size": 4}), models.build_model("tpot", {"population_size": 4})
    for search in (first, second):
        few = [(e.setMaxIter(5) if e.hasParam("maxIter") else e, p) for e, p in search.candidates()]
        search.candidates = lambda few=few: few
    chosen = [s.fit(data).stages[0] for s in (first, second)]
    assert type(chosen[0]) is type(chosen[1]) and first.tried == second.tried
    assert sorted(t[2] for t in first.tried) == list(range(4)) and first.shares(4, 100) == [(4, 1.0)] and first.shares(15, 100)[1] == (5, 1.0)


class Watched(Estimator):
    """Fits another estimator and notes the tasks and rows of what it was given."""

    def __init__(self, inner, seen):
        super().__init__()
        self.inner, self.seen = inner, seen

    def _fit(self, dataset):
        self.seen.append((dataset.rdd.getNumPartitions(), dataset.count()))
        return self.inner.fit(dataset)


def test_model_search_deals_samples_by_rows(spark):
    """A job of a fit has as many tasks as its sample needs, however many files hold the rows; the last fit reads all rows as they are."""
    data, seen = ring(spark).repartition(24).persist(), []
    search = models.build_model("tpot", {"population_size": 4})
    search.candidates = lambda: [(Watched(models.RandomForestClassifier(labelCol="irrelevant", seed=s, numTrees=2), seen), {}) for s in range(4)]
    assert accuracy(search.fit(data).transform(data)) > .7
    assert len(seen) == 5 and {tasks for tasks, _ in seen[:4]} == {1} and len({n for _, n in seen[:4]}) == 1
    assert 120 < seen[0][1] < 190 and seen[4] == (24, 200)


def test_model_search_fits_every_candidate_on_all_training_rows(spark):
    """As many rows for each of nine candidates, whatever time is configured: all but the hold-out, and all for the best one. Halving is only for who asks."""
    data = ring(spark)
    for halve in (False, True):
        seen = []
        search = models.build_model("tpot", {"population_size": 9, "max_time_mins": 1e-4, "max_eval_time_mins": 2e-5})
        search.candidates = lambda: [(Watched(models.RandomForestClassifier(labelCol="irrelevant", seed=s, numTrees=1, maxDepth=2), seen), {}) for s in range(9)]
        search.halve = search.halve or halve
        search.fit(data)
        sizes = [n for _, n in seen]
        if halve:
            assert max(sizes[:-1]) < 40 and sizes[-1] == 200
        else:
            held = 200 - sizes[0]
            assert len(sizes) == 10 and sizes == [200 - held] * 9 + [200] and 10 < held < 80
            assert {(turn, share) for turn, share, _, _ in search.tried} == {(0, 1.0)} and [i for _, _, i, _ in search.tried] == list(range(9))


def test_model_search_scores_a_round_in_one_pass(spark):
    """As the evaluator scores each model, in as many jobs for six models as for one."""
    data = ring(spark)
    search = models.ModelSearch("irrelevant", "features")
    few = [e.copy({e.maxIter: 5, **p}) if e.hasParam("maxIter") else e.copy(p) for e, p in search.candidates()[:6]]
    fitted = [e.fit(data) for e in few]
    each = [models.BalancedAccuracy(labelCol="irrelevant").evaluate(m.transform(data)) for m in fitted]
    jobs, got = [], []
    for group, some in (("one", fitted[:1]), ("six", fitted)):
        spark.sparkContext.setJobGroup(f"scores of {group}", "")
        got.append(search.scores(some, data))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"scores of {group}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == [each[:1], each] and len(set(each)) > 2 and jobs[0] == jobs[1]
    assert search.scores(fitted, data.limit(0)) == [0.0] * 6


@pytest.mark.parametrize("ring_rule", [False, True])
def test_ruled_vectors_sum_a_row_once(spark, tmp_path, ring_rule):
    """The length of a vector is not summed again for each of its components."""
    from postwatch.plans import queries

    rows = [(1, [3.0, -4.0], 0), (2, [-6.0, 8.0], 1), (3, None, 2), (None, [1.0, None], 3), (5, [], 4)]
    spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT").write.parquet(f"{tmp_path}/embeddings.parquet")
    frame = queries._ruled_vectors(spark, str(tmp_path), ring_rule)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan[plan.index("transform("):plan.index("aggregate(")]
    got = {r["id_str"]: (list(r["features"]), r["irrelevant"]) for r in frame.where("id_str in (1, 2, 5)").collect()}
    want = {"1": ([.6, -.8], 1.0), "2": ([-2.4, 3.2], 0.0), "5": ([], None)} if ring_rule else {"1": ([2.0, .75], 1.0), "2": ([-2.0, -.75], 0.0), "5": ([], None)}
    assert {k: (pytest.approx(v), y) for k, (v, y) in want.items()} == got


def test_model_search_budgets():
    search = models.build_model("tpot", {"max_time_mins": 0.003, "max_eval_time_mins": 0.001})
    plan = search.shares(15, 10_000)
    assert [n for n, _ in plan] == [15, 5] and sum(n * share for n, share in plan) * 10_000 <= 3000 + 1e-6
    assert max(share for _, share in plan) * 10_000 <= 1000 and search.shares(15, 10) == [(15, 1 / 3), (5, 1.0)]


def test_registry(spark):
    assert models.is_known_model("bayes") and not models.is_known_model("x")
    assert set(models.list_models()) >= {"randomforest", "svm", "linear", "bayes", "tpot"}
    for bad in (lambda: models.build_model("x"), lambda: models.build_model("svm", {"kernel": "poly"}),
                lambda: models.build_model("linear", {"loss": "huber"})):
        with pytest.raises(ValueError):
            bad()
    assert models.build_model("randomforest").getMaxDepth() == 10


def test_a_registered_family_is_fitted(spark):
    """A family of the user's own goes through training, scoring and prediction of posts like those that are built in."""
    from pyspark.ml.classification import GBTClassifier

    from postwatch.operators import classify

    models.register_family("boosted", lambda p, label, features: GBTClassifier(labelCol=label, featuresCol=features, maxIter=p["rounds"], seed=1), {"rounds": 3})
    try:
        rows = [(str(i), float(i % 2), f"{'good' if i % 2 else 'bad'} w{i % 5}", ["t"]) for i in range(40)]
        posts = spark.createDataFrame(rows, "id_str STRING, irrelevant DOUBLE, full_text_preprocessed STRING, trigger ARRAY<STRING>")
        vectors = spark.createDataFrame([("good", [1.0, 0.0]), ("bad", [0.0, 1.0]), ("w1", [0.3, 0.3])], "token STRING, vector ARRAY<FLOAT>")
        model = classify.fit(posts, "boosted", None, vectors)
        assert {(r["irrelevant"], r["predicted_irrelevant"]) for r in model.predict(posts).collect()} == {(0.0, 0), (1.0, 1)}
        scores = classify.cross_validate(posts, "boosted", None, vectors, k=2).collect()
        assert [r["balanced_accuracy"] for r in scores] == [1.0, 1.0]
    finally:
        models.FAMILIES.pop("boosted"), models.MODEL_CONFIG.pop("boosted")


def test_stats(spark):
    posts = spark.createDataFrame([(0.0, ["t"]), (1.0, ["t"]), (1.0, []), (None, ["t"]), (7.0, [])], "irrelevant DOUBLE, trigger ARRAY<STRING>")
    assert tuple(stats.label_stats(posts).first()) == (3, 5, 1, 2, pytest.approx(1 / 3))
    assert tuple(stats.training_stats(stats.labelled_only(posts)).first()) == (2, 1, pytest.approx(2 / 3), 1, 1, .5)
    assert tuple(stats.label_stats(posts.limit(0)).first()) == (0, 0, 0, 0, None)


def test_scores(spark):
    rows = [(1, 1)] * 6 + [(1, 0)] * 2 + [(0, 1)] * 3 + [(0, 0)]
    frame = spark.createDataFrame(rows, "irrelevant INT, predicted_irrelevant INT")
    counts = stats.confusion_matrix(frame)
    assert tuple(counts.first()) == (6, 3, 2, 1)
    want = (6 / 8 + 1 / 4) / 2
    assert stats.balanced_accuracy(frame).first()[0] == pytest.approx(want)
    assert stats.score_of_counts(counts).first()["balanced_accuracy"] == pytest.approx(want)
    single = frame.where("irrelevant = 1")
    assert tuple(stats.confusion_matrix(single).first()) == (6, 0, 2, 0)
    assert stats.score_of_counts(stats.confusion_matrix(single)).first()["balanced_accuracy"] == pytest.approx(.75)


def test_vocabulary(spark):
    posts = docs(spark, [(0, ["b", "a", "b"]), (1, ["b"]), (1, [])])
    assert {tuple(r) for r in voc.vocabulary(posts).collect()} == {("a", 1, 1), ("b", 3, 2)}
    classes, tokens = voc.nb_statistics(posts)
    assert {tuple(r) for r in classes.collect()} == {(0, 1), (1, 2)}
    assert {tuple(r) for r in tokens.collect()} == {(0, "a", 1), (0, "b", 1), (1, "b", 1)}


def test_repeated_posts_are_scored_alike(spark):
    from postwatch.operators.bayes import fit_bayes, predict_bayes

    train = spark.createDataFrame([("1", "a b", 1), ("2", "c d", 0), ("3", "a c", 0), ("4", "b b", 1)],
                                  "id_str STRING, full_text_preprocessed STRING, irrelevant INT")
    model = fit_bayes(train)
    posts = spark.createDataFrame([("9", "a d"), ("9", "a d"), ("9", "b"), ("8", "a d"), ("7", None), ("6", "unknown words")],
                                  "id_str STRING, full_text_preprocessed STRING")
    ways = [predict_bayes(posts, model, max_rows=n).collect() for n in (1000, 0)]
    for rows in ways:
        assert len(rows) == 6 and len({round(r["log_odds"], 9) for r in rows if r["full_text_preprocessed"] == "a d"}) == 1
    values = [sorted((r["id_str"], r["full_text_preprocessed"] or "", round(r["log_odds"], 9)) for r in rows) for rows in ways]
    assert values[0] == values[1]
