"""Classifier families on dense features, built from ``pyspark.ml``."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import zip_longest

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postwatch.operators.stats import balanced_accuracies, balanced_accuracy

# Configured parameters of each family, and those used when a family has none.
MODEL_CONFIG = {
    "randomforest": {"max_depth": 5, "n_estimators": 2, "random_state": 0},
    "svm": {"kernel": "rbf"},
    "linear": {"loss": "hinge"},
    "bayes": {},
    "tpot": {"verbosity": 2, "max_time_mins": 2, "max_eval_time_mins": 0.04, "population_size": 15},
}
FOREST_DEFAULTS = {"max_depth": 10, "n_estimators": 10, "random_state": 0}
LINEAR_REG = 1e-4


class RandomFourierFeatures(Transformer, HasInputCol, HasOutputCol, HasSeed,
                            DefaultParamsReadable, DefaultParamsWritable):
    """Approximate RBF feature map (Rahimi and Recht, 2007).

    The projection is drawn from the seed inside each task, so only its parameters are stored.
    """

    gamma = Param(Params._dummy(), "gamma", "RBF width", TypeConverters.toFloat)
    dim = Param(Params._dummy(), "dim", "input dimension", TypeConverters.toInt)
    components = Param(Params._dummy(), "components", "output dimension", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol="features", outputCol="rbf_features", gamma=1.0, dim=1,
                 components=256, seed=42):
        super().__init__()
        self._setDefault(gamma=1.0, dim=1, components=256, seed=42)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        gamma, dim, k = (self.getOrDefault(p) for p in (self.gamma, self.dim, self.components))
        seed = self.getSeed()

        def project(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            rng = np.random.RandomState(seed % 2**32)
            weights = rng.normal(scale=np.sqrt(2 * gamma), size=(dim, k))
            shift = rng.uniform(0, 2 * np.pi, size=k)
            for batch in batches:
                if len(batch) == 0:
                    yield pd.Series([], dtype=object)
                    continue
                x = np.stack(batch.to_numpy())
                yield pd.Series(list(np.sqrt(2.0 / k) * np.cos(x @ weights + shift)))

        udf = F.pandas_udf(project, T.ArrayType(T.DoubleType()))
        # A generator keeps whatever makes the vectors out of the function's argument: in one side of a union, Spark 4.1 does not
        # recognise a Python function of nested lambdas again and leaves it where nothing can run it.
        plain = df.select("*", F.inline_outer(F.array(F.struct(vector_to_array(self.getInputCol()).alias("_plain")))))
        return plain.withColumn(self.getOutputCol(), array_to_vector(udf("_plain"))).drop("_plain")


def scale_gamma(data: DataFrame, features_col: str = "features") -> tuple[float, int]:
    """``1 / (dim * variance over all entries)`` and the dimension, from one pass of sums."""
    values = vector_to_array(features_col)
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    squares = F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x)
    row = data.agg(
        F.max(F.size(values)).alias("dim"), F.sum(F.size(values)).alias("n"),
        F.sum(total).alias("s"), F.sum(squares).alias("ss"),
    ).first()
    if not row["n"]:
        return 1.0, 1
    variance = row["ss"] / row["n"] - (row["s"] / row["n"]) ** 2
    return (1.0 / (row["dim"] * variance) if variance > 0 else 1.0), row["dim"]


def _linear(params: dict, label: str, features: str) -> Estimator:
    loss = params.get("loss", "hinge")
    options = {"labelCol": label, "featuresCol": features, "regParam": LINEAR_REG, "standardization": False,
               "maxIter": params.get("max_iter", 100)}
    if loss == "hinge":
        return LinearSVC(**options)
    if loss in ("log", "log_loss"):
        return LogisticRegression(**options)
    raise ValueError(f"loss {loss!r} is not supported (hinge, log)")


def _forest(params: dict, label: str, features: str) -> Estimator:
    p = {**FOREST_DEFAULTS, **params}
    return RandomForestClassifier(labelCol=label, featuresCol=features, maxDepth=p["max_depth"],
                                  numTrees=p["n_estimators"], seed=p["random_state"], impurity="gini")


class RbfSvm(Estimator):
    """Linear SVM on random Fourier features; the width follows from the training data."""

    def __init__(self, label: str, features: str, components: int = 256, seed: int = 42, max_iter: int = 100):
        super().__init__()
        self.label, self.features = label, features
        self.components, self.seed, self.max_iter = components, seed, max_iter

    def _fit(self, data: DataFrame) -> PipelineModel:
        gamma, dim = scale_gamma(data, self.features)
        n = max(data.count(), 1)
        stages = [
            RandomFourierFeatures(inputCol=self.features, outputCol="rbf_features", gamma=gamma, dim=dim,
                                  components=self.components, seed=self.seed),
            LinearSVC(labelCol=self.label, featuresCol="rbf_features", regParam=1.0 / n, standardization=False,
                      maxIter=self.max_iter),
        ]
        return Pipeline(stages=stages).fit(data)


def _svm(params: dict, label: str, features: str) -> Estimator:
    kernel = params.get("kernel", "rbf")
    if kernel == "linear":
        return LinearSVC(labelCol=label, featuresCol=features, regParam=LINEAR_REG, standardization=False)
    if kernel != "rbf":
        raise ValueError(f"kernel {kernel!r} is not supported (rbf, linear)")
    return RbfSvm(label, features, params.get("components", 256), params.get("seed", 42), params.get("max_iter", 100))


class BalancedAccuracy(MulticlassClassificationEvaluator):
    """Balanced accuracy as an evaluator."""

    def _evaluate(self, dataset: DataFrame) -> float:
        score = balanced_accuracy(dataset, self.getLabelCol(), self.getPredictionCol()).first()
        return score["balanced_accuracy"] or 0.0

    def isLargerBetter(self) -> bool:
        return True


#: For a search that halves, a minute of a configured budget is this many rows to train on, so that it gives the same model on any machine.
ROWS_PER_MINUTE = 1_000_000
KEEP_ONE_IN, SIDE_BY_SIDE = 3, 4
#: Rows that one task holds: a fit runs hundreds of jobs over its rows, however many files they came from.
ROWS_PER_TASK = 10_000


class ModelSearch(Estimator):
    """Best of a bounded number of candidates by balanced accuracy on a hold-out.

    Every candidate is fitted, some side by side, on all rows but those of the hold-out, and the best one again on all rows. The hold-out, a
    fifth, follows from a hash of the features, never from the clock or from how rows are dealt to partitions. ``tried`` lists
    (round, rows' share, candidate, score).

    Only a caller that asks for it (``halve``) gets successive halving: all candidates on a small sample, the better third on one of three times
    the rows, and so on. Then ``row_budget`` bounds the rows that all fits together read, ``candidate_rows`` those of one fit: samples shrink until
    both hold. A search that does not halve has no use for these bounds.

    Rows are dealt to tasks by their number and kept for their round; the hold-out is read once a round, for all candidates.
    """

    def __init__(self, label: str, features: str, population_size: int = 15, row_budget: float | None = None,
                 candidate_rows: float | None = None, seed: int = 42, halve: bool = False):
        super().__init__()
        self.label, self.features, self.seed, self.halve = label, features, seed, halve
        self.population_size, self.row_budget, self.candidate_rows = population_size, row_budget, candidate_rows
        self.tried: list[tuple[int, float, int, float]] = []

    def candidates(self) -> list[tuple[Estimator, dict]]:
        """At most ``population_size`` estimators with their parameters, families in turn."""
        cols = {"labelCol": self.label, "featuresCol": self.features}
        svc = LinearSVC(standardization=False, **cols)
        logistic = LogisticRegression(standardization=False, **cols)
        forest = RandomForestClassifier(seed=self.seed, **cols)
        gaussian = NaiveBayes(modelType="gaussian", **cols)
        grids = [
            (svc, ParamGridBuilder().addGrid(svc.regParam, [1e-4, 1e-2, 1e-1, 1.0]).build()),
            (logistic, ParamGridBuilder().addGrid(logistic.regParam, [1e-4, 1e-2, 1e-1, 1.0]).build()),
            (forest, ParamGridBuilder().addGrid(forest.maxDepth, [3, 5, 10])
             .addGrid(forest.numTrees, [5, 20]).build()),
            (gaussian, [{}]),
        ]
        rounds = zip_longest(*[[(estimator, params) for params in grid] for estimator, grid in grids])
        return [c for turn in rounds for c in turn if c is not None][:self.population_size]

    def shares(self, n_candidates: int, n_rows: int) -> list[tuple[int, float]]:
        """(candidates, share of the training rows) of each round of a search that halves, within the budgets."""
        sizes = [n_candidates]
        while sizes[-1] > 1:
            sizes.append(max(1, sizes[-1] // KEEP_ONE_IN))
        sizes = sizes[:-1] if len(sizes) > 1 else sizes  # one candidate needs no comparison
        plan = [(n, KEEP_ONE_IN ** -(len(sizes) - 1.0 - i)) for i, n in enumerate(sizes)]
        reads, largest = sum(n * share for n, share in plan) * n_rows, max(share for _, share in plan) * n_rows
        limits = ((self.row_budget, reads), (self.candidate_rows, largest))
        shrink = min([1.0, *(limit / reading for limit, reading in limits if limit is not None and reading)])
        return [(n, share * shrink) for n, share in plan]

    def scores(self, fitted: list, held: DataFrame) -> list[float]:
        """Balanced accuracy of each model, from one pass over the hold-out."""
        scored, names = held.select(self.label, self.features), [f"_p{i}" for i in range(len(fitted))]
        for name, model in zip(names, fitted):
            scored = model.transform(scored).select(*scored.columns, F.col("prediction").alias(name))
        return [x or 0.0 for x in balanced_accuracies(scored, self.label, names).first()]

    def _fit(self, data: DataFrame):
        place = F.pmod(F.xxhash64(F.lit(self.seed), vector_to_array(self.features)), F.lit(1 << 20)) / float(1 << 20)
        dealt = data.withColumn("_at", place).persist()
        try:
            held, train = dealt.where("_at >= 0.8"), dealt.where("_at < 0.8")
            left = list(enumerate(self.candidates()))
            self.tried = []
            n_rows = train.count()
            rounds = self.shares(len(left), n_rows) if self.halve else [(len(left), 1.0)]
            for turn, (_, share) in enumerate(rounds):
                part = train.where(F.col("_at") < F.lit(0.8 * share))
                sample = part.repartition(max(1, math.ceil(share * n_rows / ROWS_PER_TASK))).persist()
                try:
                    both = {r[0] for r in sample.select(self.label).distinct().limit(2).collect()}
                    rows = sample if len(both) > 1 else train  # too few rows to tell anything
                    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
                        fitted = list(pool.map(lambda own: own[1][0].fit(rows, own[1][1]), left))
                finally:
                    sample.unpersist()
                scores = self.scores(fitted, held)
                self.tried += [(turn, share, i, x) for (i, _), x in zip(left, scores)]
                ranked = sorted(zip(scores, left), key=lambda x: (-x[0], x[1][0]))
                left = [own for _, own in ranked[:max(1, len(left) // KEEP_ONE_IN)]]
            estimator, params = left[0][1]
            return PipelineModel(stages=[estimator.fit(dealt.drop("_at"), params)])
        finally:
            dealt.unpersist()


def _search(params: dict, label: str, features: str) -> Estimator:
    known = {"verbosity", "population_size", "max_time_mins", "max_eval_time_mins"}
    if unknown := set(params) - known:
        raise ValueError(f"unknown search settings {sorted(unknown)}, known: {sorted(known)}")
    rows = [None if (minutes := params.get(name)) is None else minutes * ROWS_PER_MINUTE for name in ("max_time_mins", "max_eval_time_mins")]
    return ModelSearch(label, features, params.get("population_size", 15), *rows)


Builder = Callable[[dict, str, str], Estimator]
FAMILIES: dict[str, Builder] = {"linear": _linear, "randomforest": _forest, "svm": _svm, "tpot": _search}


def register_family(name: str, builder: Builder, defaults: dict | None = None) -> None:
    """Add a model family: ``builder(params, label_col, features_col) -> Estimator``."""
    FAMILIES[name] = builder
    MODEL_CONFIG.setdefault(name, defaults or {})


def list_models() -> list[str]:
    return list(MODEL_CONFIG)


def is_known_model(name: str) -> bool:
    return name in MODEL_CONFIG


def model_parameters(name: str) -> dict | None:
    return MODEL_CONFIG.get(name)


def build_model(name: str, params: dict | None = None, label_col: str = "irrelevant",
                features_col: str = "features") -> Estimator:
    """Estimator of a family; missing parameters take the defaults, an unknown family is an error."""
    if name not in FAMILIES:
        raise ValueError(f"unknown model family {name!r}, known: {sorted([*FAMILIES, 'bayes'])}")
    return FAMILIES[name](dict(params or {}), label_col, features_col)
