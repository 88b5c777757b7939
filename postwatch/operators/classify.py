"""One classifier interface over table-based naive Bayes and the ``pyspark.ml`` families."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postwatch.functions.lookup import KEY, one_of_each, salted_join, value_key
from postwatch.functions.text import word_tokenize
from postwatch.operators.bayes import (
    SMOOTHING, BayesModel, class_sizes, fit_bayes, log_weights, predict_bayes,
)
from postwatch.operators.matching import trigger_gate
from postwatch.operators.models import build_model, model_parameters
from postwatch.operators.pooling import dense_features
from postwatch.operators.splits import SEED, stratified_folds
from postwatch.operators.stats import balanced_accuracy, confusion_matrix, cv_summary, score_of_counts
from postwatch.operators.vocabulary import token_rows
from postwatch.session import scratch_path


@dataclass
class Classifier:
    """A trained model with what it needs to turn posts into features."""

    model_type: str
    model: object
    embedding: DataFrame | None = None

    def release(self) -> None:
        """Drop what training kept in memory."""
        if isinstance(self.model, BayesModel):
            self.model.unpersist()

    def predict(self, posts: DataFrame) -> DataFrame:
        """Labels for posts with a trigger; without any such post the result is empty."""
        gated = trigger_gate(posts)
        if self.model_type == "bayes":
            return predict_bayes(gated, self.model).drop("log_odds")
        scored = self.model.transform(dense_features(gated, self.embedding))
        return attach_prediction(scored, gated.columns)


def attach_prediction(scored: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns and ``predicted_irrelevant`` as an integer."""
    return scored.select(*columns, F.col("prediction").cast("int").alias("predicted_irrelevant"))


def fit(train: DataFrame, model_type: str, params: dict | None = None, embedding: DataFrame | None = None,
        label_col: str = "irrelevant", id_col: str = "id_str") -> Classifier:
    """Train on posts that were already gated and labelled."""
    if model_type == "bayes":
        return Classifier("bayes", fit_bayes(train, label_col))
    if embedding is None:
        raise ValueError(f"model family {model_type!r} needs a word embedding")
    narrow = train.select(id_col, label_col, "full_text_preprocessed")
    features = dense_features(narrow, embedding).persist()
    try:
        params = model_parameters(model_type) if params is None else params
        return Classifier(model_type, build_model(model_type, params, label_col).fit(features), embedding)
    finally:
        features.unpersist()


def evaluate(classifier: Classifier, labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(predictions, confusion counts with balanced accuracy), on posts with a trigger."""
    scored = classifier.predict(labelled)
    return scored, score_of_counts(confusion_matrix(scored))


def cross_validate(posts: DataFrame, model_type: str, params: dict | None = None,
                   embedding: DataFrame | None = None, k: int = 5, label_col: str = "irrelevant",
                   id_col: str = "id_str", seed: int = SEED) -> DataFrame:
    """``(fold, balanced_accuracy)`` of stratified folds over gated, labelled posts."""
    if model_type == "bayes":
        return cross_validate_bayes(posts, k, label_col, id_col, seed)
    if embedding is None:
        raise ValueError(f"model family {model_type!r} needs a word embedding")
    narrow = posts.select(id_col, label_col, "full_text_preprocessed")
    folded = dense_features(stratified_folds(narrow, label_col, k, id_col, seed), embedding)
    folded = folded.persist()
    try:
        params = model_parameters(model_type) if params is None else params
        scores = []
        for fold in range(k):
            model = build_model(model_type, params, label_col).fit(folded.where(F.col("fold") != fold))
            scored = model.transform(folded.where(F.col("fold") == fold))
            score = balanced_accuracy(scored, label_col, "prediction").first()["balanced_accuracy"]
            scores.append((fold, score))
        return posts.sparkSession.createDataFrame(scores, "fold INT, balanced_accuracy DOUBLE")
    finally:
        folded.unpersist()


def bayes_fold_predictions(folded: DataFrame, label_col: str = "irrelevant", id_col: str = "id_str") -> DataFrame:
    """``(id, label, fold, predicted_irrelevant)`` with each fold scored by a model of the other folds.

    All folds are trained in one grouped count: a token's count in the other folds is its total minus
    its count in the fold itself. ``folded`` is read several times, so callers keep it.
    """
    y, fold = F.col(label_col), F.col("fold")
    sizes = {r["fold"]: (r["n0"], r["n1"]) for r in class_sizes(folded, label_col, ["fold"]).collect()}
    n0, n1 = sum(n for n, _ in sizes.values()), sum(n for _, n in sizes.values())
    counts = token_rows(folded, label_col, "fold", distinct=True).groupBy("token").agg(
        F.count_if(y == 0).alias("all0"), F.count_if(y == 1).alias("all1"),
        *[F.count_if((fold == f) & (y == c)).alias(f"in{f}_{c}") for f in sizes for c in (0, 1)],
    )
    others = counts.select("token", F.inline(F.array(*[
        F.struct(
            F.lit(f).alias("fold"),
            (F.col("all0") - F.col(f"in{f}_0")).alias("c0"), (F.col("all1") - F.col(f"in{f}_1")).alias("c1"),
            F.lit(n0 - in0).alias("n0"), F.lit(n1 - in1).alias("n1"),
        )
        for f, (in0, in1) in sizes.items()
    ]))).where("c0 + c1 > 0")
    weights = log_weights(others)
    bias = weights.groupBy("fold").agg(
        (F.log((F.max("n1") + SMOOTHING) / (F.max("n0") + SMOOTHING)) + F.sum("absent")).alias("_bias")
    )
    # A token has one row with its gap in every fold, so that a text is scored for all folds in one pass over its words.
    folds = sorted(sizes)
    gap = lambda f: F.coalesce(F.sum(F.when(F.col("fold") == f, F.col("present") - F.col("absent"))), F.lit(0.0))
    path = scratch_path(folded.sparkSession, "folds")
    weights.groupBy("token").agg(F.array(*[gap(f) for f in folds]).alias("gaps")).write.parquet(path)
    gaps = folded.sparkSession.read.schema("token STRING, gaps ARRAY<DOUBLE>").parquet(path)
    keyed = folded.withColumn(KEY, value_key(F.col("full_text_preprocessed").alias("t")))
    texts = one_of_each(keyed, F.col("full_text_preprocessed"), "_text")
    joined = salted_join(texts.select(KEY, F.explode(F.array_distinct(word_tokenize("_text"))).alias("token")), gaps, "token", row_bytes=64 + 8 * len(folds))
    gains = joined.groupBy(KEY).agg(*[F.sum(F.col("gaps")[i]).alias(f"_g{i}") for i in range(len(folds))])
    gain = F.coalesce(*[F.when(F.col("fold") == f, F.col(f"_g{i}")) for i, f in enumerate(folds)], F.lit(0.0)) if folds else F.lit(0.0)
    return (
        keyed.select(id_col, label_col, "fold", KEY).join(gains, KEY, "left").join(F.broadcast(bias), "fold")
        .select(id_col, label_col, "fold", (F.col("_bias") + gain >= 0).cast("int").alias("predicted_irrelevant"))
    )


def cross_validate_bayes(posts: DataFrame, k: int = 5, label_col: str = "irrelevant",
                         id_col: str = "id_str", seed: int = SEED) -> DataFrame:
    narrow = posts.select(id_col, label_col, "full_text_preprocessed")
    folded = stratified_folds(narrow, label_col, k, id_col, seed).persist()
    try:
        scored = bayes_fold_predictions(folded, label_col, id_col)
        rows = balanced_accuracy(scored, label_col, by=["fold"]).collect()
        return posts.sparkSession.createDataFrame(rows, "fold INT, balanced_accuracy DOUBLE")
    finally:
        folded.unpersist()


def summarise_folds(scores: DataFrame) -> DataFrame:
    return cv_summary(scores)


def save_classifier(classifier: Classifier, root: str, lang: str) -> str:
    """Store a model under ``root/{model_type}_{lang}``."""
    path = f"{root}/{classifier.model_type}_{lang}"
    if classifier.model_type == "bayes":
        classifier.model.save(path)
    else:
        model = classifier.model
        model = model if isinstance(model, PipelineModel) else PipelineModel(stages=[model])
        model.write().overwrite().save(path)
    return path


def load_classifier(spark: SparkSession, root: str, model_type: str, lang: str,
                    embedding: DataFrame | None = None) -> Classifier:
    path = f"{root}/{model_type}_{lang}"
    if model_type == "bayes":
        return Classifier("bayes", BayesModel.load(spark, path))
    return Classifier(model_type, PipelineModel.load(path), embedding)
