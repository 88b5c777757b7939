"""Naive Bayes over boolean word features.

A model is a number, ``bias``, and a table ``weights(token, gap, n)`` with one row per vocabulary token; n, the training posts that hold
it, only decides how the table is joined. Training is one grouped count. Prediction looks a model of checked size up row by
row, and joins a larger one, so that no vocabulary is too large.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postwatch.functions.lookup import KEY, MAX_BROADCAST_BYTES, one_of_each, salted_join, value_key
from postwatch.functions.text import word_tokenize

SMOOTHING = 0.5  # fixed value: expected-likelihood estimate
#: Off: on cleaned posts whose lemmas are looked up in place, Spark 4.1 leaves the scoring function in a plan that cannot run it.
LOCAL_SCORING = False
MAX_LOCAL_WEIGHTS = 4_000_000  # tokens of a model that is broadcast; 16 bytes each


@dataclass
class BayesModel:
    """``bias`` is the log odds of class 1 for a post without known words; a present word adds its gap."""

    bias: float
    weights: DataFrame
    evidence: DataFrame | None = None

    def save(self, path: str) -> None:
        self.weights.write.mode("overwrite").parquet(f"{path}/weights")
        bias = self.weights.sparkSession.createDataFrame([(self.bias,)], "bias DOUBLE")
        bias.write.mode("overwrite").parquet(f"{path}/base")

    @staticmethod
    def load(spark: SparkSession, path: str) -> BayesModel:
        return BayesModel(spark.read.parquet(f"{path}/base").first()["bias"], spark.read.parquet(f"{path}/weights"))

    def unpersist(self) -> None:
        """Release the counts kept since training (not needed for a loaded model)."""
        if self.evidence is not None:
            self.evidence.unpersist()


def token_evidence(posts: DataFrame, label_col: str = "irrelevant",
                   text_col: str = "full_text_preprocessed") -> DataFrame:
    """``(token, c0, c1)``: posts of each class that hold the token.

    Each post also counts once under the null token, which gives the class sizes in the same pass.
    """
    y = F.col(label_col)
    words = F.array_append(F.array_distinct(word_tokenize(text_col)), F.lit(None).cast("string"))
    return (
        posts.select(label_col, F.explode(words).alias("token"))
        .groupBy("token")
        .agg(F.count_if(y == 0).alias("c0"), F.count_if(y == 1).alias("c1"))
    )


def log_weights(evidence: DataFrame) -> DataFrame:
    """Add ``present`` and ``absent`` (log likelihood ratios, class 1 over class 0) to rows with
    ``c0, c1, n0, n1``.

    A feature has two values unless the token is in every training post, then it has one.
    """
    values = F.when(F.col("c0") + F.col("c1") == F.col("n0") + F.col("n1"), 1).otherwise(2)

    def ratio(k1, k0):
        def share(k, n):
            return (k + F.lit(SMOOTHING)) / (n + F.lit(SMOOTHING) * values)
        return F.log(share(k1, F.col("n1"))) - F.log(share(k0, F.col("n0")))

    return evidence.withColumn("present", ratio(F.col("c1"), F.col("c0"))).withColumn(
        "absent", ratio(F.col("n1") - F.col("c1"), F.col("n0") - F.col("c0"))
    )


def class_sizes(posts: DataFrame, label_col: str, by: list[str] | None = None) -> DataFrame:
    y = F.col(label_col)
    return posts.groupBy(*(by or [])).agg(F.count_if(y == 0).alias("n0"), F.count_if(y == 1).alias("n1"))


def fit_bayes(posts: DataFrame, label_col: str = "irrelevant",
              text_col: str = "full_text_preprocessed") -> BayesModel:
    """Train on rows labelled 0 or 1. The texts are read once; their counts are kept until released."""
    evidence = token_evidence(posts, label_col, text_col).persist()
    sizes = evidence.where(F.col("token").isNull()).first()
    n0, n1 = (sizes["c0"], sizes["c1"]) if sizes else (0, 0)
    known = evidence.where(F.col("token").isNotNull())
    scored = log_weights(known.withColumns({"n0": F.lit(n0), "n1": F.lit(n1)}))
    absent = scored.agg(F.sum("absent").alias("s")).first()["s"] or 0.0
    bias = math.log((n1 + SMOOTHING) / (n0 + SMOOTHING)) + absent
    weights = scored.select("token", (F.col("present") - F.col("absent")).alias("gap"), (F.col("c0") + F.col("c1")).alias("n"))
    return BayesModel(bias, weights, evidence)


def weight_arrays(model: BayesModel, max_rows: int = MAX_LOCAL_WEIGHTS) -> tuple[np.ndarray, np.ndarray] | None:
    """Sorted token hashes and their gaps if the model has at most ``max_rows`` tokens without equal hashes, else None."""
    if model.weights.limit(max_rows + 1).count() > max_rows:
        return None
    table = model.weights.select(F.xxhash64("token").alias("h"), "gap").toArrow()
    hashes = table["h"].to_numpy().astype(np.int64)
    order = np.argsort(hashes)
    hashes, gaps = hashes[order], table["gap"].to_numpy()[order]
    return None if (hashes[1:] == hashes[:-1]).any() else (hashes, gaps)


def _local_log_odds(posts: DataFrame, arrays: tuple[np.ndarray, np.ndarray], bias: float, text_col: str) -> Column:
    """Scores where the texts are: only hashes of the distinct tokens leave the JVM, and the model is broadcast."""
    shared = posts.sparkSession.sparkContext.broadcast(arrays)

    def score(tokens: pd.Series) -> pd.Series:
        hashes, gaps = shared.value
        sizes = tokens.map(len).to_numpy(np.int64)
        flat = np.concatenate([np.empty(0, np.int64), *tokens.tolist()]).astype(np.int64)
        at = np.minimum(np.searchsorted(hashes, flat), max(len(hashes) - 1, 0))
        gained = np.where(hashes[at] == flat, gaps[at], 0.0) if len(hashes) else np.zeros(len(flat))
        return pd.Series([gained[e - n:e].sum() for e, n in zip(np.cumsum(sizes), sizes)], dtype=float)

    words = F.array_distinct(word_tokenize(text_col))
    # Marked so that no plan merges it into other expressions, or scores a text a second time for the label.
    scored = F.pandas_udf(score, "double").asNondeterministic()
    return F.lit(bias) + scored(F.transform(words, lambda t: F.xxhash64(t)))


def log_odds(posts: DataFrame, model: BayesModel, text_col: str = "full_text_preprocessed",
             max_rows: int = MAX_LOCAL_WEIGHTS) -> DataFrame:
    """Add ``log_odds`` to every post; unknown words have no effect.

    Each row is scored by itself: repeated posts get the same score. A model of checked size is looked up row by row, without
    a shuffle. A larger one is joined on the tokens of the distinct texts, and the scores come back by text.
    """
    arrays = weight_arrays(model, max_rows) if LOCAL_SCORING else None
    if arrays is not None:
        return posts.withColumn("log_odds", _local_log_odds(posts, arrays, model.bias, text_col))
    keyed = posts.withColumn(KEY, value_key(F.col(text_col).alias("t")))
    # Texts are shuffled as they are, and split once each.
    texts = one_of_each(keyed, F.col(text_col), "_text")
    tokens = texts.select(KEY, F.explode_outer(F.array_distinct(word_tokenize("_text"))).alias("token"))
    gained = _gains(tokens, model.weights)
    return keyed.join(gained, KEY).withColumn("log_odds", F.col("_gain") + F.lit(model.bias)).drop(KEY, "_gain")


def _gains(tokens: DataFrame, weights: DataFrame) -> DataFrame:
    """``(KEY, _gain)`` of the distinct tokens of texts.

    Of weights above the broadcast bound those of the tokens with most training posts are broadcast and the rare ones are joined as they are: few
    rows are left for that join, and no copy of the weights is made for each salt.
    """
    gain = F.coalesce(F.sum("gap"), F.lit(0.0)).alias("_gain")
    most = MAX_BROADCAST_BYTES // 128
    if "n" not in weights.columns or weights.limit(most + 1).count() <= most:
        return salted_join(tokens, weights.select("token", "gap"), "token", how="left").groupBy(KEY).agg(gain)
    class_of = F.floor(4 * F.log2(F.col("n").cast("double"))).cast("int")
    least, total = 1 << 20, 0
    for r in weights.groupBy(class_of.alias("c")).agg(F.count("*").alias("n")).orderBy(F.desc("c")).collect():
        total += r["n"]
        if total > most:
            break
        least = r["c"]
    frequent, rare = (weights.where(test).select("token", "gap") for test in (class_of >= least, class_of < least))
    by_frequent = tokens.join(F.broadcast(frequent), "token", "left").groupBy(KEY).agg(gain)
    left = tokens.join(F.broadcast(frequent.select("token")), "token", "left_anti")
    by_rare = left.join(rare, "token").groupBy(KEY).agg(gain)
    return by_frequent.unionByName(by_rare).groupBy(KEY).agg(F.sum("_gain").alias("_gain"))


def predict_bayes(posts: DataFrame, model: BayesModel, text_col: str = "full_text_preprocessed",
                  max_rows: int = MAX_LOCAL_WEIGHTS) -> DataFrame:
    """Add ``log_odds`` and ``predicted_irrelevant``; a tie goes to class 1."""
    scored = log_odds(posts, model, text_col, max_rows)
    return scored.withColumn("predicted_irrelevant", (F.col("log_odds") >= 0).cast("int"))
