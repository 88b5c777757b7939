"""Counts and scores, each in one pass over its input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_only(posts: DataFrame, label_col: str = "irrelevant") -> DataFrame:
    """Rows labelled 0 or 1; missing and other codes are dropped."""
    return posts.where(F.col(label_col).isin(0.0, 1.0))


def split_relevance(posts: DataFrame, label_col: str = "irrelevant") -> tuple[DataFrame, DataFrame]:
    """(relevant, irrelevant) posts."""
    return posts.where(F.col(label_col) == 0.0), posts.where(F.col(label_col) == 1.0)


def label_stats(posts: DataFrame, label_col: str = "irrelevant") -> DataFrame:
    relevant, irrelevant = F.count_if(F.col(label_col) == 0.0), F.count_if(F.col(label_col) == 1.0)
    return posts.agg(
        (relevant + irrelevant).alias("n_labelled"), F.count("*").alias("n_all"),
        relevant.alias("n_relevant"), irrelevant.alias("n_irrelevant"),
        F.try_divide(relevant, relevant + irrelevant).alias("share_relevant"),
    )


def training_stats(tagged: DataFrame, label_col: str = "irrelevant") -> DataFrame:
    has = F.size("trigger") > 0
    with_trigger = F.count_if(has)
    relevant = F.count_if(has & (F.col(label_col) == 0.0))
    return tagged.agg(
        with_trigger.alias("n_with_trigger"),
        F.count_if(~has).alias("n_without_trigger"),
        F.try_divide(with_trigger, F.count("*")).alias("share_with_trigger"),
        relevant.alias("n_trigger_relevant"),
        F.count_if(has & (F.col(label_col) == 1.0)).alias("n_trigger_irrelevant"),
        F.try_divide(relevant, with_trigger).alias("share_relevant"),
    )


def confusion_matrix(scored: DataFrame, label_col: str = "irrelevant",
                     prediction_col: str = "predicted_irrelevant", by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn with *irrelevant = 1* as the positive class; always all four."""
    y, p = F.col(label_col), F.col(prediction_col)
    return scored.groupBy(*(by or [])).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn"),
    )


def balanced_accuracy(scored: DataFrame, label_col: str = "irrelevant",
                      prediction_col: str = "predicted_irrelevant", by: list[str] | None = None) -> DataFrame:
    """Mean recall over the classes present in the truth."""
    by = by or []
    hit = (F.col(label_col) == F.col(prediction_col)).cast("double")
    recalls = scored.groupBy(*by, label_col).agg(F.avg(hit).alias("recall"))
    return recalls.groupBy(*by).agg(F.avg("recall").alias("balanced_accuracy"))


def balanced_accuracies(scored: DataFrame, label_col: str, prediction_cols: list[str]) -> DataFrame:
    """``balanced_accuracy`` of several prediction columns, all in one pass."""
    hit = lambda c: (F.col(label_col) == F.col(c)).cast("double")
    recalls = scored.groupBy(label_col).agg(*[F.avg(hit(c)).alias(c) for c in prediction_cols])
    return recalls.agg(*[F.avg(c).alias(c) for c in prediction_cols])


def score_of_counts(counts: DataFrame) -> DataFrame:
    """Balanced accuracy from a confusion table, without another pass over the predictions."""
    recalls = F.array_compact(F.array(
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")),
        F.try_divide(F.col("tn"), F.col("tn") + F.col("fp")),
    ))
    total = F.aggregate(recalls, F.lit(0.0), lambda a, r: a + r)
    return counts.withColumn("balanced_accuracy", F.try_divide(total, F.size(recalls)))


def cv_summary(fold_scores: DataFrame, score_col: str = "balanced_accuracy") -> DataFrame:
    """Mean and sample standard deviation of the fold scores."""
    return fold_scores.agg(F.avg(score_col).alias("mean_score"), F.stddev_samp(score_col).alias("sd_score"))


def latest_date(dated: DataFrame, by: str = "lang", date_col: str = "extraction_date") -> DataFrame:
    return dated.groupBy(by).agg(F.max(date_col).alias(date_col))
