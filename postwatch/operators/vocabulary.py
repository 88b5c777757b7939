"""Token tables of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postwatch.functions.text import word_tokenize


def token_rows(posts: DataFrame, *keep: str, text_col: str = "full_text_preprocessed",
               distinct: bool = False) -> DataFrame:
    """One row per token of each post (per distinct token with ``distinct=True``)."""
    tokens = word_tokenize(text_col)
    return posts.select(*keep, F.explode(F.array_distinct(tokens) if distinct else tokens).alias("token"))


def vocabulary(posts: DataFrame, text_col: str = "full_text_preprocessed") -> DataFrame:
    """``(token, n, n_docs)``: occurrences and number of posts.

    Sorting a post's tokens marks each first occurrence, so both numbers are plain counts that are
    summed before the shuffle; there is no distinct aggregate and a frequent token is not a hot spot.
    """
    ordered = F.sort_array(word_tokenize(text_col))
    marked = F.get(
        F.transform(F.array(ordered), lambda ts: F.transform(
            ts, lambda t, i: F.struct(t.alias("token"), F.coalesce(F.get(ts, i - 1) != t, F.lit(True)).alias("first"))
        )), 0)
    return (
        posts.select(F.explode(marked).alias("m"))
        .groupBy("m.token")
        .agg(F.count("*").alias("n"), F.count_if("m.first").alias("n_docs"))
    )


def nb_statistics(posts: DataFrame, label_col: str = "irrelevant",
                  text_col: str = "full_text_preprocessed") -> tuple[DataFrame, DataFrame]:
    """Class sizes ``(label, n_posts)`` and posts per class and token ``(label, token, n_posts)``."""
    classes = posts.groupBy(F.col(label_col).cast("int").alias("label")).agg(F.count("*").alias("n_posts"))
    rows = token_rows(posts, F.col(label_col).cast("int").alias("label"), text_col=text_col, distinct=True)
    return classes, rows.groupBy("label", "token").agg(F.count("*").alias("n_posts"))
