"""Seeded order, hold-out split and folds.

The order is that of ``md5(seed:id)``. Ranks are exact although no task ever sorts a whole class: rows
are counted per hash prefix, the few prefix counts are summed up, and each row is ranked inside its
prefix only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEED = 42
PREFIX = 3  # hex digits: 4,096 slices per class


def hash_rank(df: DataFrame, by: list[str], id_col: str = "id_str", seed: int = SEED,
              prefix: int = PREFIX) -> DataFrame:
    """Add ``_rank`` (1-based, seeded order within ``by``) and ``_total`` (rows of the group).

    ``by`` holds class labels: the table of slice starts has at most ``16 ** prefix`` rows per class and
    is broadcast.
    """
    h = df.withColumn("_hash", F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))))
    h = h.withColumn("_slice", F.substring("_hash", 1, prefix))
    keys = [*by, "_slice"]
    counts = h.groupBy(*keys).agg(F.count("*").alias("_n"))
    over_group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    before = over_group.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
        F.sum("_n").over(over_group).alias("_total"),
    )
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    in_slice = F.row_number().over(W.partitionBy(*keys).orderBy("_hash", id_col))
    ranked = h.withColumn("_in_slice", in_slice).join(F.broadcast(starts), same)
    return ranked.withColumn("_rank", F.col("_in_slice") + F.col("_start")).drop(
        "_hash", "_slice", "_in_slice", "_start", *[f"_k{i}" for i in range(len(keys))]
    )


def stratified_split(df: DataFrame, label_col: str = "irrelevant", test_share: float = 0.2,
                     id_col: str = "id_str", seed: int = SEED) -> DataFrame:
    """Add ``is_test``: the first ``ceil(share * n)`` rows of each class in seeded order."""
    ranked = hash_rank(df, [label_col], id_col, seed)
    return ranked.withColumn("is_test", F.col("_rank") <= F.ceil(F.lit(test_share) * F.col("_total"))).drop("_rank", "_total")


def stratified_folds(df: DataFrame, label_col: str = "irrelevant", k: int = 5,
                     id_col: str = "id_str", seed: int = SEED) -> DataFrame:
    """Add ``fold`` in 0..k-1; class sizes of the folds differ by at most one."""
    ranked = hash_rank(df, [label_col], id_col, seed)
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank", "_total")


def shuffle_rows(df: DataFrame, id_col: str = "id_str", seed: int = SEED) -> DataFrame:
    """Add ``row_index``, the 0-based position in a seeded random order; nothing is sorted globally."""
    return hash_rank(df, [], id_col, seed).withColumn("row_index", F.col("_rank") - 1).drop("_rank", "_total")
