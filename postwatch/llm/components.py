"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postwatch.functions.lookup import never_broadcast
from postwatch.llm.common import store


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a long, b long) that is not itself the smallest of its component.

    Each round points a node's larger neighbours, then its smaller ones, at the smallest it knows. Minima
    are combined before the shuffle, and a node with very many neighbours meets them in a plain join, which
    Spark may split. Rounds are written to the shared folder. An empty table gives an empty table; repeated
    links and links of a node to itself have no effect; more than ``max_rounds`` rounds raise an error.
    """
    edges = store(
        links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links",
    )
    before = _mark(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        edges = store(_small_star(_large_star(edges)), "links")
        after = _mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(never_broadcast(lowest), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    lowest = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(never_broadcast(lowest), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(lowest.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
