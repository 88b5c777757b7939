"""Word vectors to post vectors."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postwatch.functions.lookup import KEY, one_of_each, salted_join, value_key
from postwatch.functions.text import word_tokenize
from postwatch.session import stored


BROADCAST_BYTES = 64 << 20  # vectors up to this size are broadcast, and of more of them the most frequent up to
HEAD_BYTES = 48 << 20


def embedding_lookup(token_rows: DataFrame, embedding: DataFrame, id_col: str = "id_str") -> DataFrame:
    """Token rows with their vectors; unknown tokens are dropped."""
    return salted_join(token_rows, embedding.select("token", "vector"), "token", id_col, row_bytes=4096)


def mean_pool(posts: DataFrame, embedding: DataFrame, tokens_col: str, out_col: str = "features",
              id_col: str = "id_str", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(id, features)``: mean vector of the known tokens, repeats counted; zeros if none is known.

    The size of the vectors is checked first. Small ones are broadcast, so that neither tokens nor vectors are
    shuffled. Of larger ones, those of the most frequent tokens are broadcast and the others joined: few rows are left for that join, and
    no token has many. There is one sum for each component, so that Spark combines a post's sums in a hash table. ``id_col`` must
    identify rows.
    """
    size = embedding.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim")).first()
    dim = size["dim"] or 0
    rows = posts.select(id_col, F.explode_outer(tokens_col).alias("token"))
    vectors = embedding.select("token", "vector")
    if size["n"] * dim * 4 <= broadcast_bytes:
        sums = _sums(rows.join(F.broadcast(vectors), "token", "left"), id_col, dim)
    else:
        counts = stored(rows.where("token IS NOT NULL").groupBy("token").agg(F.count("*").alias("n")).join(vectors, "token"), "vocabulary")
        class_of = F.floor(4 * F.log2(F.col("n").cast("double"))).cast("int")
        least = _least_class(counts.groupBy(class_of.alias("c")).agg(F.count("*").alias("n")).collect(), HEAD_BYTES // max(1, 4 * dim))
        frequent, rare = (counts.where(test).select("token", "vector") for test in (class_of >= least, class_of < least))
        by_frequent = _sums(rows.join(F.broadcast(frequent), "token", "left"), id_col, dim)
        left = rows.where("token IS NOT NULL").join(F.broadcast(frequent.select("token")), "token", "left_anti")
        # Sums of few rows are larger than the rows: these are dealt out as they are.
        by_rare = _sums(left.join(rare, "token").select(id_col, "vector").repartition(id_col), id_col, dim)
        both = by_frequent.unionByName(by_rare)
        sums = both.groupBy(id_col).agg(*[F.sum(c).alias(c) for c in both.columns if c != id_col])
    n = F.greatest(F.col("_n"), F.lit(1))
    mean = F.array(*[F.col(f"_s{i}") / n for i in range(dim)]) if dim else F.array().cast("array<double>")
    return sums.select(id_col, mean.alias(out_col))


def _sums(known: DataFrame, id_col: str, dim: int) -> DataFrame:
    """Rows with a vector and the sum of each component."""
    component = lambda i: F.sum(F.coalesce(F.get("vector", F.lit(i)).cast("double"), F.lit(0.0)))
    return known.groupBy(id_col).agg(F.count("vector").alias("_n"), *[component(i).alias(f"_s{i}") for i in range(dim)])


def _least_class(classes: list, most: int) -> int:
    """The lowest class of frequency from which on the tokens are ``most`` at most."""
    least, total = 1 << 20, 0
    for r in sorted(classes, key=lambda r: -r["c"]):
        total += r["n"]
        if total > most:
            break
        least = r["c"]
    return least


def dense_features(posts: DataFrame, embedding: DataFrame, text_col: str = "full_text_preprocessed",
                   verified_col: str | None = None) -> DataFrame:
    """Posts with a ``features`` vector, also for empty texts. Posts with the same text share it, whatever their ids.

    ``verified_col`` appends the account's verified flag; it is off by default.
    """
    keyed = posts.withColumn(KEY, value_key(F.col(text_col).alias("t")))
    texts = one_of_each(keyed, F.col(text_col), "_text")
    tokens = texts.select(KEY, word_tokenize("_text").alias("_tokens"))
    joined = keyed.join(mean_pool(tokens, embedding, "_tokens", "_mean", KEY), KEY).drop(KEY)
    if verified_col is None:
        return joined.withColumn("features", array_to_vector("_mean")).drop("_mean")
    flag = F.coalesce(F.col(verified_col).cast("double"), F.lit(0.0))
    wide = joined.withColumn("_vec", array_to_vector("_mean")).withColumn("_flag", flag)
    return VectorAssembler(inputCols=["_vec", "_flag"], outputCol="features").transform(wide).drop(
        "_mean", "_vec", "_flag")
