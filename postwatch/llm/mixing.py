"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key scaled by its quality weight. A source that is to give more words
than it has gives whole epochs first; the fraction that remains is taken from its documents by ascending key until the
word budget is spent. The prefix sums are taken over bins of keys, and row by row only in the one bin of
each source in which the budget ends, so that no task sorts a source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postwatch.llm.common import BLANKS, store, unit_interval, word_array, word_count

WEIGHTS, MOST_EPOCHS, BINS, SEED = (5, 2, 1), 3, 4096, 42
#: A table of sources up to this many rows is broadcast; beyond it, Spark joins.
SMALL_SOURCES = 20_000


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0,
            most: float = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target) of a table (source, source_size) with one row for each source.

    Sources by code point, null last, weigh ``weights``, repeating, and share ``share`` of all sizes. A target
    stops at ``most`` times its source's size; the excess goes to the others by weight. With the sources in the
    order of limit per weight, a source's level is what is left after the limits before it, per weight from it
    on; the highest level is the one at which all of the budget is given out.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = sources.withColumn("w", F.element_at(cycle, F.pmod(place, F.lit(len(weights))) + 1)).withColumn(
        "most", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    full = ranked.select(
        "*", F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("gone"),
        F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("rest"),
        (F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))).alias("all"),
    )
    level = F.max((F.col("all") - F.col("gone")) / F.col("rest")).over(Window.partitionBy())
    return full.withColumn("level", level).select(
        "source", "source_size", F.least("most", F.col("level") * F.col("w")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None,
        quality: Column | None = None, weights: Sequence[float] = WEIGHTS, share: float = 1.0,
        most: float = MOST_EPOCHS, bins: int = BINS, seed: int = SEED) -> DataFrame:
    """(row, size, source_size, target, epochs, part, taken) for each row of ``docs``, ``row`` holding its columns.

    ``taken = epochs * size + part`` words: ``epochs`` whole copies and the first ``part`` words of one more. The
    taken words of a source add up to its target, rounded. ``size`` is the number of words of ``text`` unless
    given; null counts as 0. ``quality`` is a positive weight; null, zero and negative ones count as the smallest
    weight. Null is a source of its own. Equal keys are taken by id, then size; rows equal in both are
    interchangeable. Empty documents and sources take nothing; an empty table gives an empty result.
    """
    size = word_count(F.col("text")) if size is None else F.coalesce(size, F.lit(0)).cast("long")
    quality = F.lit(1.0) if quality is None else F.greatest(F.coalesce(quality, F.lit(0.0)), F.lit(0.01))
    key = -F.log(unit_interval(F.col(id_col), F.lit(seed))) / quality
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                       size.alias("size"), key.alias("key"))
    rows = rows.withColumn("bin", F.floor(F.col("key") / (F.col("key") + 1) * bins).cast("int"))

    binned = store(rows.groupBy("source", "bin").agg(F.sum("size").alias("words")), "bins")
    goal = targets(binned.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    budget = F.round("target").cast("long")
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("rest", budget - F.col("epochs") * F.col("source_size")).withColumnRenamed("source", "_s")
    before = F.coalesce(F.sum("words").over(
        Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = (binned.withColumn("before", before).join(goal, F.col("source").eqNullSafe(F.col("_s")))
            .where("before < rest AND rest <= before + words")
            .select(F.col("source").alias("_e"), F.col("bin").alias("last"), "before"))
    plan = store(goal.join(ends, F.col("_s").eqNullSafe(F.col("_e")), "left").select(
        "_s", "source_size", "target", "epochs", "rest", F.coalesce("last", F.lit(-1)).alias("last"),
        F.coalesce("before", F.lit(0)).alias("before")), "mix")

    small = plan.count() <= SMALL_SOURCES
    planned = rows.join(F.broadcast(plan) if small else plan, F.col("source").eqNullSafe(F.col("_s")))
    whole = planned.where("bin <> last").withColumn("part", F.when(F.col("bin") < F.col("last"), F.col("size")).otherwise(0))
    prefix = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("key", "id", "size").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    cut = planned.where("bin = last").withColumn("_p", prefix).withColumn(
        "part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before") - F.col("_p"))))
    columns = ["row", "size", "source_size", "target", "epochs", F.col("part").cast("long").alias("part")]
    return whole.select(*columns).union(cut.select(*columns)).withColumn(
        "taken", F.col("epochs") * F.col("size") + F.col("part"))


def prose_share(text: Column) -> Column:
    """Quality weight from the text alone, so that mixing moves no texts: the share of small letters, blanks aside."""
    solid = F.regexp_replace(text, BLANKS, "")
    return F.length(F.regexp_replace(solid, r"\P{Ll}+", "")) / F.greatest(F.length(solid), F.lit(1))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix: whole copies as rows, and the first words of those that the budget cuts.

    The columns of ``docs`` are kept; ``n_chars``, if there, follows the text.
    """
    mixed = mix(docs, **options)
    copies = F.when(F.col("size") > 0, F.col("epochs") + (F.col("part") > 0).cast("long")).otherwise(0)
    out = mixed.where(copies > 0).select("*", F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("_copy"))
    is_cut = (F.col("_copy") > F.col("epochs")) & (F.col("part") < F.col("size"))
    text = F.when(is_cut, F.array_join(F.slice(word_array(F.col("row.text")), 1, F.greatest(F.col("part"), F.lit(1)).cast("int")), " ")
                  ).otherwise(F.col("row.text"))
    out = out.withColumn("_text", text)
    changed = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(is_cut, F.length("_text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
