"""Sharding by sampled splitters: shards of near equal size in bytes, from ranges of a text hash.

A sample of the keys, drawn by size, gives many more boundaries than there are shards. Exact sizes of the
ranges between them, added up in order, say which shard each belongs to. A range that is overfull, as one key holds
very many rows, is subdivided by a hash of the id. Only built-in functions are used, texts are read once, and no
task sees more than a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postwatch.llm.common import store, unit_interval

SHARDS, RANGES_PER_SHARD, DRAWN, SEED = 24, 256, 200_000, 5
#: A range above this part of a shard is subdivided.
OVERFULL = 0.1


def range_of(key: Column, splitters: list[int]) -> Column:
    """How many of the ascending ``splitters`` are at most ``key``, by bisection."""
    steps = [1 << i for i in reversed(range(max(1, len(splitters).bit_length())))]
    values = F.lit(splitters or [0])
    if not splitters:
        return F.lit(0)
    return F.aggregate(F.lit(steps), F.lit(0), lambda n, s: F.when(F.get(values, n + s - 1) <= key, n + s).otherwise(n))


def splitters(rows: DataFrame, wanted: int, drawn: int = DRAWN, seed: int = SEED) -> list[int]:
    """About ``wanted`` ascending boundaries of the column ``key``, from about ``drawn`` rows drawn by ``size``.

    A key that fills more than one boundary alone gets a range of its own.
    """
    total = rows.agg(F.sum("size")).first()[0]
    if not total:
        return []
    sample = rows.where(unit_interval("key", "id", F.lit(seed)) < F.col("size") * F.lit(drawn / total))
    quantiles = [i / wanted for i in range(1, wanted)]
    found = sample.agg(F.percentile_approx("key", quantiles, 10 * wanted)).first()[0] or []
    heavy = {a + 1 for a, b in zip(found, found[1:]) if a == b and a < (1 << 63) - 1}
    return sorted({*found, *heavy})


def shard(docs: DataFrame, shards: int = SHARDS, ranges_per_shard: int = RANGES_PER_SHARD, drawn: int = DRAWN,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row; size is the text's UTF-8 bytes plus 8.

    Shards follow ranges of the text's hash, so that equal texts share a shard, unless they make a range of more than ``OVERFULL`` of a
    shard; then they are dealt by a hash of the id. Null texts count as empty, in size and checksum. ``slot`` counts the rows of a shard
    from 0. Rows equal in id and text are interchangeable. With fewer rows than shards some shards are empty; an empty
    table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = store(docs.select(
        F.col(id_col).cast("long").alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("key")), "sizes")
    wanted = shards * ranges_per_shard
    cuts = splitters(rows, wanted, drawn)
    ranged = rows.withColumn("range", range_of(F.col("key"), cuts))
    sizes = ranged.groupBy("range").agg(F.sum("size").alias("bytes"))
    total = F.sum("bytes").over(Window.partitionBy())
    # One row for each range, at most twice the number of boundaries: small whatever the input.
    parts = F.when(F.col("bytes") > total * F.lit(OVERFULL / shards), F.ceil(F.col("bytes") * wanted / total)).otherwise(1)
    parts = store(sizes.select("range", parts.cast("int").alias("parts")), "ranges")
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("id", F.lit(SEED)), F.col("parts"))).otherwise(0).cast("int")
    dealt = ranged.join(F.broadcast(parts), "range").withColumn("part", part)

    units = store(dealt.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "units")
    order = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.coalesce(F.sum("bytes").over(order), F.lit(0)) + F.col("bytes") / 2
    share = F.sum("bytes").over(Window.partitionBy()) / F.lit(shards)
    placed = units.withColumn("shard", F.least(F.floor(middle / share), F.lit(shards - 1)).cast("int"))
    first = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = store(placed.withColumn("first", first).select("range", "part", "shard", "first"), "shards")

    within = F.row_number().over(Window.partitionBy("range", "part").orderBy("key", "id", "crc", "size")) - 1
    out = dealt.select("id", "size", "crc", "key", "range", "part").withColumn("within", within).join(F.broadcast(placed), ["range", "part"])
    return out.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("first") + F.col("within")).cast("long").alias("slot"))
