"""Dictionary look-ups for token arrays.

A dictionary whose size is checked to be small travels with the query as a hashed literal: each token
is looked up where it is, no explode and no shuffle. A larger one is joined on exploded tokens.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postwatch.session import scratch_path

MAX_LITERAL_ROWS = 20_000
MAX_BROADCAST_BYTES = 16 << 20  # the driver holds a table that is broadcast several times over
KEY = "_row_key"


def value_key(*cols: Column | str) -> Column:
    """A key of what a row's result depends on: two 64-bit hashes. Look-ups are functions of the text alone, so rows with the same
    text share one result, however often a post is stored and whatever its id."""
    return F.concat(F.hex(F.xxhash64(*cols)), F.lit("-"), F.hex(F.xxhash64(F.lit("second"), *cols)))


def one_of_each(keyed: DataFrame, value: Column, name: str) -> DataFrame:
    """``(KEY, name)`` with one row per key: what repeated posts share is worked out once."""
    return keyed.select(KEY, value.alias(name)).groupBy(KEY).agg(F.first(name).alias(name))


MOST_FILTER_BITS = 1 << 23


def _bit_places(value: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(i), value), F.lit(bits)) for i in range(3)]


@dataclass(frozen=True)
class BloomFilter:
    """A test that is true for every value that it was made of and for few others. Its bits are a table of one row in the shared folder.

    Plans read the row as a scalar subquery: it is no part of them, as a literal is, which would be printed and copied with each step.
    """

    bits: int
    table: DataFrame

    def holds(self, words: Column, value: Column) -> Column:
        """Whether ``value`` may be among the values; ``words`` are the bits, as ``sift`` binds them."""
        hit = F.lit(True)
        for at in _bit_places(value, self.bits):
            own = F.get(words, (at / 64).cast("int"))
            hit = hit & (F.call_function("shiftrightunsigned", own, (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return hit


def sift(df: DataFrame, items: Column, name: str, test: Callable[..., Column], *filters: BloomFilter) -> DataFrame:
    """Add ``name``: the items of an array for which ``test(item, *tests)`` holds, where ``tests`` are the tests of ``filters``.

    No subquery may stand in a higher-order function, so each row names the bits in a projection of its own, which Spark merges with
    the next one, as that reads them once.
    """
    named = [f"_filter{i}" for i in range(len(filters))]
    bound = df.select("*", *[f.table.scalar().alias(n) for n, f in zip(named, filters)])
    tests = lambda own: [lambda value, n=n, f=f: f.holds(own[n], value) for n, f in zip(named, filters)]
    found = F.transform(F.array(F.struct(*named)), lambda own: F.filter(items, lambda item: test(item, *tests(own))))
    return bound.select(*df.columns, F.get(found, 0).alias(name))


def bloom_filter(values: DataFrame, col: str, most_bits: int = MOST_FILTER_BITS) -> BloomFilter:
    """A Bloom filter of ``values``.

    About 12 bits a value, up to ``most_bits``; with very many values it lets more through, and loses none. Sort rows out
    with it before they are exploded or shuffled; a join decides.
    """
    bits = 1 << 10
    while bits < min(most_bits, 12 * values.count()):
        bits *= 2
    at = values.select(F.explode(F.array(*_bit_places(F.col(col), bits))).alias("at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))
    set_words = at.groupBy((F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    spark = values.sparkSession
    every = set_words.unionByName(spark.range(bits // 64).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bits")))
    listed = F.sort_array(F.collect_list(F.struct("word", "bits")))  # one row of at most most_bits / 64 words
    row = every.groupBy("word").agg(F.bit_or("bits").alias("bits")).agg(F.transform(listed, lambda w: w["bits"]).alias("words"))
    path = scratch_path(spark, "filter")
    row.write.parquet(path)
    return BloomFilter(bits, spark.read.schema("words ARRAY<BIGINT>").parquet(path))


def one_value(dictionary: DataFrame) -> DataFrame:
    """``(token, value)`` with one row per token: of several values the smallest counts."""
    return dictionary.groupBy("token").agg(F.min("value").alias("value"))


def small_rows(df: DataFrame, max_rows: int = MAX_LITERAL_ROWS) -> list | None:
    """The rows of ``df`` if there are at most ``max_rows``, else None."""
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


def hashed_literal(pairs: dict[str, object], value_type: str = "string") -> Callable[[Column], Column]:
    """A look-up function over a literal hash table: ``array<map>``, about one key per slot."""
    n = 1
    while n < len(pairs):
        n *= 2
    slots: list[dict] = [{} for _ in range(n)]
    for key, value in pairs.items():
        slots[zlib.crc32(key.encode()) % n][key] = value
    table = F.from_json(F.lit(json.dumps(slots)), f"array<map<string,{value_type}>>")
    return lambda key: F.try_element_at(F.get(table, (F.crc32(key) % F.lit(n)).cast("int")), key)


def salted_join(facts: DataFrame, dictionary: DataFrame, key: str, spread_by: str | None = None,
                how: str = "inner", row_bytes: int = 128) -> DataFrame:
    """Join exploded tokens with a dictionary table of any size.

    A dictionary whose counted rows stay below ``MAX_BROADCAST_BYTES`` is broadcast as it is. Otherwise one
    frequent token may hold a large share of all rows: tokens are spread over salts, as many as there are cores,
    at random but by the row's content, and the dictionary is repeated for each salt.
    """
    limit = MAX_BROADCAST_BYTES // row_bytes
    if dictionary.limit(limit + 1).count() <= limit:
        return facts.join(F.broadcast(dictionary), key, how)
    salts = max(8, facts.sparkSession.sparkContext.defaultParallelism)
    salted_facts = facts.withColumn("_salt", F.pmod(F.xxhash64(spread_by or KEY), F.lit(salts)).cast("int"))
    repeated = dictionary.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # Spark takes the repeated dictionary for as small as its file, and would broadcast it.
    return salted_facts.join(never_broadcast(repeated), [key, "_salt"], how).drop("_salt")


def never_broadcast(df: DataFrame) -> DataFrame:
    """Marked to be joined by sorting: Spark sizes a table by its files, however many rows an explode makes of each and however well they
    were compressed, and what it broadcasts stands in the driver's memory."""
    return df.hint("merge")


def map_tokens(df: DataFrame, tokens_col: str, dictionary: DataFrame, out_col: str,
               keep_unknown: bool = True, max_rows: int = MAX_LITERAL_ROWS) -> DataFrame:
    """Replace each token of an array by its ``value`` in ``dictionary(token, value)``.

    Order and length are kept. Unknown tokens stay, or become null with ``keep_unknown=False``. A token listed
    more than once takes its smallest value. Both ways give the same result for repeated rows and ids.
    """
    known = one_value(dictionary)
    rows = small_rows(known, max_rows)
    if rows is not None:
        find = hashed_literal({r["token"]: r["value"] for r in rows})
        return df.withColumn(
            out_col,
            F.transform(tokens_col, lambda t: F.coalesce(find(t), t) if keep_unknown else find(t)),
        )
    keyed = df.withColumn(KEY, value_key(tokens_col))
    exploded = one_of_each(keyed, F.col(tokens_col), "_all").select(KEY, F.posexplode("_all").alias("_pos", "token"))
    joined = salted_join(exploded, known, "token", how="left")
    value = F.coalesce("value", "token") if keep_unknown else F.col("value")
    mapped = joined.groupBy(KEY).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("_pos", value.alias("v")))), lambda s: s["v"]
        ).alias("_mapped")
    )
    empty = F.array().cast("array<string>")
    joined = keyed.join(mapped, KEY, "left").withColumn(out_col, F.coalesce("_mapped", empty))
    return joined.drop(KEY, "_mapped")
