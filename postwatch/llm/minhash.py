"""Document fingerprints: MinHash signatures over word shingles, with bands joined in Spark and Jaccard verified.

A signature holds the minima of many universal hash functions over the shingles of a text. The share of
equal places estimates the Jaccard similarity. ``near_duplicates`` joins texts that share a band and verifies
the similarity on the shingles themselves; ``compare_with_next`` compares each document with an edited version and with the
next document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postwatch.llm.common import small_batches, store, unit_interval, utf8
from postwatch.llm.components import components
from postwatch.llm.simhash import first_documents, spanning_forest

WIDTH, PERMUTATIONS, SEED = 5, 128, 20240501
BAND_ROWS, LIKENESS, CHUNK, SLICE_ROWS = 5, 0.8, 256, 20_000
PARTITION_BYTES, MOST_PARTITIONS, SAMPLE = 8 << 20, 20_000, 32
_MIX = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(0xFFFFFFFF)


def shingles(raw: bytes, width: int = WIDTH) -> np.ndarray:
    """64-bit hashes of the shingles of ``width`` words, A-Z lower-cased; a shorter text is one shingle, one without words none."""
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_digest
    h = np.frombuffer(b"".join([digest(w, 42) for w in words]), ">u8").astype(np.uint64)
    n = max(1, len(h) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(width, len(h))):
        out = (out ^ h[k:k + n]) * _MIX
        out ^= out >> np.uint64(29)
    return out


class MinHash:
    """Signatures of ``permutations`` unsigned 32-bit places; the place of no shingle is 2^32 - 1."""

    def __init__(self, permutations: int = PERMUTATIONS, width: int = WIDTH, seed: int = SEED):
        random = np.random.default_rng(seed)
        self.width = width
        self.a = (random.integers(0, 1 << 63, permutations, np.uint64) << np.uint64(1)) | np.uint64(1)
        self.b = random.integers(0, 1 << 63, permutations, np.uint64)

    def of(self, found: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), _EMPTY, np.uint64)
        for at in range(0, len(found), 2048):
            hashed = np.multiply.outer(self.a, found[at:at + 2048])
            hashed += self.b[:, None]
            low = np.minimum(low, hashed.min(1) >> np.uint64(32))
        return low.astype(np.uint32)

    def signature(self, raw: bytes) -> np.ndarray:
        return self.of(shingles(raw, self.width))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal places; texts without words are alike to each other only."""
    return float((a == b).mean())


def hexadecimal(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def compare_with_next(docs: DataFrame, permutations: int = PERMUTATIONS, width: int = WIDTH, seed: int = SEED,
                      id_col: str = "doc_id", text_col: str = "text", partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row.

    The next document is that with the next smaller doc_id, after the last the first. The edited text has its last
    ``floor(n_chars / 2)`` code points replaced by as many first ones of the next document. Ranges of
    doc_id are cut at doc_ids that occur, so that the first rows of a range, which the range before it needs as
    well, are known in advance: texts are shuffled once and each task streams over its sorted rows.

    Null texts count as empty, null doc_ids as the smallest. Repeated doc_ids follow each other by text hash. A single row
    is its own next. An empty table gives an empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession, 500)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)).cast("long"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("key"), utf8(F.col(text_col)).alias("raw"))
    cuts = _cuts(rows, partition_bytes)
    place = _count_at_least(F.col("key"), cuts) - 1
    spread = rows.withColumn("place", place).withColumn("first", F.get(F.lit(cuts or [0]), F.col("place")) == F.col("key"))
    before = F.pmod(F.col("place") - 1, F.lit(max(1, len(cuts))))
    targets = F.when(F.col("first"), F.array(F.struct(F.col("place").alias("part"), F.lit(False).alias("halo")),
                                             F.struct(before.alias("part"), F.lit(True).alias("halo")))).otherwise(
        F.array(F.struct(F.col("place").alias("part"), F.lit(False).alias("halo"))))
    spread = spread.select("doc_id", "key", "raw", F.explode(targets).alias("t")).select("t.part", "t.halo", "doc_id", "key", "raw")
    ordered = spread.repartition(max(1, len(cuts)), "part").withColumn("h", F.xxhash64("raw")).sortWithinPartitions(
        "part", "halo", F.col("key").desc(), "h", "raw")
    hasher = MinHash(permutations, width, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # part, doc_id, text, signature
        for batch in batches:
            out = []
            for part, halo, doc_id, raw in zip(*[batch.column(c).to_pylist() for c in ("part", "halo", "doc_id", "raw")]):
                own = None
                if held and held[0] == part:
                    own = hasher.signature(raw)
                    out.append(_compared(hasher, held, raw, own))
                    held = None
                if not halo:
                    held = (part, doc_id, raw, hasher.signature(raw) if own is None else own)
            columns = list(zip(*out)) or [[]] * len(_SCHEMA)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)

    return ordered.select("part", "halo", "doc_id", "raw").mapInArrow(run, (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"))


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                     ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compared(hasher: MinHash, held: tuple, next_raw: bytes, next_signature: np.ndarray) -> tuple:
    _, doc_id, raw, own = held
    text = raw.decode()
    half = len(text) // 2
    edited = (text[:len(text) - half] + next_raw[:4 * half].decode(errors="ignore")[:half]).encode()
    other = hasher.signature(edited)
    return (doc_id, len(text), hashlib.sha256(edited).hexdigest(), hexadecimal(own), hexadecimal(other),
            likeness(own, other), likeness(own, next_signature))


def _cuts(rows: DataFrame, partition_bytes: int) -> list[int]:
    """Keys that occur, descending, from the largest on, about one for each ``partition_bytes`` of text."""
    n, size, top = rows.agg(F.count("*"), F.sum(F.octet_length("raw")), F.max("key")).first()
    if not n:
        return []
    wanted = max(rows.sparkSession.sparkContext.defaultParallelism, int(size or 0) // partition_bytes + 1)
    wanted = min(wanted, n, MOST_PARTITIONS)
    drawn = rows.where(unit_interval("key", F.lit(SEED)) < SAMPLE * wanted / n).select("key").distinct()
    keys = sorted((r[0] for r in drawn.collect()), reverse=True)
    return sorted({top, *keys[::max(1, len(keys) // wanted)]}, reverse=True)


def _count_at_least(key: Column, cuts: list[int]) -> Column:
    """How many of the descending ``cuts`` are at least ``key``, by bisection."""
    steps = [1 << i for i in reversed(range(max(1, len(cuts).bit_length())))]
    values = F.lit(cuts or [0])
    return F.aggregate(F.lit(steps), F.lit(0), lambda n, s: F.when(F.get(values, n + s - 1) >= key, n + s).otherwise(n))


# ---------------------------------------------------------------- near duplicates

def near_duplicates(docs: DataFrame, threshold: float = LIKENESS, permutations: int = PERMUTATIONS, width: int = WIDTH, seed: int = SEED,
                    band_rows: int = BAND_ROWS, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id): the smallest doc_id that links of Jaccard similarity ``threshold`` or more reach.

    Texts with equal shingles are one node. Of the nodes that share a band, each is verified against the smallest first, so that a
    tight group costs one comparison a node. Where that leaves a band in more than one component, its nodes are compared
    in chunks of bounded size, and a task returns a spanning forest of the verified links. Shingles are kept of no
    text: those of candidates are hashed again. Texts without words are one group. Rows without doc_id get the
    component of their text, null if no other row has it.
    """
    small_batches(docs.sparkSession, 500)
    hasher, bands = MinHash(permutations, width, seed), permutations // band_rows

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, whole = [], []
            for raw in batch.column(1).to_pylist():
                found = np.unique(shingles(raw, width))
                places = hasher.of(found)[:bands * band_rows].reshape(bands, band_rows)
                keys.append(np.array([xxhash.xxh64_intdigest(p.tobytes()) >> 1 for p in places], np.int64))
                whole.append(hashlib.md5(found.tobytes()).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(whole, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "same", "bands"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingles(raw, width)).view(np.int64) for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "set"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(F.col(text_col)).alias("raw"))
    base = store(rows.mapInArrow(sketch, "doc_id long, same binary, bands array<long>"), "minhash")
    nodes = store(base.where("doc_id IS NOT NULL").groupBy("same").agg(
        F.min("doc_id").alias("node"), F.first("bands").alias("bands")), "minhash-nodes")
    keys = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = keys.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).where("n > 1")
    members = store(keys.join(shared, ["band", "key"]), "minhash-bands")
    # A doc_id that is repeated with other texts is one node with several sets.
    sets = store(rows.join(members.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(
        hashed, "node long, set array<long>").distinct(), "minhash-sets")
    near = store(_near_pivots(members, sets, threshold, chunk), "minhash-near")
    roots = store(components(near), "minhash-roots")
    parts, own = F.ceil(F.col("n") / F.lit(chunk)).cast("int"), F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    units = F.transform(F.sequence(F.lit(0), F.col("parts") - 1),
                        lambda d: F.struct(F.least(d, F.col("own")).alias("lo"), F.greatest(d, F.col("own")).alias("hi")))
    # A pair has been compared already, and a band in one component has nothing more to find.
    rooted = members.where("n > 2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = rooted.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band", "key")
    spread = store(rooted.join(split, ["band", "key"]).withColumn("parts", parts).withColumn("own", own).select(
        "band", "key", "node", "root", F.explode(units).alias("u")).select("band", "key", "node", "root", "u.*"), "minhash-units")
    unit = ["band", "key", "lo", "hi"]
    open_units = spread.groupBy(*unit).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select(*unit)
    left = store(spread.join(open_units, unit), "minhash-open")
    slices = max(left.count() // SLICE_ROWS + 1, left.sparkSession.sparkContext.defaultParallelism)
    links = left.join(sets, "node").groupBy(
        F.pmod(F.xxhash64(*unit), F.lit(slices)).alias("slice")).applyInPandas(_verified(threshold), "a long, b long")
    roots = components(near.unionByName(links))
    classes = nodes.join(roots, "node", "left").select("same", F.coalesce("root", "node").alias("component_id"))
    return base.select("doc_id", "same").join(classes, "same", "left").select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The documents of the smallest doc_id of each component, one row each; columns unchanged. Rows without doc_id stay."""
    return first_documents(docs, near_duplicates(docs, **options))


def _near_pivots(members: DataFrame, sets: DataFrame, threshold: float, chunk: int) -> DataFrame:
    """Verified links (a, b) of the nodes with the smallest node of a band; a pivot of very many nodes is dealt over parts."""
    pairs = members.where("node <> pivot").select("node", "pivot").distinct()
    counts = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / F.lit(chunk)).cast("int").alias("parts"))
    dealt = pairs.join(counts, "pivot").select("node", "pivot", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    pivots = counts.join(sets.select(F.col("node").alias("pivot"), F.col("set").alias("other")), "pivot").select(
        "pivot", "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    both = F.size(F.array_intersect("set", "other"))
    found = dealt.join(sets, "node").join(pivots, ["pivot", "part"]).withColumn("both", both)
    return found.where(F.col("both") >= F.lit(threshold) * (F.size("set") + F.size("other") - F.col("both"))).select(
        F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()


def _verified(threshold: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for _, unit in rows.groupby(["band", "key", "lo", "hi"]):
            nodes, sets = unit["node"].to_numpy(), list(unit["set"])
            low = np.unique(unit["root"].to_numpy(), return_inverse=True)[1]  # links inside what is connected already need no look
            sizes = np.array([len(x) for x in sets])
            for i in range(len(nodes)):
                for j in (np.flatnonzero(low[i + 1:] != low[i]) + i + 1).tolist():
                    if low[i] != low[j] and min(sizes[i], sizes[j]) >= threshold * max(sizes[i], sizes[j]):
                        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                        if both >= threshold * (sizes[i] + sizes[j] - both):
                            a.append(nodes[i])
                            b.append(nodes[j])
                            low[low == low[j]] = low[i]
        a, b = spanning_forest(np.array(a, np.int64), np.array(b, np.int64))
        return pd.DataFrame({"a": a, "b": b})

    return run
