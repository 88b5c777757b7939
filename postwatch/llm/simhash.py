"""SimHash near-duplicates: fingerprints that differ in few bits, found by pigeonhole blocks.

64 bits are cut into ``blocks`` blocks. Two fingerprints with at most ``bits`` differing bits agree in at
least ``blocks - bits`` whole blocks, so they share a key made of those blocks: every link is found. With
seven blocks a key has 27 bits or more; raise ``blocks`` when there are far more than 10^8 different
fingerprints.

Every work unit is bounded: equal fingerprints are one node, and a key with many nodes is cut into chunks
of about ``chunk`` nodes, each pair of which is compared by itself. A task returns a spanning forest
of the links it finds, so that a group of n near copies gives about n rows and not n squared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postwatch.functions.lookup import never_broadcast
from postwatch.llm.common import small_batches, store, utf8
from postwatch.llm.components import components

WIDTH, BITS, BLOCKS, CHUNK, SLICE_ROWS = 4, 4, 7, 1024, 100_000


def simhash(raw: bytes, width: int = WIDTH) -> int:
    """The unsigned fingerprint of a UTF-8 text: A-Z lower-cased, shingles of ``width`` words, XXH64 seed 42."""
    words = raw.lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(width, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], 42) for a, b in zip(starts, ends)])
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8 << 14):
        ones += np.unpackbits(np.frombuffer(hashes[at:at + (8 << 14)], np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long. Null, empty and blank texts have fingerprint zero."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((simhash(x, width) for x in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(F.col(text_col)).alias("raw")).mapInArrow(
        run, "doc_id long, fp long")


def block_keys(fp: Column, bits: int = BITS, blocks: int = BLOCKS) -> Column:
    """All keys of ``blocks - bits`` whole blocks of a fingerprint."""
    if not 0 <= bits < blocks <= 64:
        raise ValueError("blocks must be greater than bits, and 64 at most")
    cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    signed = [m - (1 << 64) if m >> 63 else m for m in (sum(c) for c in combinations(masks, blocks - bits))]
    return F.array(*[F.struct(F.lit(i).alias("k"), fp.bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(signed)])


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of the links a-b, without the smallest ones themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, low = at[:len(a)], at[len(a):], np.arange(len(nodes))
    while True:
        m = np.minimum(low[u], low[v])
        new = low.copy()
        np.minimum.at(new, low[u], m)
        np.minimum.at(new, low[v], m)
        while (new != new[new]).any():
            new = new[new]
        if (new == low).all():
            break
        low = new
    apart = low != np.arange(len(nodes))
    return nodes[apart], nodes[low[apart]]


def _links_of_slice(bits: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["k", "v", "lo", "hi"], kind="stable")
        fp, node = rows["fp"].to_numpy().view(np.uint64), rows["node"].to_numpy()
        own = rows[["k", "v", "lo", "hi"]].to_numpy()
        first = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]).any(1))))
        left = np.repeat(np.append(first[1:], len(own)), np.diff(np.append(first, len(own)))) - np.arange(len(own)) - 1
        a, b, at, step = [], [], np.arange(len(own)), 1
        while len(at := at[left[at] >= step]):  # rows that have a step-th successor in their unit
            near = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= bits]
            a.append(node[near])
            b.append(node[near + step])
            if sum(map(len, a)) > 1 << 20:  # keep what is held bounded
                a, b = ([x] for x in spanning_forest(np.concatenate(a), np.concatenate(b)))
            step += 1
        none = np.empty(0, np.int64)
        a, b = spanning_forest(np.concatenate([none, *a]), np.concatenate([none, *b]))
        return pd.DataFrame({"a": a, "b": b})

    return run


def links(nodes: DataFrame, bits: int = BITS, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) that connect what is connected among ``nodes`` (node long, fp long; fp distinct)."""
    spread = nodes.select("node", "fp", F.explode(block_keys(F.col("fp"), bits, blocks)).alias("x")).select("node", "fp", "x.*")
    shared = spread.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / F.lit(chunk)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    units = F.transform(F.sequence(F.lit(0), F.col("parts") - 1),
                        lambda d: F.struct(F.least(d, F.col("own")).alias("lo"), F.greatest(d, F.col("own")).alias("hi")))
    members = store(
        spread.join(never_broadcast(shared), ["k", "v"]).withColumn("parts", parts).withColumn("own", own)
        .select("k", "v", "node", "fp", F.explode(units).alias("u")).select("k", "v", "node", "fp", "u.*"), "blocks",
    )
    slices = members.count() // SLICE_ROWS + 1
    slices = max(slices, members.sparkSession.sparkContext.defaultParallelism)
    return members.groupBy(F.pmod(F.xxhash64("k", "v", "lo", "hi"), F.lit(slices)).alias("slice")).applyInPandas(
        _links_of_slice(bits), "a long, b long")


def near_duplicates(docs: DataFrame, bits: int = BITS, blocks: int = BLOCKS, chunk: int = CHUNK, width: int = WIDTH,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``; component_id is the smallest doc_id reachable.

    Links join fingerprints with at most ``bits`` differing bits. Null, empty and blank texts share
    fingerprint zero and are linked like others. Rows without doc_id link nothing by themselves: they get the
    component of their fingerprint, null if no row with a doc_id has it. Repeated rows each get their row.
    An empty table gives an empty result.
    """
    base = store(fingerprints(docs, id_col, text_col, width), "fingerprints")
    nodes = store(base.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    roots = components(links(nodes, bits, blocks, chunk))
    classes = nodes.join(never_broadcast(roots), "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return base.join(never_broadcast(classes), "fp", "left").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The documents of the smallest doc_id of each component, one row each; columns unchanged."""
    return first_documents(docs, near_duplicates(docs, **options))


def first_documents(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the component_id in ``found`` (doc_id, component_id), one for each doc_id.

    Where that doc_id is repeated, the row with the smallest text hash stays. Rows without doc_id stay.
    """
    found = store(found, "components")
    kept = found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("_n"))
    single = docs.join(never_broadcast(kept.where("_n = 1").select("doc_id")), "doc_id", "left_semi")
    nameless = docs.where("doc_id IS NULL")
    repeated = docs.join(never_broadcast(kept.where("_n > 1").select("doc_id")), "doc_id", "left_semi")
    one = repeated.select("*", F.struct(F.xxhash64("text"), F.col("text")).alias("_t"))
    one = one.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.col("_t")).alias("_r")).select("_r.*")
    return single.unionByName(nameless).unionByName(one).select(*docs.columns)
