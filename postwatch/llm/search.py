"""Ranked lexical search: hashed max-sketches bound the scores, documents are rescored by descending bound.

A document's impacts (what one occurrence list of a term is worth in it, before the term's weight) are folded into a sketch: each
term is hashed to a coordinate, which keeps the largest impact of its terms. A query's weighted look-up of its own
coordinates is never below its true score. The queries of a batch look up the sketches of a block of documents at once;
per query, the block's documents are then rescored exactly by descending bound, until the bound falls below the score of the last of the
best that the task has seen. Tasks hand on their best documents of each query, and these are ranked.

Two passes read the texts: one counts documents, lengths and the document frequencies of the queries' terms, one searches.
Queries are taken in blocks of bounded size, and only these, with their weights, travel to the tasks.
"""

from __future__ import annotations

from bisect import insort
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from math import floor, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postwatch.llm.common import small_batches, store, utf8

TOP, COORDINATES, BLOCK_DOCS, BLOCK_BYTES, QUERY_BYTES = 10, 4096, 1000, 4 << 20, 4 << 20
#: Bytes of terms stay, A-Z as a-z; all other ASCII parts terms. UTF-8 bytes from 0x80 on belong to terms.
_FOLD = bytes(b if b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


def term_counts(raw: bytes) -> Counter:
    """Terms ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` of a UTF-8 text, A-Z lower-cased, with their occurrences."""
    return Counter(raw.translate(_FOLD).split())


def weight(n_docs: int, df: int) -> int:
    return floor(1000 * log((2 * n_docs + 2) / (2 * df + 1)))


def length_norm(n_terms, n_docs: int, n_all: int):
    """The part ``m`` of a document's impacts that grows with its length; for numbers or int64 arrays."""
    return 100 - 75 + (75 * n_terms * n_docs) // max(n_all, 1)


def impact(tf, m):
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def statistics(docs: DataFrame, terms: frozenset[bytes]) -> tuple[int, int, dict[bytes, int]]:
    """(documents with a term, terms of all documents, document frequencies of ``terms``) of a table (raw binary).

    Tasks count by themselves; what comes back is at most one row for each of ``terms``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n_docs, n_all = Counter(), 0, 0
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                counts = term_counts(raw)
                if counts:
                    n_docs, n_all = n_docs + 1, n_all + counts.total()
                    found.update(counts.keys() & terms)
        rows = [(None, n_docs, n_all), *((t, n, 0) for t, n in found.items())]
        yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64()))], ["term", "docs", "terms"])

    rows = docs.select("raw").mapInArrow(run, "term binary, docs long, terms long").groupBy("term").agg(
        F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).collect()
    by_term = {None if r["term"] is None else bytes(r["term"]): (r["docs"], r["terms"]) for r in rows}
    n_docs, n_all = by_term.pop(None, (0, 0))
    return n_docs, n_all, {t: n for t, (n, _) in by_term.items()}


class Query:
    """A query's weighted terms, its coordinates, and the best documents seen so far as (-score, no id, doc_id)."""

    def __init__(self, terms: dict[bytes, int], coordinates: int, top: int):
        self.terms, self.top = list(terms.items()), top
        at: Counter = Counter()
        for term, w in self.terms:
            at[crc32(term) % coordinates] += w
        self.at, self.weights = np.fromiter(at.keys(), np.int64, len(at)), np.fromiter(at.values(), np.float64, len(at))
        self.best: list[tuple] = []

    def search(self, sketch: np.ndarray, counts: list[Counter], norms: list[int], ids: list) -> int:
        """Rescores the block's documents by descending bound; returns how many it has rescored.

        Sums of weights and impacts stay far below 2^53, so bounds are exact in doubles. A document at the bound of the last of the
        best is looked at too: it may have the same score and the smaller id.
        """
        bounds = self.weights @ sketch[self.at]
        near = np.flatnonzero(bounds >= max(self.least(), 1))
        rescored = 0
        for j in near[np.argsort(-bounds[near], kind="stable")].tolist():
            if bounds[j] < self.least():
                break
            rescored += 1
            own, m = counts[j], norms[j]
            score = sum(w * impact(own[t], m) for t, w in self.terms if t in own)
            if score > 0:
                insort(self.best, (-score, ids[j] is None, ids[j] or 0))
                del self.best[self.top:]
        return rescored

    def least(self) -> int:
        return -self.best[-1][0] if len(self.best) == self.top else 0


def sketches(counts: list[Counter], norms: np.ndarray, coordinates: int) -> np.ndarray:
    """Coordinates x documents: the largest impact of the terms that are hashed to a coordinate."""
    sizes = [len(c) for c in counts]
    at = np.fromiter((crc32(t) for t in chain.from_iterable(counts)), np.int64, sum(sizes)) % coordinates
    tf = np.fromiter(chain.from_iterable(c.values() for c in counts), np.int64, sum(sizes))
    doc = np.repeat(np.arange(len(counts)), sizes)
    sketch = np.zeros((coordinates, len(counts)))
    np.maximum.at(sketch, (at, doc), impact(tf, norms[doc]))
    return sketch


def _blocks(ids: list, raws: list[bytes]) -> Iterator[tuple[list, list[bytes]]]:
    start = size = 0
    for i, raw in enumerate(raws):
        if i > start and (i - start >= BLOCK_DOCS or size + len(raw) > BLOCK_BYTES):
            yield ids[start:i], raws[start:i]
            start, size = i, 0
        size += len(raw)
    if start < len(raws):
        yield ids[start:], raws[start:]


def best_of_tasks(docs: DataFrame, queries: list[dict[bytes, int]], n_docs: int, n_all: int, top: int, coordinates: int) -> DataFrame:
    """(query, doc_id, score): each task's ``top`` documents of each query, by its number in ``queries``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Query(q, coordinates, top) for q in queries]
        for batch in batches:
            for ids, raws in _blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = [term_counts(raw) for raw in raws]
                norms = length_norm(np.array([c.total() for c in counts], np.int64), n_docs, n_all)
                sketch, m = sketches(counts, norms, coordinates), norms.tolist()
                for q in own:
                    q.search(sketch, counts, m, ids)
        rows = [(i, None if none else doc_id, -s) for i, q in enumerate(own) for s, none, doc_id in q.best]
        columns = zip(*rows) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, (pa.int32(), pa.int64(), pa.int64()))], ["query", "doc_id", "score"])

    return docs.mapInArrow(run, "query int, doc_id long, score long")


def search(docs: DataFrame, queries: DataFrame, top: int = TOP, coordinates: int = COORDINATES, query_bytes: int = QUERY_BYTES,
           id_col: str = "doc_id", text_col: str = "text", query_col: str = "item_id") -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of ``queries`` (item_id, text), the ``top`` best rows of ``docs`` (doc_id, text).

    Only scores above 0 count; equal ones are ranked by ascending doc_id, nulls last. Null and empty texts have no
    term: as documents they are never found and do not count, as queries they find nothing. Repeated rows are documents, or
    queries, of their own. Empty tables give an empty result; other columns are ignored. Texts of any length are read whole.
    Every task holds one block of documents and ``top`` documents for each query of a block of queries.
    """
    spark = docs.sparkSession
    small_batches(spark, BLOCK_DOCS)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(F.col(text_col)).alias("raw"))
    asked = queries.select(F.col(query_col).alias("item_id"), utf8(F.col("text")).alias("raw"), F.monotonically_increasing_id().alias("row"))
    asked = store(asked, "queries")  # so that a row's number stays, whatever is read again
    size = asked.agg(F.sum(F.octet_length("raw") + 64)).first()[0] or 0
    blocks = int(size) // query_bytes + 1
    ranked = spark.createDataFrame([], f"item_id {asked.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    for block in range(blocks):
        part = [(r["item_id"], term_counts(bytes(r["raw"]))) for r in asked.where(
            F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).collect()]  # query_bytes on average
        if not part:
            continue
        n_docs, n_all, df = statistics(rows, frozenset(chain.from_iterable(c for _, c in part)))
        weights = {t: weight(n_docs, n) for t, n in df.items()}
        wanted = [{t: k * weights[t] for t, k in c.items() if weights.get(t)} for _, c in part]
        names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(part)],
                                      f"query int, item_id {asked.schema['item_id'].dataType.simpleString()}")
        best = store(best_of_tasks(rows, wanted, n_docs, n_all, top, coordinates), "search")
        order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        found = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        ranked = ranked.union(found.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    return ranked
