"""Best-fit packing by length patterns: non-negative least squares on the histogram of lengths.

A pattern is a few lengths that fill a sequence exactly. How often each pattern is used is fitted to the histogram of all
lengths by non-negative least squares, rounded, and kept as far as there are documents for it. What is left over is
packed best fit, longest first, on the histogram as well. The plan is
a table of slots (length, first rank, repeats, sequence, offset) whose size depends on the sequence length alone; a piece
finds its place by its length and its rank among the pieces of that length. No task and not the driver sees more of the documents than
the histogram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postwatch.llm.common import small_batches, store
from postwatch.llm.packing import VOCABULARY, encoder

LENGTH, END_ID, STEPS = 1024, 2, 400
#: Starts of ranks (one row for each task and length) up to this many are broadcast; beyond it, Spark joins.
SMALL_STARTS = 200_000


def enumerate_patterns(lengths: np.ndarray, length: int) -> np.ndarray:
    """Rows of one to three of the ``lengths``, ascending and filled up with 0 in front, that add up to ``length``."""
    have = np.zeros(length + 1, bool)
    have[lengths] = True
    a, b = (x.ravel() for x in np.meshgrid(np.append(0, lengths), np.append(0, lengths), indexing="ij"))
    c = length - a - b
    good = (a <= b) & (b <= c) & (c > 0)
    a, b, c = a[good], b[good], c[good]
    good = have[c]
    return np.stack([a[good], b[good], c[good]], axis=1)


def fit_repeats(patterns: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeats >= 0 of each pattern that minimise the squares of (histogram - documents used), by accelerated projected gradients.

    The squares of a length weigh as much as it is long, since short documents fit anywhere. The curvature is found by power
    iteration; momentum starts again whenever a step turns back.
    """
    size = len(histogram)
    weigh, flat = np.arange(size) / size, patterns.ravel()
    use = lambda x: np.bincount(flat, np.repeat(x, patterns.shape[1]), size)
    slope = lambda rest: (weigh * rest)[patterns].sum(1)
    along = np.ones(len(patterns))
    for _ in range(15):
        along = slope(use(along))
        curvature = np.sqrt((along**2).sum())
        along /= curvature
    repeats = ahead = np.zeros(len(patterns))
    pace = 1.0
    for _ in range(steps):
        moved = np.maximum(ahead - slope(use(ahead) - histogram) / curvature, 0)
        if ((ahead - moved) * (moved - repeats)).sum() > 0:
            pace = 1.0
        quicker = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        ahead = moved + (pace - 1) / quicker * (moved - repeats)
        repeats, pace = moved, quicker
    return repeats


def whole_repeats(patterns: np.ndarray, repeats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, whole repeats): rounded so that the running sums, in the order of the longest, then the middle length, stay within one
    half. Thousands of small fractions would otherwise all round to nothing."""
    order = np.lexsort((patterns[:, 1], patterns[:, 2]))
    whole = np.diff(np.floor(np.cumsum(repeats[order]) + 0.5), prepend=0.0).astype(np.int64)
    return patterns[order][whole > 0], whole[whole > 0]


def pack_histogram(histogram: np.ndarray, length: int) -> list[tuple[int, tuple[int, ...]]]:
    """(repeats, lengths) of best-fit packing by descending length, equal windows filled together."""
    by_free: dict[int, list[list]] = {}  # free places: [repeats, lengths]
    frees: list[int] = []  # the keys of by_free that have windows, ascending

    def put(free: int, repeats: int, lengths: tuple) -> None:
        if free not in by_free:
            by_free[free] = []
            frees.insert(int(np.searchsorted(frees, free)), free)
        by_free[free].append([repeats, lengths])

    for own in range(length, 0, -1):
        left = int(histogram[own])
        while left:
            at = int(np.searchsorted(frees, own))
            if at == len(frees):  # no window fits: open as many as are needed, filled with this length
                each = min(length // own, left)
                put(length - each * own, left // each, (own,) * each)
                left %= each
                continue
            free = frees[at]
            repeats, lengths = by_free[free].pop()
            if not by_free[free]:
                del by_free[free]
                frees.pop(at)
            each = min(free // own, left)
            used = min(repeats, left // each)
            left -= used * each
            put(free - each * own, used, lengths + (own,) * each)
            if used < repeats:
                put(free, repeats - used, lengths)
    return [(n, lengths) for rows in by_free.values() for n, lengths in rows]


def plan(histogram: np.ndarray) -> list[tuple[int, tuple[int, ...]]]:
    """(repeats, lengths) that use every document of ``histogram`` (number of documents by length) once."""
    length, left, out = len(histogram) - 1, histogram.astype(np.int64).copy(), []
    if left[length]:
        out.append((int(left[length]), (length,)))
        left[length] = 0
    lengths = np.flatnonzero(left)
    patterns = enumerate_patterns(lengths, length) if len(lengths) else []
    if len(patterns):
        have = left.tolist()
        for own, n in zip(*map(np.ndarray.tolist, whole_repeats(patterns, fit_repeats(patterns, left)))):
            own = tuple(x for x in reversed(own) if x)
            n = min(n, *(have[x] // own.count(x) for x in own))
            if n > 0:
                for x in own:
                    have[x] -= n
                out.append((n, own))
        left = np.array(have)
    return out + pack_histogram(left, length)


def slots(planned: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """Columns of the slots, by length and first rank: ranks ``first, first + 1, ...`` of a length lie in the sequences ``sequence,
    sequence + 1, ...`` at ``offset``."""
    rows, used, sequence = [], {}, 0
    for repeats, lengths in planned:
        offset = 0
        for own in lengths:
            rows.append((own, used.get(own, 0), sequence, offset))
            used[own] = used.get(own, 0) + repeats
            offset += own
        sequence += repeats
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("length", "first", "sequence", "offset"), table.T))


def cut(ids: bytes, length: int) -> Iterator[tuple[int, int, bytes]]:
    """(piece, start, ids): a document that is too long is cut into whole sequences; its first piece takes the rest."""
    n = len(ids) // 4
    first = n if n <= length else n % length or length
    yield 0, 0, ids[:4 * first]
    for i, start in enumerate(range(first, n, length)):
        yield i + 1, start, ids[4 * start:4 * (start + length)]


def pieces(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, vocabulary: str = VOCABULARY, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids, task, rank): rank counts a task's pieces of one length from 0."""
    small_batches(docs.sparkSession, 500)
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                        ("task", pa.int32()), ("rank", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, task, encode = [0] * (length + 1), TaskContext.get().partitionId(), encoder(vocabulary).encode
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for piece, start, ids in cut(encode(text) + end, length):
                    n = len(ids) // 4
                    out.append((doc_id, piece, start, n, ids, task, seen[n]))
                    seen[n] += 1
            columns = list(zip(*out)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids binary, task int, rank long")


def pack_by_patterns(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, vocabulary: str = VOCABULARY, id_col: str = "doc_id",
                     text_col: str = "text", small_starts: int = SMALL_STARTS) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset) of all documents; ids as little-endian unsigned 32-bit bytes.

    A document is its text's ids followed by ``end_id``; null and empty texts are that id alone. Only documents longer than
    ``length`` are cut, and only their first piece may be short. Rows without doc_id and repeated rows are documents of their own;
    an empty table gives an empty result; other columns are ignored.
    """
    made = store(pieces(docs, length, end_id, vocabulary, id_col, text_col), "pieces")
    counts = store(made.groupBy("task", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = np.zeros(length + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``length`` rows
        histogram[r["length"]] = r["n"]
    table = slots(plan(histogram))
    keys = table["length"] << 44 | table["first"]
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    starts = F.broadcast(starts) if counts.count() <= small_starts else starts

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *kept, rank = batch.columns
            own, at = kept[3].to_numpy(), rank.to_numpy()
            slot = np.searchsorted(keys, own << 44 | at, side="right") - 1
            sequence = table["sequence"][slot] + at - table["first"][slot]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(table["offset"][slot])],
                                             ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"])

    ranked = made.join(starts, ["task", "length"]).select(
        "doc_id", "piece", "start", "length", "ids", (F.col("rank") + F.col("first")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long")
