"""Bounded-space online packing of tokenised documents into sequences of one length.

Each partition keeps ``windows`` open windows. A piece goes to the open window it fits best. When none fits,
the fullest is filled with the head of the piece, emitted, and the rest opens a new window. What is left open at
the end of a partition is merged within it, and then, in rounds, across partitions, until at most one sequence
is short. Memory per task: the open windows and one batch of texts.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postwatch.llm.common import small_batches
from postwatch.session import scratch_path

LENGTH, WINDOWS, END_ID, MERGE = 2048, 32, 1, 64
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = ("doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long, "
          "open boolean")

_SPECIAL, _RUN = "<|endoftext|>", 512
_BLANK_RUN = re.compile(rf"\s{{{_RUN}}}")


class Encoder:
    """Texts to little-endian unsigned 32-bit ids of the vocabulary ``<path>.json``.

    The same vocabulary is there as ranks, which tiktoken encodes in a third of the time that the tokenizers library
    takes. Texts with the special token's string, which is one id in the ``.json`` file and unknown to the ranks, and texts with
    a run of ``_RUN`` or more blanks, for which tiktoken's pattern search takes time by the square of the run and, at a million,
    runs out of stack, go to the tokenizers library; tests hold both against each other.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        with open(path.removesuffix(".json") + ".tiktoken") as file:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(str.split, file)}
        self.plain = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(path)

    def encode(self, text: str) -> bytes:
        if _SPECIAL in text or len(text) >= _RUN and _BLANK_RUN.search(text):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.plain.encode_ordinary(text)).tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Packer:
    """Open windows of one task; closed ones collect in ``out`` as rows of SCHEMA."""

    def __init__(self, length: int, windows: int, first_id: int):
        self.length, self.windows, self.next_id = length, windows, first_id
        self.open: list[list] = []  # [free, pieces]
        self.out: list[tuple] = []

    def add(self, doc_id, ids: bytes, start: int = 0, total: int | None = None) -> None:
        """Place the ids ``start, start + 1, ...`` of a document of ``total`` ids."""
        total = len(ids) // 4 if total is None else total
        while len(ids) >= 4 * self.length:
            self._close([0, [(doc_id, start, ids[:4 * self.length], total)]])
            ids, start = ids[4 * self.length:], start + self.length
        if not ids:
            return
        fits = [w for w in self.open if w[0] >= len(ids) // 4]
        if fits:
            self._put(min(fits, key=lambda w: w[0]), (doc_id, start, ids, total))
        elif len(self.open) < self.windows:
            window = [self.length, []]
            self.open.append(window)
            self._put(window, (doc_id, start, ids, total))
        else:
            fullest = min(self.open, key=lambda w: w[0])
            free = fullest[0]
            self._put(fullest, (doc_id, start, ids[:4 * free], total))
            self.add(doc_id, ids[4 * free:], start + free, total)

    def finish(self) -> None:
        """Fill the fullest windows from the emptiest; one short window at most stays, marked open."""
        while len(self.open) > 1:
            self.open.sort(key=lambda w: w[0])
            full, last = self.open[0], self.open[-1]
            doc_id, start, ids, total = last[1].pop()
            free = full[0]
            last[0] += len(ids) // 4
            if len(ids) > 4 * free:
                last[1].append((doc_id, start + free, ids[4 * free:], total))
                last[0] -= len(ids) // 4 - free
                ids = ids[:4 * free]
            if not last[1]:
                self.open.pop()
            self._put(full, (doc_id, start, ids, total))
        for window in self.open:
            self._close(window, True)
        self.open = []

    def batch(self) -> pa.RecordBatch:
        columns, self.out = list(zip(*self.out)) or [[]] * len(_ARROW), []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

    def _put(self, window: list, piece: tuple) -> None:
        window[1].append(piece)
        window[0] -= len(piece[2]) // 4
        if not window[0]:
            self.open = [w for w in self.open if w is not window]
            self._close(window)

    def _close(self, window: list, is_open: bool = False) -> None:
        offset = 0
        for doc_id, start, ids, total in window[1]:
            self.out.append((doc_id, start, len(ids) // 4, total, ids, self.next_id, offset, is_open))
            offset += len(ids) // 4
        self.next_id += 1


_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
                    ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_())])


def _first_id(merge_round: int) -> int:
    return merge_round << 57 | TaskContext.get().partitionId() << 31


def pack(docs: DataFrame, length: int = LENGTH, windows: int = WINDOWS, vocabulary: str = VOCABULARY,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, ids, sequence_id, offset) of all documents, ids as little-endian
    unsigned 32-bit bytes.

    A document is its text's ids followed by ``END_ID``; null and empty texts are that id alone. Every id lies
    in one piece. A text of any length is cut at sequence ends. Repeated rows are packed as often as
    they occur; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(length, windows, _first_id(0))
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                packer.add(doc_id, encoder(vocabulary).encode(text) + end)
            yield packer.batch()
        packer.finish()
        yield packer.batch()

    def merge(merge_round: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packer = Packer(length, windows, _first_id(merge_round))
            for batch in batches:
                for row in batch.to_pylist():
                    packer.add(row["doc_id"], row["ids"], row["start"], row["doc_tokens"])
                yield packer.batch()
            packer.finish()
            yield packer.batch()

        return run

    packed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    done, merge_round = [], 0
    packed = _by_open(packed.mapInArrow(run, SCHEMA))
    while True:
        done.append(packed.where("NOT open"))
        left = packed.where("open")
        short = left.select("sequence_id").distinct().count()
        if short <= 1:
            break
        merge_round += 1
        packed = _by_open(left.coalesce(-(-short // MERGE)).mapInArrow(merge(merge_round), SCHEMA))
    out = left
    for part in done:
        out = out.unionByName(part)
    return out.drop("open")


def _by_open(df: DataFrame) -> DataFrame:
    """Written to the shared folder with the short windows apart, so that a merge reads these alone."""
    path = scratch_path(df.sparkSession, "packed")
    df.write.partitionBy("open").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
