import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from postwatch.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.VOCABULARY)


def held(pieces, texts, tokenizer, length):
    """Every id in one piece, sequences gapless and no longer than ``length``; returns the sizes of the sequences."""
    want = sorted((doc_id or -1, zlib.crc32(np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4").tobytes())) for doc_id, text in texts)
    parts, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length > 0
        parts[p.doc_id or -1, p.doc_tokens].append(p)
        sequences[p.sequence_id].append(p)
    got = []
    for (doc_id, total), own in parts.items():
        own.sort(key=lambda p: p.start)
        while own:  # repeated ids: take one chain of pieces after the other
            at, ids = 0, b""
            while at < total:
                p = next(p for p in own if p.start == at)
                own.remove(p)
                at, ids = at + p.length, ids + p.ids
            got.append((doc_id, zlib.crc32(ids)))
    assert sorted(got) == want
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= length
    return sorted(sum(p.length for p in own) for own in sequences.values())


@pytest.mark.parametrize("length", [64, 2048])
def test_every_id_in_one_piece_and_one_short_sequence(docs, rows, tokenizer, length):
    pieces = packing.pack(docs.repartition(7), length=length, windows=4).collect()
    sizes = held(pieces, [(r[0], r[1]) for r in rows], tokenizer, length)
    assert all(s == length for s in sizes[1:])


def test_merge_over_many_partitions(docs, rows, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "MERGE", 3)
    pieces = packing.pack(docs.repartition(40), length=256).collect()
    assert all(s == 256 for s in held(pieces, [(r[0], r[1]) for r in rows], tokenizer, 256)[1:])


def test_edges(edges, nothing, edge_rows, tokenizer):
    unique = [(i, t) for i, t, *_ in edge_rows if i not in (None, 5)]
    pieces = packing.pack(edges.where("doc_id IS NOT NULL AND doc_id <> 5")).collect()
    held(pieces, unique, tokenizer, 2048)
    assert sum(p.length for p in packing.pack(edges).collect()) == sum(
        len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in edge_rows)
    assert packing.pack(nothing).count() == 0


def test_encoder_agrees_with_the_tokenizers_library(tokenizer):
    rng = random.Random(3)
    marks = ["a", "b ", " ", "\n", "\t", "'s", "don't", "Ü", "中", " 12", ",", "<|endoftext|>", "😀", "  ", "\r\n", "'"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    texts += [f"a{chr(c)}b 1{chr(c)}{chr(c)} {chr(c)}9 \n{chr(c)}" for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    encoder = packing.encoder(packing.VOCABULARY)
    for text, found in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert encoder.encode(text) == np.array(found.ids, "<u4").tobytes(), text


@pytest.mark.parametrize("text", [" " * 2_000_000, "\t" * 2_000_000, "\n" * 2_000_000, "a\u00a0" + "\u2003" * 1_500_000 + " b", "y" * 2_000_000, "!" * 2_000_000,
                                  "7" * 2_000_000, "x " + " " * 510 + "z", ("w" + " " * 511) * 200, ("w" + " " * 512) * 200], ids=range(10))
def test_encoder_on_very_long_runs(tokenizer, text):
    want = np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert packing.encoder(packing.VOCABULARY).encode(text) == want


def test_packs_a_very_long_run_of_blanks(spark, tokenizer):
    texts = [(1, "a" + " " * 2_000_000 + "b"), (2, "\n" * 1_000_000), (3, "plain")]
    pieces = packing.pack(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    held(pieces, texts, tokenizer, 2048)
