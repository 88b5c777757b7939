"""The registered queries and the pipeline on the smallest tables, against the rules by brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry_points
import corpus_pipeline
from postwatch.llm import minhash, packing, patterns, quality

from .conftest import WORD
from .test_minhash import brute as brute_minhash
from .test_mixing import water_fill
from .test_patterns import held as held_patterns
from .test_pii import brute_base
from .test_quality import brute_counts, brute_kept, counts_of
from .test_search import brute as brute_search
from .test_search import rows_of
from .test_simhash import brute_components, brute_fingerprint
from .test_spelling import brute as brute_spelling

NAMES = {
    "op1_mixing": "doc_id size source_size target taken", "op2_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op3_langid": "doc_id held_out lang_pred score", "op4_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op5_simhash": "doc_id fingerprint component_id", "op6_licenses": "doc_id licence covered_by", "op7_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op8_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op9_toxicity": "doc_id held_out score predicted",
    "op10_minhash": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
}


@pytest.fixture(scope="module")
def rows(sf):
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="module")
def found(spark, sf):
    cache = {}

    def get(name):
        if name not in cache:
            cache[name] = entry_points.queries()[name](spark, sf).collect()
        return cache[name]

    return get


@pytest.mark.parametrize("name", NAMES)
def test_rows_and_columns(found, rows, name):
    got = found(name)
    assert set(NAMES[name].split()) <= set(got[0].__fields__)
    assert {r.doc_id for r in got} == {i for i, *_ in rows}
    assert name == "op2_packing" or len(got) == len(rows)


def test_mixing(found, rows):
    sizes = defaultdict(int)
    for _, text, _, source in rows:
        sizes[source] += len(WORD.findall(text))
    want, taken = water_fill(sizes), Counter()
    for r in found("op1_mixing"):
        taken[r.source] += r.taken
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
    assert dict(taken) == pytest.approx(want, abs=0.51)


def test_packing(found, rows):
    tokenizer = Tokenizer.from_file(packing.VOCABULARY)
    ids = {i: tokenizer.encode(t, add_special_tokens=False).ids + [1] for i, t, *_ in rows}
    for r in found("op2_packing"):
        piece = b"".join(x.to_bytes(4, "little") for x in ids[r.doc_id][r.start:r.start + r.length])
        assert r.ids_crc32 == zlib.crc32(piece) and r.doc_tokens == len(ids[r.doc_id])
    total = Counter()
    for r in found("op2_packing"):
        total[r.sequence_id] += r.length
    assert sum(total.values()) == sum(map(len, ids.values())) and sorted(total.values())[1] == 2048


def test_simhash(found, rows):
    fps = {i: brute_fingerprint(t) for i, t, *_ in rows}
    near = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4]
    want = brute_components(fps, near)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found("op5_simhash")} == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


def test_pii(found, rows):
    texts = {i: t for i, t, *_ in rows}
    for r in found("op7_pii"):
        spans = brute_base(texts[r.doc_id])
        written = [f"{k}:{s}:{e}" for k, s, e in spans]
        kinds = Counter(k for k, *_ in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in ("email", "ip", "card", "phone"))
        assert r.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest() and set(written) <= set(r.spans.split(",")) | {""}


def test_quality(found, rows):
    got = {r.doc_id: r for r in found("op8_quality")}
    kept = {i: k for i, k, _ in brute_kept(rows, quality.MOST_TEXTS, quality.MOST_SHARE, quality.LEAST_LEFT)}
    assert all(counts_of(got[i]) == brute_counts(t) and got[i].kept == kept[i] for i, t, *_ in rows)


def test_held_out(found):
    for name, n, slot in (("op3_langid", 4, 2), ("op9_toxicity", 5, 0)):
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == slot) for r in found(name))


def test_langid_accuracy(found, rows):
    lang = {i: x for i, _, x, _ in rows}
    held = [r for r in found("op3_langid") if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) > 0.95 * len(held)


def test_minhash(found, rows):
    want = brute_minhash(rows)
    assert all(tuple(r) == want[r.doc_id] for r in found("op10_minhash"))
    assert minhash.PERMUTATIONS * 8 == len(found("op10_minhash")[0].fingerprint)


def test_spelling(found, rows):
    want = brute_spelling([(i, t) for i, t, *_ in rows])
    assert {r.word: (r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in found("op11_spelling")} == want


def test_patterns(spark, sf, found, rows):
    """The query's digests are those of the operator's pieces, and these hold every id once."""
    pieces = patterns.pack_by_patterns(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    sizes = held_patterns(pieces, [(i, t) for i, t, *_ in rows], Tokenizer.from_file(packing.VOCABULARY), 1024)
    digests = lambda ps, crc: sorted((p.doc_id, p.piece, p.start, p.length, crc(p)) for p in ps)
    assert digests(pieces, lambda p: zlib.crc32(p.ids)) == digests(found("op12_patterns"), lambda p: p.ids_crc32)
    histogram = np.bincount([p.length for p in pieces], minlength=1025)
    plain = sum(n for n, _ in patterns.pack_histogram(histogram, 1024))
    assert len(sizes) == len({r.sequence_id for r in found("op12_patterns")}) <= plain + 1


def test_search(spark, sf, rows):
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()
    want = brute_search([(i, t) for i, t, *_ in rows], items)
    assert rows_of(entry_points.queries()["op13_search"](spark, sf)) == want
    with duckdb.connect() as db:
        for name in ("documents", "benchmark"):
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
        assert sorted(db.execute(entry_points.oracle_sql()["op13_search"]).fetchall(), key=str) == want


def test_pipeline(spark, sf, rows):
    """Each stage by brute force on what the stage before it kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "personal_data", "mix_sources", "pack"]
    from postwatch.llm.common import store

    before = [tuple(r) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, sf), f"test-{name}")
        after = [tuple(r) for r in docs.collect()]
        if name != "pack":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert all(r[4] == len(r[1]) for r in after)
        texts = {r[0]: r[1] for r in before}
        if name == "quality_rules":
            verdicts = brute_kept([(i, t, lang, s) for i, t, lang, s, _ in before], quality.MOST_TEXTS, quality.MOST_SHARE, quality.LEAST_LEFT)
            assert {r[0] for r in after} == {i for i, k, _ in verdicts if k}
        elif name == "near_duplicates":
            fps = {i: brute_fingerprint(t) for i, t in texts.items()}
            root = brute_components(fps, [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4])
            assert sorted(r[0] for r in after) == sorted(set(root.values()))
        elif name == "personal_data":
            assert len(after) == len(before) and not any(brute_base(r[1]) for r in after)
            assert all(r[1] == texts[r[0]] for r in after if not brute_base(texts[r[0]]) and "<" not in r[1])
        elif name == "mix_sources":
            sizes, got = defaultdict(int), Counter()
            for r in before:
                sizes[r[3]] += len(WORD.findall(r[1]))
            for r in after:
                got[r[3]] += len(WORD.findall(r[1]))
            assert dict(got) == pytest.approx(water_fill(sizes), abs=0.51)
        else:
            tokenizer = Tokenizer.from_file(packing.VOCABULARY)
            tokens = sum(len(tokenizer.encode(r[1], add_special_tokens=False).ids) + 1 for r in before)
            assert sum(r.length for r in docs.collect()) == tokens
        before = after
    assert corpus_pipeline.run(spark, sf).count() == len(before)
