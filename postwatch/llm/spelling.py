"""Spelling variant grouping: words one edit apart, found in a trie of letter-group counts.

Letters are dealt to groups of about equal frequency. A word is arranged by how many letters of the first group it has, then of the
second, and so on: words with equal counts share a leaf. One inserted letter raises one count by one, a deleted one lowers
one, a replaced one does both or neither. So the search for a word walks down the trie, depth first, and may at one level go to the
child with one more, and at one level to the child with one less: a surplus and a deficit of one each are its whole budget. The words of the
leaves that it reaches are verified letter by letter.

The trie is cut below its first levels into subtries, as many levels as bring them below a size, and each subtrie
is a unit of work. A word is sent to its own subtrie and to those that its budget reaches and that come later in the order
of counts, so that each pair meets once. Units of very many words with the same counts, or of very many searching words, are cut into
chunks that all meet. Units return counts and best neighbours per word, not pairs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postwatch.llm.common import small_batches, store

LEAST_LETTERS, LEAST_COUNT, RATIO, MODULUS = 6, 5, 5, 199
GROUPS, LEAVES, SEARCHERS, FRONTIER, FLUSH, WIDE = 16, 20_000, 100_000, 2_000_000, 300_000, 64

_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_RUN = re.compile("[a-zÀ-ÿ]+")


# ---------------------------------------------------------------- words

def runs_of(text: str) -> Counter:
    """Maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` of a text, A-Z lower-cased, with their occurrences."""
    return Counter(_RUN.findall(text.translate(_FOLD)))


def dropped_letter(prefix_crc: int, run: str, modulus: int = MODULUS) -> str:
    """The run, without one letter if the crc32 of ``<doc_id>:<run>`` is divisible by ``modulus``."""
    h = crc32(run.encode(), prefix_crc)
    if h % modulus:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, modulus: int = MODULUS,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of all texts with at least that many letters and occurrences. Counts are summed up in the tasks first."""
    small_batches(docs.sparkSession)

    def batch_of(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                prefix = crc32(f"{doc_id}:".encode())
                for own, n in runs_of(text).items():
                    if len(own) >= least_letters:
                        own = dropped_letter(prefix, own, modulus)
                        if len(own) >= least_letters:
                            found[own] += n
            if len(found) > FLUSH:
                yield batch_of(found)
                found = Counter()
        yield batch_of(found)

    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# ---------------------------------------------------------------- the trie

def letter_groups(words: DataFrame, groups: int = GROUPS) -> list[str]:
    """Letters by group, the most frequent group first; a letter joins the group that is the rarest so far."""
    letters = words.select(F.explode(F.split("word", "")).alias("x")).where("x <> ''").groupBy("x").count().collect()  # as many as the alphabet
    sums, members = [0] * groups, [""] * groups
    for r in sorted(letters, key=lambda r: (-r["count"], r["x"])):
        at = min(range(groups), key=lambda g: (sums[g], g))
        sums[at] += r["count"]
        members[at] += r["x"]
    order = sorted(range(groups), key=lambda g: (-sums[g], g))
    return [members[g] for g in order if members[g]]


def counts_of(word: Column, groups: list[str]) -> Column:
    return F.array(*[F.length(word) - F.length(F.translate(word, g, "")) for g in groups])


def count_matrix(words: list[bytes], groups: list[str]) -> np.ndarray:
    """Words x groups, of latin-1 bytes."""
    group_of = np.zeros(256, np.int64)
    for g, letters in enumerate(groups):
        group_of[list(letters.encode("latin-1"))] = g
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    cells = np.repeat(np.arange(len(words)) * len(groups), sizes) + group_of[np.frombuffer(b"".join(words), np.uint8)]
    return np.bincount(cells, minlength=len(words) * len(groups)).reshape(len(words), len(groups))


class Trie:
    """Words by successive counts: ``keys[d]`` holds (parent node, count) of the nodes of level d, ``first`` the rows of each leaf."""

    def __init__(self, counts: np.ndarray):
        self.order = np.lexsort(counts.T[::-1])
        rows = counts[self.order]
        self.base = int(rows.max(initial=0)) + 2
        new, node, self.keys = np.zeros(len(rows), bool), np.zeros(len(rows), np.int64), []
        new[:1] = True
        for level in rows.T:
            new[1:] |= level[1:] != level[:-1]
            self.keys.append((node * self.base + level)[new])
            node = np.cumsum(new) - 1
        self.first = np.append(np.flatnonzero(new), len(rows))

    def walk(self, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row of ``counts``, word) of all pairs within the budget, in pieces; depth first over pieces of the frontier."""
        none = np.zeros(len(counts), bool)
        stack = [(0, np.arange(len(counts)), np.zeros(len(counts), np.int64), none, none)]
        while stack:
            level, row, node, more, less = stack.pop()
            if len(row) > FRONTIER:
                half = len(row) // 2
                stack += [(level, *(x[half:] for x in (row, node, more, less))), (level, *(x[:half] for x in (row, node, more, less)))]
                continue
            if level == len(self.keys):
                yield from self._words(row, node)
                continue
            keys, own, steps = self.keys[level], counts[row, level], []
            for change, allowed in ((0, None), (1, ~more), (-1, ~less)):
                r, at, want, m, s = (x if allowed is None else x[allowed] for x in (row, node, own + change, more, less))
                wanted = at * self.base + want
                child = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                hit = (keys[child] == wanted) & (want >= 0) & (want < self.base)
                steps.append((r[hit], child[hit], m[hit] | (change > 0), s[hit] | (change < 0)))
            stack.append((level + 1, *map(np.concatenate, zip(*steps))))

    def _words(self, row: np.ndarray, leaf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sizes = self.first[leaf + 1] - self.first[leaf]
        ends = np.cumsum(sizes)
        start = 0
        while start < len(row):  # about FRONTIER pairs at a time
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + FRONTIER)))
            n = sizes[start:stop]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(row[start:stop], n), self.order[np.repeat(self.first[leaf[start:stop]], n) + inside]
            start = stop


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether exactly one letter is inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)):] == b[at + 1:]


class Letters:
    """Words as rows of letters, for checking many pairs at once; longer words than ``wide`` are checked one by one."""

    def __init__(self, words: list[bytes], wide: int = WIDE):
        self.words, self.sizes = words, np.fromiter(map(len, words), np.int64, len(words))
        self.limit, self.wide = wide, min(wide, int(self.sizes.max(initial=1)))
        self.rows = np.zeros((len(words), self.wide + 2), np.uint8)
        short = np.array([w[:self.wide] for w in words], f"S{self.wide}")
        self.rows[:, :self.wide] = short.view(np.uint8).reshape(len(words), self.wide)

    def near(self, i: np.ndarray, other: Letters, j: np.ndarray) -> np.ndarray:
        """Which of the pairs (own word i, other's word j) are exactly one edit apart."""
        wide = max(self.wide, other.wide) + 2
        a, b = (np.zeros((len(x), wide), np.uint8) for x in (i, j))
        a[:, :self.wide + 2], b[:, :other.wide + 2] = self.rows[i], other.rows[j]
        size_a, size_b = self.sizes[i], other.sizes[j]
        flip = size_a > size_b
        a[flip], b[flip] = b[flip], a[flip].copy()
        same = a == b
        good = (size_a == size_b) & ((~same).sum(1) == 1)
        longer = abs(size_a - size_b) == 1
        at = np.argmin(same, axis=1)  # the first difference; the words differ in length
        shifted = a[:, :-1] == b[:, 1:]
        good |= longer & (shifted | (np.arange(wide - 1) < at[:, None])).all(1)
        for k in np.flatnonzero(np.maximum(size_a, size_b) > self.limit):
            good[k] = one_edit(self.words[i[k]], other.words[j[k]])
        return good


def near_pairs(searchers: list[bytes], leaves: list[bytes], groups: list[str], own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(searcher, leaf) of all words one edit apart; where ``own`` holds, a searcher has the leaf's counts up to the cut and only
    pairs with a smaller searcher count, as the leaf searches, too."""
    if not searchers or not leaves:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    trie, a, b = Trie(count_matrix(leaves, groups)), Letters(searchers), Letters(leaves)
    rank = {w: i for i, w in enumerate(sorted({*searchers, *leaves}))}
    rank_a, rank_b = (np.array([rank[w] for w in ws]) for ws in (searchers, leaves))
    found = []
    for i, j in trie.walk(count_matrix(searchers, groups)):
        once = ~own[i] | (rank_a[i] < rank_b[j])
        i, j = i[once], j[once]
        good = a.near(i, b, j)
        found.append((i[good], j[good]))
    return tuple(map(np.concatenate, zip(*found))) if found else (np.empty(0, np.int64), np.empty(0, np.int64))


def _neighbours_of_unit(groups: list[str]):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        search, leaf = rows[rows["role"] > 0], rows[rows["role"] == 0]
        words, others = ([w.encode("latin-1") for w in x["word"]] for x in (search, leaf))
        i, j = near_pairs(words, others, groups, (search["role"] == 1).to_numpy())
        word = np.concatenate([search["word"].to_numpy(object)[i], leaf["word"].to_numpy(object)[j]])
        other = np.concatenate([leaf["word"].to_numpy(object)[j], search["word"].to_numpy(object)[i]])
        n = np.concatenate([leaf["n"].to_numpy()[j], search["n"].to_numpy()[i]])
        pairs = pd.DataFrame({"word": word, "best": other, "best_n": n}).sort_values(["best_n", "best"], ascending=[False, True], kind="stable")
        by = pairs.groupby("word", sort=False)
        return by.first().assign(n_near=by.size()).reset_index()[["word", "n_near", "best", "best_n"]].astype({"n_near": "int64", "best_n": "int64"})

    return run


def reached(own: Column, levels: int) -> Column:
    """The keys of the subtries that a word of the counts ``own`` reaches with its budget, and that come after its own."""
    changes = [{i: 1} for i in range(levels)] + [{i: 1, j: -1} for i, j in combinations(range(levels), 2)]
    return F.array(*[F.struct(
        F.concat_ws(",", *[own[i] + F.lit(c.get(i, 0)) for i in range(levels)]).alias("unit")) for c in changes])


def neighbours(words: DataFrame, groups: list[str] | None = None, leaves: int = LEAVES, searchers: int = SEARCHERS) -> DataFrame:
    """(word, n_near, best, best_n) of the words of a table (word, n) that have near words: how many, and the one of the largest n (of
    several the smallest by code points). Words are distinct, of letters up to U+00FF."""
    groups = letter_groups(words) if groups is None else groups
    if not groups:
        return words.limit(0).select("word", F.lit(0).cast("long").alias("n_near"), F.col("word").alias("best"), F.col("n").alias("best_n"))
    counted = store(words.select("word", "n", counts_of(F.col("word"), groups).alias("counts")), "counts")
    key = lambda levels: F.concat_ws(",", *[F.col("counts")[i] for i in range(levels)])
    for levels in range(1, len(groups) + 1):
        largest = counted.groupBy(key(levels)).count().agg(F.max("count")).first()[0]
        if (largest or 0) <= leaves:
            break
    home = counted.select("word", "n", key(levels).alias("unit"), F.lit(1).alias("role"))
    away = counted.select("word", "n", F.inline(reached(F.col("counts"), levels)), F.lit(2).alias("role")).select("word", "n", "unit", "role")
    units = home.groupBy("unit").agg(F.ceil(F.count("*") / leaves).cast("int").alias("leaf_parts"))
    search = home.union(away).join(units, "unit")  # subtries that no word has drop out here
    parts = search.groupBy("unit").agg(F.ceil(F.count("*") / searchers).cast("int").alias("parts"), F.first("leaf_parts").alias("leaf_parts"))
    part = lambda n: F.pmod(F.xxhash64("word"), n).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    sent = search.drop("leaf_parts").join(parts, "unit").select("unit", "word", "n", "role", part(F.col("parts")).alias("part"), upto(F.col("leaf_parts")).alias("leaf_part"))
    held = home.join(parts, "unit").select("unit", "word", "n", F.lit(0).alias("role"), upto(F.col("parts")).alias("part"), part(F.col("leaf_parts")).alias("leaf_part"))
    found = sent.union(held).groupBy("unit", "part", "leaf_part").applyInPandas(
        _neighbours_of_unit(groups), "word string, n_near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", F.col("b.w").alias("best"), (-F.col("b.n")).alias("best_n"))


# ---------------------------------------------------------------- forms and roots

def roots(forms: DataFrame, max_rounds: int = 12) -> DataFrame:
    """(word, root) of a table (word, form): forms followed to the last. Forms are more frequent than their words, so there is no
    circle, and as each is several times as frequent, chains are short; each round doubles the way."""
    steps = store(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(max_rounds):
        further = steps.join(steps.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        new = store(further.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = new.where("moved").limit(1).count()
        steps = new.select("word", "root")
        if not moved:
            return steps
    raise RuntimeError(f"forms did not end in {max_rounds} rounds")


def variants(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, ratio: int = RATIO,
             modulus: int = MODULUS, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word of ``docs`` with enough letters and occurrences.

    ``form`` is the near word of the largest n if that is at least ``ratio`` times the word's own n, else null; ``root`` is the last
    form, the word itself if it has none. Null and empty texts have no words; a null doc_id counts as an empty text before the colon. Repeated
    rows count as often as they occur; words of any length count whole; an empty table gives an empty result; other columns are ignored.
    """
    words = store(word_counts(docs, least_letters, least_count, modulus, id_col, text_col), "words")
    near = neighbours(words, **options)
    is_form = F.col("best_n") >= ratio * F.col("n")
    formed = store(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("form"),
        F.when(is_form, F.col("best_n")).alias("form_n")), "forms")
    last = roots(formed.where("form IS NOT NULL"))
    return formed.join(last, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
