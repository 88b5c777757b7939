"""Toxicity by a factorization machine over hashed terms.

Terms are the words of a text and their beginnings, hashed; a text has each term once. Besides a weight, each
term has a short vector, and pairs of terms add the product of theirs, so that an insult beside a group's name can count more
than both by themselves. Every slot of the training sample is learned; a prior draws those to zero that tell nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postwatch.llm.common import small_batches, store, unit_interval

#: Training reads at most about this many labelled texts of each class, drawn by a hash of the id; all texts are scored.
MOST_TEXTS, SLOTS, FACTORS, EPOCHS, START, PRIOR, SEED = 6000, 1 << 18, 8, 12, 0.5, 2.5, 11
#: Terms of all drawn texts together, beyond which fewer texts are drawn.
MOST_TERMS = 8_000_000
_EDGES = ".,;:!?\"'()[]{}<>#*$%&|-_«»¡¿…"


def word_terms(word: str, slots: int = SLOTS) -> tuple[int, ...]:
    """Hashed terms of a word: itself and, if longer, its first five letters."""
    word = word.lower().strip(_EDGES)
    if not word:
        return ()
    own = (xxhash.xxh64_intdigest(word, 1) % slots,)
    return own + ((xxhash.xxh64_intdigest(word[:5], 2) % slots,) if len(word) > 5 else ())


@dataclass
class Machine:
    """Score = sigmoid(bias + sum of weights + sum of products of the vectors of all pairs of terms)."""

    place: dict[int, int]
    bias: float
    weights: np.ndarray
    vectors: np.ndarray
    cache: dict[str, tuple] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "cache": {}}

    def terms(self, text: str) -> list[int]:
        """Sorted places of the learned terms of a text."""
        words = set(text.split())
        if len(self.cache) > 400_000:
            self.cache.clear()
        cache = self.cache
        for word in [w for w in words if w not in cache]:
            cache[word] = tuple(self.place[t] for t in word_terms(word) if t in self.place)
        return sorted({t for found in map(cache.__getitem__, words) if found for t in found})

    def score(self, text: str) -> float:
        at = self.terms(text)
        own = self.vectors[at]
        z = self.bias + self.weights[at].sum() + 0.5 * ((own.sum(0) ** 2).sum() - (own**2).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(terms: list[np.ndarray], labels: np.ndarray, shift: float = 0.0, factors: int = FACTORS, epochs: int = EPOCHS,
        rate: float = 0.02, prior: float = PRIOR, start: float = START, seed: int = SEED) -> Machine:
    """Fit by Adam on the logarithmic loss. ``shift`` is added to the bias, for classes drawn at different rates.

    Only the terms of a batch are moved in its step. Each number of a term is then drawn to zero by ``prior`` standard errors of its
    mean step, the errors being one over the root of the number of its texts: what moves it by chance is taken back, and most terms end
    at zero; what its texts agree on stays.
    """
    n_pos, n_neg = int(labels.sum()), int(len(labels) - labels.sum())
    if not n_pos or not n_neg:
        return Machine({}, (20.0 if n_pos else -20.0), np.zeros(0), np.zeros((0, factors)))
    pos = np.bincount(np.concatenate([t for t, y in zip(terms, labels) if y] or [[]]).astype(np.int64), minlength=SLOTS)
    neg = np.bincount(np.concatenate([t for t, y in zip(terms, labels) if not y] or [[]]).astype(np.int64), minlength=SLOTS)
    known = np.flatnonzero(pos + neg)
    place = {int(t): i for i, t in enumerate(known)}
    random = np.random.default_rng(seed)
    lookup = np.full(SLOTS, -1)
    lookup[known] = np.arange(len(known))
    none = len(known)  # a term that every text has keeps the sums simple; it has no weight
    rows = [np.append(lookup[t], none) for t in terms]
    pos, neg = pos[known], neg[known]
    p, q, both = pos / n_pos, neg / n_neg, (pos + neg) / (n_pos + n_neg)
    signal = ((p - q) ** 2 / (both * (1 - both) * (1 / n_pos + 1 / n_neg) + 1e-9)) ** 2
    weights, vectors = np.zeros(none + 1), random.normal(0, 0.05, (none + 1, factors))
    # Training goes on from the odds of each term, as far as they are more than chance.
    weights[:none] = start * np.log((p + 1 / n_pos) / (q + 1 / n_neg)) * signal / (signal + 81)
    vectors[none] = 0
    pull = np.append(prior / np.sqrt(pos + neg), 0)
    bias = np.array([np.log(n_pos / n_neg)])
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (bias, weights, vectors)]
    step = 0
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for batch in np.array_split(order, max(1, len(order) // 256)):
            sizes = np.array([len(rows[i]) for i in batch])
            used, flat = np.unique(np.concatenate([rows[i] for i in batch]), return_inverse=True)
            starts, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(batch)), sizes)
            own = vectors[used][flat]
            total = np.add.reduceat(own, starts, axis=0)
            z = bias[0] + np.add.reduceat(weights[used][flat], starts) + 0.5 * ((total**2).sum(1) - np.add.reduceat((own**2).sum(1), starts))
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[batch]) / len(batch)
            slope_w = np.bincount(flat, error[owner], len(used))
            change = error[owner, None] * (total[owner] - own)
            slope_v = np.stack([np.bincount(flat, change[:, k], len(used)) for k in range(factors)], axis=1)
            slope_w[used == none], slope_v[used == none] = 0, 0
            step += 1
            every = np.zeros(1, np.int64)
            for x, at, g, (m, v), less in zip((bias, weights, vectors), (every, used, used), (np.array([error.sum()]), slope_w, slope_v), moments,
                                              (np.zeros(1), pull[used], pull[used, None])):
                m[at] += 0.1 * (g - m[at])
                v[at] += 0.001 * (g * g - v[at])
                moved = x[at] - rate * (m[at] / (1 - 0.9**step)) / (np.sqrt(v[at] / (1 - 0.999**step)) + 1e-8)
                x[at] = np.sign(moved) * np.maximum(np.abs(moved) - rate * less, 0)
    return Machine(place, float(bias[0] + shift), weights[:none].copy(), vectors[:none].copy())


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", most_texts: int = MOST_TEXTS, most_terms: int = MOST_TERMS, **options) -> Machine:
    """A machine from the labelled rows where ``learn`` (a condition on the id) holds.

    A document that is labelled more than once is toxic if one label says so; null labels do not count. At most about
    ``most_texts`` texts of each class are drawn, by a hash of the id; the bias makes up for different rates. Texts with more than
    ``most_terms`` terms among them are drawn once more, by a hash of their terms, so that the driver's memory has a bound.
    """
    known = labels.where(learn & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_y"))
    sizes = {int(y): n for y, n in known.groupBy("_y").count().collect()}
    rates = {y: min(1.0, most_texts / n) for y, n in sizes.items()}
    rate = F.when(F.col("_y") == 1, F.lit(rates.get(1, 1.0))).otherwise(F.lit(rates.get(0, 1.0)))
    drawn = known.where(unit_interval("_id", F.lit(SEED)) < rate)
    # The sample has a proven bound of rows and holds ids and labels alone.
    sample = docs.join(F.broadcast(drawn), F.col(id_col) == F.col("_id")).select(F.col("_y").cast("int").alias("y"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.array(sorted({t for w in set(text.split()) for t in word_terms(w)}), np.int32) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["y", "terms"])

    found = store(sample.mapInArrow(hashed, "y int, terms array<int>"), "toxic-terms")
    total = found.agg(F.sum(F.size("terms"))).first()[0] or 0
    if total > most_terms:
        found = found.where(unit_interval("terms", F.lit(SEED)) < most_terms / total)
    table = found.toArrow()
    lists, y = table.column("terms").combine_chunks(), table.column("y").to_numpy().astype(np.float64)
    flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy()
    texts = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
    order = sorted(range(len(y)), key=lambda i: (xxhash.xxh64_intdigest(texts[i].tobytes()), y[i]))
    shift = np.log(rates.get(0, 1.0) / rates.get(1, 1.0))
    return fit([texts[i] for i in order], y[order], shift, **options)


def predict(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for each row; null texts count as empty, which have the score of no term.

    Texts are read whole. Repeated rows get equal results; an empty table gives an empty result; other columns are
    ignored. Without labels of both classes all scores are those of the class there is.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = shared(machine)
            score = np.array([own.score(t) for t in batch.column(1).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(
        run, "doc_id long, score double, predicted int")


_MACHINES: dict[bytes, Machine] = {}


def shared(machine: Machine) -> Machine:
    """The copy of the machine whose word cache all batches of a Python worker use."""
    key = machine.weights.tobytes() + np.float64(machine.bias).tobytes()
    if key not in _MACHINES:
        _MACHINES.clear()
        _MACHINES[key] = machine
    return _MACHINES[key]
