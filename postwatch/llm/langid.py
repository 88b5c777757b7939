"""Language identification by character models with interpolated Kneser-Ney smoothing.

The models of all languages lie in one sorted hash array for each order, with a column for each language. A text gets
the language of the lowest cross-entropy per character over all its words; temperature and rejection limits come
from labelled texts that the models did not see. Words are scored once and kept in a bounded cache.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postwatch.llm.common import small_batches, unit_interval

#: Training reads at most about this many texts of a language, drawn by a hash of the id; all are scored.
MOST_TEXTS, ORDER, DISCOUNT, HELD_BACK, QUANTILE, SEED = 1000, 4, 0.75, 0.2, 0.995, 7
UNKNOWN = "und"
_STEP = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def letters(word: str) -> str:
    """The letters of a word, lower-cased."""
    low = word.lower()
    return low if low.isalpha() else "".join(filter(str.isalpha, low))


def grams(words: list[str], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the hash of the gram that ends at each place of the words, and the number of places of a word.

    A word is its letters and an end mark; grams reach over its start mark but not further, and stand at 0 where they would.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    text = "".join([f"\x02{w}\x03" for w in words])
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out, h = [], np.zeros(len(codes), np.uint64)
    for n in range(order):
        shifted = np.zeros(len(codes), np.uint64)
        shifted[n:] = codes[:len(codes) - n]
        h = (h ^ (shifted * _MIX)) * _STEP
        h ^= h >> np.uint64(31)
        out.append(np.where(place >= n, h, np.uint64(0)))
    return out, sizes


@dataclass
class Models:
    """For each order: sorted gram hashes, discounted probabilities and back-off masses by language."""

    languages: list[str]
    hashes: list[np.ndarray]
    probability: list[np.ndarray]
    backoff: list[np.ndarray]
    floor: float
    temperature: float = 1.0
    limits: np.ndarray | None = None
    raw: dict[str, int] = field(default_factory=dict, repr=False)
    rows: list[np.ndarray] = field(default_factory=list, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "raw": {}, "rows": []}

    def word_scores(self, words: list[str]) -> np.ndarray:
        """(word, language + 1): log probability of a word's letters and end mark, then their number."""
        found, sizes = grams(words, len(self.hashes))
        p = np.full((len(found[0]), len(self.languages)), self.floor, np.float32)
        held = None
        for n, (h, known, prob) in enumerate(zip(found, self.hashes, self.probability)):
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = (known[at] == h) & (h != 0)
            if n == 0:
                mass = np.broadcast_to(self.backoff[0][:1], p.shape)  # the empty context
            else:
                before = np.concatenate(([0], held[0][:-1]))
                seen = np.concatenate(([False], held[1][:-1])) & (h != 0)
                mass = np.where(seen[:, None], self.backoff[n][before], np.float32(1))
            p = np.where(hit[:, None], prob[at], np.float32(0)) + mass * p
            held = at, hit
        logs = np.log(p)
        starts = np.cumsum(sizes) - sizes
        logs[starts] = 0  # the start mark is given
        total = np.add.reduceat(logs, starts, axis=0)
        return np.concatenate([total, (sizes - 1)[:, None]], axis=1).astype(np.float32)

    def entropies(self, texts: list[str], most: int = 400_000) -> tuple[np.ndarray, np.ndarray]:
        """(text, language) cross-entropies, and how many letters and end marks each text has."""
        k = len(self.languages)
        words, sizes = [], []
        for text in texts:
            part = text.split()
            sizes.append(len(part))
            words += part
        if len(self.raw) > most or not self.rows:
            self.raw.clear()
            self.rows[:] = [np.zeros((1, k + 1), np.float32)]
        new: dict[str, list[str]] = {}
        for word in {w for w in words if w not in self.raw}:
            new.setdefault(letters(word), []).append(word)
        for word in new.pop("", ()):
            self.raw[word] = 0
        if new:
            at = sum(map(len, self.rows))
            self.rows.append(self.word_scores(list(new)))
            for i, same in enumerate(new.values(), at):
                self.raw.update(dict.fromkeys(same, i))
        if len(self.rows) > 1:
            self.rows[:] = [np.concatenate(self.rows)]
        ids = np.fromiter(map(self.raw.__getitem__, words), np.int64, len(words))
        sums = np.zeros((len(texts) + 1, k + 1))
        sizes = np.array(sizes + [0])
        filled = np.flatnonzero(sizes)
        if len(filled):
            starts = (np.cumsum(sizes) - sizes)[filled]
            sums[filled] = np.add.reduceat(self.rows[0][ids].astype(np.float64), starts, axis=0)
        sums = sums[:-1]
        return -sums[:, :k] / np.maximum(sums[:, k:], 1), sums[:, k]

    def predict(self, texts: list[str]) -> pd.DataFrame:
        """lang_pred, score, entropy and rejected; ties go to the first language by name."""
        if not self.languages:
            return pd.DataFrame({"lang_pred": UNKNOWN, "score": 0.0, "entropy": None, "rejected": True}, index=range(len(texts)))
        entropy, size = self.entropies(texts)
        best = entropy.argmin(1)
        low = entropy[np.arange(len(texts)), best]
        over = np.zeros(len(texts)) if self.limits is None else np.maximum(0, low - self.limits[best])
        share = 1 / np.exp(-self.temperature * (entropy - low[:, None])).sum(1)
        none = size == 0
        return pd.DataFrame({
            "lang_pred": np.where(none, UNKNOWN, np.array(self.languages, object)[best]),
            "score": np.where(none, 0.0, np.clip(share * np.exp(-over), 0, 1)),
            "entropy": np.where(none, np.nan, low), "rejected": none | (over > 0)})


def fit(counts: pd.DataFrame, order: int = ORDER, discount: float = DISCOUNT) -> Models:
    """Models of a table (lang, word, n); orders below the highest count the contexts that a gram continues."""
    languages = sorted(counts["lang"].unique())
    tables: list[dict] = [[] for _ in range(order)]
    for lang in languages:
        part = counts[counts["lang"] == lang]
        found, sizes = grams(part["word"].tolist(), order)
        weight = np.repeat(part["n"].to_numpy(np.float64), sizes)
        starts = np.cumsum(sizes) - sizes
        real = np.ones(len(weight), bool)
        real[starts] = False  # the start mark is only a context
        for n in range(order):
            h = found[n]
            context = np.concatenate(([np.uint64(0)], found[n - 1][:-1])) if n else np.zeros(len(h), np.uint64)
            if n == order - 1:
                use, own = real & (h != 0), weight
            else:  # one for each different longer gram; where a gram starts the word, its number of occurrences
                use, own = real & (h != 0), np.ones(len(h))
                longer = found[n + 1]
                _, first = np.unique(longer, return_index=True)
                once = np.zeros(len(h), bool)
                once[first] = True
                use = use & (once | (longer == 0))
                own = np.where(longer == 0, weight, own)
            grams_, at = np.unique(h[use], return_inverse=True)
            total = np.bincount(at, own[use])
            where = np.zeros(len(grams_), np.uint64)
            where[at] = context[use]
            contexts, group = np.unique(where, return_inverse=True)
            mass = np.bincount(group, total)
            kinds = np.bincount(group)
            cut = np.minimum(discount, total * discount)
            lost = np.bincount(group, cut)
            tables[n].append((grams_, (total - cut) / mass[group], contexts, lost / mass, kinds))
    hashes, probability, backoff = [], [], []
    alphabet = max([len(t[0]) for t in tables[0]], default=1) + 1
    for n in range(order):
        known = np.unique(np.concatenate([t[0] for t in tables[n]] or [np.zeros(0, np.uint64)]))
        prob = np.zeros((len(known), len(languages)), np.float32)
        for i, t in enumerate(tables[n]):
            prob[np.searchsorted(known, t[0]), i] = t[1]
        hashes.append(known)
        probability.append(prob)
        if n == 0:
            backoff.append(np.array([[t[3][0] for t in tables[0]]], np.float32))
    # A gram of order n is the context of order n + 1; contexts that are no gram themselves are start marks.
    for n in range(1, order):
        starts = np.unique(np.concatenate([hashes[n - 1], *[t[2] for t in tables[n]]]))
        grown = np.zeros((len(starts), len(languages)), np.float32)
        grown[np.searchsorted(starts, hashes[n - 1])] = probability[n - 1]
        mass = np.ones((len(starts), len(languages)), np.float32)
        for i, t in enumerate(tables[n]):
            mass[np.searchsorted(starts, t[2]), i] = t[3]
        hashes[n - 1], probability[n - 1] = starts, grown
        backoff.append(mass)
    return Models(languages, hashes, probability, backoff, 1.0 / alphabet)


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          most_texts: int = MOST_TEXTS, order: int = ORDER) -> Models:
    """Models of the texts where ``learn`` holds, with a language and a text.

    At most about ``most_texts`` texts of each language are drawn, by a hash of the id. Words are counted in Spark; the counts of
    this bounded sample are all that comes to the driver. Words count whole at any length: in a language written without
    blanks, one can be a paragraph. A part of the sample sets temperature and limits.
    """
    known = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = dict(known.groupBy(lang_col).count().collect())
    if not sizes:
        return Models([], [], [], [], 1.0)
    rate = F.coalesce(F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, most_texts / n))])[F.col(lang_col)], F.lit(0.0))
    drawn = known.where(unit_interval(F.col(id_col), F.lit(SEED)) < rate).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
                                                                               (unit_interval(F.col(id_col), F.lit(SEED + 1)) < HELD_BACK).alias("held"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = batch.loc[~batch["held"], ["lang", "text"]]
            words = words.assign(word=words["text"].map(lambda t: [x for x in map(letters, t.split()) if x]))[["lang", "word"]].explode("word").dropna()
            yield words.groupby(["lang", "word"], as_index=False).size().rename(columns={"size": "n"})

    counts = drawn.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toPandas()
    if counts.empty:
        return Models([], [], [], [], 1.0)
    models = fit(counts.sort_values(["lang", "word"]), order)
    _calibrate(models, drawn.where("held"))
    return models


def _calibrate(models: Models, held: DataFrame) -> None:
    """Sets the temperature of the greatest likelihood and a limit of entropy for each language, from texts kept back."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            entropy, size = models.entropies(batch["text"].tolist())
            yield pd.DataFrame({"lang": batch["lang"], "size": size, "entropy": list(entropy)})

    found = held.mapInPandas(measure, "lang string, size double, entropy array<double>").toPandas()
    found = found[(found["size"] > 0) & found["lang"].isin(models.languages)]
    if found.empty:
        return
    entropy = np.stack(found["entropy"].to_numpy())
    true = found["lang"].map(models.languages.index).to_numpy()
    own = entropy[np.arange(len(true)), true]
    likelihood = lambda t: -np.log(np.exp(-t * (entropy - own[:, None])).sum(1)).mean()
    models.temperature = max((float(t) for t in np.geomspace(0.5, 64, 22)), key=likelihood)
    models.limits = np.array([np.quantile(own[true == i], QUANTILE) if (true == i).any() else np.inf for i in range(len(models.languages))])


def predict(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, entropy, rejected) for each row.

    Texts that are null or have no letter are ``und`` with score 0. Others get a learned language; where the entropy is above
    that language's limit, ``rejected`` is true and the score is lowered. Texts are scored whole. Repeated rows get equal
    results; an empty table gives an empty result; other columns are ignored. Without a learned language all are ``und``.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = shared(models).predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out["lang_pred"], pa.string()), pa.array(out["score"], pa.float64()),
                                              pa.array(out["entropy"], pa.float64(), from_pandas=True), pa.array(out["rejected"], pa.bool_())],
                                             ["doc_id", "lang_pred", "score", "entropy", "rejected"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(
        run, "doc_id long, lang_pred string, score double, entropy double, rejected boolean")


_MODELS: dict[tuple, Models] = {}


def shared(models: Models) -> Models:
    """The copy of the models whose word cache all batches of a Python worker use."""
    key = (*models.languages, *[int(h.sum()) for h in models.hashes])
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = models
    return _MODELS[key]
