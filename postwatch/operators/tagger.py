"""A sequence tagger for the custom entities: a linear-chain model over token features and label transitions.

Features are made by built-in functions and hashed to slots. Training is by full gradients: each task runs the sums forward and
backward over its pieces of text and adds up the slots that it has met, Spark adds up the tasks, and the driver takes a step (L-BFGS) on
what is as large as the model and no larger. Tagging finds the best label sequence of each post (Viterbi) in one pass over
the texts, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postwatch.functions.lookup import KEY, value_key
from postwatch.functions.text import split_tokens

# The token labels of the training annotations.
LABELS = ["B-trig", "I-trig", "B-term", "I-term", "B-fig", "I-fig", "B-time", "I-time", "B-unit", "I-unit"]
FEATURES = ["token", "lower", "shape", "prefix", "suffix", "previous", "following"]


def _shape(token: Column) -> Column:
    for pattern, mark in ((r"\p{Lu}", "X"), (r"\p{Ll}", "x"), (r"\p{Nd}", "d")):
        token = F.regexp_replace(token, pattern, mark)
    return F.regexp_replace(token, r"(.)\1{2,}", "$1$1")


def _in_context(text_col: str) -> Column:
    """All tokens of a text with position and neighbours, as an array."""
    return F.get(F.transform(
        F.array(split_tokens(text_col)),
        lambda ts: F.transform(ts, lambda t, i: F.struct(
            i.alias("pos"), t.alias("token"), F.get(ts, i - 1).alias("previous"), F.get(ts, i + 1).alias("following")
        )),
    ), 0)


def token_context(posts: DataFrame, *keep: str, text_col: str = "full_text") -> DataFrame:
    """``(keep, pos, token, previous, following)``; neighbours are read from the post's own token list,
    so no window and no shuffle is needed."""
    return posts.select(*keep, F.inline(_in_context(text_col)))


def listed_context(posts: DataFrame, *keep: str, text_col: str = "full_text") -> DataFrame:
    """As ``token_context``, a row for each text: ``(keep, tokens)``."""
    return posts.select(*keep, _in_context(text_col).alias("tokens"))


def feature_slots(token: Column, previous: Column, following: Column, num_features: int) -> Column:
    """The hashed slots of a token's features, and one slot that all tokens have."""
    lower = F.lower(token)
    values = [token, lower, _shape(token), F.substring(lower, 1, 3), F.right(lower, F.lit(3)),
              F.lower(F.coalesce(previous, F.lit("<s>"))), F.lower(F.coalesce(following, F.lit("</s>")))]
    hashed = [F.pmod(F.xxhash64(F.lit(name), v), F.lit(num_features)).cast("int") for name, v in zip(FEATURES, values)]
    return F.array(*hashed, F.lit(num_features))


@dataclass
class Tagger:
    """Weights of feature slots (slot, label) and of label pairs; the last row of ``transitions`` is the start of a text."""

    labels: list[str]
    emissions: np.ndarray
    transitions: np.ndarray

    @property
    def num_features(self) -> int:
        return len(self.emissions) - 1

    def save(self, spark: SparkSession, path: str) -> None:
        """As a table: one row for each slot that has a weight, and one for each row of the transitions."""
        rows = [(f"to {i}", i, None, w.tolist()) for i, w in enumerate(self.transitions)]
        rows += [("slot", i, None, self.emissions[i].tolist()) for i in np.flatnonzero(self.emissions.any(1)).tolist()]
        rows += [("label", i, name, None) for i, name in enumerate([*self.labels, str(self.num_features)])]
        spark.createDataFrame(rows, _STORED).repartition(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Tagger:
        rows = spark.read.schema(_STORED).parquet(path).collect()  # as large as the model
        *labels, slots = [r["name"] for r in sorted(rows, key=lambda r: r["at"]) if r["kind"] == "label"]
        emissions = np.zeros((int(slots) + 1, len(labels)))
        transitions = np.zeros((len(labels) + 1, len(labels)))
        for r in rows:
            if r["kind"] == "slot":
                emissions[r["at"]] = r["weights"]
            elif r["kind"] != "label":
                transitions[r["at"]] = r["weights"]
        return cls(labels, emissions, transitions)


_STORED = "kind STRING, at INT, name STRING, weights ARRAY<DOUBLE>"
_BATCH, ROWS_AT_ONCE = "spark.sql.execution.arrow.maxRecordsPerBatch", 16
PIECE, CELLS, TASK_TOKENS, REGULARISATION, BARRED = 128, 2_000_000, 4_000_000, 1e-3, -1e6


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def _padded(scores: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token scores (tokens x labels) as (sequences, longest, labels), and where there are tokens."""
    there = np.arange(sizes.max(initial=0)) < sizes[:, None]
    out = np.zeros((*there.shape, scores.shape[1]))
    out[there] = scores
    return out, there


def expected_counts(scores: np.ndarray, sizes: np.ndarray, transitions: np.ndarray, gold: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(loss, slope by token and label, slope by label pair) of sequences laid end to end: expected less observed counts.

    Sums run over shares that are scaled to one at each token, so that a step is a product of small matrices. Scores so far apart that
    no label sequence has a share in doubles are summed as logarithms.
    """
    n, longest, k = len(sizes), int(sizes.max(initial=0)), scores.shape[1]
    first = np.cumsum(sizes) - sizes
    post = np.repeat(np.arange(n), sizes)
    at = np.arange(len(scores)) - first[post]
    alive = [np.flatnonzero(sizes > t) for t in range(longest)]
    top, most, start_most = scores.max(1, initial=BARRED), transitions[:-1].max(), transitions[-1].max()
    e = np.zeros((longest, n, k))
    e[at, post] = np.exp(scores - top[:, None])
    step, start = np.exp(transitions[:-1] - most), np.exp(transitions[-1] - start_most)
    forward, backward, scale = np.zeros_like(e), np.ones_like(e), np.ones((longest, n))
    for t in range(longest):
        own = alive[t]
        share = (e[t, own] * start) if t == 0 else (forward[t - 1, own] @ step) * e[t, own]
        total = share.sum(1)
        if not (np.isfinite(total) & (total > 1e-290)).all():
            return _expected_counts_by_logs(scores, sizes, transitions, gold)
        forward[t, own] = share / total[:, None]
        scale[t, own] = total
    pairs = np.zeros_like(transitions)
    for t in range(longest - 1, 0, -1):
        own = alive[t]
        ahead = e[t, own] * backward[t, own] / scale[t, own][:, None]
        pairs[:-1] += forward[t - 1, own].T @ ahead
        backward[t - 1, own] = ahead @ step.T
    pairs[:-1] *= step
    share = (forward * backward)[at, post]
    total = np.log(scale).sum() + top.sum() + most * (len(scores) - n) + start_most * n
    if not np.isfinite(share).all():
        return _expected_counts_by_logs(scores, sizes, transitions, gold)
    return _less_observed(float(total), share, pairs, scores, sizes, transitions, gold)


def _less_observed(total: float, share: np.ndarray, pairs: np.ndarray, scores: np.ndarray, sizes: np.ndarray, transitions: np.ndarray, gold: np.ndarray):
    """Loss and slopes from the sum over all label sequences, the tokens' label shares and the expected label pairs inside sequences."""
    inner, start = transitions[:-1], transitions[-1]
    first = np.cumsum(sizes) - sizes
    right = np.zeros_like(share)
    right[np.arange(len(gold)), gold] = 1
    pairs[-1] = share[first].sum(0) - right[first].sum(0)
    follows = np.ones(len(gold), bool)
    follows[first] = False
    to = np.flatnonzero(follows)
    k = share.shape[1]
    pairs[:-1] -= np.bincount(gold[to - 1].astype(np.int64) * k + gold[to], minlength=k * k).reshape(k, k)
    known = scores[np.arange(len(gold)), gold].sum() + start[gold[first]].sum() + inner[gold[to - 1], gold[to]].sum()
    return float(total - known), share - right, pairs


def _expected_counts_by_logs(scores: np.ndarray, sizes: np.ndarray, transitions: np.ndarray, gold: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """As ``expected_counts``, for scores of any size."""
    e, there = _padded(scores, sizes)
    n, longest, k = e.shape
    inner, start = transitions[:-1], transitions[-1]
    forward, backward = np.empty_like(e), np.zeros_like(e)
    for t in range(longest):
        step = start if t == 0 else _log_sum(forward[:, t - 1, :, None] + inner, 1)
        forward[:, t] = np.where(there[:, t, None], e[:, t] + step, forward[:, t - 1] if t else 0)
    for t in range(longest - 2, -1, -1):
        ahead = _log_sum(inner + (e[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
        backward[:, t] = np.where(there[:, t + 1, None], ahead, 0)
    total = _log_sum(forward[:, -1], 1)
    share = np.exp(forward + backward - total[:, None, None])[there]
    pairs = np.zeros_like(transitions)
    for t in range(1, longest):
        own = there[:, t]
        joint = np.exp(forward[own, t - 1, :, None] + inner + (e[own, t] + backward[own, t])[:, None, :] - total[own, None, None])
        pairs[:-1] += joint.sum(0)
    return _less_observed(float(total.sum()), share, pairs, scores, sizes, transitions, gold)


def best_labels(scores: np.ndarray, sizes: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """The label of each token in the best sequence of its text (Viterbi); the first label wins ties."""
    e, there = _padded(scores, sizes)
    n, longest, k = e.shape
    back = np.zeros(e.shape, np.int16)
    best = e[:, 0] + transitions[-1] if longest else np.zeros((n, k))
    ends = best.copy()
    for t in range(1, longest):
        ways = best[:, :, None] + transitions[:-1]
        back[:, t] = ways.argmax(1)
        best = ways.max(1) + e[:, t]
        ends = np.where(there[:, t, None], best, ends)
    labels = np.zeros(there.shape, np.int16)
    own = ends.argmax(1)
    for t in range(longest - 1, -1, -1):
        labels[:, t] = own
        step = back[np.arange(n), t, own]
        own = np.where(there[:, t], step, own) if t else own
    return labels[there]


def _sequences(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, sizes) of a list column without nulls."""
    return lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())


def _slot_rows(batch_column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens x features, tokens of each text) of a column of slot lists, those of a text end to end."""
    flat, sizes = _sequences(batch_column)
    return flat.reshape(-1, len(FEATURES) + 1), sizes // (len(FEATURES) + 1)


def _packed(rows: int, cut: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Slots and labels of pieces, ``rows`` pieces a row, as compressed bytes, which are copied whole each time that they are read.

    Five slots of a token follow from its letters alone: they stand once for each of a row's different tokens, which are numbered. Texts are
    cut into pieces of ``cut`` tokens, if that is given.
    """
    own = len(FEATURES) - 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, sizes = _slot_rows(batch.column(0))
            gold, _ = _sequences(batch.column(1))
            if cut:
                n_pieces = -(-sizes // cut)
                last = np.cumsum(n_pieces)[n_pieces > 0] - 1
                pieces = np.full(n_pieces.sum(), cut)
                pieces[last] = (sizes - cut * (n_pieces - 1))[n_pieces > 0]
                sizes = pieces
            ends, packed = np.append(0, np.cumsum(sizes)), []
            for begin in range(0, len(sizes), rows):
                some = sizes[begin:begin + rows]
                part = slice(ends[begin], ends[begin + len(some)])
                mixed = np.zeros(part.stop - part.start, np.uint64)
                for j in range(own):
                    mixed = (mixed ^ slots[part, j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                _, at, number = np.unique(mixed, return_index=True, return_inverse=True)
                words = slots[part, :own][at]
                if not np.array_equal(words[number], slots[part, :own]):  # two tokens of one mixed number
                    words, number = np.unique(slots[part, :own], axis=0, return_inverse=True)
                arrays = [some, words, number.ravel(), slots[part, own], slots[part, own + 1], gold[part]]
                raw = [np.ascontiguousarray(x.T if x is words else x, "<i4").tobytes() for x in arrays]
                packed.append((sum(map(len, raw)), [len(x) // 4 for x in raw], pa.compress(b"".join(raw), "zstd", asbytes=True)))
            yield pa.RecordBatch.from_arrays([
                pa.array([n for n, _, _ in packed], pa.int64()), pa.array([x for _, x, _ in packed], pa.list_(pa.int32())), pa.array([x for _, _, x in packed], pa.binary())], ["size", "parts", "data"])

    return run


@dataclass(frozen=True)
class _Pieces:
    """A packed row: tokens of each piece; five slots of each different token; for all tokens its number, the slots of its neighbours, its label."""

    sizes: np.ndarray
    words: np.ndarray
    number: np.ndarray
    previous: np.ndarray
    following: np.ndarray
    gold: np.ndarray

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        """The scores (tokens x labels), summed in the order of the features."""
        scores = _emissions(weights, self.words).take(self.number, axis=0)
        scores += weights.take(self.previous, axis=0)
        scores += weights.take(self.following, axis=0)
        scores += weights[-1]
        return scores

    def add_up(self, by_token: np.ndarray | None, into: np.ndarray) -> None:
        """Adds a number of each token (1 without ``by_token``) to all slots that the token has."""
        n = len(into)
        by_word = np.bincount(self.number, by_token, len(self.words))
        into += np.bincount(self.words.ravel(), np.repeat(by_word, self.words.shape[1]), n)
        into += np.bincount(self.previous, by_token, n)
        into += np.bincount(self.following, by_token, n)
        into[-1] += len(self.gold) if by_token is None else by_token.sum()


def _unpacked(batch: pa.RecordBatch) -> Iterator[_Pieces]:
    for size, parts, data in zip(*(c.to_pylist() for c in batch.columns)):
        flat = np.frombuffer(pa.decompress(data, size, "zstd", asbytes=True), "<i4")
        sizes, words, *rest = np.split(flat, np.cumsum(parts)[:-1])
        yield _Pieces(sizes, np.ascontiguousarray(words.reshape(len(FEATURES) - 2, -1).T), *rest)


def _emissions(weights: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """The scores (tokens x labels) of slots (tokens x features)."""
    return sum((weights.take(slots[:, j], axis=0) for j in range(1, slots.shape[1])), weights.take(slots[:, 0], axis=0))


def _minimise(slope_of: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, max_iter: int, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS; a step is halved until the loss falls by a part of what the slope promises."""
    loss, slope = slope_of(x)
    moves: list[tuple[np.ndarray, np.ndarray, float]] = []
    used = 1
    while used < max_iter and np.abs(slope).max(initial=0) > 1e-5:
        way, kept = -slope, []
        for s, y, r in reversed(moves):
            kept.append(r * (s @ way))
            way = way - kept[-1] * y
        if moves:
            s, y, _ = moves[-1]
            way = way * ((s @ y) / (y @ y))
        else:
            way = way / max(1.0, float(np.abs(slope).sum()))
        for (s, y, r), a in zip(moves, reversed(kept)):
            way = way + (a - r * (y @ way)) * s
        pace, fall = 1.0, float(slope @ way)
        while used < max_iter:
            new_loss, new_slope = slope_of(x + pace * way)
            used += 1
            if new_loss <= loss + 1e-4 * pace * fall:
                break
            pace /= 2
        else:
            break
        s, y = pace * way, new_slope - slope
        if s @ y > 1e-12:
            moves = [*moves, (s, y, 1 / float(s @ y))][-memory:]
        done = loss - new_loss < 1e-5 * abs(loss)
        x, loss, slope = x + s, new_loss, new_slope
        if done:
            break
    return x


def train_tagger(tokens: DataFrame, id_col: str, num_features: int = 1 << 18, max_iter: int = 50, piece: int = PIECE,
                 regularisation: float = REGULARISATION, texts: DataFrame | None = None) -> Tagger:
    """Fit on rows ``(id, pos, token, previous, following, label)``, such as ``spans.token_table`` gives, and on ``texts``: rows ``(id,
    tokens)`` with all tokens of an id in their order, each with its neighbours and label, which are cut where they are, without a shuffle.

    All tokens count. Texts are cut into pieces of ``piece`` tokens for training, so that a text of any length takes bounded
    memory; only the transition at a cut is lost. ``max_iter`` bounds the passes over the pieces. Rows without label count
    as ``O``; without any row, every token is ``O``.
    """
    spark = tokens.sparkSession
    label = F.coalesce("label", F.lit("O"))
    every = tokens.select(label.alias("label"))
    if texts is not None:
        every = every.unionByName(texts.select(F.explode(F.transform("tokens", lambda t: F.coalesce(t["label"], F.lit("O")))).alias("label")))
    sizes = {r["label"]: r["count"] for r in every.groupBy("label").count().collect()}
    labels, n_tokens = sorted({"O", *sizes}, key=lambda x: (x != "O", x)), sum(sizes.values())
    k = len(labels)
    number = lambda x: F.array_position(F.array(*[F.lit(y) for y in labels]), x).cast("int") - 1
    token = F.struct("pos", feature_slots(F.col("token"), F.col("previous"), F.col("following"), num_features).alias("slots"), number(label).alias("label"))
    grouped = tokens.groupBy(id_col, F.floor(F.col("pos") / piece).alias("_piece")).agg(F.sort_array(F.collect_list(token)).alias("t"))
    listed = grouped.select(F.flatten(F.transform("t", lambda x: x["slots"])).alias("slots"), F.transform("t", lambda x: x["label"]).alias("labels"))
    # Every pass reads the pieces again. As many make a row as stay below a bound of cells.
    per_row, packed = max(1, CELLS // (piece * k * 4)), "size LONG, parts ARRAY<INT>, data BINARY"
    pieces = listed.mapInArrow(_packed(per_row, None), packed).repartition(max(spark.sparkContext.defaultParallelism, n_tokens // TASK_TOKENS))
    if texts is not None:
        whole = texts.select(
            F.flatten(F.transform("tokens", lambda t: feature_slots(t["token"], t["previous"], t["following"], num_features))).alias("slots"),
            F.transform("tokens", lambda t: number(F.coalesce(t["label"], F.lit("O")))).alias("labels"))
        pieces = pieces.unionByName(whole.mapInArrow(_packed(per_row, piece), packed))
    pieces = pieces.persist()
    # A pass leaves the slopes of each task on disk until Spark collects its garbage: as many tasks as there are cores, however many tokens.
    dealt = pieces.coalesce(spark.sparkContext.defaultParallelism)

    def summed(run: Callable, schema: str, *names: str) -> pa.Table:
        """What the tasks found, added up: a row for each slot at most."""
        before = spark.conf.get(_BATCH)
        spark.conf.set(_BATCH, str(ROWS_AT_ONCE))  # a row has many pieces
        try:
            return dealt.mapInArrow(run, schema).groupBy("at").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
        finally:
            spark.conf.set(_BATCH, before)

    columns = [f"g{c}" for c in range(k)]

    def slope_of(scaled: np.ndarray) -> tuple[float, np.ndarray]:
        x = scaled * scale
        weights = x.reshape(-1, k)
        emissions, transitions = weights[:num_features + 1], weights[num_features + 1:] + barred

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, slope, columns_of = 0.0, np.zeros_like(weights), np.zeros((k, num_features + 1))
            for own in (x for batch in batches for x in _unpacked(batch)):
                part, by_token, by_pair = expected_counts(own.emissions(emissions), own.sizes, transitions, own.gold)
                loss += part
                for c in range(k):
                    own.add_up(by_token[:, c], columns_of[c])
                slope[num_features + 1:] += by_pair
            slope[:num_features + 1] = columns_of.T
            at = np.flatnonzero(slope.any(1))
            sums = np.vstack([np.full(k, loss), slope[at]])
            yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, at).astype(np.int32)), *[pa.array(np.ascontiguousarray(c)) for c in sums.T]], ["at", *columns])

        found = summed(run, "at int, " + ", ".join(f"{c} double" for c in columns), *columns)
        at, values = found["at"].to_numpy(), np.column_stack([found[c].to_numpy() for c in columns])
        slope = np.zeros_like(weights)
        slope[at[at >= 0]] = values[at >= 0]
        loss = float(values[at < 0][0, 0]) if (at < 0).any() else 0.0
        n = max(n_tokens, 1)
        return loss / n + 0.5 * regularisation * float(x @ x) / n, (slope.ravel() + regularisation * x) * scale / n

    try:
        # What goes on with an entity cannot follow another one, or begin a text, unless the rows have it so.
        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            met, steps = np.zeros(num_features + 1), np.zeros((k + 1) * k, np.int64)
            for own in (x for batch in batches for x in _unpacked(batch)):
                own.add_up(None, met)
                before = np.append(k, own.gold[:-1]).astype(np.int64)
                before[np.cumsum(own.sizes) - own.sizes] = k
                steps += np.bincount(before * k + own.gold, minlength=(k + 1) * k)
            both = np.concatenate([met.astype(np.int64), steps])
            at = np.flatnonzero(both)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(both[at], pa.int64())], ["at", "n"])

        # How many tokens have a slot, and which label pairs there are (the row after the last label is the start of a piece).
        tallied = summed(tally, "at LONG, n LONG", "n")
        at, counted = tallied["at"].to_numpy(), tallied["n"].to_numpy()
        seen = {divmod(int(i) - num_features - 1, k) for i in at[at > num_features]}
        goes_on = lambda a, b: not labels[b].startswith("I-") or a < k and labels[a] in (labels[b], f"B-{labels[b][2:]}")
        barred = np.array([[0.0 if goes_on(a, b) or (a, b) in seen else BARRED for b in range(k)] for a in range(k + 1)])
        # A slot that few tokens have is steered by few: steps are taken in units of one over the root of its tokens.
        seen_by = np.full(num_features + k + 2, float(n_tokens) + 1)
        seen_by[:num_features + 1] = 1
        seen_by[at[at <= num_features]] += counted[at <= num_features]
        scale = np.repeat((max(n_tokens, 1) / seen_by) ** 0.5, k)
        x = np.zeros((num_features + k + 2) * k)
        x = _minimise(slope_of, x, max_iter) * scale if n_tokens and k > 1 else x
    finally:
        pieces.unpersist()
    weights = x.reshape(-1, k)
    return Tagger(labels, weights[:num_features + 1].copy(), weights[num_features + 1:] + barred)


def tag_tokens(posts: DataFrame, model: Tagger, id_col: str = "id_str",
               text_col: str = "full_text") -> DataFrame:
    """``(id, pos, token, tag)`` of all tokens with a tag other than ``O``. Texts are read whole; null has no token."""
    context = _in_context(text_col)
    slots = F.transform(context, lambda t: feature_slots(t["token"], t["previous"], t["following"], model.num_features))
    rows = posts.select(F.col(id_col), F.transform(context, lambda t: t["token"]).alias("token"), F.flatten(slots).alias("slots"))
    names = np.array(model.labels, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, sizes = _slot_rows(batch.column(2))
            starts = np.cumsum(sizes) - sizes
            labels = np.zeros(sizes.sum(), np.int16)
            order, begin = np.argsort(sizes, kind="stable"), int((sizes == 0).sum())
            while begin < len(order):  # texts of about one length together, as many as stay below a bound of cells
                stop = begin + 1
                while stop < len(order) and (stop + 1 - begin) * sizes[order[stop]] * len(names) <= CELLS:
                    stop += 1
                own = order[begin:stop]
                at = np.concatenate([np.arange(starts[i], starts[i] + sizes[i]) for i in own])
                labels[at] = best_labels(_emissions(model.emissions, slots[at]), sizes[own], model.transitions)
                begin = stop
            hit = np.flatnonzero(names[labels] != "O")
            post = np.repeat(np.arange(len(sizes)), sizes)[hit]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(post)), pa.array((hit - starts[post]).astype(np.int32)), batch.column(1).flatten().take(pa.array(hit)),
                 pa.array(names[labels[hit]], pa.string())], [id_col, "pos", "token", "tag"])

    id_type = posts.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {id_type}, pos INT, token STRING, tag STRING")


def tag_posts(posts: DataFrame, model: Tagger, id_col: str = "id_str",
              text_col: str = "full_text") -> DataFrame:
    """``(id, pos, label, text)``: a ``B-`` token and the ``I-`` tokens of its kind that follow it.

    Tokens are merged text by text; an id that has several texts, or one text several times, gets the entities of each of
    its texts once. Only tagged tokens and keys are shuffled.
    """
    keyed = posts.withColumn(KEY, value_key(F.col(text_col).alias("t")))
    # Dealt by key once: repeated rows are dropped, and tokens merged, where they then are.
    found = merge_runs(tag_tokens(keyed, model, KEY, text_col).repartition(KEY).distinct(), KEY)
    return keyed.select(id_col, KEY).distinct().join(found, KEY).drop(KEY)


def merge_runs(tagged: DataFrame, id_col: str = "id_str") -> DataFrame:
    """Merge tagged tokens ``(id, pos, token, tag)`` to entities."""
    by_post = W.partitionBy(id_col).orderBy("pos")
    kind = F.substring("tag", 3, 100)
    starts = (
        F.startswith("tag", F.lit("B-"))
        | F.lag("pos").over(by_post).isNull()
        | (F.lag("pos").over(by_post) != F.col("pos") - 1)
        | (F.lag(kind).over(by_post) != kind)
    )
    runs = tagged.withColumn("_kind", kind).withColumn("_starts", starts.cast("int"))
    runs = runs.withColumn("_run", F.sum("_starts").over(by_post))
    return runs.groupBy(id_col, "_run", F.col("_kind").alias("label")).agg(
        F.min("pos").alias("pos"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda s: s["token"]), " "
        ).alias("text"),
    ).select(id_col, "pos", "label", "text")
