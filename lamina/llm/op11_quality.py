"""Quality classifier: a generalised additive model with pairwise interactions.

A text is described by ``FEATURES`` numbers (lengths, shares of kinds of bytes, repetition of words). Each feature is cut into bins at quantiles of the
learning rows, and has a lookup table with one addend a bin; a few pairs of features have tables over the bins of both. The tables are learned by cyclic
boosting: in turn, a tree with three leaves over one feature's bins is fitted to what all tables so far leave open, and added to
that feature's table at a small rate. Pairs are chosen by the gain of their best tree after the single features, then boosted likewise with trees of two
levels. A fifth of the learning rows decides how many rounds are kept. A score is the sum of the addends of a text, put through the logistic function.

Spark finds the features of at most about ``TRAIN_ROWS`` labelled rows, chosen by a hash of the id (a bounded table of numbers, on which the tables
are fitted), and of all texts to be scored, which adds up the bins of a slice of texts at once. The model's size is bounded by features and bins.

Defined results: null counts as empty; an empty text has zeros for features and scores like any other; of several labels of one id the highest counts; rows
repeated or with a null id are scored like any others; labels that are all alike, or none at all, give every text their smoothed rate; an
empty table gives an empty result; other columns are not read, and pass through ``drop_poor`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.kernels import SLICE_BYTES, Texts, shingles_of, text_slices, words_of
from lamina.llm.op06_language_id import sampled
from lamina.llm.rows import carried, quoted, schema_with

TRAIN_ROWS = 30_000
BINS = 64
PAIR_BINS = 16
PAIRS = 8
ROUNDS = 400
RATE = 0.1
PATIENCE = 40
PENALTY = 1.0
LEAST_ROWS = 10
THRESHOLD = 0.3
#: Kinds of bytes: 0 other, then in this order.
_KINDS = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\f\v", b"\n", b",.;:'\"()-?", b"!", bytes(range(128, 256)))
FEATURES = (
    "log_bytes log_words word_bytes words_per_line words_per_mark upper_share digit_share space_share mark_share "
    "shout_share other_share wide_share same_as_last distinct_words top_word repeated_shingles"
).split()
_KIND = np.zeros(256, np.uint8)
for _k, _bytes in enumerate(_KINDS):
    _KIND[list(_bytes)] = _k + 1


def features_of(texts: Texts) -> np.ndarray:
    """A row of ``FEATURES`` for each text."""
    n = len(texts)
    size = np.diff(texts.offsets)
    owner = np.repeat(np.arange(n), size)
    kinds = np.bincount(owner * 9 + _KIND[texts.data], minlength=9 * n).reshape(n, 9)
    other, small, upper, digit, space, line, mark, shout, wide = kinds.T
    words = words_of(texts)
    count = np.diff(words.bounds)
    of = np.repeat(np.arange(n), count)
    again = np.zeros(n, np.int64)
    if len(of) > 1:
        again = np.bincount(of[1:], (of[1:] == of[:-1]) & (words.hashes[1:] == words.hashes[:-1]), n)
    distinct, most = _spread(of, words.hashes, n)
    shingles, bounds = shingles_of(words)
    per = np.diff(bounds)
    kept, _ = _spread(np.repeat(np.arange(n), per), shingles, n)
    share = lambda x, whole: x / np.maximum(whole, 1)
    return np.stack(
        [
            np.log1p(size),
            np.log1p(count),
            share(np.bincount(of, words.ends - words.starts, n), count),
            count / (line + 1),
            count / (mark + shout + 1),
            share(upper, small + upper),
            share(digit, size),
            share(space + line, size),
            share(mark, size),
            share(shout, size),
            share(other, size),
            share(wide, size),
            share(again, count - 1),
            share(distinct, count),
            share(most, count),
            share(per - kept, per),
        ],
        1,
    ).astype(np.float64)


def _spread(of: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct hashes each text has, and how often its most frequent one stands there."""
    distinct, most = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if len(of):
        order = np.lexsort((hashes, of))
        owner, value = of[order], hashes[order]
        first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])]))
        times = np.diff(np.append(first, len(owner)))
        distinct = np.bincount(owner[first], minlength=n)
        np.maximum.at(most, owner[first], times)
    return distinct, most


@dataclass
class QualityModel:
    bias: float
    edges: list[np.ndarray] = field(default_factory=list)  # of each feature's bins
    tables: list[np.ndarray] = field(default_factory=list)  # an addend for each bin
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)  # of the coarser bins of each feature
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.bias)
        for f, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[f], rows[:, f], "right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[np.searchsorted(self.pair_edges[a], rows[:, a], "right"), np.searchsorted(self.pair_edges[b], rows[:, b], "right")]
        return np.exp(-np.logaddexp(0, -total))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + PENALTY)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + PENALTY)


def _best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """The gain of the best cut of some bins in two, and how many bins are left of it (0: none)."""
    left_g, left_h, left_n = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    allowed = (left_n >= LEAST_ROWS) & (n.sum() - left_n >= LEAST_ROWS)
    if not allowed.any():
        return 0.0, 0
    gain = np.where(allowed, _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h), -1.0) - _gain(g.sum(), h.sum())
    k = int(gain.argmax())
    return float(gain[k]), k + 1 if gain[k] > 0 else 0


def _three_leaves(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The addends of a tree with up to three leaves over a feature's bins."""
    _, first = _best_cut(g, h, n)
    cuts = [0, first, len(g)] if first else [0, len(g)]
    if first:
        more = [(*_best_cut(g[a:b], h[a:b], n[a:b]), a) for a, b in ((0, first), (first, len(g)))]
        gain, at, a = max(more)
        if at:
            cuts = sorted([*cuts, a + at])
    out = np.zeros(len(g))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _four_leaves(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The gain and addends of a tree that cuts one feature of a pair, then each half by the other feature."""
    best, table = 0.0, np.zeros(g.shape)
    for flip in (False, True):
        x, y = (g.T, h.T) if flip else (g, h)
        above_g, above_h = np.cumsum(x, 0)[:-1], np.cumsum(y, 0)[:-1]
        halves = []
        for half_g, half_h in ((above_g, above_h), (x.sum(0) - above_g, y.sum(0) - above_h)):
            part_g, part_h = np.cumsum(half_g, 1), np.cumsum(half_h, 1)
            whole_g, whole_h = part_g[:, -1:], part_h[:, -1:]
            gain = _gain(part_g, part_h) + _gain(whole_g - part_g, whole_h - part_h)
            halves.append((gain.max(1), gain.argmax(1), part_g, part_h))
        total = halves[0][0] + halves[1][0] - _gain(x.sum(), y.sum())
        row = int(total.argmax())
        if total[row] > best:
            best, out = float(total[row]), np.zeros(x.shape)
            for rows, (_, column, part_g, part_h) in zip((slice(0, row + 1), slice(row + 1, None)), halves, strict=True):
                c = int(column[row])
                out[rows, : c + 1] = _leaf(part_g[row, c], part_h[row, c])
                out[rows, c + 1 :] = _leaf(part_g[row, -1] - part_g[row, c], part_h[row, -1] - part_h[row, c])
            table = out.T if flip else out
    return best, table


def _boosted(bins: list[np.ndarray], sizes: list[int], grow, start: np.ndarray, y: np.ndarray, learn: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Tables over ``bins``, one tree a table and round, up to the round with the least loss on the rows not in ``learn``; and the sums of all rows."""
    tables = [np.zeros(s) for s in sizes]
    total = start.copy()
    best, kept, since = np.inf, [t.copy() for t in tables], 0
    loss = lambda: np.logaddexp(0, np.where(y > 0, -total, total))[~learn].mean()
    best = loss()
    for _ in range(ROUNDS):
        for k, own in enumerate(bins):
            p = 1 / (1 + np.exp(-total[learn]))
            g, h = (np.bincount(own[learn], w, sizes[k]) for w in (y[learn] - p, p * (1 - p)))
            step = RATE * grow(k, g, h)
            tables[k] += step
            total += step[own]
        now = loss()
        since += 1
        if now < best - 1e-6:
            best, kept, since = now, [t.copy() for t in tables], 0
        if since > PATIENCE:
            break
    return kept, start + sum((t[b] for t, b in zip(kept, bins, strict=True)), np.zeros(len(y)))


def learned(rows: np.ndarray, y: np.ndarray, part: np.ndarray) -> QualityModel:
    """The model of features ``rows`` and labels ``y``; rows whose ``part`` (0 to 4) is 0 decide the number of rounds."""
    bias = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    learn = part != 0
    if not 0 < y[learn].sum() < learn.sum() or learn.all():
        return QualityModel(bias)

    def edges(count: int) -> list[np.ndarray]:
        return [np.unique(np.quantile(rows[learn, f], np.arange(1, count) / count)) for f in range(rows.shape[1])]

    model = QualityModel(bias, edges(BINS), [], [], edges(PAIR_BINS), [])
    bins = [np.searchsorted(e, rows[:, f], "right") for f, e in enumerate(model.edges)]
    sizes = [len(e) + 1 for e in model.edges]
    held = [np.bincount(b[learn], minlength=s) for b, s in zip(bins, sizes, strict=True)]
    model.tables, total = _boosted(bins, sizes, lambda k, g, h: _three_leaves(g, h, held[k]), np.full(len(y), bias), y, learn)
    coarse = [np.searchsorted(e, rows[:, f], "right") for f, e in enumerate(model.pair_edges)]
    shape = [len(e) + 1 for e in model.pair_edges]
    p = 1 / (1 + np.exp(-total[learn]))
    rated = []
    for a in range(len(coarse)):
        for b in range(a + 1, len(coarse)):
            if shape[a] > 1 and shape[b] > 1:
                own = (coarse[a] * shape[b] + coarse[b])[learn]
                g, h = (np.bincount(own, w, shape[a] * shape[b]).reshape(shape[a], shape[b]) for w in (y[learn] - p, p * (1 - p)))
                rated.append((-_four_leaves(g, h)[0], a, b))
    model.pairs = [(a, b) for _, a, b in sorted(rated)[:PAIRS]]
    pair_bins = [coarse[a] * shape[b] + coarse[b] for a, b in model.pairs]
    pair_shapes = [(shape[a], shape[b]) for a, b in model.pairs]
    grow = lambda k, g, h: _four_leaves(g.reshape(pair_shapes[k]), h.reshape(pair_shapes[k]))[1].ravel()
    flat, _ = _boosted(pair_bins, [x * z for x, z in pair_shapes], grow, total, y, learn)
    model.pair_tables = [t.reshape(s) for t, s in zip(flat, pair_shapes, strict=True)]
    return model


def fit(
    docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> QualityModel:
    """Learn from the rows of ``docs`` whose id has a label."""
    marked = labels.where(F.col(quoted(label_col)).isNotNull() & F.col(quoted(id_col)).isNotNull()).groupBy(F.col(quoted(id_col)).cast("long").alias("id"))
    bounded = sampled(marked.agg(F.max(quoted(label_col)).cast("int").alias("label")), train_rows, "id")
    # at most about train_rows pairs of numbers, so the texts stay where they are
    texts = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).alias("text"))
    rows = texts.join(F.broadcast(bounded), "id").select(F.struct("id", "label", F.pmod(F.xxhash64("id", F.lit("rounds")), F.lit(5)).alias("part")).alias("row"), "text")
    table = _described(rows).select("row.*", "features").orderBy("id", "features").toArrow()
    if not table.num_rows:
        return QualityModel(0.0)
    numbers = table["features"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, len(FEATURES))
    return learned(numbers, (table["label"].to_numpy() > 0).astype(float), table["part"].to_numpy())


def _described(rows: DataFrame) -> DataFrame:
    """The struct ``row`` of ``rows`` (that have a column text, too) and the array of features."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in text_slices(batch["text"], SLICE_BYTES):
                found = features_of(texts)
                offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(FEATURES))
                lists = pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([batch["row"].slice(texts.first, len(texts)), lists], ["row", "features"])

    return rows.mapInArrow(describe, schema_with(rows, "features array<double>"))


def _scored(rows: DataFrame, model: QualityModel) -> DataFrame:
    """The struct ``row`` of ``rows`` (that have a column text, too) and a column score."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [np.zeros(0)]
            for texts in text_slices(batch["text"], SLICE_BYTES):
                scores.append(shared.value.score(features_of(texts)))
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(np.concatenate(scores))], ["row", "score"])

    return rows.mapInArrow(score, schema_with(rows, "score double"))


def quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` narrowed to doc_id, and its score from 0 to 1."""
    narrow = docs.select(F.struct(F.col(quoted(id_col)).cast("long").alias("doc_id")).alias("row"), F.col(quoted(text_col)).alias("text"))
    return _scored(narrow, model).select("row.doc_id", "score")


def drop_poor(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, all columns kept."""
    inner = carried(docs, F.col(quoted(text_col)).alias("text"))
    return _scored(inner, model).where(F.col("score") >= threshold).select("row.*")


def lookup_tables(spark: SparkSession, model: QualityModel) -> DataFrame:
    """The learned tables for people to read: feature, bin, its least value (null: none), other, other_bin, other_least, addend."""
    least = lambda edges, k: float(edges[k - 1]) if k else None
    rows = [(FEATURES[f], k, least(model.edges[f], k), None, None, None, float(x)) for f, t in enumerate(model.tables) for k, x in enumerate(t)]
    for (a, b), t in zip(model.pairs, model.pair_tables, strict=True):
        rows += [(FEATURES[a], i, least(model.pair_edges[a], i), FEATURES[b], j, least(model.pair_edges[b], j), float(x)) for (i, j), x in np.ndenumerate(t)]
    return spark.createDataFrame(rows, "feature string, bin int, least double, other string, other_bin int, other_least double, addend double")
