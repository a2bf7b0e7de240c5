"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct hashed n-grams (3 to 6 folded characters, spaces at word
ends) of a text. Spark counts in how many toxic and in how many other texts of the sample
each bucket occurs; the ratio of the two smoothed rates gives the scale of the feature.
The ``features`` buckets whose counts tell the classes apart best (a parameter of the model like the ``2 ** BITS`` buckets; README has figures
of other values) are kept, and a logistic regression over the scaled features is fitted on at most about ``TRAIN_ROWS`` labelled rows.
Scoring reads whole texts; the model is a table of ``2 ** BITS`` places, so it is broadcast
whatever the corpus holds.

Defined results: null and empty texts have no features and score the fitted base rate;
of several labels of one id the highest counts; rows repeated or with a null id are scored
like any others; without a feature every text scores the base rate; without labelled rows of both classes every score is 0; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.char_grams import CharGrams
from lamina.llm.kernels import SLICE_BYTES, Texts, text_slices
from lamina.llm.op06_language_id import sampled
from lamina.llm.rows import carried, schema_with
from lamina.session import stored

BITS = 20
SIZES = (3, 4, 5, 6)
FEATURES = 4096
TRAIN_ROWS = 30_000
SMOOTHING = 1.0
THRESHOLD = 0.3
PENALTY = 1e-4
STEPS = 300
RATE = 0.02


@dataclass
class ToxicityModel:
    place: np.ndarray  # of each bucket among the features, or -1
    weights: np.ndarray  # times the log-count ratio
    bias: float


def _distinct(grams: CharGrams, place: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs: features are places if a table of them is given, else buckets."""
    codes = []
    for n in SIZES:
        buckets, bounds = grams.hashed(n, BITS)
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        if place is not None:
            chosen = place[buckets]
            hit = chosen >= 0
            owner, buckets = owner[hit], chosen[hit].astype(np.int64)
        codes.append(owner << 32 | buckets)
    pairs = np.unique(np.concatenate(codes))
    return pairs >> 32, pairs & 0xFFFFFFFF


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[Texts, CharGrams]]:
    for texts in text_slices(batch["text"], SLICE_BYTES // 4):  # four n-gram sizes at once
        yield texts, CharGrams(texts)


def fit(
    docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, features: int = FEATURES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> ToxicityModel:
    """Learn from the rows of ``docs`` whose id has a label."""
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id"))
    bounded = sampled(marked.agg(F.max(label_col).cast("int").alias("label")), train_rows, "id")
    # at most about train_rows pairs of numbers, so the texts stay where they are
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(bounded), "id")
    rows = rows.repartition(16, "id").select("label", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            label = np.array(batch["label"].to_pylist(), np.int64) > 0
            for texts, grams in _slices(batch):
                owner, bucket = _distinct(grams, None)
                toxic = label[texts.first + owner]
                for k in (0, 1):
                    seen[k] += np.bincount(bucket[toxic == k], minlength=1 << BITS).astype(np.int32)
        some = np.flatnonzero(seen.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (some, seen[0, some], seen[1, some])], ["bucket", "clean", "toxic"])

    counted = rows.mapInArrow(count, "bucket int, clean int, toxic int").groupBy("bucket").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")
    )
    sizes = {r.label: r.n for r in rows.groupBy((F.col("label") > 0).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n_clean, n_toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not n_clean or not n_toxic:
        return ToxicityModel(np.full(1 << BITS, -1, np.int32), np.zeros(1), float("-inf"))
    share = n_toxic / (n_clean + n_toxic)
    part = lambda seen, expected: F.when(F.col(seen) > 0, F.col(seen) * F.log(F.col(seen) / expected)).otherwise(0.0)
    both = F.col("clean") + F.col("toxic")
    gain = part("toxic", both * share) + part("clean", both * (1 - share))
    rated = stored(counted.select("bucket", "clean", "toxic", gain.alias("gain"), F.floor(16 * F.log2(F.greatest(gain, F.lit(2.0**-16)))).alias("grade")))
    # grades are few hundred: the least one that is needed for so many features
    grades = sorted(((r.grade, r["count"]) for r in rated.groupBy("grade").count().collect()), reverse=True)
    reached = np.cumsum([n for _, n in grades])
    least = grades[min(int(np.searchsorted(reached, features)), len(grades) - 1)][0] if grades else 0
    chosen = rated.where(F.col("grade") >= least).toArrow().sort_by([("gain", "descending"), ("bucket", "ascending")]).slice(0, features)
    if not chosen.num_rows:
        return ToxicityModel(np.full(1 << BITS, -1, np.int32), np.zeros(1), float(np.log(n_toxic / n_clean)))
    buckets = chosen["bucket"].to_numpy()
    clean, toxic = chosen["clean"].to_numpy(), chosen["toxic"].to_numpy()
    ratio = np.log((toxic + SMOOTHING) / (n_toxic + 2 * SMOOTHING)) - np.log((clean + SMOOTHING) / (n_clean + 2 * SMOOTHING))
    place = np.full(1 << BITS, -1, np.int32)
    place[buckets] = np.arange(len(buckets), dtype=np.int32)
    shared = docs.sparkSession.sparkContext.broadcast(place)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = (np.array(batch["label"].to_pylist(), np.int64) > 0).astype(np.int8)
            for texts, grams in _slices(batch):
                owner, feature = _distinct(grams, shared.value)
                ends = np.searchsorted(owner, np.arange(len(texts) + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(feature.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(label[texts.first : texts.first + len(texts)]), lists], ["label", "features"])

    # at most about train_rows rows of features of the chosen few; their order does not matter to the fit
    table = rows.mapInArrow(vectors, "label tinyint, features array<int>").toArrow()
    lists = table["features"].combine_chunks()
    y = table["label"].to_numpy().astype(float)
    owner = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
    weights, bias = _logistic(owner, lists.values.to_numpy().astype(np.int64), ratio, y)
    return ToxicityModel(place, weights * ratio, bias)


def _logistic(owner: np.ndarray, feature: np.ndarray, ratio: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Gradient descent with adaptive steps on the penalised mean log loss of features worth ``ratio`` each."""
    n, scale = len(y), ratio[feature]
    at = np.zeros(len(ratio) + 1)  # the weights, then the bias
    mean, square = np.zeros_like(at), np.zeros_like(at)
    for step in range(1, STEPS + 1):
        z = np.bincount(owner, at[feature] * scale, n) + at[-1]
        miss = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        slope = np.append(np.bincount(feature, miss[owner] * scale, len(ratio)), miss.sum())
        slope[:-1] += PENALTY * at[:-1]
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope**2
        at -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    return at[:-1], float(at[-1])


def toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` narrowed to doc_id, and its score from 0 to 1."""
    narrow = docs.select(F.struct(F.col(id_col).cast("long").alias("doc_id")).alias("row"), F.col(text_col).alias("text"))
    return _scored(narrow, model).select("row.doc_id", "score")


def _scored(rows: DataFrame, model: ToxicityModel) -> DataFrame:
    """The struct ``row`` of ``rows`` (that have a column text, too) and a column score."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = shared.value
        for batch in batches:
            scores = [np.zeros(0)]
            for texts, grams in _slices(batch):
                owner, feature = _distinct(grams, learned.place)
                z = np.bincount(owner, learned.weights[feature], len(texts)) + learned.bias
                scores.append(np.exp(-np.logaddexp(0, -z)))
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(np.concatenate(scores))], ["row", "score"])

    return rows.mapInArrow(score, schema_with(rows, "score double"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns kept."""
    inner = carried(docs, F.col(text_col).alias("text"))
    return _scored(inner, model).where(F.col("score") < threshold).select("row.*")
