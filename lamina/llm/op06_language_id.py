"""Language ID: multinomial naive Bayes over hashed character n-grams.

Counts of n-grams (1 to 3 characters, letters folded to lower case, all else a space, hashed to
``2 ** BITS`` buckets) are gathered by Spark for each language from a sample of about ``TRAIN_ROWS`` labelled rows, chosen by a
hash of the id, in which each language has about ``LEAST_ROWS`` rows, or all that it has. The matrix of log
probabilities has ``2 ** BITS`` rows and a column for each language, so it is broadcast
whatever the corpus holds: more than ``MAX_LANGUAGES`` languages are an error, never left out; a scoring task gathers its rows for a slice of texts and sums
them by text in numpy, ``GATHERED`` numbers (n-grams times languages) at a time, so its memory does not grow with the languages. Whole texts are scored, lang, source and id are not.

Defined results: a text that is null or has no letter is ``und`` with score 0; ties go to
the language first in alphabetical order; rows repeated or with a null id are scored like
any others; rows whose language is null teach nothing; without any labelled row every text is ``und``;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.char_grams import CharGrams
from lamina.llm.kernels import text_slices

BITS = 16
SIZES = (1, 2, 3)
TRAIN_ROWS = 20_000
LEAST_ROWS = 200
MAX_LANGUAGES = 256
GATHERED = 1 << 23
SMOOTHING = 0.5
UNKNOWN = "und"


@dataclass
class LanguageModel:
    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray  # bucket x language


def sampled(rows: DataFrame, bound: int, id_col: str) -> DataFrame:
    """About ``bound`` rows at most, chosen by a hash of the id, the same on every run."""
    total = rows.count()
    if total <= bound:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1_000_000)) < int(1e6 * bound / total))


def stratified(rows: DataFrame, counts: dict[str, int], bound: int, id_col: str, lang_col: str) -> DataFrame:
    """About ``bound`` rows, but of each language about ``LEAST_ROWS`` or all that there are, chosen by a hash of the id."""
    total = sum(counts.values())
    if total <= bound:
        return rows
    parts = [(k, int(1e6 * min(1.0, max(bound / total, LEAST_ROWS / n)))) for k, n in counts.items()]
    part = F.create_map(*[F.lit(x) for pair in parts for x in pair])[F.col(lang_col)]
    return rows.where(F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1_000_000)) < part)


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn from the rows of ``docs`` that have a language."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    per = rows.groupBy(F.col(lang_col).alias("lang")).count().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(per) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = [r.lang for r in per]
    place = {x: k for k, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((max(1, len(languages)), 1 << BITS), np.int64)
        for batch in batches:
            langs = np.array([place.get(x, -1) for x in batch["lang"].to_pylist()], np.int64)
            for texts in text_slices(batch["text"]):
                grams = CharGrams(texts)
                own = langs[texts.first : texts.first + len(texts)]
                for n in SIZES:
                    buckets, bounds = grams.hashed(n, BITS)
                    lang = np.repeat(own, np.diff(bounds))
                    for k in np.unique(own[own >= 0]):
                        totals[k] += np.bincount(buckets[lang == k], minlength=1 << BITS)
        lang, bucket = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(totals[lang, bucket])], ["lang", "bucket", "n"]
        )

    sample = stratified(rows, {r.lang: r["count"] for r in per}, train_rows, id_col, lang_col).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    found = sample.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = found.toArrow()  # at most languages x buckets rows
    totals = np.full((1 << BITS, max(1, len(languages))), SMOOTHING)
    np.add.at(totals, (table["bucket"].to_numpy(), table["lang"].to_numpy()), table["n"].to_numpy())
    prior = np.array([r["count"] for r in per] or [1], float)
    return LanguageModel(languages, np.log(prior / prior.sum()), np.log(totals / totals.sum(0)).astype(np.float32))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", *keep: Column) -> DataFrame:
    """doc_id, lang_pred, score for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = shared.value
        for batch in batches:
            names, scores = [], []
            for texts in text_slices(batch["text"]):
                grams = CharGrams(texts)
                total = np.tile(learned.log_prior, (len(texts), 1))
                for n in SIZES:
                    buckets, bounds = grams.hashed(n, BITS)
                    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
                    some = max(1, GATHERED // max(1, len(learned.languages)))
                    for at in range(0, len(buckets), some):
                        own = owner[at : at + some]
                        first = np.flatnonzero(np.diff(own, prepend=-1))
                        total[own[first]] += np.add.reduceat(learned.log_prob[buckets[at : at + some]], first, axis=0, dtype=np.float64)
                best = total.argmax(1)
                share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                known = grams.has_letter & bool(learned.languages)
                names += [learned.languages[b] if ok else UNKNOWN for b, ok in zip(best, known, strict=True)]
                scores.append(np.where(known, share, 0.0))
            if names:
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(names), pa.array(np.concatenate(scores))], ["doc_id", "lang_pred", "score"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(score, "doc_id long, lang_pred string, score double")
