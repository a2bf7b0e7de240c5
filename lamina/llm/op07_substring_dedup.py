"""Substring dedup by hashing lines, paragraphs and runs of sentences.

Texts are cut into units of one or more kinds, units are normalised and hashed; digests are grouped over
the whole table, the earliest occurrence by (doc_id, unit number) stays, and every later one
is removed. Offsets are characters of the original text.

* ``line``: what stands between line breaks; ``paragraph``: lines with no empty line between them. Normalised: lower case,
  runs of white space as one space, trimmed.
* ``passage``: from each start of a sentence the fewest whole sentences that have ``PASSAGE`` words or more. Normalised: the words
  alone, A-Z as a-z. Such runs overlap, so that a passage is found wherever it was put into a line. Sentences end at . ! ? and line breaks.

The first pass writes the units to the shared checkpoint folder. Digests are counted (map-side combined); units of
repeated digests are joined with the earliest place of each.

Skew: a digest with more than ``HOT_SHARE`` of all units is joined by broadcast (there can be
``1 / HOT_SHARE`` such digests at most), all others by shuffle.

Every removed character stands in an earlier place too, and the earliest place of all is kept: where two equal passages of one text
overlap (periodic text), only what reaches beyond the first is removed.

Defined results: null text has no units; every line or paragraph that holds more than white space counts, however short
(``min_words`` can spare shorter ones, and spares none unless it is given); rows repeated with the same id and text are compared
like any others, in the order of (doc_id, unit number), and of units that tie on both, all but one
are removed; a null id sorts first; an empty table gives an empty result; other columns pass as they are.
In scripts without spaces a line is one word, so only lines and paragraphs are compared there.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.kernels import Texts, mix, power, text_slices, words_of
from lamina.llm.rows import carried, free_name, quoted, schema_with
from lamina.operators.joins import HOT_SHARE, lookup_join
from lamina.session import stored

MIN_WORDS = 1
PASSAGE = 20
UNITS = {"line": re.compile(r"[^\n]+"), "paragraph": re.compile(r"[^\n]+(?:\n[^\n]+)*")}
KINDS = ("line", "paragraph", "passage")

_UNIT = "row long, doc_id long, kind byte, unit int, start int, stop int, words int, h1 long, h2 long"
_TYPES = [pa.int64(), pa.int64(), pa.int8(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
_NAMES = [x.split()[0] for x in _UNIT.split(", ")]
_DIGEST = ["h1", "h2"]

_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _block_units(texts: Texts, pattern: re.Pattern, min_words: int) -> list[np.ndarray]:
    """Columns text, unit, start, stop, words, h1, h2 of the units that ``pattern`` finds."""
    out, digests = [], []
    for t, (a, b) in enumerate(zip(texts.offsets[:-1], texts.offsets[1:], strict=True)):
        text = bytes(texts.data[a:b]).decode("utf-8", "replace")
        for k, found in enumerate(pattern.finditer(text)):
            words = found.group().lower().split()
            if len(words) >= min_words:
                digests.append(hashlib.blake2b(" ".join(words).encode(), digest_size=16).digest())
                out.append((t, k, found.start(), found.end(), len(words)))
    numbers = np.array(out, np.int64).reshape(-1, 5)
    return [*numbers.T, *np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2).T]


def _passage_units(texts: Texts, least: int) -> list[np.ndarray]:
    """The same columns of the runs of whole sentences that have ``least`` words or more."""
    words = words_of(texts)
    n = len(words.hashes)
    if not n:
        return [np.zeros(0, np.int64)] * 7
    ended = np.concatenate([[0], np.cumsum(_ENDS[texts.data])])
    begins = np.ones(n, bool)
    begins[1:] = ended[words.starts[1:]] > ended[words.ends[:-1]]
    begins[words.bounds[:-1][words.bounds[:-1] < n]] = True
    first = np.flatnonzero(begins)
    owner = np.searchsorted(words.bounds, first, "right") - 1
    number = np.arange(len(first)) - np.searchsorted(first, words.bounds[owner])
    edges = np.append(first, n)
    stop = edges[np.minimum(np.searchsorted(edges, first + least), len(edges) - 1)]
    whole = (stop <= words.bounds[owner + 1]) & (stop - first >= least)
    first, owner, number, stop = first[whole], owner[whole], number[whole], stop[whole]
    digests = []
    for seed in (0x51ED, 0xC0DE):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words.hashes + np.uint64(seed)) * power("up", n), dtype=np.uint64)])
        digests.append(mix((sums[stop] - sums[first]) * power("down", n)[first] + (stop - first).astype(np.uint64)).view(np.int64))
    # a run ends before the white space behind its last word
    blanks = np.append(np.flatnonzero(_BLANK[texts.data]), len(texts.data))
    last_byte = np.minimum(blanks[np.searchsorted(blanks, words.ends[stop - 1])], texts.offsets[owner + 1])
    characters = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
    begin = characters[texts.offsets[owner]]
    return [owner, number, characters[words.starts[first]] - begin, characters[last_byte] - begin, stop - first, *digests]


def text_units(
    docs: DataFrame, kinds: Sequence[str] = ("line",), min_words: int = MIN_WORDS, passage: int = PASSAGE, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None
) -> DataFrame:
    """A row for each unit - its place, offsets, digest - and one without digest for each row of ``docs``, whose ``stop`` is
    the length of the text. ``row`` numbers the rows, or is ``row_col``."""

    def cut_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch["doc_id"], batch["row"]
            for texts in text_slices(batch["text"]):
                n = len(texts)
                characters = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
                own = [np.arange(n), np.full(n, -1), np.zeros(n, int), np.diff(characters[texts.offsets]), np.zeros(n, int)]
                yield packed(texts, ids, rows, own, -1)
                for kind in kinds:
                    found = _passage_units(texts, passage) if kind == "passage" else _block_units(texts, UNITS[kind], min_words)
                    if len(found[0]):
                        yield packed(texts, ids, rows, found, KINDS.index(kind))

    def packed(texts: Texts, ids: pa.Array, rows: pa.Array, found: list[np.ndarray], kind: int) -> pa.RecordBatch:
        at = pa.array(texts.first + found[0])
        columns = [rows.take(at), ids.take(at), pa.array(np.full(len(at), kind, np.int8)), *[pa.array(x) for x in found[1:]]]
        columns += [pa.nulls(len(at), pa.int64())] * (len(_TYPES) - len(columns))
        return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)

    narrow = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"), F.col(text_col).alias("text")
    )
    return narrow.mapInArrow(cut_units, _UNIT)


def repeats(units: DataFrame, hot_share: float = HOT_SHARE) -> DataFrame:
    """Every unit whose digest occurs more than once, with the ``first`` place of its digest (a struct) and how many ``copies`` it has."""
    own = units.where(F.col("h1").isNotNull())
    total = own.count()
    often = own.groupBy(*_DIGEST).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    found = stored(lookup_join(own, stored(often), _DIGEST, "copies", total, hot_share))
    groups = found.groupBy(*_DIGEST, "copies").agg(F.min(F.struct("doc_id", "unit", "row", "stop")).alias("first"))
    return lookup_join(found.drop("copies"), stored(groups), _DIGEST, "copies", total, hot_share)


def with_removals(repeated: DataFrame) -> DataFrame:
    """``repeats`` and the boolean ``later``; in the text of its own first place a later unit begins where that ends."""
    later = F.struct("doc_id", "unit", "row") != F.struct("first.doc_id", "first.unit", "first.row")
    begin = F.when(later & (F.col("row") == F.col("first.row")), F.greatest("start", "first.stop")).otherwise(F.col("start"))
    return repeated.withColumn("later", later).withColumn("start", begin)


def repeated_units(
    docs: DataFrame, kind: str = "line", min_words: int = MIN_WORDS, hot_share: float = HOT_SHARE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A row for each unit to remove: doc_id, row, unit, start, stop, words, keep_id, keep_unit, copies."""
    units = stored(text_units(docs, [kind], min_words, id_col=id_col, text_col=text_col))
    return with_removals(repeats(units, hot_share)).where("later AND start < stop").select(
        "doc_id", "row", "unit", "start", "stop", "words",
        F.col("first.doc_id").alias("keep_id"), F.col("first.unit").alias("keep_unit"), "copies",
    )


def document_report(
    docs: DataFrame,
    kinds: Sequence[str] = ("line", "passage"),
    min_words: int = MIN_WORDS,
    passage: int = PASSAGE,
    hot_share: float = HOT_SHARE,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_col: str | None = None,
) -> DataFrame:
    """A row for each row of ``docs``: doc_id, row, n_chars, shares_passage (it has a unit of ``passage`` words or more that occurs more than
    once), removed (its stretches [start, stop) to remove, merged and in order), n_removed (characters in them)."""
    units = stored(text_units(docs, kinds, min_words, passage, id_col, text_col, row_col))
    repeated = with_removals(repeats(units, hot_share))
    along = Window.partitionBy("row").orderBy("start", "stop")
    reached = F.max(F.when(F.col("cuts"), F.col("stop"))).over(along.rowsBetween(Window.unboundedPreceding, -1))
    apart = (F.col("cuts") & F.coalesce(F.col("start") > reached, F.lit(True))).cast("int")
    stretches = (
        repeated.select("row", "start", "stop", "words", (F.col("later") & (F.col("start") < F.col("stop"))).alias("cuts"))
        .withColumn("apart", apart)
        .withColumn("part", F.sum("apart").over(along))
        .groupBy("row", "part")
        .agg(
            F.min(F.when(F.col("cuts"), F.col("start"))).alias("start"),
            F.max(F.when(F.col("cuts"), F.col("stop"))).alias("stop"),
            F.max("words").alias("words"),
        )
    )
    per_row = stretches.groupBy("row").agg(
        F.sort_array(F.collect_list(F.when(F.col("start").isNotNull(), F.struct("start", "stop")))).alias("removed"),
        F.sum(F.col("stop") - F.col("start")).alias("n_removed"),
        (F.max("words") >= passage).alias("shares_passage"),
    )
    rows = units.where(F.col("h1").isNull()).select("row", "doc_id", F.col("stop").alias("n_chars"))
    none = F.array().cast("array<struct<start:int,stop:int>>")
    return rows.join(per_row, "row", "left").select(
        "row",
        "doc_id",
        "n_chars",
        F.coalesce("shares_passage", F.lit(False)).alias("shares_passage"),
        F.coalesce("removed", none).alias("removed"),
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
    )


def drop_repeated(
    docs: DataFrame, kinds: Sequence[str] = ("line",), min_words: int = MIN_WORDS, passage: int = PASSAGE, id_col: str = "doc_id", text_col: str = "text", name: str = "removed"
) -> DataFrame:
    """``docs`` with every later occurrence cut out of its text, and the column ``removed`` (stretches of the original text, in order).

    A null text stays null; a text may become empty, and its row stays.
    """
    row = free_name("row", docs.columns)
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()))
    found = document_report(numbered, kinds, min_words, passage, id_col=id_col, text_col=text_col, row_col=row)
    spans = found.select(F.col("row").alias(row), F.col("removed").alias(name))
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    joined = numbered.select(*[F.col(quoted(c)) for c in [*kept, row]]).join(spans, row).drop(row)
    whole = carried(joined, F.col(text_col).alias("text"), F.col(quoted(name)).alias("spans"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, cuts in zip(batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True):
                at, parts = 0, []
                for s in cuts:
                    parts.append((text or "")[at : s["start"]])
                    at = s["stop"]
                texts.append(None if text is None else "".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(texts, pa.string())], ["row", "text"])

    cleaned = whole.mapInArrow(clean, schema_with(whole, "text string"))
    columns = [F.col("text").alias(c) if c.lower() == text_col.lower() else F.col("row")[c].alias(c) for c in kept]
    return cleaned.select(*columns, F.col("row")[name].alias(name))
