"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over a window of words; its hash ignores the words at the masked-out
places, so a substituted word there does not hide a match. Hashes of all windows of the test
items, for all masks, are joined with those of every window of every document; each hit names
a diagonal (place in the document minus place in the item), and of the whole diagonal the longest
stretch in which at most a quarter of the words is substituted is taken, wherever in it they lie; what is left of the diagonal on either
side of it is searched again.

The test side is dealt into blocks of at most about ``BLOCK_WORDS`` words, measured first; a block is a hash table of
bounded size, so it is broadcast and joined in one pass over the documents. Several blocks are several passes, one after the other,
each of which writes its rows and frees its broadcast, so a large benchmark costs more passes, not more memory. Nothing is shuffled.

A document is contaminated by an item if a stretch holds at least ``MIN_MATCHED`` equal
words, or, of a shorter item, all its words but the share that may differ (a quarter, rounded down). A row is returned for every such stretch, wherever the
substituted words lie: items of 4 to 7 and of 8 words have masks of their own for that.

Defined results: null texts have no words and match nothing; items without a word match nothing;
items shorter than the shortest mask are matched whole and exactly; repeated rows and items
each give their rows; null ids pass as they are; empty tables give an empty
result; other columns are not read, and pass through ``drop_contaminated`` whatever their names. Text that repeats itself meets an item that
does on as many diagonals as both have words, and gives a row for each.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.kernels import SLICE_BYTES, Texts, mix, stream, text_slices, words_of
from lamina.llm.rows import carried, schema_with
from lamina.session import stored

# 1 reads the word at that place of the window, 0 ignores it.
MASKS = ("1111", "110101", "1010011", "1100000101")
MASK_OF_EIGHT = "11011"
MIN_MATCHED = 12
MISMATCH_COST = 3  # equal words that a stretch must hold for each substituted one
BLOCK_WORDS = 1_000_000
_FILTER_BITS = 20
_HITS = 1 << 18

HIT_SCHEMA = "doc_id long, item_id long, first_word int, last_word int, matched int, substituted int, start int, stop int"


def masks_for(words: int) -> list[str]:
    """The masks for an item of so many words: whichever quarter of its words is substituted, one of them still fits somewhere."""
    if words < min(map(len, MASKS)):
        return ["1" * words] if words else []
    if words < 8:  # one may differ: all words but one
        return ["1" * k + "0" + "1" * (words - k - 1) for k in range(words)]
    return [*MASKS, *([MASK_OF_EIGHT] if words == 8 else [])]


def spaced_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the words that ``mask`` reads, at each place where the whole mask fits."""
    size = len(words) - len(mask) + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    factors = stream(int(mask, 2) + 1000 * len(mask), len(mask)) | np.uint64(1)  # a mask that begins with 0 has its own, too
    total = np.zeros(size, np.uint64)
    for k, read in enumerate(mask):
        if read == "1":
            total += words[k : k + size] * factors[k]
    return mix(total)


@dataclass
class TestBlock:
    """Items of one block: their words, and hash -> (item, place) for each mask, sorted by hash."""

    ids: list[int | None]
    words: list[np.ndarray]
    seeds: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def test_block(ids: list[int | None], texts: list[str | None]) -> TestBlock:
    words: list[np.ndarray] = []
    for part in text_slices(pa.array(texts, pa.large_string())):
        found = words_of(part)
        words += [found.hashes[a:b] for a, b in zip(found.bounds[:-1], found.bounds[1:], strict=True)]
    entries: dict[str, list[tuple[np.ndarray, int]]] = defaultdict(list)
    for k, own in enumerate(words):
        for mask in masks_for(len(own)):
            entries[mask].append((spaced_hashes(own, mask), k))
    seeds = {}
    for mask, found in entries.items():
        hashes = np.concatenate([h for h, _ in found])
        item = np.concatenate([np.full(len(h), k) for h, k in found])
        place = np.concatenate([np.arange(len(h)) for h, _ in found])
        order = np.argsort(hashes, kind="stable")
        filled = np.zeros(1 << _FILTER_BITS, bool)
        filled[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        seeds[mask] = hashes[order], item[order], place[order], filled
    return TestBlock(ids, words, seeds)


def longest_stretch(equal: np.ndarray) -> tuple[int, int]:
    """The longest stretch with ``MISMATCH_COST`` equal words or more to each other one, without other words at its ends.

    No such stretch has more equal words: a shorter one that had would have words to spare and could be extended.
    Of ties the first.
    """
    gain = np.concatenate([[0], np.cumsum(np.where(equal, 1, -MISMATCH_COST))])
    # the earliest place that is not above the gain at each end
    begin = np.searchsorted(-np.minimum.accumulate(gain), -gain)
    count = np.concatenate([[0], np.cumsum(equal)])
    stop = int((count - count[begin]).argmax())
    start = int(begin[stop])
    return start + int(equal[start:stop].argmax()) if stop > start else start, stop


def stretches(equal: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """The longest stretch, then those of what is left on its sides, while they hold ``least`` equal words."""
    open_parts = [(0, len(equal))]
    while open_parts:
        low, high = open_parts.pop()
        if high - low < least:
            continue
        start, stop = longest_stretch(equal[low:high])
        if stop > start and int(equal[low + start : low + stop].sum()) >= least:
            yield low + start, low + stop
            open_parts += [(low, low + start), (low + stop, high)]


def needed(words: int, min_matched: int) -> int:
    return min(min_matched, max(1, words - words // (MISMATCH_COST + 1))) if words >= min(map(len, MASKS)) else words


def slice_hits(texts: Texts, block: TestBlock, min_matched: int) -> Iterator[tuple]:
    """(text, item, first word, last word, matched, substituted, first byte, stop byte) of verified overlaps."""
    words = words_of(texts)
    seen = [np.zeros((0, 3), np.int64)]
    for mask, (hashes, items, places, filled) in block.seeds.items():
        own = spaced_hashes(words.hashes, mask)
        maybe = np.flatnonzero(filled[(own >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        low = np.searchsorted(hashes, own[maybe], "left")
        high = np.searchsorted(hashes, own[maybe], "right")
        text = np.searchsorted(words.bounds, maybe, "right") - 1
        inside = (high > low) & (maybe + len(mask) <= words.bounds[text + 1])
        maybe, low, high, text = (x[inside] for x in (maybe, low, high, text))
        at = np.concatenate([[0], np.cumsum(high - low)])
        for part in range(0, int(at[-1]), _HITS):
            # the hits [part, part + _HITS), each a row of the table for one window
            hit = np.arange(part, min(part + _HITS, int(at[-1])))
            window = np.searchsorted(at, hit, "right") - 1
            row = low[window] + hit - at[window]
            diagonal = maybe[window] - words.bounds[text[window]] - places[row]
            seen.append(np.unique(np.stack([text[window], items[row], diagonal], 1), axis=0))
    for t, item, diagonal in np.unique(np.concatenate(seen), axis=0).tolist():
        own, test = words.hashes[words.bounds[t] : words.bounds[t + 1]], block.words[item]
        a, b = max(0, diagonal), min(len(own), diagonal + len(test))
        equal = own[a:b] == test[a - diagonal : b - diagonal]
        at = words.bounds[t]
        for start, stop in stretches(equal, needed(len(test), min_matched)):
            first, last, matched = a + start, a + stop - 1, int(equal[start:stop].sum())
            yield t, item, first, last, matched, stop - start - matched, words.starts[at + first] - texts.offsets[t], words.ends[at + last] - texts.offsets[t]


def blocks_of(items: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[tuple[TestBlock, bool]]:
    """The test side in blocks whose words were counted first, and of each whether it is the only one."""
    narrow = items.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # a word takes two bytes at least, with what parts it from the next
    size = narrow.agg(F.sum(F.octet_length("text") / 2)).first()[0] or 0
    count = max(1, int(2 * size // block_words))
    for k in range(count):
        part = narrow if count == 1 else narrow.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k)
        rows = part.orderBy("item_id", "text").toArrow()
        if rows.num_rows:
            yield test_block(rows["item_id"].to_pylist(), rows["text"].to_pylist()), count == 1


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    min_matched: int = MIN_MATCHED,
    block_words: int = BLOCK_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """A row for each overlap of a document with an item; start and stop are bytes of the UTF-8 text."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    context = docs.sparkSession.sparkContext

    def search(shared) -> DataFrame:
        def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = shared.value
            types = [pa.int64(), pa.int64(), *[pa.int32()] * 6]
            names = [x.split()[0] for x in HIT_SCHEMA.split(", ")]
            for batch in batches:
                found = []
                for texts in text_slices(batch["text"], SLICE_BYTES):
                    for t, item, *rest in slice_hits(texts, block, min_matched):
                        found.append((batch["doc_id"][texts.first + t].as_py(), block.ids[item], *map(int, rest)))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), types, strict=True)], names
                    )

        return narrow.mapInArrow(hits, HIT_SCHEMA)

    found = []
    for block, only in blocks_of(items, item_id_col, item_text_col, block_words):
        shared = context.broadcast(block)
        found.append(search(shared) if only else stored(search(shared)))
        if not only:
            shared.unpersist()
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], HIT_SCHEMA)


def drop_contaminated(docs: DataFrame, items: DataFrame, min_matched: int = MIN_MATCHED, block_words: int = BLOCK_WORDS, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that overlap no item, all columns kept; each block of items is one filtering pass."""
    context = docs.sparkSession.sparkContext

    def clean(df: DataFrame, shared) -> DataFrame:
        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = np.zeros(batch.num_rows, bool)
                for texts in text_slices(batch["text"], SLICE_BYTES):
                    for t, *_ in slice_hits(texts, shared.value, min_matched):
                        hit[texts.first + t] = True
                yield batch.select(["row"]).filter(pa.array(~hit))

        inner = carried(df, F.col(text_col).alias("text"))
        return inner.mapInArrow(mark, schema_with(inner)).select("row.*")

    for block, only in blocks_of(items, "item_id", "text", block_words):
        shared = context.broadcast(block)
        docs = clean(docs, shared) if only else stored(clean(docs, shared))
        if not only:
            shared.unpersist()
    return docs
