"""Suffix-array dedup with a sparse suffix array.

A repeated passage has at least ``LENGTH`` words. Suffixes are retained at minimiser positions: of the
``LENGTH - PREFIX + 1`` places in a window the one whose words hash least, the leftmost of
equals, so every passage holds a retained suffix whose first ``PREFIX`` words lie in it, chosen
by content and hence the same in each copy. A suffix is a row: the hash of its first
``PREFIX`` words and the ``REACH`` words on either side of them.

Suffixes are sorted over the whole table by range partitions, so a passage in a third of all
documents fills many partitions. Suffixes of one prefix lie together, in the order of the words to the right, then of
document and place. A suffix is compared with its neighbours, with the nearest one of another document on
either side (so that a document's own overlapping suffixes, as in periodic text, hide no other document) and with the earliest of the
neighbours that match, and each match is extended left and right. The same is done in the order of the words to the left. Work and
rows are linear in the suffixes: pairs of a group are never formed.

A task handles large groups in pieces and carries the suffixes that the next piece is compared with; the edges of partitions
are compared once more. Left order needs a whole prefix group: those that lie within a partition are sorted in the task, all others
- cut into pieces, or at a partition's edge - by a second range sort of the table's own, in the same way. So neither the size of a group
nor the partitions decide what is compared.

Of two suffixes that match, the later by (id, place) repeats the other. Matches along one diagonal are joined to whole
passages, and those within another one of the same two documents left out. Result: a row for each passage that repeats an earlier one: doc_id, first_word, last_word, source_id, source_word.

Defined results: null and empty texts and texts below ``LENGTH`` words repeat nothing; within
one document overlapping copies (periodic text) do not count; repeated rows with one id are one
document; rows with a null id are documents of their own, before all others, and carry null; ids must be above -2^62; an empty
table gives an empty result; other columns are not read.
Words are compared by hashes (64 bits in prefixes, 15 bits for each word beside them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.kernels import gram_hashes, stream, text_slices, words_of
from lamina.session import stored

LENGTH = 50
PREFIX = 25
GRAM = 5
REACH = 25
HOLD = 20_000  # suffixes of one prefix that a task handles at once
_NULL_IDS = -(1 << 62)  # rows without an id are numbered below this

_SUFFIX = "key long, right binary, left binary, doc_id long, place int"
_MATCH = "doc_id long, first_word int, last_word int, source_id long, source_word int"


def minimisers(order: np.ndarray, valid: np.ndarray, window: int) -> np.ndarray:
    """Places that are least in a window of ``window`` places whose start is ``valid``, the leftmost of equals."""
    at = np.arange(len(order), dtype=np.int32)
    width = 1
    while width < window:
        step = min(width, window - width)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(order[b] < order[a], b, a)
        width += step
    return np.unique(at[valid[: len(at)]])


def suffixes(docs: DataFrame, length: int, prefix: int, id_col: str, text_col: str) -> DataFrame:
    reach, window = length - prefix, length - prefix + 1
    factors = stream(61, prefix) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["doc_id"].to_numpy(zero_copy_only=False)
            for texts in text_slices(batch["text"]):
                words = words_of(texts)
                n = len(words.hashes)
                if n < length:
                    continue
                owner = np.repeat(np.arange(len(texts)), np.diff(words.bounds))
                stop = words.bounds[1:][owner]
                grams = gram_hashes(words.hashes, GRAM, seed=59)
                chosen = minimisers(grams, np.arange(n) + length <= stop, window)
                if not len(chosen):
                    continue
                # two bytes of each word; 0 is no word
                small = np.concatenate([[0], (words.hashes >> np.uint64(48)).astype(np.uint16) | 1]).astype(">u2")
                reachable = np.arange(reach)
                rows = 1 << 16
                for k in range(0, len(chosen), rows):
                    at = chosen[k : k + rows, None]
                    low, high = words.bounds[owner[at]], stop[at]
                    key = (words.hashes[at + np.arange(prefix)] * factors).sum(1, dtype=np.uint64)
                    left = at - 1 - reachable
                    right = at + prefix + reachable
                    sides = [small[np.where(ok, x + 1, 0)] for x, ok in ((right, right < high), (left, left >= low))]
                    packed = [pa.array(list(np.ascontiguousarray(x).view(f"V{2 * reach}").ravel().tolist()), pa.binary()) for x in sides]
                    own = owner[at[:, 0]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), *packed, pa.array(ids[texts.first + own]), pa.array((at[:, 0] - low[:, 0]).astype(np.int32))],
                        ["key", "right", "left", "doc_id", "place"],
                    )

    unnamed = F.lit(2 * _NULL_IDS) + F.monotonically_increasing_id()
    narrow = docs.select(F.coalesce(F.col(id_col).cast("long"), unnamed).alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, _SUFFIX)


class _Group:
    """Sorted suffixes: arrays of key, words on either side (nearest first), id and place."""

    def __init__(self, suffix: pa.Table, reach: int):
        self.key = suffix["key"].to_numpy()
        self.raw = {c: b"".join(suffix[c].to_pylist()) for c in ("right", "left")}
        self.right, self.left = (np.frombuffer(x, ">u2").reshape(-1, reach) for x in self.raw.values())
        self.doc, self.place = suffix["doc_id"].to_numpy(), suffix["place"].to_numpy().astype(np.int64)
        self.reach = reach

    def by_left(self) -> np.ndarray:
        words = np.frombuffer(self.raw["left"], f"S{2 * self.reach}") if len(self.key) else np.zeros(0, "S1")
        _, run = np.unique(self.key, return_inverse=True)
        return np.lexsort((self.place, self.doc, words, run))

    def common(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Equal words before and behind the prefixes of each pair."""
        found = []
        for words in (self.left, self.right):
            equal = np.ones((len(a), self.reach + 1), bool)
            equal[:, :-1] = (words[a] == words[b]) & (words[a] != 0)
            equal[:, -1] = False
            found.append(equal.argmin(1))
        return found[0], found[1]

    def matched(self, a: np.ndarray, b: np.ndarray, length: int, prefix: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Which of the pairs match, and their columns of _MATCH."""
        before, after = self.common(a, b)
        total = before + prefix + after
        apart = (self.doc[a] != self.doc[b]) | (np.abs(self.place[a] - self.place[b]) >= total)
        hit = (total >= length) & apart
        a, b, before, after = a[hit], b[hit], before[hit], after[hit]
        later = (self.doc[a] > self.doc[b]) | ((self.doc[a] == self.doc[b]) & (self.place[a] > self.place[b]))
        copy, source = np.where(later, a, b), np.where(later, b, a)
        return hit, [self.doc[copy], self.place[copy] - before, self.place[copy] + prefix + after - 1, self.doc[source], self.place[source] - before]

    def matches(self, order: np.ndarray, length: int, prefix: int) -> list[np.ndarray]:
        """Columns of _MATCH from what is compared along ``order``."""
        n = len(order)
        if n < 2:
            return [np.zeros(0, np.int64)] * 5
        key, doc, at = self.key[order], self.doc[order], np.arange(n)
        new_key = np.append(True, key[1:] != key[:-1])
        new_doc = new_key | np.append(True, doc[1:] != doc[:-1])
        # stretches of suffixes of one document; the k-th of one is compared with the k-th of another, so that periodic text stays on one diagonal
        stretch = np.cumsum(new_doc) - 1
        begin = np.flatnonzero(new_doc)
        size = np.diff(np.append(begin, n))
        number = at - begin[stretch]

        def partner(other: np.ndarray) -> np.ndarray:
            other = np.clip(other, 0, len(begin) - 1)
            return begin[other] + number % size[other]

        where = (stretch << 33) + self.place[order]
        far = np.searchsorted(where, where - (2 * self.reach + prefix), "right") - 1  # of one document, beyond its own overlap
        found, linked = [], np.zeros(n, bool)

        def compare(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            same = (key[a] == key[b]) & (a != b)
            a, b = a[same], b[same]
            hit, columns = self.matched(order[a], order[b], length, prefix)
            found.append(columns)
            return b[hit]

        linked[compare(at[:-1], at[1:])] = True
        some = at[~(new_key & np.append(new_key[1:], True))]  # not alone with their prefix
        before, behind = partner(stretch - 1), partner(stretch + 1)
        linked[compare(before[some[before[some] < some - 1]], some[before[some] < some - 1])] = True
        for other in (behind, np.maximum(far, begin[stretch])):
            more = some[np.abs(other[some] - some) > 1]
            compare(other[more], more)
        # the earliest of those that are linked with one before
        run = np.cumsum(new_key | ~(linked | ~new_doc))
        rank = np.empty(n, np.int64)
        rank[np.lexsort((self.place[order], doc))] = at
        least = np.empty(n, np.int64)
        least[rank] = at
        first = partner(stretch[least[np.minimum.reduceat(rank, np.flatnonzero(np.append(True, run[1:] != run[:-1])))][run - 1]])
        more = some[np.abs(first[some] - some) > 1]
        compare(first[more], more)
        return [np.concatenate(column) for column in zip(*found, strict=True)]

    def carry(self, hold: int) -> np.ndarray:
        """The suffixes of the last prefix that what follows must be compared with: its earliest, the last one of the last other
        document, and those of the last document."""
        n = len(self.key)
        own = int(np.flatnonzero(np.append(True, self.key[1:] != self.key[:-1]))[-1])
        last = int(np.flatnonzero(np.append(True, self.doc[1:] != self.doc[:-1]))[-1])
        last = max(last, own, n - max(1, hold // 4))
        earliest = own + int(np.lexsort((self.place[own:], self.doc[own:]))[0])
        return np.unique(np.concatenate([[earliest, max(own, last - 1)], np.arange(last, n)]))


def compared(sorted_suffixes: DataFrame, side: str, length: int, prefix: int, hold: int, edges: bool) -> DataFrame:
    """Matches within partitions sorted by (key, ``side``, doc_id, place).

    With ``edges`` also suffixes: as ``part`` 1 those at the edges of a partition, and, in right order, as 2 those of groups that
    may not be whole, whose left order is still to be compared.
    """
    reach = length - prefix
    names = ["key", "right", "left", "doc_id", "place"]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32()]
    match_names = [x.split()[0] for x in _MATCH.split(", ")]
    match_kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
    all_names = ["part", *match_names, *[f"s_{n}" for n in names]]

    def found(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        n = len(columns[0])
        if n:
            own = [pa.array(c).cast(t) for c, t in zip(columns, match_kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int8)), *own, *[pa.nulls(n, t) for t in kinds]], all_names)

    def passed(part: int, suffix: pa.Table) -> Iterator[pa.RecordBatch]:
        n = suffix.num_rows
        if n:
            own = [suffix[c].combine_chunks() for c in names]
            own = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in own]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int8)), *[pa.nulls(n, t) for t in match_kinds], *own], all_names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        carried = 0  # of the held suffixes, those that were compared before
        opening = True  # the first group may have begun in the partition before

        def piece(table: pa.Table, whole: bool) -> Iterator[pa.RecordBatch]:
            """Compare; the groups at either end of ``table`` are whole unless ``opening``, ``carried`` or not ``whole``."""
            group = _Group(table, reach)
            yield from found(group.matches(np.arange(table.num_rows), length, prefix))
            if side == "left" or not edges:
                return
            key = group.key
            split = np.zeros(len(key), bool)
            if opening or carried:
                split |= key == key[0]
            if not whole:
                split |= key == key[-1]
            own = split.copy()
            own[:carried] = False
            yield from passed(2, table.filter(pa.array(own)))
            rest = np.flatnonzero(~split)
            if len(rest) > 2 and (key[rest[2:]] == key[rest[:-2]]).any():
                order = group.by_left()
                yield from found(group.matches(order[~split[order]], length, prefix))

        first = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            if first is None and edges:
                docs = now["doc_id"].to_numpy()
                first = now.slice(0, 1 + int(np.argmax(docs != docs[0])))
                yield from passed(1, pa.concat_tables([first.slice(0, 1), first.slice(first.num_rows - 1)]))
            held = now if held is None else pa.concat_tables([held, now])
            key = held["key"].to_numpy()
            till = int(np.flatnonzero(np.append(True, key[1:] != key[:-1]))[-1])
            if till:
                yield from piece(held.slice(0, till), True)
                held, carried, opening = held.slice(till), 0, False
            if held.num_rows - carried > hold:
                yield from piece(held, False)
                kept = _Group(held, reach).carry(hold)
                held, carried = held.take(pa.array(kept)).combine_chunks(), len(kept)
        if held is not None:
            yield from piece(held, False)
            if edges:
                kept = _Group(held, reach).carry(hold)
                yield from passed(1, held.take(pa.array(np.unique([*kept[:2], kept[-1]]))))

    schema = f"part byte, {_MATCH}, " + ", ".join(f"s_{x}" for x in _SUFFIX.split(", "))
    return sorted_suffixes.mapInArrow(run, schema)


def _in_order(suffix: DataFrame, side: str, length: int, prefix: int, hold: int) -> tuple[DataFrame, DataFrame]:
    """Matches along one order of the whole table, and the suffixes whose other order is still to be compared."""
    order = ["key", side, "doc_id", "place"]
    found = stored(compared(suffix.repartitionByRange(*order).sortWithinPartitions(*order), side, length, prefix, hold, edges=True))
    names = [x.split()[0] for x in _SUFFIX.split(", ")]
    columns = [x.split()[0] for x in _MATCH.split(", ")]
    passed = lambda part: found.where(F.col("part") == part).select(*[F.col(f"s_{n}").alias(n) for n in names])
    edge = passed(1).distinct().repartition("key").sortWithinPartitions(*order)
    across = compared(edge, side, length, prefix, hold, edges=False)
    matches = found.where("part = 0").select(columns).unionByName(across.where("part = 0").select(columns))
    return matches, passed(2)


def repeated_passages(docs: DataFrame, length: int = LENGTH, prefix: int = PREFIX, hold: int = HOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, first_word, last_word, source_id, source_word of each passage that repeats another."""
    right, split = _in_order(suffixes(docs, length, prefix, id_col, text_col), "right", length, prefix, hold)
    left, _ = _in_order(split, "left", length, prefix, hold)
    matches = right.unionByName(left)
    diagonal = (F.col("source_word") - F.col("first_word")).alias("shift")
    along = Window.partitionBy("doc_id", "source_id", "shift").orderBy("first_word", "last_word")
    reached = F.max("last_word").over(along.rowsBetween(Window.unboundedPreceding, -1))
    joined = (
        matches.select("doc_id", "source_id", diagonal, "first_word", "last_word")
        .withColumn("new", F.coalesce(F.col("first_word") > reached + 1, F.lit(True)).cast("int"))
        .withColumn("part", F.sum("new").over(along))
        .groupBy("doc_id", "source_id", "shift", "part")
        .agg(F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"))
    )
    # periodic text matches along many diagonals: what lies within another passage of the same two documents says no more
    wider = Window.partitionBy("doc_id", "source_id").orderBy("first_word", F.desc("last_word"), "shift").rowsBetween(Window.unboundedPreceding, -1)
    joined = joined.withColumn("wider", F.max("last_word").over(wider)).where("wider IS NULL OR last_word > wider")
    named = lambda c: F.when(F.col(c) > _NULL_IDS, F.col(c)).alias(c)
    return joined.select(named("doc_id"), "first_word", "last_word", named("source_id"), (F.col("first_word") + F.col("shift")).alias("source_word"))
