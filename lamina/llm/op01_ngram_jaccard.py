"""N-gram Jaccard self-join with Bayesian candidate pruning.

Documents are sets of hashed word 5-grams; two documents are linked if the Jaccard
similarity of their sets is 0.8 or more.

1. One pass makes a MinHash signature and a digest of the set of each text. Equal sets are one
   class representative (the least id) and its copies.
2. Bands of the signature bucket the representatives. In a bucket of at most ``SMALL`` the signatures of pairs are compared ``STEP`` values at a time, and a pair is
   dropped when the posterior probability (uniform prior) that its similarity reaches the threshold falls below ``TOLERANCE``. A bucket
   gives a forest of the pairs left, so its rows grow with its size, not with the square. A larger bucket gives edges to its least member unpruned; step 3 prunes these.
3. Connected components of these edges hold every link. A component is cut into blocks of about ``BLOCK_BYTES`` of text and
   ``BLOCK`` texts on average (rows go to blocks by hash), every pair of blocks being one unit of work, so no component, however large, meets in
   one task. Only signatures (384 bytes) are dealt to all units of their block; a text goes to the units in which the pruning leaves it a partner, and one
   of a component of one block, as most are, is dealt once. In a unit, tiles of ``TILE`` texts are compared: the signatures
   prune all pairs incrementally as above, and the rest are verified exactly by the sizes of intersection and union. A unit returns
   a row for each text (its links and the least text it reaches), not its pairs.
4. Components over verified links give the classes.

Result: a row for each document: doc_id, class_id (least id reached over links and
copies), rep_id (least id of its set), n_links (other representatives it is
linked with), n_copies (documents with its set, itself included).

Defined results: a text of 1 to 4 words is one shingle of all of them; one without words, null or
empty, is linked with nothing and a class of its own; rows repeated with one id are copies; a null id shares the class of
the other documents with its set, else its class is null; an id must name one text; an empty table gives an empty result;
other columns are not read. A group of many near copies costs work that grows with the
square of the representatives in it (as exact counts of links must), and its texts are dealt to all units in which they have partners; memory is
that of two blocks, and of the longest text.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.kernels import minhash, shingles_of, text_slices, words_of
from lamina.llm.rows import free_name
from lamina.operators.graph import connected_components
from lamina.operators.joins import lookup_join
from lamina.session import cut

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
STEP = 16
TOLERANCE = 1e-5
SMALL = 4096
BLOCK = 1024
BLOCK_BYTES = 4 << 20
TILE = 256
_COLUMNS = 4096


def needed_matches(compared: int, threshold: float, tolerance: float) -> int:
    """Fewest equal values of ``compared`` with which a pair stays.

    With a uniform prior, P(similarity >= threshold | m of n equal) = P(Binomial(n + 1, threshold) <= m).
    """
    total = 0.0
    for m in range(compared + 1):
        total += math.comb(compared + 1, m) * threshold**m * (1 - threshold) ** (compared + 1 - m)
        if total >= tolerance:
            return m
    return compared


def plausible(left: np.ndarray, right: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """Rows whose signatures stay plausible at every step."""
    alive = np.arange(len(left))
    equal = np.zeros(len(left), np.int64)
    for at in range(0, left.shape[1], STEP):
        equal[alive] += (left[alive, at : at + STEP] == right[alive, at : at + STEP]).sum(1)
        alive = alive[equal[alive] >= needed_matches(min(at + STEP, left.shape[1]), threshold, tolerance)]
    return alive


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """doc_id, digest of the shingle set (null without words), signature."""
    size = BANDS * ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in text_slices(batch["text"]):
                shingles, bounds = shingles_of(words_of(texts), words)
                signature = minhash(shingles, bounds, size)
                digests = [
                    hashlib.blake2b(np.unique(shingles[a:b]).tobytes(), digest_size=16).digest() if b > a else None
                    for a, b in zip(bounds[:-1], bounds[1:], strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(texts.first, len(texts)), pa.array(digests, pa.binary()), pa.array([r.tobytes() for r in signature], pa.binary())],
                    ["doc_id", "digest", "signature"],
                )

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, digest binary, signature binary")


def candidate_edges(reps: DataFrame, threshold: float, tolerance: float, small: int = SMALL) -> DataFrame:
    """(a, b): a forest of the plausible pairs of each bucket, and a star for each of more than ``small``."""
    width = 4 * ROWS
    keys = F.array(*[F.xxhash64(F.lit(k), F.substring("signature", k * width + 1, width)) for k in range(BANDS)])
    banded = cut(reps.select("rep_id", F.explode(keys).alias("bucket")))
    sizes = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("rep_id").alias("pivot")).where("size > 1")
    members = cut(lookup_join(banded, sizes, "bucket", "size", banded.count()))
    stars = members.where((F.col("size") > small) & (F.col("rep_id") != F.col("pivot"))).select(F.col("pivot").alias("a"), F.col("rep_id").alias("b"))
    # bands often gather the same rows: each set of them is looked at once
    sets = members.where(F.col("size") <= small).groupBy("bucket").agg(F.sort_array(F.collect_list("rep_id")).alias("ids")).select("ids").distinct()
    gathered = sets.select(F.xxhash64("ids").alias("part"), F.explode("ids").alias("rep_id")).join(reps.select("rep_id", "signature"), "rep_id")

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, signatures in _grouped(batches, 1):
            a, b = _plausible_forest(signatures, threshold, tolerance)
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

    ordered = gathered.select("part", "rep_id", "signature").repartition("part").sortWithinPartitions("part", "rep_id")
    return ordered.mapInArrow(prune, "a long, b long").union(stars).distinct()


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, signatures) of each run of equal keys, the first columns of rows that are sorted by them."""
    held: list[pa.RecordBatch] = []

    def joined() -> tuple[np.ndarray, np.ndarray]:
        rows = pa.Table.from_batches(held)
        signatures = np.frombuffer(b"".join(rows["signature"].to_pylist()), np.uint32).reshape(rows.num_rows, BANDS * ROWS)
        return rows["rep_id"].to_numpy(), signatures

    for batch in batches:
        if not batch.num_rows:
            continue
        own = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)])
        edges = [0, *(np.flatnonzero((own[:, 1:] != own[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for start, stop in zip(edges[:-1], edges[1:], strict=True):
            if held and any(held[0].column(k)[0].as_py() != own[k, start].item() for k in range(keys)):
                yield joined()
                held = []
            held.append(batch.slice(start, stop - start))
    if held:
        yield joined()


def _plausible_forest(signatures: np.ndarray, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) that join what plausible pairs join: from each row in turn to those rows that none before reached."""
    away = np.arange(1, len(signatures))
    queue, a, b = [0], [], []
    while queue or len(away):
        if not queue:  # what is left is apart from all so far
            queue, away = [int(away[0])], away[1:]
        at = queue.pop()
        if not len(away):
            break
        near = plausible(np.broadcast_to(signatures[at], (len(away), signatures.shape[1])), signatures[away], threshold, tolerance)
        reached = away[near]
        a += [at] * len(reached)
        b += reached.tolist()
        queue += reached.tolist()
        away = np.delete(away, near)
    return np.array(a, np.int64), np.array(b, np.int64)


class _Sets:
    """Shingle sets of some texts, and what pairs of them need."""

    def __init__(self, texts: list[str], words: int):
        self.sets: list[np.ndarray] = []
        rows = []
        for part in text_slices(pa.array(texts, pa.large_string())):
            shingles, bounds = shingles_of(words_of(part), words)
            rows.append(minhash(shingles, bounds, BANDS * ROWS))
            self.sets += [np.unique(shingles[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self.signature = np.concatenate(rows)
        self.sizes = np.array([len(s) for s in self.sets], np.int64)

    def plausible_pairs(self, left: np.ndarray, right: np.ndarray, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs a < b (or across, if the sides differ) that the first step and then the others leave."""
        equal = np.zeros((len(left), len(right)), np.int16)
        for k in range(STEP):
            equal += self.signature[left, k][:, None] == self.signature[right, k][None, :]
        a, b = np.nonzero(equal >= needed_matches(STEP, threshold, tolerance))
        a, b = left[a], right[b]
        if left is right:
            a, b = a[a < b], b[a < b]
        small, large = np.minimum(self.sizes[a], self.sizes[b]), np.maximum(self.sizes[a], self.sizes[b])
        able = small >= threshold * large  # else the union is too large
        a, b = a[able], b[able]
        kept = [np.zeros(0, np.int64)]
        for at in range(0, len(a), 1 << 16):
            part = slice(at, at + (1 << 16))
            kept.append(at + plausible(self.signature[a[part]], self.signature[b[part]], threshold, tolerance))
        alive = np.concatenate(kept)
        return a[alive], b[alive]

    def intersections(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sizes of the intersections, by set operations or, of many pairs, by products of incidence matrices."""
        some, places = np.unique(np.concatenate([a, b]), return_inverse=True)
        n = len(some)
        if len(a) <= 4 * n:
            return np.array([len(np.intersect1d(self.sets[x], self.sets[y], assume_unique=True)) for x, y in zip(a, b, strict=True)], np.int64)
        a, b = places[: len(a)], places[len(a) :]
        owner = np.repeat(np.arange(n), self.sizes[some])
        _, column, seen = np.unique(np.concatenate([self.sets[k] for k in some]), return_inverse=True, return_counts=True)
        shared = seen > 1
        number = np.cumsum(shared) - 1
        own = shared[column]
        owner, column = owner[own], number[column[own]]
        total = np.zeros((n, n), np.float32)
        for at in range(0, int(shared.sum()), _COLUMNS):
            some = (column >= at) & (column < at + _COLUMNS)
            has = np.zeros((n, _COLUMNS), np.float32)
            has[owner[some], column[some] - at] = 1
            total += has @ has.T
        return total[a, b].astype(np.int64)


def _unit_links(ids: np.ndarray, side: np.ndarray, texts: list[str], diagonal: bool, words: int, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each text of a unit of work, and the least id it reaches in it."""
    sets = _Sets(texts, words)
    tiles = [[own[k : k + TILE] for k in range(0, len(own), TILE)] for own in (np.flatnonzero(side == 0), np.flatnonzero(side == 1))]
    if diagonal:
        pairs = [(left, right) for k, left in enumerate(tiles[0]) for right in tiles[0][k:]]
    else:
        pairs = [(left, right) for left in tiles[0] for right in tiles[1]]
    links, root = np.zeros(len(ids), np.int64), ids.copy()
    linked_pairs = []
    for left, right in pairs:
        a, b = sets.plausible_pairs(left, right, threshold, tolerance)
        if not len(a):
            continue
        shared = sets.intersections(a, b)
        linked = shared >= threshold * (sets.sizes[a] + sets.sizes[b] - shared) - 1e-9
        a, b = a[linked], b[linked]
        links += np.bincount(a, minlength=len(ids)) + np.bincount(b, minlength=len(ids))
        linked_pairs.append(_forest(a, b, len(ids)))
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*linked_pairs, strict=True)) if linked_pairs else (np.zeros(0, np.int64),) * 2
    while len(a):
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        if (before == root).all():
            break
    return links, root


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text that the pairs join, and the least place that it reaches: at most ``n`` pairs with the same components."""
    root = np.arange(n)
    while len(a):
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (before == root).all():
            break
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]


def dealt_to_units(texts: DataFrame, block: int, block_bytes: int, payload: str = "text") -> DataFrame:
    """(component, rep_id, size, bytes, ``payload``) dealt to pairs of blocks: component, i, j, side, rep_id, ``payload``."""
    own = F.pmod(F.xxhash64("rep_id"), F.col("blocks")).cast("int")
    return (
        texts.withColumn("blocks", _blocks(block, block_bytes))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "component",
            F.least("own", "other").alias("i"),
            F.greatest("own", "other").alias("j"),
            (F.col("own") > F.col("other")).cast("int").alias("side"),
            "rep_id",
            payload,
        )
    )


def _blocks(block: int, block_bytes: int) -> Column:
    return F.greatest(F.ceil(F.greatest(F.col("size") / block, F.col("bytes") / block_bytes)).cast("int"), F.lit(1))


def units_with_partners(dealt: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(component, i, j, side, rep_id) of the dealt signatures to which the pruning leaves a partner in their unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None

        def flush() -> pa.RecordBatch:
            side = np.array([r[0] for r in held], np.int64)
            ids = np.array([r[1] for r in held], np.int64)
            signature = np.frombuffer(b"".join(r[2] for r in held), np.uint32).reshape(len(held), BANDS * ROWS)
            kept = np.flatnonzero(_has_partner(signature, side, now[1] == now[2], threshold, tolerance))
            head = [pa.array(np.full(len(kept), v), t) for v, t in zip(now, (pa.int64(), pa.int32(), pa.int32()), strict=True)]
            return pa.RecordBatch.from_arrays([*head, pa.array(side[kept], pa.int32()), pa.array(ids[kept])], ["component", "i", "j", "side", "rep_id"])

        for batch in batches:
            for c, i, j, side, rep, signature in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                if (c, i, j) != now:
                    if held:
                        yield flush()
                    held, now = [], (c, i, j)
                held.append((side, rep, signature))
        if held:
            yield flush()

    units = dealt.select("component", "i", "j", "side", "rep_id", "signature").repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "rep_id")
    return units.mapInArrow(run, "component long, i int, j int, side int, rep_id long")


def _has_partner(signature: np.ndarray, side: np.ndarray, diagonal: bool, threshold: float, tolerance: float) -> np.ndarray:
    """Whether a plausible pair of the unit holds a row; a tile of rows at a time, each pair until one of its rows' tiles is done."""
    found = np.zeros(len(side), bool)
    least = needed_matches(STEP, threshold, tolerance)
    left, right = (np.flatnonzero(side == 0),) * 2 if diagonal else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    for x in range(0, len(left), TILE):
        for y in range(0, len(right), TILE):
            rows, columns = left[x : x + TILE], right[y : y + TILE]
            if found[rows].all() and found[columns].all():
                continue
            equal = np.zeros((len(rows), len(columns)), np.int16)
            for k in range(STEP):
                equal += signature[rows, k][:, None] == signature[columns, k][None, :]
            a, b = np.nonzero(equal >= least)
            a, b = rows[a], columns[b]
            open_pairs = (a != b) & ~(found[a] & found[b])
            a, b = a[open_pairs], b[open_pairs]
            kept = plausible(signature[a], signature[b], threshold, tolerance)
            found[a[kept]] = found[b[kept]] = True
    return found


def verified_links(dealt: DataFrame, words: int, threshold: float, tolerance: float) -> DataFrame:
    """(rep_id, links, root) rows from the units of work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        now = None

        def flush() -> pa.RecordBatch:
            ids = np.array([r[0] for r in waiting], np.int64)
            side = np.array([r[1] for r in waiting], np.int64)
            links, root = _unit_links(ids, side, [r[2] for r in waiting], now[1] == now[2], words, threshold, tolerance)
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(root)], ["rep_id", "links", "root"])

        for batch in batches:
            for c, i, j, side, rep, text in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                if (c, i, j) != now:
                    if waiting:
                        yield flush()
                    waiting, now = [], (c, i, j)
                if not waiting or waiting[-1][0] != rep:  # a repeated row has the same text
                    waiting.append((rep, side, text))
        if waiting:
            yield flush()

    units = dealt.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "rep_id")
    return units.mapInArrow(run, "rep_id long, links long, root long")


def near_duplicates(
    docs: DataFrame,
    words: int = WORDS,
    threshold: float = THRESHOLD,
    tolerance: float = TOLERANCE,
    block: int = BLOCK,
    block_bytes: int = BLOCK_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, class_id, rep_id, n_links, n_copies for each row of ``docs``."""
    sketched = cut(sketches(docs, id_col, text_col, words))
    reps = cut(
        sketched.where(F.col("digest").isNotNull())
        .groupBy("digest", "signature")
        .agg(F.min("doc_id").alias("rep_id"), F.count(F.lit(1)).alias("n_copies"))
    )
    named = reps.where(F.col("rep_id").isNotNull())
    components = cut(connected_components(candidate_edges(named, threshold, tolerance)))
    lengths = docs.select(F.col(id_col).cast("long").alias("node"), F.octet_length(F.coalesce(text_col, F.lit(""))).alias("bytes"))
    own = cut(components.join(lengths.groupBy("node").agg(F.max("bytes").alias("bytes")), "node"))
    totals = own.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sum("bytes").alias("bytes"))
    sized = lookup_join(own.select("component", F.col("node").alias("rep_id")), totals, "component", "size", own.count())
    parted = cut(sized.withColumn("blocks", _blocks(block, block_bytes)))
    alone = parted.where("blocks = 1").select("component", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "rep_id")
    signed = parted.where("blocks > 1").drop("blocks").join(named.select("rep_id", "signature"), "rep_id")
    dealt = alone.unionByName(units_with_partners(dealt_to_units(signed, block, block_bytes, "signature"), threshold, tolerance))
    texts = docs.select(F.col(id_col).cast("long").alias("rep_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    found = cut(verified_links(texts.join(dealt, "rep_id").select("component", "i", "j", "side", "rep_id", "text"), words, threshold, tolerance))
    links = found.groupBy("rep_id").agg(F.sum("links").alias("n_links"))
    classes = connected_components(found.where("root <> rep_id"), "rep_id", "root")
    about = (
        reps.drop("signature")
        .join(links, "rep_id", "left")
        .join(classes.toDF("rep_id", "class_id"), "rep_id", "left")
        .select("digest", "rep_id", F.coalesce("class_id", "rep_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    )
    members = sketched.select("doc_id", "digest")
    with_words = lookup_join(members.where(F.col("digest").isNotNull()), cut(about), "digest", "n_copies", docs.count())
    without = members.where(F.col("digest").isNull())
    return with_words.select("doc_id", "class_id", "rep_id", "n_links", "n_copies").unionByName(
        without.select(
            "doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("rep_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies")
        )
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the least id of each class, all columns kept, whatever they are called; rows without an id stay."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col)
    drop = free_name("dropped_id", docs.columns)
    drops = found.where(F.col("doc_id") != F.col("class_id")).select(F.col("doc_id").alias(drop))
    return docs.join(drops, F.col(id_col).cast("long") == F.col(drop), "left_anti")
