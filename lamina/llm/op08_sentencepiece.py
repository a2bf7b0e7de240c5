"""SentencePiece encoding with seeded merge-dropout, and decoding.

The vocabulary of a merge-type (BPE) model with byte fallback is read from its file; its
path is a parameter. A text is its characters with spaces as U+2581 and one U+2581 before
it. No piece crosses a place where U+2581 follows another character or next to a character
that no piece has, so the text falls into units there; each unit merges its best-ranked
neighbouring pair, the leftmost of equals, until none is left. With dropout, the agenda skips a
candidate (left end, middle and right end in the unit) if a hash of seed, text id, number of the unit in
the text, unit and candidate falls below the rate, so each occurrence of a word is drawn by itself, and each run cuts alike.

A task merges each distinct unit of a slice once without dropout and notes the candidates it meets. An
occurrence whose draws skip none of them has the same agenda and shares those pieces; every other one is merged by itself.
Units of up to ``SIDE_BY_SIDE`` symbols, which words are, merge side by side, one merge a round, in numpy. Longer ones, as texts without spaces
make them, have an agenda each: a heap of candidates over linked symbols, whose time grows with the length and its logarithm. Both give the same pieces.
With dropout a long unit is merged for each occurrence only, as some draw skips a candidate of it anyway.

Decoding joins the bytes of the pieces. A literal U+2581 in a text is encoded by byte pieces,
so every text comes back exactly.

Defined results: null and empty texts have no pieces and decode to the empty text; rows
repeated with the same id are cut alike, and a null id counts as 0 in the hash; text of any length is one
row; an empty table gives an empty result; other columns pass as they are, whatever their names (but those named like a new one).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.kernels import Texts, mix, stream, text_slices
from lamina.llm.rows import carried, schema_with

DROPOUT = 0.1
SEED = 20_240_601
SPACE = 0x2581
_NONE = np.iinfo(np.int32).max
_CODES = 0x110000
_SLOT_BITS = 20
SIDE_BY_SIDE = 64
_WORD = 2**64 - 1


@dataclass
class Vocabulary:
    """Symbols are piece ids; a character without a piece is a unit of byte pieces."""

    byte_ids: np.ndarray  # of the 256 byte pieces
    char_id: np.ndarray  # code point -> id, or -1
    pair_keys: np.ndarray  # left id << 32 | right id, in the order of their slots, and an end mark
    pair_ids: np.ndarray  # merged id of each
    slots: np.ndarray  # place of the first pair of each slot
    rank: np.ndarray  # of each id, lower merges first
    piece_bytes: list[bytes]

    @cached_property
    def pairs(self) -> dict[int, int]:
        return dict(zip(self.pair_keys[:-1].tolist(), self.pair_ids[:-1].tolist(), strict=True))

    @cached_property
    def ranks(self) -> list[int]:
        return self.rank.tolist()


def read_vocabulary(path: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    pieces = [model.id_to_piece(k) for k in range(size)]
    usual = [k for k in range(size) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]
    ids = {pieces[k]: k for k in usual}
    char_id = np.full(_CODES, -1, np.int32)
    for k in usual:
        if len(pieces[k]) == 1:
            char_id[ord(pieces[k])] = k
        elif any(a != chr(SPACE) and b == chr(SPACE) for a, b in zip(pieces[k], pieces[k][1:], strict=False)):
            raise ValueError(f"piece {pieces[k]!r} crosses a word start")
    order = sorted(usual, key=lambda k: -model.get_score(k))
    rank = np.full(size, _NONE, np.int32)
    rank[order] = np.arange(len(order))
    pairs = sorted(
        (ids[p[:cut]] << 32 | ids[p[cut:]], k) for p, k in ids.items() for cut in range(1, len(p)) if p[:cut] in ids and p[cut:] in ids
    )
    spelled = [b""] * size
    for k in usual:
        spelled[k] = pieces[k].replace(chr(SPACE), " ").encode()
    byte_ids = np.zeros(256, np.int32)
    for k in range(size):
        if model.is_byte(k):
            value = int(pieces[k][3:5], 16)
            byte_ids[value] = k
            spelled[k] = bytes([value])
    pair_keys = np.array([x for x, _ in pairs], np.int64)
    slot = _slot(pair_keys)
    order = np.argsort(slot, kind="stable")
    return Vocabulary(
        byte_ids,
        char_id,
        np.append(pair_keys[order], -1),
        np.append(np.array([k for _, k in pairs], np.int32)[order], np.int32(-1)),
        np.searchsorted(slot[order], np.arange((1 << _SLOT_BITS) + 1)).astype(np.int32),
        rank,
        spelled,
    )


def _slot(keys: np.ndarray) -> np.ndarray:
    """Slot of each pair: the top bits of its product with a fixed odd number."""
    return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)


def _lookup(vocabulary: Vocabulary, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Merged id of each pair, or -1."""
    keys = left.astype(np.int64) << 32 | right
    slot = _slot(keys)
    at = vocabulary.slots[slot]
    found = np.where(vocabulary.pair_keys[at] == keys, vocabulary.pair_ids[at], -1)
    # a slot of several pairs is read on
    more = np.flatnonzero((found < 0) & (vocabulary.slots[slot + 1] - at > 1))
    place, end = at[more] + 1, vocabulary.slots[slot[more] + 1]
    while len(more):
        hit = vocabulary.pair_keys[place] == keys[more]
        found[more[hit]] = vocabulary.pair_ids[place[hit]]
        on = ~hit & (place + 1 < end)
        more, place, end = more[on], place[on] + 1, end[on]
    return found


def _draws(keys: np.ndarray, hashes: np.ndarray, dropout: float) -> np.ndarray:
    return mix(keys ^ hashes) < np.uint64(min(int(dropout * 2.0**64), 2**64 - 1))


def _skipped(keys: np.ndarray, candidates: np.ndarray, dropout: float) -> np.ndarray:
    return _draws(keys, mix(candidates + np.uint64(1)), dropout)


def _mixed(x: int) -> int:
    """``kernels.mix`` of one number."""
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD & _WORD
    x ^= x >> 33
    x = x * 0xC4CEB9FE1A85EC53 & _WORD
    return x ^ x >> 33


def merge_by_agenda(vocabulary: Vocabulary, units: np.ndarray, key: int, dropout: float, met: list[int] | None = None) -> list[int]:
    """Pieces of one unit: a heap has the candidates by rank, then from left; symbols are linked to their neighbours by their places."""
    n = len(units)
    symbols, after, before = units.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
    pairs, ranks, limit = vocabulary.pairs, vocabulary.ranks, min(int(dropout * 2.0**64), _WORD)
    merged, waits = [-1] * n, [-1] * n  # of the pair that begins at a place: its merged id, its rank if it is on the agenda

    def rated(i: int) -> int:
        """Rank of the pair that begins at ``i``, or -1 if there is none to merge."""
        j = after[i]
        found = pairs.get(symbols[i] << 32 | symbols[j], -1) if j < n else -1
        if found >= 0:
            merged[i] = found
            candidate = (i << 42 | j << 21 | after[j]) & _WORD
            if met is not None:
                met.append(candidate)
            if not dropout or _mixed(key ^ _mixed((candidate + 1) & _WORD)) >= limit:
                return ranks[found]
        return -1

    agenda = []
    for i in range(n):
        waits[i] = r = rated(i)
        if r >= 0:
            agenda.append(r * n + i)
    heapify(agenda)
    while agenda:
        r, i = divmod(heappop(agenda), n)
        if waits[i] != r:  # an end of it has been merged away
            continue
        j = after[i]
        symbols[i], after[i], waits[j] = merged[i], after[j], -1
        if after[j] < n:
            before[after[j]] = i
        for k in (i, before[i]):
            if k >= 0:
                waits[k] = r = rated(k)
                if r >= 0:
                    heappush(agenda, r * n + k)
    out, i = [], 0
    while i < n:
        out.append(symbols[i])
        i = after[i]
    return out


def merge_units(
    vocabulary: Vocabulary,
    symbols: np.ndarray,
    bounds: np.ndarray,
    keys: np.ndarray,
    dropout: float,
    met: list[tuple[np.ndarray, np.ndarray]] | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Merge the symbols of units ([bounds[k], bounds[k + 1]), none empty); keys drive the dropout.

    ``met`` receives the unit and the code of each candidate.
    """
    sizes = np.diff(bounds)
    long = np.flatnonzero(sizes > SIDE_BY_SIDE)
    if not len(long):
        return _merge_side_by_side(vocabulary, symbols, bounds, keys, dropout, met)
    short = np.flatnonzero(sizes <= SIDE_BY_SIDE)
    own_met: list[tuple[np.ndarray, np.ndarray]] | None = None if met is None else []
    pieces, ends = _merge_side_by_side(
        vocabulary, symbols[_ragged(bounds[:-1][short], sizes[short])], np.concatenate([[0], np.cumsum(sizes[short])]), keys[short], dropout, own_met
    )
    if met is not None:
        met += [(short[unit], candidate) for unit, candidate in own_met]
    counts, places, pool, total = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), [pieces], len(pieces)
    counts[short], places[short] = np.diff(ends), ends[:-1]
    for k in long.tolist():
        seen: list[int] | None = None if met is None else []
        own = np.array(merge_by_agenda(vocabulary, symbols[bounds[k] : bounds[k + 1]], int(keys[k]), dropout, seen), np.int32)
        if met is not None:
            met.append((np.full(len(seen), k), np.array(seen, np.uint64)))
        counts[k], places[k] = len(own), total
        pool.append(own)
        total += len(own)
    return np.concatenate(pool)[_ragged(places, counts)], np.concatenate([[0], np.cumsum(counts)])


def _merge_side_by_side(
    vocabulary: Vocabulary,
    symbols: np.ndarray,
    bounds: np.ndarray,
    keys: np.ndarray,
    dropout: float,
    met: list[tuple[np.ndarray, np.ndarray]] | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    n = len(bounds) - 1
    symbols = symbols.astype(np.int32)
    unit = np.repeat(np.arange(n, dtype=np.int32), np.diff(bounds))
    start = (np.arange(len(symbols)) - bounds[:-1][unit]).astype(np.int32)  # of each symbol in its unit, in characters
    done_unit, done_start, done_symbol = [], [], []
    size = np.diff(bounds)

    def rate(at: np.ndarray) -> None:
        """Merged id and rank of the pairs that begin at ``at``; the last symbol of a unit begins none."""
        at = at[~last[at]]
        merged[at] = _lookup(vocabulary, symbols[at], symbols[at + 1])
        at = at[merged[at] >= 0]
        if dropout > 0 or met is not None:
            middle = start[at + 1]
            stop = np.where(last[at + 1], size[unit[at]], start[np.minimum(at + 2, len(start) - 1)])
            candidate = (start[at].astype(np.int64) << 42 | middle.astype(np.int64) << 21 | stop).astype(np.uint64)
            if met is not None:
                met.append((unit[at], candidate))
            if dropout > 0:
                at = at[~_skipped(keys[unit[at]], candidate, dropout)]
        rank[at] = vocabulary.rank[merged[at]]

    last = np.ones(len(symbols), bool)
    last[:-1] = unit[1:] != unit[:-1]
    merged = np.full(len(symbols), -1, np.int32)
    rank = np.full(len(symbols), _NONE, np.int32)
    rate(np.arange(len(symbols)))
    while len(symbols):
        first = np.ones(len(symbols), bool)
        first[1:] = last[:-1]
        heads = np.flatnonzero(first)
        best = np.minimum.reduceat(rank, heads)
        best_of = np.repeat(best, np.diff(np.append(heads, len(symbols))))
        at = np.flatnonzero((rank == best_of) & (rank < _NONE))
        at = at[np.append(True, unit[at[1:]] != unit[at[:-1]])] if len(at) else at  # leftmost of each unit
        symbols[at] = merged[at]
        last[at] = last[at + 1]
        stays = np.ones(len(symbols), bool)
        stays[at + 1] = False
        finished = best_of == _NONE
        over = finished & stays
        done_unit.append(unit[over])
        done_start.append(start[over])
        done_symbol.append(symbols[over])
        stays &= ~finished
        new = (np.cumsum(stays) - 1)[at]
        symbols, unit, start, last, merged, rank = (x[stays] for x in (symbols, unit, start, last, merged, rank))
        before = new[new > 0] - 1
        touched = np.concatenate([new, before[unit[before] == unit[before + 1]]])
        rank[touched] = _NONE
        rate(touched)
    units = np.concatenate([*done_unit, np.zeros(0, np.int64)])
    order = np.lexsort((np.concatenate([*done_start, np.zeros(0, np.int64)]), units))
    out = np.concatenate([*done_symbol, np.zeros(0, np.int32)])[order]
    return out, np.searchsorted(units[order], np.arange(n + 1))


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices of the ranges [start, start + count) end to end."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)


def encode_slice(
    vocabulary: Vocabulary, texts: Texts, ids: np.ndarray, dropout: float, seed: int, variants: int | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of the texts end to end, and bounds for each text; ``variants`` bounds the draws of a word."""
    lead = b"\xe2\x96\x81"
    decoded = [bytes(texts.data[a:b]).decode("utf-8", "replace") for a, b in zip(texts.offsets[:-1], texts.offsets[1:], strict=True)]
    lengths = np.array([len(t) + 1 if t else 0 for t in decoded], np.int64)
    raw = np.frombuffer("".join(lead.decode() + t for t in decoded if t).encode("utf-32-le"), np.uint32)
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[lengths > 0]
    codes = np.where(raw == 32, SPACE, raw).astype(np.int64)
    symbol = vocabulary.char_id[codes]
    literal = raw == SPACE
    literal[starts] = False
    symbol[literal] = -1
    # unit starts: at a text's start, where U+2581 follows another character, around characters without a piece
    n = len(codes)
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    space = codes == SPACE
    begins = np.zeros(n, bool)
    begins[starts] = True
    begins[1:] |= (space[1:] & ~space[:-1]) | (symbol[1:] < 0) | (symbol[:-1] < 0)
    unit_at = np.flatnonzero(begins)
    sizes = np.diff(np.append(unit_at, n))
    weights = stream(53, 1)[0] | np.uint64(1)
    # hash of each unit: a polynomial in its characters, and its length
    powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(int(sizes.max()), weights, np.uint64)]))
    inside = np.arange(n) - np.repeat(unit_at, sizes)
    content = mix(np.add.reduceat((codes + literal * _CODES).astype(np.uint64) * powers[inside], unit_at) + np.uint64(0x9E37) * sizes.astype(np.uint64))
    text_of = np.searchsorted(ends, unit_at, "right")
    _, chosen, back = np.unique(content, return_index=True, return_inverse=True)
    known = symbol[unit_at[chosen]] >= 0
    alone = known & (sizes[chosen] > SIDE_BY_SIDE) if dropout > 0 else np.zeros(len(chosen), bool)  # merged by occurrence only
    plain = known & ~alone

    def merged(some: np.ndarray, keys: np.ndarray, rate: float, met: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of the units ``some`` end to end, and their bounds."""
        source = _ragged(unit_at[some], sizes[some])
        return merge_units(vocabulary, symbol[source], np.concatenate([[0], np.cumsum(sizes[some])]), keys, rate, met)

    met: list[tuple[np.ndarray, np.ndarray]] = []
    pieces, piece_bounds = merged(chosen[plain], content[chosen[plain]], 0.0, met if dropout > 0 else None)
    # characters without a piece: their UTF-8 bytes
    spelled, spelled_counts = [], []
    for k in chosen[~known]:
        own = vocabulary.byte_ids[np.frombuffer(chr(raw[unit_at[k]]).encode("utf-8", "replace"), np.uint8)]
        spelled.append(own)
        spelled_counts.append(len(own))
    pool = np.concatenate([pieces, *spelled]).astype(np.int32)
    counts = np.zeros(len(chosen), np.int64)
    places = np.zeros(len(chosen), np.int64)
    counts[plain], places[plain] = np.diff(piece_bounds), piece_bounds[:-1]
    counts[~known] = spelled_counts
    places[~known] = len(pieces) + np.cumsum(np.array([0, *spelled_counts], np.int64))[:-1]
    counts, places = counts[back], places[back]
    if dropout > 0:
        first_unit = np.searchsorted(unit_at, (ends - lengths))
        number = (np.arange(len(unit_at)) - first_unit[text_of]).astype(np.uint64)
        draw = mix(mix(ids[text_of] + np.uint64(seed)) ^ mix(number + np.uint64(7)))
        if variants is not None:
            draw %= np.uint64(variants)
        keys = mix(content ^ mix(draw + np.uint64(seed)))
        # candidates of each distinct unit, and of each occurrence whether a draw skips one of them
        met_unit, candidates = (np.concatenate(x) for x in zip(*[(np.zeros(0, np.int64), np.zeros(0, np.uint64)), *met], strict=True))
        of_chosen = np.flatnonzero(plain)[met_unit.astype(np.int64)]
        hashes = mix(candidates[np.argsort(of_chosen, kind="stable")] + np.uint64(1))
        met_counts = np.bincount(of_chosen, minlength=len(chosen))
        per = met_counts[back]
        at = np.repeat(np.arange(len(unit_at)), per)
        skips = alone[back]
        skips[at[_draws(keys[at], hashes[_ragged((np.cumsum(met_counts) - met_counts)[back], per)], dropout)]] = True
        skips = np.flatnonzero(skips)
        if len(skips):
            own, own_bounds = merged(skips, keys[skips], dropout)
            counts[skips], places[skips] = np.diff(own_bounds), len(pool) + own_bounds[:-1]
            pool = np.concatenate([pool, own])
    total = np.concatenate([[0], np.cumsum(counts)])
    text_units = np.searchsorted(unit_at, np.concatenate([[0], ends]))
    return pool[_ragged(places, counts)], total[text_units]


class _Model:
    """The vocabulary of a worker, read once."""

    loaded: dict[str, Vocabulary] = {}

    @classmethod
    def get(cls, path: str) -> Vocabulary:
        if path not in cls.loaded:
            cls.loaded[path] = read_vocabulary(path)
        return cls.loaded[path]


def encode(
    docs: DataFrame,
    model_path: str,
    dropout: float = DROPOUT,
    seed: int = SEED,
    variants: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    check: bool = False,
) -> DataFrame:
    """``docs`` and a column ``pieces`` (array of piece ids); every other column passes as it is; one named like a new column
    is replaced.

    With ``check`` the task decodes what it encoded, and ``lossless`` tells whether the text came back.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_Model.get(model_path))
    extra = ["pieces", "lossless"] if check else ["pieces"]
    inner = carried(
        docs,
        F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"),
        F.col(text_col).alias("text"),
        without=tuple(extra),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            ids = batch["id"].to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for texts in text_slices(batch["text"]):
                some = slice(texts.first, texts.first + len(texts))
                pieces, bounds = encode_slice(vocabulary, texts, ids[some], dropout, seed, variants)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(pieces))
                columns = {"row": batch["row"].slice(texts.first, len(texts)), "pieces": lists}
                if check:
                    own = batch["text"].slice(texts.first, len(texts)).fill_null("")
                    columns["lossless"] = pc.equal(decode_lists(vocabulary, lists), own.cast(pa.string()))
                yield pa.RecordBatch.from_pydict(columns)

    return inner.mapInArrow(run, schema_with(inner, "pieces array<int>" + ", lossless boolean" * check)).select("row.*", *extra)


def decode_lists(vocabulary: Vocabulary, lists: pa.ListArray) -> pa.Array:
    """Text of each list of piece ids."""
    spelled = pa.array(vocabulary.piece_bytes, pa.large_binary())
    joined = spelled.take(lists.flatten())
    sizes = np.concatenate([[0], np.cumsum(np.array([len(x) for x in vocabulary.piece_bytes], np.int64)[lists.flatten().to_numpy()])])
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    ends = sizes[offsets]
    starts = np.minimum(ends[:-1] + 1, ends[1:])  # the first character is the space before the text
    data = joined.buffers()[2]
    blob = data.to_pybytes()[: int(ends[-1])] if data is not None else b""
    return pa.array([blob[a:b].decode("utf-8", "replace") for a, b in zip(starts, ends[1:], strict=True)], pa.string())


def decode(encoded: DataFrame, model_path: str, pieces_col: str = "pieces", name: str = "decoded") -> DataFrame:
    """``encoded`` and a column of the texts that its pieces spell."""
    shared = encoded.sparkSession.sparkContext.broadcast(_Model.get(model_path))
    inner = carried(encoded, F.col(pieces_col).alias("pieces"), without=(name,))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part["pieces"]
                if lists.null_count:
                    lists = pa.array(lists.to_pylist(), pa.list_(pa.int32())).fill_null([])
                yield pa.RecordBatch.from_arrays([part["row"], decode_lists(shared.value, lists)], ["row", "text"])

    return inner.mapInArrow(run, schema_with(inner, "text string")).select("row.*", F.col("text").alias(name))
