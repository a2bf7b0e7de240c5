"""Periodic runs of words: the linear tandem-repeat method of Gusfield and Stoye.

A run is a stretch of words with smallest period ``q`` and a length of at least ``MIN_LENGTH`` and ``MIN_EXPONENT * q``, as long as it can be. Documents
are independent, so Spark deals them and a task looks at one at a time, in these steps:

0. A run repeats some phrase of ``needed_repeat()`` words (16) at a distance of its period, and every word of it lies in such a phrase. Stretches of words
   that lie in repeated phrases are kept, the rest of the text is left out; the stretches hold all runs whole.
1. The suffix tree of a stretch gives its LZ blocks, and extensions to both sides of the borders of blocks give, for each period, the leftmost squares from
   which the others follow by rotation. Only squares of primitive words of at most a third of the stretch count: others lie in their runs.
2. From each square that occurs there for the first time, suffix links lead to its rotations as long as they occur anywhere: the complete
   vocabulary of squares, each at a place of the tree.
3. The leaves below the places are all occurrences; those of a period that follow one another make up a run.

Time and memory grow linearly with the words of the stretch (about 13 microseconds and a kilobyte a word; words outside repeated phrases need a tenth of it).

Defined results: null counts as empty; words are parted by ASCII white space (space, tab to carriage return) and compared byte by byte; a text without words or
runs has no runs and collapses to its words; rows repeated or with a null id are handled like any others; an empty table gives an empty result;
other columns are not read, and pass through ``collapse_runs`` whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.kernels import gram_hashes, mix
from lamina.llm.rows import carried, quoted, schema_with

MIN_LENGTH = 24
MIN_EXPONENT = 3
_RUN = "struct<start: long, length: long, period: long, first_byte: long, stop_byte: long>"
_FOUND = f"n_words long, runs array<{_RUN}>, collapsed string"
_WORD = re.compile(rb"[^ \t-\r]+")


def needed_repeat(min_length: int, min_exponent: int) -> int:
    """The words that any run has in common with itself one period on, at least."""
    return min(max(min_length - q, (min_exponent - 1) * q) for q in range(1, min_length + 1))


def repeated_stretches(codes: np.ndarray, n: int, least: int) -> list[tuple[int, int]]:
    """Stretches of at least ``least`` words that all lie in ``n``-word phrases that occur twice (or share a hash)."""
    grams = gram_hashes(mix(codes.astype(np.uint64) + np.uint64(1)), n)
    if len(grams) < 2:
        return []
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return []
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    step = np.zeros(len(codes) + 1, np.int64)
    step[at] += 1
    step[at + n] -= 1
    inside = np.concatenate([[False], np.cumsum(step[:-1]) > 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a >= least]


class SuffixTree:
    """Ukkonen's suffix tree of ``symbols``, whose last must occur once: for each node its parent, suffix link, depth, first occurrence, and leaves."""

    def __init__(self, symbols: list[int]):
        self.symbols, n = symbols, len(symbols)
        self.size = size = max(symbols) + 1
        self.child: dict[int, int] = {}
        self.parent, self.link = [0], [0]
        start, end, child, parent, link = [0], [0], self.child, self.parent, self.link
        node = edge = length = waiting = 0
        for i, symbol in enumerate(symbols):
            waiting += 1
            last = 0
            while waiting:
                if not length:
                    edge = i
                key = node * size + symbols[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(start)
                    start.append(i)
                    end.append(n)
                    parent.append(node)
                    link.append(0)
                    if last:
                        link[last] = node
                        last = 0
                else:
                    begin = start[below]
                    span = min(end[below], i + 1) - begin
                    if length >= span:
                        edge += span
                        length -= span
                        node = below
                        continue
                    if symbols[begin + length] == symbol:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    middle = len(start)
                    child[key] = middle
                    start += (begin, i)
                    end += (begin + length, n)
                    parent += (node, middle)
                    link += (0, 0)
                    start[below] = begin + length
                    parent[below] = middle
                    child[middle * size + symbols[begin + length]] = below
                    child[middle * size + symbol] = middle + 1
                    if last:
                        link[last] = middle
                    last = middle
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        self._order(start, end, n)

    def _order(self, start: list[int], end: list[int], n: int) -> None:
        """Depths, first occurrences, and the range of leaves of each node in one order of the leaves."""
        parents = np.array(self.parent)
        order = np.argsort(parents[1:], kind="stable") + 1
        bounds = np.searchsorted(parents[order], np.arange(len(parents) + 1)).tolist()
        kids = order.tolist()
        depth, low, high = [0] * len(kids + [0]), [0] * len(kids + [0]), [0] * len(kids + [0])
        leaves: list[int] = []
        self.leaf_of = [0] * n
        open_nodes = [0]
        while open_nodes:
            v = open_nodes.pop()
            if v < 0:
                high[~v] = len(leaves)
                continue
            if v:
                depth[v] = depth[self.parent[v]] + end[v] - start[v]
            low[v] = len(leaves)
            below = kids[bounds[v] : bounds[v + 1]]
            if below:
                open_nodes.append(~v)
                open_nodes += below
            else:
                leaves.append(n - depth[v])
                self.leaf_of[n - depth[v]] = v
                high[v] = len(leaves)
        self.depth, self.low, self.high, self.leaves = depth, low, high, leaves
        # leaves are made in the order of their suffixes, so an edge's text was taken from its first occurrence
        self.first = [e - d for e, d in zip(end, depth, strict=True)]

    def blocks(self, n: int) -> list[int]:
        """Borders of the LZ blocks of the first ``n`` symbols: each is the longest text from there that began earlier, or one symbol."""
        borders, i = [0], 0
        child, first, depth, symbols, size = self.child, self.first, self.depth, self.symbols, self.size
        while i < n:
            v = 0
            while True:
                below = child[v * size + symbols[i + depth[v]]]
                if first[below] >= i:
                    break
                v = below
            i += depth[v] or 1
            borders.append(i)
        return borders

    def rotations(self, start: int, node: int, q: int) -> Iterator[tuple[int, int]]:
        """Places (node, and its first occurrence) of the rotations by 1, 2, ... of the square of ``q`` symbols at ``start``, while they occur."""
        child, depth, first, symbols, size = self.child, self.depth, self.first, self.symbols, self.size
        whole = 2 * q
        while True:
            v = self.link[self.parent[node]]
            while depth[v] < whole - 1:
                v = child[v * size + symbols[start + 1 + depth[v]]]
            symbol = symbols[start]
            if depth[v] == whole - 1:
                v = child.get(v * size + symbol, -1)
                if v < 0:
                    return
            elif symbols[first[v] + whole - 1] != symbol:
                return
            node, start = v, first[v]
            yield node, start


def z_values(pattern: list[int], text: list[int]) -> list[int]:
    """How many symbols of ``pattern`` stand at each place of ``text``."""
    joined = [*pattern, -1, *text]
    n = len(joined)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        if i + k >= right:
            while i + k < n and joined[k] == joined[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z[len(pattern) + 1 :]


def leftmost_squares(symbols: list[int], n: int, borders: list[int], longest: int, least_prime: list[int]) -> Iterator[tuple[int, int]]:
    """(start, q) of squares of primitive words of ``q <= longest`` symbols, among them for each square whose first occurrence is there
    one at or before it from which squares of ``q`` lead on to it."""

    def primitive(q: int, start: int, lead: int, forward: list[int], back: list[int]) -> bool:
        """Whether no divisor of ``q`` is a period of the square; ``forward`` and ``back`` count equal pairs around ``lead`` less the period (or ``lead``)."""
        rest = q
        while rest > 1:
            prime = least_prime[rest]
            while rest % prime == 0:
                rest //= prime
            p = q // prime
            at = lead(p)
            if at - back[p] <= start and at + forward[p] >= start + 2 * q - p:
                return False
        return True

    for k in range(len(borders) - 1):
        h, h1 = borders[k], borders[k + 1]
        beyond = borders[k + 2] if k + 2 < len(borders) else h1
        # squares that begin before the block and whose second half begins in it: equal pairs (x, x + q) around x = h
        most = min(beyond - h, longest)
        if h and most:
            stop = min(h + 2 * most, n)
            forward = z_values(symbols[h:stop], symbols[h:stop])
            near = max(h - most, 0)
            mirrored = symbols[near : min(h + most, n)][::-1]
            found = z_values(symbols[near:h][::-1], mirrored)
            back = [0] + [found[len(mirrored) - (h - near) - q] if h + q <= n and q <= most else 0 for q in range(1, most + 1)]
            forward += [0] * (most + 1 - len(forward))
            for q in range(1, most + 1):
                if back[q] and forward[q] + back[q] >= q:
                    start = max(h - back[q], h - q)
                    if primitive(q, start, lambda p: h, forward, back):
                        yield start, q
        # squares that begin in the block and end beyond it: pairs around x = h1 - q
        most = min(h1 - h - 1, longest)
        if h1 < n and most:
            far = max(h1 - most, 0)
            ahead = symbols[h1 : min(h1 + most, n)]
            found = z_values(ahead, symbols[far : min(h1 + most, n)])
            near = max(h1 - 3 * most, 0)
            mirrored = symbols[near:h1][::-1]
            behind = z_values(mirrored[: 2 * most], mirrored)
            forward = [0] + [found[h1 - q - far] for q in range(1, most + 1)]
            back = [0] + [behind[q] if q < len(behind) else 0 for q in range(1, most + 1)]
            for q in range(1, most + 1):
                if forward[q] and forward[q] + back[q] >= q:
                    start = max(h1 - q - back[q], h1 - 2 * q + 1)
                    if primitive(q, start, lambda p: h1 - p, forward, back):
                        yield start, q


def least_primes(n: int) -> list[int]:
    """The least prime factor of each number up to ``n``."""
    least = np.arange(n + 1)
    for p in range(2, int(n**0.5) + 1):
        if least[p] == p:
            own = least[p * p :: p]
            own[own == np.arange(p * p, n + 1, p)] = p
    return least.tolist()


def runs_of(codes: list[int], min_length: int, min_exponent: int) -> np.ndarray:
    """Rows (start, length, period) of the runs of a stretch of words given as numbers."""
    n = len(codes)
    longest = n // min_exponent
    place = {c: k + 1 for k, c in enumerate(dict.fromkeys(codes))}
    symbols = [*map(place.__getitem__, codes), 0]
    tree = SuffixTree(symbols)
    by_start: dict[int, list[int]] = {}
    for start, q in leftmost_squares(symbols, n, tree.blocks(n), longest, least_primes(longest)):
        by_start.setdefault(start, []).append(q)
    marked: set[tuple[int, int]] = set()
    for start, periods in by_start.items():
        node = tree.leaf_of[start]
        for q in sorted(set(periods), reverse=True):
            # up the nodes that first occur at start: other squares occurred before and are reached from there
            while tree.depth[tree.parent[node]] >= 2 * q and tree.first[tree.parent[node]] == start:
                node = tree.parent[node]
            if tree.depth[tree.parent[node]] >= 2 * q or (node, q) in marked:
                continue
            marked.add((node, q))
            for v, _ in tree.rotations(start, node, q):
                if (v, q) in marked:
                    break
                marked.add((v, q))
    if not marked:
        return np.zeros((0, 3), np.int64)
    nodes, periods = (np.array(x) for x in zip(*marked, strict=True))
    low = np.array(tree.low)[nodes]
    count = np.array(tree.high)[nodes] - low
    ends = np.cumsum(count)
    places = np.array(tree.leaves)[np.arange(ends[-1]) + np.repeat(low - (ends - count), count)]
    periods = np.repeat(periods, count)
    order = np.lexsort((places, periods))
    places, periods = places[order], periods[order]
    apart = np.flatnonzero((np.diff(places, prepend=-9) != 1) | (np.diff(periods, prepend=-9) != 0))
    last = np.append(apart[1:], len(places)) - 1
    found = np.stack([places[apart], places[last] - places[apart] + 2 * periods[apart], periods[apart]], 1)
    return found[(found[:, 1] >= min_length) & (found[:, 1] >= min_exponent * found[:, 2])]


def text_runs(words: list[bytes], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """Rows (start, length, period) of the runs of ``words``, by start, then period."""
    place: dict[bytes, int] = {}
    codes = [place.setdefault(w, len(place)) for w in words]
    found = [np.zeros((0, 3), np.int64)]
    for a, b in repeated_stretches(np.array(codes, np.int64), needed_repeat(min_length, min_exponent), min_length):
        found.append(runs_of(codes[a:b], min_length, min_exponent) + [a, 0, 0])
    runs = np.concatenate(found)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _with_runs(rows: DataFrame, min_length: int, min_exponent: int) -> DataFrame:
    """The struct ``row`` of ``rows`` (that have a column text, too), n_words, runs, collapsed."""
    schema = schema_with(rows, _FOUND)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, collapsed, counts, tables = [], [], [0], [np.zeros((0, 5), np.int64)]
            for value in batch["text"].cast(pa.large_string()).fill_null(""):
                data = bytes(value.as_buffer())
                words = data.split()  # bytes part at ASCII white space only
                runs = text_runs(words, min_length, min_exponent)
                if len(runs):
                    spans = np.array([m.span() for m in _WORD.finditer(data)])
                    tables.append(np.column_stack([runs, spans[runs[:, 0], 0], spans[runs[:, 0] + runs[:, 1] - 1, 1]]))
                    # the later periods of all runs, by counting how many are open at each word
                    open_runs = np.zeros(len(words) + 1, np.int64)
                    np.add.at(open_runs, runs[:, 0] + runs[:, 2], 1)
                    np.add.at(open_runs, runs[:, 0] + runs[:, 1], -1)
                    kept = np.flatnonzero(np.cumsum(open_runs[:-1]) == 0).tolist()
                    collapsed.append(b" ".join([words[k] for k in kept]))
                else:
                    collapsed.append(b" ".join(words))
                sizes.append(len(words))
                counts.append(len(runs))
            flat = np.concatenate(tables)
            structs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(5)], ["start", "length", "period", "first_byte", "stop_byte"])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(counts).astype(np.int32)), structs)
            texts = pa.array(collapsed, pa.large_binary()).cast(pa.large_string()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(sizes, pa.int64()), lists, texts], ["row", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(find, schema)


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (by start, then period), collapsed for each row of ``docs``.

    A run has its first word, length and period in words, and the range of UTF-8 bytes it takes up. ``collapsed`` has the text's words, parted by single
    spaces, without those that any run holds after its first period.
    """
    narrow = docs.select(F.struct(F.col(quoted(id_col)).cast("long").alias("doc_id")).alias("row"), F.col(quoted(text_col)).alias("text"))
    return _with_runs(narrow, min_length, min_exponent).select("row.doc_id", "n_words", "runs", "collapsed")


def collapse_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, text_col: str = "text") -> DataFrame:
    """``docs`` with the texts that hold runs collapsed, all other texts and columns as they are."""
    inner = carried(docs, F.col(quoted(text_col)).alias("text"))
    found = _with_runs(inner, min_length, min_exponent)
    own = lambda c: F.col(f"row.{quoted(c)}")
    text = F.when(F.size("runs") > 0, F.col("collapsed")).otherwise(own(text_col))
    return found.select(*[(text if c.lower() == text_col.lower() else own(c)).alias(c) for c in docs.columns])


def oracle_sql() -> str:
    """Runs by their definition: for each distance at which some phrase repeats, the stretches of words equal to those so far on."""
    crc = """xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: ascii(substr(doc_id::VARCHAR, k, 1))::UBIGINT)),
        lambda c, b: list_reduce(list_concat([xor(c, b)], list_transform(range(8), lambda z: 0::UBIGINT)),
            lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))), 4294967295::UBIGINT)::BIGINT"""
    return f"""
WITH parted AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') AS w, {crc} AS h FROM documents
), planned AS (
  SELECT doc_id, w, h % 10 = 0 AND len(w) > 0 AS planted, (h // 10) % greatest(len(w), 1) AS a, (h // 10) % 8 + 3 AS parts FROM parted
), texts AS (
  SELECT doc_id, CASE WHEN planted THEN list_concat(w[:a], list_transform(range(a, len(w)), lambda i: w[a + (i - a) % (1 + (len(w) - a) // parts) + 1])) ELSE w END AS w
  FROM planned
), placed AS (
  SELECT doc_id, unnest(range(len(w))) AS i, len(w) AS n, w FROM texts
), grams AS (
  SELECT doc_id, i, n, array_to_string(w[i + 1 : i + 16], ' ') AS gram FROM placed WHERE i + 16 <= n
), distances AS (
  SELECT DISTINCT x.doc_id, y.i - x.i AS q FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.gram = y.gram AND x.i < y.i AND 3 * (y.i - x.i) <= x.n
), equal AS (
  SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island
  FROM (SELECT doc_id, q, w, unnest(range(len(w) - q)) AS i FROM distances JOIN texts USING (doc_id)) WHERE w[i + 1] = w[i + q + 1]
), stretches AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM equal GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(24, 3 * q)
), runs AS (
  SELECT * FROM stretches s WHERE NOT EXISTS (
    SELECT 1 FROM stretches t WHERE t.doc_id = s.doc_id AND t.q < s.q AND t.start <= s.start AND t.start + t.length >= s.start + s.length)
), best AS (
  SELECT r.doc_id, r.start, r.length, r.q AS period, 1000 * r.length // r.q AS exponent_milli FROM runs r
  QUALIFY row_number() OVER (PARTITION BY r.doc_id ORDER BY r.length * 1.0 / r.q DESC, r.start, r.q) = 1
), told AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines FROM runs GROUP BY doc_id
), dropped AS (
  SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM runs
), kept AS (
  SELECT doc_id, string_agg(w[i + 1], ' ' ORDER BY i) AS collapsed FROM placed ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM texts LEFT JOIN told USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
