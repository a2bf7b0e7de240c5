"""Operators 1, 2, 5 and 7 against brute force, and their defined results on odd input."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import op01_ngram_jaccard as op1
from lamina.llm import op02_exact_dedup as op2
from lamina.llm import op05_suffix_dedup as op5
from lamina.llm import op07_substring_dedup as op7
from tests.llm.conftest import frame, sentence

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    words = WORD.findall(fold(text))
    return frozenset(zip(*[words[k:] for k in range(5)])) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute_near(rows):
    """{id: (class, links, copies)} by all pairs."""
    sets = {}
    for i, text in rows:
        sets.setdefault(shingles(text), []).append(i)
    sets.pop(frozenset(), None)
    keys = list(sets)
    root, links = list(range(len(keys))), [0] * len(keys)

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(range(len(keys)), 2):
        if len(keys[a] & keys[b]) >= 0.8 * len(keys[a] | keys[b]):
            links[a] += 1
            links[b] += 1
            root[top(a)] = top(b)
    least = {}
    for k, s in enumerate(keys):
        least[top(k)] = min([*sets[s], least.get(top(k), 1 << 60)])
    return {i: (least[top(k)], links[k], len(sets[s])) for k, s in enumerate(keys) for i in sets[s]}


def near_rows():
    rng = random.Random(11)
    rows, i = [], 0
    for size in (2, 3, 40):
        base = sentence(rng, 150).split()
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = sentence(rng, 1)
            rows.append((i, " ".join(own)))
            i += 1
    rows += [(i + k, sentence(rng, 60)) for k in range(20)]
    rows += [(i + 100, rows[0][1]), (i + 101, rows[0][1].upper()), (i + 102, "short text"), (i + 103, "Short; text!")]
    return rows


@pytest.mark.parametrize("block", [256, 12])
def test_near_duplicates_match_all_pairs(spark, block):
    rows = near_rows()
    found = op1.near_duplicates(frame(spark, rows), block=block).collect()
    assert {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in found} == brute_near(rows)


def test_near_duplicates_of_odd_rows(spark, odd_rows):
    found = op1.near_duplicates(frame(spark, odd_rows)).collect()
    assert len(found) == len(odd_rows)
    classes = {(r.doc_id, r.class_id) for r in found}
    assert {(4, 4), (5, 4), (None, 4), (1, 1), (2, 2), (6, 6), (None, None)} <= classes
    kept = op1.drop_near_copies(frame(spark, odd_rows))
    assert kept.columns == frame(spark, odd_rows).columns
    assert 5 not in {r.doc_id for r in kept.collect()}
    assert op1.near_duplicates(frame(spark, odd_rows).limit(0)).count() == 0


def test_texts_of_one_component_are_dealt_to_few_units(spark):
    some = spark.range(5000).selectExpr("1L AS component", "id AS rep_id", "5000L AS size", "5000L * 40 AS bytes", "'a few words of text' AS text")
    dealt = op1.dealt_to_units(some, op1.BLOCK, op1.BLOCK_BYTES)
    assert dealt.count() == 5 * 5000 and dealt.groupBy("i", "j").count().agg(F.max("count")).first()[0] < 2.2 * op1.BLOCK
    long = some.withColumn("bytes", F.lit(100 * op1.BLOCK_BYTES))
    assert op1.dealt_to_units(long, op1.BLOCK, op1.BLOCK_BYTES).groupBy("i", "j").count().agg(F.max("count")).first()[0] < 200


def test_a_chain_deals_each_text_to_the_units_of_its_neighbours(spark):
    # a window slides over words: neighbours are alike, one component of 5,000 texts in 50 blocks
    rng = random.Random(4)
    words = sentence(rng, 5000 * 6 + 100).split()
    rows = [(k, " ".join(words[6 * k : 6 * k + 100])) for k in range(5000)]
    signed = op1.sketches(frame(spark, rows), "doc_id", "text", 5).select(F.lit(1).cast("long").alias("component"), F.col("doc_id").alias("rep_id"), F.lit(5000).alias("size"), F.lit(1).alias("bytes"), "signature")
    dealt = op1.dealt_to_units(signed, 100, op1.BLOCK_BYTES, "signature")
    assert dealt.count() == 50 * 5000
    times = op1.units_with_partners(dealt, 0.8, 1e-5).groupBy("rep_id").count().agg(F.max("count"), F.count("*")).first()
    assert times[0] <= 12 and times[1] == 5000
    found = {r.doc_id: (r.class_id, r.n_links) for r in op1.near_duplicates(frame(spark, rows[:600]), block=100).collect()}
    want = brute_near(rows[:600])
    assert found == {i: w[:2] for i, w in want.items()}


def test_forests_join_what_plausible_pairs_join():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 32, (9, 96), dtype=np.uint32)
    rows = base[rng.integers(0, 9, 200)]
    rows = np.where(rng.random(rows.shape) < rng.choice([0.02, 0.2, 0.5], (200, 1)), rng.integers(0, 1 << 32, rows.shape, dtype=np.uint32), rows)
    a, b = op1._plausible_forest(rows, 0.8, 1e-5)
    assert len(a) < 200

    def classes(pairs):
        root = list(range(200))
        for _ in range(200):
            for x, y in pairs:
                root[x] = root[y] = min(root[x], root[y])
        return root

    every = [(x, y) for x in range(200) for y in range(x) if len(op1.plausible(rows[[x]], rows[[y]], 0.8, 1e-5))]
    assert len(every) > len(a) and classes(list(zip(a.tolist(), b.tolist()))) == classes(every)


def test_large_buckets_as_stars_give_the_same_links(spark, monkeypatch):
    rows = near_rows()
    monkeypatch.setattr(op1.candidate_edges, "__defaults__", (4,))
    found = op1.near_duplicates(frame(spark, rows), block=12).collect()
    assert {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in found} == brute_near(rows)


def test_pruning_keeps_what_the_posterior_allows():
    least = op1.needed_matches(96, 0.8, 1e-5)
    rng = np.random.default_rng(3)
    equal = rng.binomial(96, 0.8, 20_000)
    assert (equal < least).mean() < 1e-3 and (rng.binomial(96, 0.4, 1000) >= least).sum() == 0


def brute_exact(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(text or "", []).append(i)
    return groups


@pytest.mark.parametrize("digest", [op2.sha256, lambda t: F.substring(F.sha2(t, 256), 1, 1)])
def test_exact_groups(spark, odd_rows, digest):
    rng = random.Random(2)
    rows = [(r[0], r[1]) for r in odd_rows] + [(100 + k, rng.choice(["hot text", "hot text", sentence(rng, 3)])) for k in range(60)]
    groups = brute_exact(rows)
    found = op2.exact_groups(frame(spark, rows), digest=digest, salts=4, hot_share=0.05).collect()
    assert len(found) == len(rows)
    largest = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = sorted((repr(i), repr(largest[t or ""]), len(groups[t or ""])) for i, t in rows)
    assert sorted((repr(r.doc_id), repr(r.keep_id), r.group_size) for r in found) == want
    assert sum(r.kept for r in found) == len(groups)


def test_drop_copies_keeps_columns_and_one_row_of_each(spark, odd_rows):
    kept = op2.drop_copies(frame(spark, odd_rows))
    assert kept.columns == frame(spark, odd_rows).columns
    texts = [r.text or "" for r in kept.collect()]
    assert sorted(texts) == sorted({r[1] or "" for r in odd_rows})
    assert op2.drop_copies(frame(spark, odd_rows).limit(0)).count() == 0


def test_repeated_passages(spark):
    rng = random.Random(7)
    passage, other = sentence(rng, 60), sentence(rng, 51)
    rows = [(k, f"{sentence(rng, rng.randint(5, 90))} {passage} {sentence(rng, rng.randint(5, 90))}") for k in range(6)]
    rows += [(10, f"{other} {sentence(rng, 10)}"), (11, f"{sentence(rng, 10)} {other}"), (12, sentence(rng, 300)), (13, sentence(rng, 49)), (14, rows[0][1])]
    words = {i: WORD.findall(fold(t)) for i, t in rows}
    found = op5.repeated_passages(frame(spark, rows)).collect()
    for r in found:
        n = r.last_word - r.first_word + 1
        assert n >= 50 and words[r.doc_id][r.first_word : r.last_word + 1] == words[r.source_id][r.source_word : r.source_word + n]
    touched = {r.doc_id for r in found} | {r.source_id for r in found}
    assert touched == {0, 1, 2, 3, 4, 5, 10, 11, 14}
    assert {r.doc_id for r in found} >= {1, 2, 3, 4, 5, 11, 14}
    assert max(r.last_word - r.first_word + 1 for r in found if r.doc_id == 14) == len(words[14])


def covered(spark, rows, **how):
    """{(id, word)} of all passages found, each of which is checked against the texts."""
    words = {i: WORD.findall(fold(t)) for i, t in rows}
    out = set()
    for r in op5.repeated_passages(frame(spark, rows), **how).collect():
        n = r.last_word - r.first_word + 1
        assert n >= 50 and words[r.doc_id][r.first_word : r.last_word + 1] == words[r.source_id][r.source_word : r.source_word + n]
        assert (r.source_id, r.source_word) < (r.doc_id, r.first_word)
        out |= {(r.doc_id, k) for k in range(r.first_word, r.last_word + 1)}
    return out


def brute_covered(rows):
    """{(id, word)} of all 50-word places that an earlier document has."""
    seen, out = set(), set()
    for i, text in sorted(rows):
        words = WORD.findall(fold(text))
        own = [(k, tuple(words[k : k + 50])) for k in range(len(words) - 49)]
        out |= {(i, k + d) for k, w in own if w in seen for d in range(50)}
        seen |= {w for _, w in own}
    return out


@pytest.mark.parametrize("hold", [op5.HOLD, 8])
@pytest.mark.parametrize("partitions", [1, 7])
def test_passages_found_do_not_depend_on_pieces_or_partitions(spark, hold, partitions):
    rng = random.Random(17)
    hot, left, right = sentence(rng, 30), sentence(rng, 30), sentence(rng, 30)
    # a frequent passage of 30 words; some texts share what stands before it, some what stands behind it, with other words on the other side
    rows = [(k, f"{sentence(rng, 40)} {left if k % 3 == 0 else sentence(rng, 30)} {hot} {right if k % 3 == 1 else sentence(rng, 30)} {sentence(rng, 20)}") for k in range(45)]
    rows += [(100 + k, f"{sentence(rng, 60 + k)} {'again ' * 296} {sentence(rng, 60)}") for k in range(3)]
    rows += [(200 + k, f"{sentence(rng, 55)} {'one two three ' * 60} {sentence(rng, 55 + k)}") for k in range(3)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = covered(spark, rows, hold=hold)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = brute_covered(rows)
    assert len(want - found) <= 0.02 * len(want) and {i for i, _ in found} >= {i for i, _ in want}
    # beyond 50-word places of earlier documents only repeats within a text are found
    assert all(i >= 100 for i, _ in found - want)


def test_rows_without_an_id_are_documents(spark):
    text = sentence(random.Random(3), 80)
    found = op5.repeated_passages(frame(spark, [(None, text), (None, text)])).collect()
    assert [(r.doc_id, r.first_word, r.last_word, r.source_id, r.source_word) for r in found] == [(None, 0, 79, None, 0)]


def test_repeated_passages_of_odd_rows(spark, odd_rows):
    found = op5.repeated_passages(frame(spark, odd_rows)).collect()
    assert {(r.doc_id, r.source_id) for r in found} <= {(a, b) for a in (4, 5, None) for b in (4, 5, None)} and found
    assert op5.repeated_passages(frame(spark, odd_rows).limit(0)).count() == 0


def test_minimisers_are_the_leftmost_least_of_each_window():
    rng = np.random.default_rng(1)
    order = rng.integers(0, 50, 400).astype(np.uint64)
    valid = rng.random(400) < 0.8
    valid[-25:] = False
    want = sorted({k + int(order[k : k + 26].argmin()) for k in range(375) if valid[k]})
    assert op5.minimisers(order, valid, 26).tolist() == want


@pytest.mark.parametrize("kind", ["line", "paragraph"])
def test_repeated_units(spark, kind):
    rng = random.Random(9)
    lines = [sentence(rng, 15) for _ in range(8)]
    rows = [(k, "\n\n".join([lines[0], f"  {rng.choice(lines).upper()}  ", sentence(rng, 12), "short line"])) for k in range(30)] + [(99, None), (98, "")]
    seen, want = {}, set()
    for i, text in sorted(rows):
        for k, unit in enumerate(u for u in re.split(r"\n+", text or "") if u):
            key = tuple(unit.lower().split())
            if len(key) >= op7.MIN_WORDS:
                if key in seen:
                    want.add((i, k, *seen[key], unit))
                else:
                    seen[key] = (i, k)
    texts = dict(rows)
    found = op7.repeated_units(frame(spark, rows), kind, hot_share=0.1).collect()
    assert {(r.doc_id, r.unit, r.keep_id, r.keep_unit, texts[r.doc_id][r.start : r.stop]) for r in found} == want


def test_repeated_units_of_odd_rows(spark, odd_rows):
    found = op7.repeated_units(frame(spark, odd_rows)).collect()
    assert sorted(repr(r.doc_id) for r in found) == ["4", "4", "5"] and {r.keep_id for r in found} == {None}
    assert op7.repeated_units(frame(spark, odd_rows).limit(0)).count() == 0


def test_short_units_are_removed_too(spark):
    rows = [(1, "one\nTwo words\n \t\none"), (2, "two  words\n今日は良い天気です。\nnine words are in this line and no more"), (3, "今日は良い天気です。\n \t\nNine words are in this line and no more")]
    found = op7.repeated_units(frame(spark, rows)).collect()
    assert {(r.doc_id, r.unit, r.keep_id, r.keep_unit) for r in found} == {(1, 3, 1, 0), (2, 0, 1, 1), (3, 0, 2, 1), (3, 2, 2, 2)}
    assert op7.repeated_units(frame(spark, rows), min_words=10).count() == 0


SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")


def brute_report(rows):
    """{id: (removed characters, shares a passage)} by units in order: lines of any length, and runs of sentences of 20 words or more."""
    units = []
    for i, text in sorted(rows):
        for k, m in enumerate(re.finditer(r"[^\n]+", text or "")):
            key = tuple(m.group().lower().split())
            if key:
                units.append((("line", key), i, k, m.start(), m.end(), len(key)))
        words = [(m.start(), m.end(), fold(m.group())) for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        begins = [k for k in range(len(words)) if k == 0 or re.search(r"[.!?\n]", text[words[k - 1][1] : words[k][0]])]
        for number, k in enumerate(begins):
            stop = next((e for e in [*begins, len(words)] if e >= k + op7.PASSAGE), None)
            if stop is not None:
                end = words[stop - 1][1]
                while end < len(text) and text[end] not in " \t\n\r\x0b\x0c":
                    end += 1
                units.append((("passage", tuple(w for _, _, w in words[k:stop])), i, number, words[k][0], end, stop - k))
    groups = {}
    for u in units:
        groups.setdefault(u[0], []).append(u)
    out = {i: (set(), False) for i, _ in rows}
    for same in groups.values():
        first = min(same, key=lambda u: u[1:3])
        for u in same if len(same) > 1 else []:
            removed, shares = out[u[1]]
            if u is not first:
                removed |= set(range(max(u[3], first[4]) if u[1] == first[1] else u[3], u[4]))
            out[u[1]] = removed, shares or u[5] >= op7.PASSAGE
    return out


def report_rows():
    rng = random.Random(21)
    prose = lambda n: ". ".join(sentence(rng, rng.randint(2, 9)).capitalize() for _ in range(n)) + "."
    passage, line = prose(12), prose(2)
    rows = [(k, f"{prose(rng.randint(1, 4))} {passage} {prose(3)}\n{line if k % 2 else prose(2)}\n\n\u00c9 {prose(1)}") for k in range(8)]
    rows += [(20, "Ab c! " * 90), (21, "x " * 30 + "Ab c! " * 70), (22, prose(9)), (23, None), (24, ""), (25, "\u4eca\u65e5\u306f\u3002\n\u4eca\u65e5\u306f\u3002")]
    return rows


def test_document_report_matches_brute_force(spark):
    rows = report_rows()
    found = op7.document_report(frame(spark, rows), hot_share=0.05).collect()
    got = {r.doc_id: ({k for s in r.removed for k in range(s.start, s.stop)}, r.shares_passage) for r in found}
    assert len(found) == len(rows) and got == brute_report(rows)
    assert all(r.n_removed == len(got[r.doc_id][0]) and r.n_chars == len(dict(rows)[r.doc_id] or "") for r in found)


def test_drop_repeated_returns_what_is_left(spark, odd_rows):
    rows = report_rows()
    docs = frame(spark, rows)
    left = op7.drop_repeated(docs, ("line", "passage"))
    assert sorted(left.columns) == sorted([*docs.columns, "removed"])
    want = brute_report(rows)
    got = {r.doc_id: (r.text, r["my col"]) for r in left.collect()}
    assert got == {i: (None if t is None else "".join(c for k, c in enumerate(t) if k not in want[i][0]), "my col") for i, t in rows}
    odd = op7.drop_repeated(frame(spark, odd_rows)).collect()
    assert len(odd) == len(odd_rows) and sorted(r.text or "" for r in odd if r.doc_id in (4, 5)) == ["", "", ""]
    assert op7.drop_repeated(docs.limit(0)).count() == 0
