"""Operators 11, 12 and 13."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import op11_quality as op11
from lamina.llm import op12_merkle_manifest as op12
from lamina.llm import op13_periodic_runs as op13
from lamina.llm import queries
from lamina.session import table
from tests.compare import rows_of, rows_of_sql
from tests.llm.conftest import ODD_NAMES, frame, sentence


@pytest.mark.parametrize("name", ["op12_merkle_manifest", "op13_periodic_runs"])
def test_query_matches_sql(spark, duck, data, name):
    found = queries.QUERIES[name](spark, data)
    names, want = rows_of_sql(duck, queries.SQL[name])
    assert sorted(found.columns) == names
    assert rows_of(found) == want


# operator 11


def plain_features(text):
    """The features of one text, by loops over its bytes and words."""
    raw = (text or "").encode()
    folded = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    words = re.findall(rb"[0-9a-z\x80-\xff]+", folded)
    count = lambda chars: sum(b in chars for b in raw)
    share = lambda x, whole: x / max(whole, 1)
    upper, small = count(range(65, 91)), count(range(97, 123))
    digit, wide = count(range(48, 58)), count(range(128, 256))
    space, line = count(b" \t\r\f\v"), count(b"\n")
    mark, shout = count(b",.;:'\"()-?"), count(b"!")
    other = len(raw) - upper - small - digit - wide - space - line - mark - shout
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)] or ([tuple(words)] if words else [])
    tally = Counter(words)
    return [
        np.log1p(len(raw)),
        np.log1p(len(words)),
        share(sum(map(len, words)), len(words)),
        len(words) / (line + 1),
        len(words) / (mark + shout + 1),
        share(upper, small + upper),
        share(digit, len(raw)),
        share(space + line, len(raw)),
        share(mark, len(raw)),
        share(shout, len(raw)),
        share(other, len(raw)),
        share(wide, len(raw)),
        share(sum(a == b for a, b in zip(words[1:], words[:-1])), len(words) - 1),
        share(len(tally), len(words)),
        share(max(tally.values(), default=0), len(words)),
        share(len(grams) - len(set(grams)), len(grams)),
    ]


def plain_score(model, features):
    total = model.bias
    at = lambda edges, f: sum(e <= features[f] for e in edges[f])
    for f, addends in enumerate(model.tables):
        total += addends[at(model.edges, f)]
    for (a, b), addends in zip(model.pairs, model.pair_tables, strict=True):
        total += addends[at(model.pair_edges, a)][at(model.pair_edges, b)]
    return float(1 / (1 + np.exp(-total)))


def test_quality_scores_match_sums_by_hand(spark, data, odd_rows):
    docs, labels = table(spark, data, "documents"), table(spark, data, "labels")
    model = op11.fit(docs, labels)
    assert len(model.tables) == len(op11.FEATURES) and len(model.pairs) == op11.PAIRS and any(t.any() for t in model.tables)
    rng = np.random.default_rng(2)  # so few rows leave nothing to the pairs
    model.pair_tables = [t + rng.normal(size=t.shape) for t in model.pair_tables]
    texts = dict(docs.select("doc_id", "text").collect())
    for r in op11.quality(docs, model).collect():
        assert r.score == pytest.approx(plain_score(model, plain_features(texts[r.doc_id])), abs=1e-9)
    odd = frame(spark, odd_rows)
    scored = op11.quality(odd, model).collect()
    assert sorted(repr((r.doc_id, round(r.score, 9))) for r in scored) == sorted(repr((i, round(plain_score(model, plain_features(t)), 9))) for i, t, *_ in odd_rows)
    kept = op11.drop_poor(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r.score >= op11.THRESHOLD for r in scored)
    addends = op11.lookup_tables(spark, model)
    assert addends.count() == sum(t.size for t in [*model.tables, *model.pair_tables])
    assert op11.quality(odd.limit(0), model).count() == 0


def test_quality_of_held_out_rows(spark, data):
    scored = queries.op11_quality(spark, data.replace("sf0.001", "sf0.01"))
    labels = table(spark, data.replace("sf0.001", "sf0.01"), "labels")
    rows = scored.where("held_out").join(labels, "doc_id").select("quality", "score").collect()
    good, bad = ([r.score for r in rows if r.quality == k] for k in (1, 0))
    assert len(bad) >= 5 and np.mean([g > b for g in good for b in bad]) > 0.98
    assert np.mean([g >= 0.3 for g in good]) > 0.98
    every = scored.select("doc_id", "held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in every)


def test_quality_learns_an_interaction(spark):
    # good if exactly one of two features is large: neither tells anything by itself
    rng = np.random.default_rng(4)
    rows = rng.random((4000, len(op11.FEATURES)))
    y = ((rows[:, 2] > 0.5) != (rows[:, 9] > 0.5)).astype(float)
    model = op11.learned(rows, y, rng.integers(0, 5, 4000))
    fresh = rng.random((1000, len(op11.FEATURES)))
    assert (2, 9) in model.pairs
    assert ((model.score(fresh) > 0.5) == ((fresh[:, 2] > 0.5) != (fresh[:, 9] > 0.5))).mean() > 0.9


def test_quality_without_two_classes(spark):
    docs = frame(spark, [(k, f"text {k}") for k in range(6)])
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    for rows, rate in (([], 0.5), ([(0, 1), (1, 1), (1, 0), (None, 0), (2, None)], 2.5 / 3), ([(9, 0)], 0.5)):
        assert {round(r.score, 9) for r in op11.quality(docs, op11.fit(docs, labels(rows))).collect()} == {round(rate, 9)}


# operator 12


def digest(*values):
    return hashlib.sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values).encode()).hexdigest()


def brute_proofs(rows, claims, fanout):
    """(id, source, leaf, subroot, root, proof, folded root) of rows (id, source, leaf) by whole trees."""

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            last = levels[-1]
            levels.append([hashlib.sha256("".join(last[k : k + fanout]).encode()).hexdigest() for k in range(0, len(last), fanout)])
        return levels

    def sides(levels, at):
        out = []
        for nodes in levels[:-1]:
            first = at - at % fanout
            out.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + fanout])))
            at //= fanout
        return out

    order = lambda x: (x is not None, x)
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (order(r[0]), r[2])) for s in sources}
    trees = {s: tree([r[2] for r in own[s]]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    found = []
    for k, s in enumerate(sources):
        for at, r in enumerate(own[s]):
            path = sides(trees[s], at) + sides(top, k)
            folded = claims.get(r[2], r[2])
            for left, right in path:
                folded = hashlib.sha256((left + folded + right).encode()).hexdigest()
            found.append((r[0], s, r[2], trees[s][-1][0], top[-1][0], hashlib.sha256("".join(a + b for a, b in path).encode()).hexdigest(), folded, folded == top[-1][0]))
    return found


@pytest.mark.parametrize(("fanout", "levels", "n"), [(16, 2, 700), (2, 2, 150), (3, 1, 100)])
def test_proofs_match_whole_trees(spark, monkeypatch, fanout, levels, n):
    monkeypatch.setattr(op12, "FANOUT", fanout)
    monkeypatch.setattr(op12, "BLOCK_LEVELS", levels)
    monkeypatch.setattr(op12, "BLOCK", fanout**levels)
    rng = random.Random(n)
    # one hot source, a lone row, many small ones; ids in any order, some equal or null
    rows = [(rng.randrange(n), f"Text {k}", "en", "hot" if k % 2 else rng.choice(["a", "b", "é", "Z", None, *map(str, range(20))])) for k in range(n)]
    rows += [(None, "x", None, "hot"), (None, None, None, None), (3, "", "en", "lone"), (3, "again", "en", "hot"), (3, "again", "en", "hot")]
    docs = frame(spark, rows)
    leaf = lambda r, text: digest(r[0], r[3], r[2], len(r[1] or ""), text)
    leaves = [(r[0], r[3], leaf(r, r[1])) for r in rows]
    claims = {leaf(r, r[1]): leaf(r, r[1].lower()) for r in rows if r[1] and r[0] is not None and r[0] % 3 == 0}
    claimed = F.when(F.col("doc_id") % 3 == 0, op12.table_digest(text=F.lower("text")))
    found = op12.proofs(docs, claimed=claimed)
    assert found.columns == ["doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, brute_proofs(leaves, claims, fanout)))
    whole = op12.manifest(docs).collect()
    assert {(r.source, r.n_rows) for r in whole} == set(Counter(r[3] for r in rows).items()) and len({r.root for r in whole}) == 1


def test_proofs_of_odd_rows(spark, odd_rows):
    docs = frame(spark, odd_rows)
    full = [(*r, *["en", "s"][len(r) - 2 :])[:4] for r in odd_rows]
    leaves = [(i, s, digest(i, s, g, len(t or ""), t)) for i, t, g, s in full]
    found = op12.proofs(docs).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, brute_proofs(leaves, {}, 16))) and all(r.verified for r in found)
    # columns with odd names are hashed like others
    assert op12.proofs(docs, ("doc_id", "source", *ODD_NAMES)).where("verified").count() == len(odd_rows)
    assert op12.proofs(docs.limit(0)).count() == 0 and op12.manifest(docs.limit(0)).count() == 0
    lone = op12.proofs(docs.where("doc_id = 3")).first()
    assert lone.leaf == lone.subroot == lone.root == lone.folded_root and lone.proof_sha256 == hashlib.sha256(b"").hexdigest()


# operator 13


def brute_runs(words, least, times):
    """Every stretch by its definition: for each period, from each start."""
    found, n = [], len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            own = words[i : i + length]
            if j > i and length >= max(least, times * q) and not any(all(own[x] == own[x + p] for x in range(length - p)) for p in range(1, q)):
                found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def periodic_words(rng):
    words, letters = [], rng.choice([1, 2, 2, 3, 4])
    for _ in range(rng.randint(0, 12)):
        if words and rng.random() < 0.5:
            size = rng.randint(1, min(7, len(words)))
            at = rng.randint(0, len(words) - size)
            words += words[at : at + size] * rng.randint(1, 6)
        else:
            words += [rng.choice("abcd"[:letters]) for _ in range(rng.randint(1, 4))]
    return words[:70]


@pytest.mark.parametrize(("least", "times"), [(2, 2), (24, 3), (9, 3), (6, 4)])
def test_runs_match_their_definition(least, times):
    rng = random.Random(least * times)
    for _ in range(600):
        words = periodic_words(rng)
        found = op13.text_runs([w.encode() for w in words], least, times)
        assert [tuple(r) for r in found.tolist()] == brute_runs(words, least, times)


def test_runs_of_long_and_deep_texts():
    # all one word; one long period; Fibonacci words, which have as many runs as a text can
    fib, last = ["a"], ["b"]
    while len(fib) < 700:
        fib, last = fib + last, fib
    assert [tuple(r) for r in op13.text_runs([w.encode() for w in fib], 2, 2).tolist()] == brute_runs(fib, 2, 2)
    assert op13.text_runs([b"w"] * 50_000).tolist() == [[0, 50_000, 1]]
    rng = random.Random(8)
    root = [b"%d" % rng.randrange(40) for _ in range(9000)]
    assert [9, 30_000 - 9, 9000] in op13.text_runs([b"x"] * 9 + (root * 4)[: 30_000 - 9]).tolist()
    assert op13.text_runs(root + root).tolist() == [] and op13.text_runs([]).tolist() == []


def test_periodic_runs_and_collapse(spark, odd_rows):
    rng = random.Random(6)
    phrase = sentence(rng, 9)
    rows = [
        (1, "start  here\t" + f"{phrase}\n" * 5 + " the end"),
        (2, "go " * 24),
        (3, "go " * 23),
        (4, f"{phrase} " * 2),
        (5, "é è " * 30),  # a no-break space parts nothing
        (6, " ".join([*"ab" * 12, *"bc" * 12])),
        *[(100 + (r[0] or 0), r[1]) for r in odd_rows],
    ]
    docs = frame(spark, rows)
    found = {r.doc_id: r for r in op13.periodic_runs(docs).collect() if r.doc_id < 100}
    texts = dict(rows)
    assert [tuple(r)[:3] for r in found[1].runs] == [(2, 45, 9)]
    run = found[1].runs[0]
    assert texts[1].encode()[run.first_byte : run.stop_byte].decode().split() == phrase.split() * 5
    assert found[1].collapsed == f"start here {phrase} the end" and found[1].n_words == 49
    assert [tuple(r)[:3] for r in found[2].runs] == [(0, 24, 1)] and found[2].collapsed == "go"
    assert not found[3].runs and not found[4].runs and found[4].collapsed == " ".join([phrase] * 2)
    assert [tuple(r)[:3] for r in found[5].runs] == [(0, 30, 1)]
    assert [tuple(r)[:3] for r in found[6].runs] == [tuple(r) for r in brute_runs(texts[6].split(), 24, 3)] and found[6].runs
    whole = op13.collapse_runs(docs)
    assert whole.columns == docs.columns
    kept = {r.doc_id: r for r in whole.collect() if r.doc_id < 100}
    assert kept[1].text == found[1].collapsed and kept[3].text == texts[3] and kept[1]["a.b"] == "a.b"
    assert op13.periodic_runs(docs).count() == len(rows) and op13.periodic_runs(docs.limit(0)).count() == 0


def test_planted_texts_follow_the_contract(spark, odd_rows):
    rng = random.Random(2)
    rows = [(k, sentence(rng, rng.randint(0, 90))) for k in range(400)] + [(r[0], r[1]) for r in odd_rows]
    for row, (i, text) in zip(queries.planted(frame(spark, rows)).collect(), rows, strict=True):
        words = re.findall("[^ \t-\r]+", text or "")
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            assert row.text.split(" ") == [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        else:
            assert row.text == text
