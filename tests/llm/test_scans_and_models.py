"""Operators 3, 4, 6, 8, 9 and 10, and the pipeline."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lamina.llm import op03_decontaminate as op3
from lamina.llm import op04_license_scan as op4
from lamina.llm import op06_language_id as op6
from lamina.llm import op08_sentencepiece as op8
from lamina.llm import op09_sharding as op9
from lamina.llm import op10_toxicity as op10
from lamina.llm import queries
from lamina.llm.kernels import text_slices, words_of
from lamina.session import table
from tests.compare import rows_of, rows_of_sql
from tests.llm.conftest import frame, sentence


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("block_words", [op3.BLOCK_WORDS, 60])
def test_contaminated_tolerates_substitutions(spark, odd_rows, block_words):
    rng = random.Random(4)
    tests = [sentence(rng, n) for n in (40, 25, 14, 6, 2)]

    def changed(text, n):
        words = text.split()
        for k in range(3, len(words), max(1, len(words) // n))[:n]:
            words[k] = sentence(rng, 1)
        return " ".join(words)

    wrap = lambda t: f"{sentence(rng, 50)} {t} {sentence(rng, 30)}"
    rows = [(100 + k, wrap(t)) for k, t in enumerate(tests)] + [(200, wrap(changed(tests[0], 4))), (201, wrap(changed(tests[1], 2))), (300, sentence(rng, 200)), (301, wrap(" ".join(tests[0].split()[:8])))]
    rows += [(r[0], r[1]) for r in odd_rows]
    bench = items(spark, [*enumerate(tests), (50, None), (51, ""), (None, tests[0])])
    found = op3.contaminated(frame(spark, rows), bench, block_words=block_words).collect()
    pairs = {(r.doc_id, r.item_id) for r in found}
    assert pairs == {(100, 0), (100, None), (101, 1), (102, 2), (103, 3), (104, 4), (200, 0), (200, None), (201, 1)}
    texts = dict(rows)
    for r in found:
        span = texts[r.doc_id].encode()[r.start : r.stop].decode()
        assert len(span.split()) == r.last_word - r.first_word + 1 == r.matched + r.substituted
    kept = op3.drop_contaminated(frame(spark, rows), bench, block_words=block_words)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {d for d, _ in pairs}
    assert kept.columns == frame(spark, rows).columns
    assert op3.contaminated(frame(spark, rows), bench.limit(0)).count() == 0
    assert op3.contaminated(frame(spark, rows).limit(0), bench).count() == 0


def test_longest_stretch_has_the_most_equal_words_of_all():
    rng = np.random.default_rng(1)
    for n in [*range(1, 9), *[30] * 60]:
        equal = rng.random(n) < rng.choice([0.6, 0.75, 0.9])
        allowed = [(x, y) for x in range(n) for y in range(x + 1, n + 1) if 4 * (~equal[x:y]).sum() <= y - x]
        a, b = op3.longest_stretch(equal)
        assert equal[a:b].sum() == max((equal[x:y].sum() for x, y in allowed), default=0)
        assert a == b or ((a, b) in allowed and equal[a] and equal[b - 1])
        longest = max((y - x for x, y in allowed), default=0)
        assert not allowed or any(y - x == longest and equal[x:y].sum() == equal[a:b].sum() for x, y in allowed)


@pytest.mark.parametrize(
    ("n", "substituted"), [(20, {9, 10, 11}), (15, {4, 6}), (16, {3, 7, 11, 15}), (40, set(range(3, 40, 4))), (15, {5, 6, 7})]
)
def test_contaminated_by_clustered_and_even_substitutions(spark, n, substituted):
    rng = random.Random(n)
    words = sentence(rng, n).split()
    altered = [sentence(rng, 1) if k in substituted else w for k, w in enumerate(words)]
    more = [sentence(rng, 1) if k in substituted or k % 2 == 0 else w for k, w in enumerate(words)]
    rows = [(k, f"{sentence(rng, 30)} {' '.join(w)} {sentence(rng, 30)}") for k, w in enumerate((altered, more))]
    found = op3.contaminated(frame(spark, rows), items(spark, [(7, " ".join(words))])).collect()
    last = max(set(range(n)) - substituted)
    assert [(r.doc_id, r.item_id, r.first_word, r.last_word, r.matched) for r in found] == [(0, 7, 30, 30 + last, n - len(substituted))]


def brute_stretches(equal, least):
    """Longest allowed stretch first (of the most equal words, then the first), then both sides."""
    n = len(equal)
    allowed = [(x, y) for x in range(n) for y in range(x + 1, n + 1) if equal[x] and equal[y - 1] and 4 * sum(not e for e in equal[x:y]) <= y - x]
    if not allowed:
        return []
    most = max(sum(equal[x:y]) for x, y in allowed)
    if most < least:
        return []
    x, y = min((a for a in allowed if sum(equal[a[0] : a[1]]) == most), key=lambda a: (a[1], -a[0]))
    return [(x, y), *brute_stretches(equal[:x], least), *[(y + a, y + b) for a, b in brute_stretches(equal[y:], least)]]


def brute_overlaps(docs, tests):
    """(doc, item, first word, last word, matched) on every diagonal, without any seed."""
    fold = lambda t: [w.lower() for w in re.findall(r"[0-9A-Za-z]+", t)]
    out = []
    for i, text in docs:
        own = fold(text)
        for k, item in tests:
            test = fold(item)
            least = op3.needed(len(test), op3.MIN_MATCHED)
            for diagonal in range(-len(test) + 1, len(own)):
                a, b = max(0, diagonal), min(len(own), diagonal + len(test))
                equal = [own[x] == test[x - diagonal] for x in range(a, b)]
                if sum(equal) >= least:
                    out += [(i, k, a + x, a + y - 1, sum(equal[x:y])) for x, y in brute_stretches(equal, least)]
    return out


@pytest.mark.parametrize("n", range(4, 17))
def test_some_seed_is_left_wherever_a_quarter_is_substituted(n):
    import itertools

    windows = [{s + d for d, c in enumerate(m) if c == "1"} for m in op3.masks_for(n) for s in range(n - len(m) + 1)]
    assert all(any(not w & set(gone) for w in windows) for gone in itertools.combinations(range(n), n // 4))


def test_contaminated_matches_brute_force(spark):
    rng = random.Random(12)
    tests = [(k, sentence(rng, n)) for k, n in enumerate((60, 33, 15, 5, 3, 24))] + [(9, "again " * 20)]
    docs = []
    for i in range(24):
        words = rng.choice(tests)[1].split()
        for k in range(rng.randint(0, len(words) // 3)):
            words[rng.randrange(len(words))] = sentence(rng, 1)
        docs.append((i, f"{sentence(rng, 12)} {' '.join(words)} {sentence(rng, 9)}"))
    middle = tests[0][1].split()
    docs += [(50, " ".join([*middle[:20], *sentence(rng, 20).split(), *middle[40:]])), (51, "again " * 30)]
    found = op3.contaminated(frame(spark, docs), items(spark, tests)).collect()
    got = sorted((r.doc_id, r.item_id, r.first_word, r.last_word, r.matched) for r in found)
    assert got == sorted(brute_overlaps(docs, tests))
    assert {(50, 0, 0, 19, 20), (50, 0, 40, 59, 20)} <= set(got)


def test_license_scan_matches_sql_and_odd_rows(spark, duck, data, odd_rows):
    assert rows_of(queries.op4_license_scan(spark, data)) == rows_of_sql(duck, op4.oracle_sql())[1]
    rows = [(r[0], r[1]) for r in odd_rows] + [
        (50, "CC BY cc-by; all RIGHTS reserved. GENERAL public License"),
        (51, "Permission is hereby granted, free of charge, to any lucky person obtaining a copy of this software and its documentation files"),
        (52, "general license public rights reserved all"),
        (53, "ccK by"),
    ]
    found = {r.doc_id: r for r in op4.license_scan(frame(spark, rows)).collect()}
    assert len(op4.license_scan(frame(spark, rows)).collect()) == len(rows)
    assert (found[50].n_base, found[50].first_word, found[50].last_word, found[50].base_labels) == (4, 0, 7, "cc-by,gpl,reserved")
    assert (found[51].labels, found[51].base_labels, found[51].n_base) == ("mit", "", 0) and 0.8 <= found[51].score < 1
    assert (found[52].n_base, found[53].n_base, found[1].n_words, found[1].first_word, found[1].score) == (0, 0, 0, None, 0.0)
    assert found[3].n_words == 30_000 and op4.license_scan(frame(spark, rows).limit(0)).count() == 0


def test_words_agree_with_a_regular_expression(odd_rows):
    texts = [r[1] for r in odd_rows] + ["a1É-b", "x" * 10]
    for part in text_slices(pa.array(texts), 64):
        words = words_of(part)
        for k in range(len(part)):
            text = texts[part.first + k] or ""
            want = [m.group() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
            a, b = words.bounds[k], words.bounds[k + 1]
            assert [bytes(part.data[s:e]).decode() for s, e in zip(words.starts[a:b], words.ends[a:b])] == want
            same = {}
            for w, h in zip(want, words.hashes[a:b].tolist()):
                folded = re.sub("[A-Z]", lambda m: m.group().lower(), w)
                assert same.setdefault(folded, h) == h


def test_language_id_on_held_out_rows(spark, data, odd_rows):
    docs = table(spark, data, "documents")
    model = op6.fit(docs.where(~queries.held_out()))
    found = op6.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(queries.held_out())
    assert found.where("lang_pred = lang").count() >= 0.95 * found.count()
    odd = op6.identify(frame(spark, odd_rows), model).collect()
    assert len(odd) == len(odd_rows)
    assert all((r.lang_pred == "und") == (r.doc_id in (1, 2, 6, 7) or (r.doc_id is None and r.score == 0)) for r in odd)
    nothing = op6.fit(docs.limit(0))
    assert {r.lang_pred for r in op6.identify(docs, nothing).collect()} == {"und"}
    assert op6.identify(docs.limit(0), model).count() == 0


_U64 = (1 << 64) - 1


def plain_mix(x):
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = ((x ^ (x >> 33)) * factor) & _U64
    return x ^ (x >> 33)


def plain_grams(text, n, bits):
    """Buckets of the ``n``-grams of one text, in plain Python."""
    folded = [32, *[ord(c.lower()) if len(c.lower()) == 1 and c.isalpha() else ord(c) if c.isalpha() else 32 for c in text or ""], 32]
    factors = [plain_mix(((k * 0x9E3779B97F4A7C15) + (41 + n) * 0x632BE59BD9B4E019) & _U64) | 1 for k in range(1, n + 1)]
    return [plain_mix(sum(c * f for c, f in zip(folded[k : k + n], factors)) & _U64) >> (64 - bits) for k in range(len(folded) - n + 1)]


def test_language_id_matches_plain_bayes(spark):
    rng = random.Random(14)
    spell = {"xx": "abcde", "yy": "cdefg", "zz": "efgah"}
    docs = [(k, "".join(rng.choice(spell[g] + " ,") for _ in range(rng.randint(3, 40))), g, "s") for k in range(90) for g in [rng.choice(["xx", "xx", "yy", "zz"])]]
    model = op6.fit(frame(spark, docs[:60]))
    counts, totals = {g: Counter() for g in sorted(spell)}, Counter()
    for _, text, g, _ in docs[:60]:
        totals[g] += 1
        for n in op6.SIZES:
            counts[g].update(plain_grams(text, n, op6.BITS))
    for r in op6.identify(frame(spark, docs), model).collect():
        text = docs[r.doc_id][1]
        grams = [b for n in op6.SIZES for b in plain_grams(text, n, op6.BITS)]
        score = {g: np.log(totals[g] / 60) + sum(np.log((c[b] + op6.SMOOTHING) / (sum(c.values()) + op6.SMOOTHING * 2**op6.BITS)) for b in grams) for g, c in counts.items()}
        best = max(sorted(score), key=score.get)
        share = 1 / sum(np.exp(s - score[best]) for s in score.values())
        if any(c.isalpha() for c in text):
            assert r.lang_pred == best or abs(sorted(score.values())[-2] - score[best]) < 1e-3
            assert abs(r.score - share) < 1e-3
        else:
            assert (r.lang_pred, r.score) == ("und", 0.0)


def test_every_language_is_sampled_and_none_left_out(spark, monkeypatch):
    rows = [(k, "text", "en" if k % 100 else "rare", "s") for k in range(3000)]
    docs = frame(spark, rows)
    counts = {"en": 2970, "rare": 30}
    got = {r.lang: r["count"] for r in op6.stratified(docs, counts, 500, "doc_id", "lang").groupBy("lang").count().collect()}
    assert got["rare"] == 30 and 350 < got["en"] < 650
    monkeypatch.setattr(op6, "MAX_LANGUAGES", 1)
    with pytest.raises(ValueError, match="languages"):
        op6.fit(docs)


def test_toxicity_matches_plain_ratios_and_scores(spark):
    rng = random.Random(15)
    rows = [(k, sentence(rng, 8) + (" vileword" if k % 4 == 0 else "")) for k in range(120)]
    docs, marks = frame(spark, rows), [(k, int(k % 4 == 0)) for k, _ in rows]
    model = op10.fit(docs, spark.createDataFrame(marks, "doc_id long, toxic int"), features=200)
    sets = {k: {b for n in op10.SIZES for b in plain_grams(t, n, op10.BITS)} for k, t in rows}
    toxic, clean = Counter(b for k, s in sets.items() if k % 4 == 0 for b in s), Counter(b for k, s in sets.items() if k % 4 for b in s)

    def gain(b):
        both, parts = toxic[b] + clean[b], [(toxic[b], 0.25), (clean[b], 0.75)]
        return sum(n * np.log(n / (both * share)) for n, share in parts if n)

    chosen = sorted({*toxic, *clean}, key=lambda b: (-round(gain(b), 9), b))[:200]
    places = model.place[chosen]
    assert (model.place >= 0).sum() == 200 and (places >= 0).mean() > 0.99
    scores = {r.doc_id: r.score for r in op10.toxicity(docs, model).collect()}
    for k, s in sets.items():
        z = model.bias + sum(model.weights[model.place[b]] for b in s if model.place[b] >= 0)
        assert abs(scores[k] - 1 / (1 + np.exp(-z))) < 1e-9
    # the fit is a minimum of the penalised loss: no small step of bias or of a weight in its ratio's direction lowers it by much
    y = np.array([k % 4 == 0 for k, _ in rows], float)
    loss = lambda d: float(np.mean(np.logaddexp(0, np.where(y == 1, -1, 1) * (np.log([scores[k] / (1 - scores[k]) for k, _ in rows]) + d))))
    assert abs(loss(1e-3) - loss(-1e-3)) < 1e-4
    ratio = lambda b: np.log((toxic[b] + 1) / 32) - np.log((clean[b] + 1) / 92)
    vile = [b for b in chosen if toxic[b] == 30 and clean[b] == 0]
    assert vile and all(np.sign(model.weights[model.place[b]]) == 1 and ratio(b) > 3 for b in vile)


def test_toxicity_on_held_out_rows(spark, data, odd_rows):
    rng = random.Random(8)
    bad = ["vileword", "nastyword", "uglyword"]
    rows, marks = [], []
    for k in range(400):
        words = sentence(rng, rng.randint(5, 60)).split()
        toxic = k % 5 == 0
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((k, " ".join(words)))
        marks.append((k, int(toxic)))
    docs = frame(spark, rows + [(1000 + k, *r[1:]) for k, r in enumerate(odd_rows)])
    labels = spark.createDataFrame([*marks, (0, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    model = op10.fit(docs, labels.where(~queries.held_out()))
    scores = {r.doc_id: r.score for r in op10.toxicity(docs, model).collect()}
    held = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 4 == 2]
    hit = {k: scores[k] >= op10.THRESHOLD for k in held}
    assert sum(hit[k] == (k % 5 == 0) for k in held) >= 0.95 * len(held)
    assert all(0 <= s <= 1 for s in scores.values())
    kept = op10.drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, s in scores.items() if s < op10.THRESHOLD}
    none = op10.fit(docs, labels.limit(0))
    assert {r.score for r in op10.toxicity(docs, none).collect()} == {0.0}
    assert op10.toxicity(docs.limit(0), model).count() == 0


def model_pieces(texts, dropout, seed=1):
    vocabulary = op8.read_vocabulary(queries.PIECE_MODEL)
    out = []
    for part in text_slices(pa.array(texts)):
        ids = np.arange(part.first, part.first + len(part)).astype(np.uint64)
        pieces, bounds = op8.encode_slice(vocabulary, part, ids, dropout, seed, 8)
        out += [pieces[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    return out


def test_pieces_without_dropout_are_the_library_s(spark, data):
    import sentencepiece

    texts = [r.text for r in table(spark, data, "documents").limit(60).collect()] + ["", "  two  spaces ", "aaaaaaaaaaaa", "日本語 é\x00\U0001f600", "tab\tnew\n\nline"]
    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    assert model_pieces(texts, 0.0) == [library.encode(t) for t in texts]


def brute_dropout(vocabulary, word, key, rate):
    """One unit by a plain agenda: the best pair first, the leftmost of equals, skipped for good if its hash says so."""
    symbols = [(k, k + 1, int(vocabulary.char_id[ord(c)])) for k, c in enumerate(word)]
    merges = dict(zip(vocabulary.pair_keys.tolist(), vocabulary.pair_ids.tolist()))
    skipped = set()
    while True:
        best = None
        for n, (a, b) in enumerate(zip(symbols, symbols[1:])):
            merged = merges.get(a[2] << 32 | b[2])
            if merged is not None and (a[0], b[0], b[1]) not in skipped:
                best = min([x for x in (best, (int(vocabulary.rank[merged]), n, merged)) if x])
        if best is None:
            return [s for _, _, s in symbols]
        _, n, merged = best
        start, middle, stop = symbols[n][0], symbols[n + 1][0], symbols[n + 1][1]
        candidate = np.array([start << 42 | middle << 21 | stop], np.uint64)
        if op8.mix(np.array([key], np.uint64) ^ op8.mix(candidate + np.uint64(1)))[0] < np.uint64(int(rate * 2.0**64)):
            skipped.add((start, middle, stop))
        else:
            symbols[n : n + 2] = [(start, stop, merged)]


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5])
def test_merge_dropout_matches_a_plain_agenda(rate):
    vocabulary = op8.read_vocabulary(queries.PIECE_MODEL)
    rng = random.Random(6)
    words = ["▁" + rng.choice(["there", "nation", "aaaaaa", "internationalisation", "x", "thethethe"]) for _ in range(200)]
    keys = np.array([rng.getrandbits(64) for _ in words], np.uint64)
    symbols = np.concatenate([vocabulary.char_id[[ord(c) for c in w]] for w in words])
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    pieces, at = op8.merge_units(vocabulary, symbols, bounds, keys, rate)
    assert [pieces[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [brute_dropout(vocabulary, w, k, rate) for w, k in zip(words, keys)]


@pytest.mark.parametrize("rate", [0.1, 0.4])
def test_every_occurrence_of_a_word_is_drawn_by_itself(rate):
    vocabulary = op8.read_vocabulary(queries.PIECE_MODEL)
    words = ["international", "the", "nation"] * 12
    part = next(text_slices(pa.array([" ".join(words * 40), "", " ".join(words) + " \u65e5"])))
    pieces, bounds = op8.encode_slice(vocabulary, part, np.array([3, 4, 5], np.uint64), rate, 1)
    own = [pieces[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    one = lambda x: np.array([x], np.uint64)
    want = []
    for number, word in enumerate(words):
        codes = np.array([op8.SPACE, *map(ord, word)], np.uint64)
        powers = np.multiply.accumulate(np.array([1, *[op8.stream(53, 1)[0] | np.uint64(1)] * len(word)], np.uint64))
        content = op8.mix(one((codes * powers).sum(dtype=np.uint64) + np.uint64(0x9E37 * len(codes))))
        draw = op8.mix(op8.mix(one(5 + 1)) ^ op8.mix(one(number + 7)))
        want += brute_dropout(vocabulary, "\u2581" + word, int(op8.mix(content ^ op8.mix(draw + np.uint64(1)))[0]), rate)
    assert own[1] == [] and own[2][: len(want)] == want
    starts = [k for k, p in enumerate(own[0]) if vocabulary.piece_bytes[p].startswith(b" ")]
    cuts = [tuple(own[0][a:b]) for a, b in zip(starts, [*starts[1:], None])]
    assert len(cuts) == len(words) * 40 and len(set(cuts[::3])) > 8


def test_encoding_round_trip(spark, odd_rows):
    docs = frame(spark, odd_rows)
    encoded = op8.encode(docs, queries.PIECE_MODEL, check=True)
    assert sorted(encoded.columns) == sorted({*docs.columns, "pieces", "lossless"})
    rows = op8.decode(encoded, queries.PIECE_MODEL).collect()
    assert len(rows) == len(odd_rows) and all(r.lossless and r.decoded == (r.text or "") for r in rows)
    assert {tuple(r.pieces) for r in rows if r.text in (None, "")} == {()}
    assert op8.encode(docs.limit(0), queries.PIECE_MODEL).count() == 0
    text = "the international nation of nations " * 40
    once, again = model_pieces([text] * 3, 0.3), model_pieces([text] * 3, 0.3)
    assert once == again and len({tuple(x) for x in once}) == 3 and len({tuple(x) for x in model_pieces([text], 0.3, 2) + once}) == 4


def test_shards_are_even_and_match_the_mixture(spark, odd_rows):
    rng = random.Random(3)
    rows = [(k, sentence(rng, 3), "en", rng.choice(["hot", "hot", "a", "b"])) for k in range(500)] + odd_rows
    found = op9.stratified_shards(frame(spark, rows), shards=10).collect()
    counts = Counter(r.shard for r in found)
    assert len(found) == len(rows) and max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(10))
    assert sorted((r.shard, r.slot) for r in found) == [(s, k) for s in range(10) for k in range(counts[s])]
    for source, n in Counter(r.source for r in found).items():
        own = Counter(r.shard for r in found if r.source == source)
        assert all(abs(own[s] - n / 10) <= 1.5 for s in range(10))
    texts = sorted((r.size, r.text_crc32) for r in found)
    assert texts == sorted((len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert op9.stratified_shards(frame(spark, rows).limit(0)).count() == 0
    assert sorted(r.shard for r in op9.stratified_shards(frame(spark, rows[:2]), shards=10).collect()) == [0, 5]


def test_ranks_follow_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    assert op9.with_rank(df.repartition(5), "v").where("v <> rank").count() == 0


def test_pipeline_matches_its_parts(spark, data):
    """Each stage's rows follow from brute-force versions of its decisions."""
    import corpus_pipeline
    from tests.llm.test_dedup import brute_exact, brute_near

    docs = table(spark, data, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        docs = corpus_pipeline.cut(stage(spark, docs, data))
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "toxicity":
            # fitted on the labelled rows that are not held out alone; what the scores decide is what goes
            known = table(spark, data, "labels").where(~queries.held_out())
            scored = op10.toxicity(table(spark, data, "documents"), op10.fit(table(spark, data, "documents"), known))
            assert after == {r.doc_id for r in scored.collect() if r.score < op10.THRESHOLD}
            marks = {r.doc_id: r.toxic for r in known.collect()}
            assert sum((i in after) != bool(m) for i, m in marks.items()) >= 0.9 * len(marks)
        elif name == "exact_dedup":
            assert after == {max(ids) for ids in brute_exact(before.items()).values()}
        elif name == "ngram_jaccard":
            found = brute_near(before.items())
            assert after == {i for i in before if found.get(i, (i,))[0] == i}
        elif name == "decontaminate":
            tests = [r.text for r in table(spark, data, "benchmark").collect()]
            assert not any(t in before[i] for t in tests for i in after) and {i for i, x in before.items() if any(t in x for t in tests)} <= set(before) - after
        elif name == "sentencepiece":
            assert after == set(before) and docs.where("NOT lossless").count() == 0
        if name != "sentencepiece":
            assert docs.columns == list(corpus_pipeline.COLUMNS) and docs.count() == len(after)


def test_query_contracts(spark, duck, data):
    assert rows_of(queries.op2_exact_dedup(spark, data)) == rows_of_sql(duck, queries.OP2_SQL)[1]
    assert queries.op9_sharding(spark, data).columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def test_long_units_have_the_same_pieces_by_agenda(monkeypatch):
    import time

    from lamina.llm.kernels import Texts

    vocabulary = op8.read_vocabulary(queries.PIECE_MODEL)
    rng = random.Random(1)

    def encoded(texts, rate):
        data = [t.encode() for t in texts]
        offsets = np.cumsum([0] + [len(d) for d in data])
        return [x.tolist() for x in op8.encode_slice(vocabulary, Texts(0, np.frombuffer(b"".join(data), np.uint8), offsets), np.arange(len(texts), dtype=np.uint64), rate, 5)]

    words = ["".join(rng.choice("abcdefghij日É") for _ in range(rng.choice([3, 8, 40, 64, 65, 200, 500]))) for _ in range(40)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(40)]
    for rate in (0.0, 0.1, 0.6):
        agenda = encoded(texts, rate)
        monkeypatch.setattr(op8, "SIDE_BY_SIDE", 1 << 40)
        assert encoded(texts, rate) == agenda
        monkeypatch.undo()
    long = "".join(rng.choice("etaoinshrdlu") for _ in range(300_000))
    began = time.perf_counter()
    pieces, bounds = encoded([long], 0.1)
    assert time.perf_counter() - began < 30
    assert "".join(vocabulary.piece_bytes[k].decode() for k in pieces) == " " + long and bounds == [0, len(pieces)]


def test_languages_are_scored_alike_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(3)
    names = [f"l{k:03d}" for k in range(200)]
    counts = rng.random((1 << op6.BITS, 200)) + 0.01
    model = op6.LanguageModel(names, np.log(np.full(200, 1 / 200)), np.log(counts / counts.sum(0)).astype(np.float32))
    docs = frame(spark, [(k, sentence(random.Random(k), 1 + 40 * k)) for k in range(20)] + [(90, ""), (91, None)])
    whole = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in op6.identify(docs, model).collect()}
    monkeypatch.setattr(op6, "GATHERED", 200 * 7)
    pieces = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in op6.identify(docs, model).collect()}
    assert pieces == whole and whole[90] == whole[91] == (op6.UNKNOWN, 0.0)


def test_shards_match_a_plain_interleaving(spark, data, odd_rows):
    """Ranks by two plain sorts: within each source by the seeded hash, then all by fractional rank; runs of equal length are the shards."""
    import hashlib

    documents = [tuple(r) for r in table(spark, data, "documents").select("doc_id", "text", "lang", "source").collect()]
    full = [(*r, *["en", "s"][len(r) - 2 :])[:4] for r in odd_rows]
    order = lambda x: (x is not None, x)  # noqa: E731  null first
    for rows, shards in ((documents, 40), (full, 5), (full, 40)):
        entries = [(s, None if i is None else hashlib.sha256(f"{op9.SEED}:{i}".encode()).hexdigest(), i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 16) for i, t, _, s in rows]
        entries = [(s, hashlib.sha256(op9.SEED.encode()).hexdigest() if k is None else k, i, c, n) for s, k, i, c, n in entries]
        ranked = []
        for source in {e[0] for e in entries}:
            own = sorted((e for e in entries if e[0] == source), key=lambda e: (e[1], order(e[2]), e[3]))
            ranked += [((k + 0.5) / len(own), e) for k, e in enumerate(own)]
        ranked.sort(key=lambda r: (r[0], order(r[1][0]), r[1][1], order(r[1][2]), r[1][3]))
        total, want, slots = len(ranked), [], Counter()
        for k, (_, (source, _, i, crc, size)) in enumerate(ranked):
            shard = k * shards // total
            want.append((i, source, size, crc, shard, slots[shard]))
            slots[shard] += 1
        docs = frame(spark, rows)
        found = op9.stratified_shards(docs, shards=shards).select("doc_id", "source", "size", "text_crc32", "shard", "slot")
        assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))
        assert max(slots.values()) - min(slots[s] for s in range(min(shards, total))) <= 1
