import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, digest string, score double, pieces string, label string"
# names that clash with internal ones, or that SQL must quote
ODD_NAMES = ["__id", "__drop", "__digest", "own_digest", "KEPT_ID", "dropped_id", "removed_", "text_", "my col", "a.b", "c`d"]


def sentence(rng: random.Random, n: int) -> str:
    """Words that hardly ever repeat."""
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(n))


def frame(spark, rows):
    """documents from (id, text) or (id, text, lang, source), with extra columns whose names clash with internal ones."""
    full = [(*r, *["en", "s"][len(r) - 2 :])[:4] for r in rows]
    schema = SCHEMA + "".join(f", `{n.replace('`', '``')}` string" for n in ODD_NAMES)
    return spark.createDataFrame([(i, t, g, s, len(t or ""), "x", "y", 0.5, "z", "w", *ODD_NAMES) for i, t, g, s in full], schema)


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty and long texts, null ids and columns, repeated rows, ties."""
    rng = random.Random(5)
    long = sentence(rng, 30_000)
    base = sentence(rng, 120)
    return [
        (1, None),
        (2, ""),
        (3, long),
        (4, base),
        (4, base),
        (5, base),
        (None, base, None, None),
        (6, "." * 50),
        (7, "\n\n\t "),
        (8, "one"),
        (9, "one two three four"),
        (10, "É ß ▁ K 日本 \U0001f600\x00"),
        (None, None, None, None),
    ]
