"""License scans by diagonal voting, in DataFrame functions only.

All rolling word 2-grams of every text are hashed and joined (by broadcast: the templates are a
fixed list) with the 2-grams of the templates; the join compares the words as well, so a
hash never decides alone. A hit votes for the diagonal (place in the text minus place in the
template) of its text and template, with a bit for its place in the template. A diagonal with
all bits is the whole phrase, word for word. Diagonals at most ``SLACK`` apart are merged, so
words put in or left out do not part a statement, and a merged span is verified: the share of
the template's words that it covers must reach ``COVER`` within at most twice the
template's length.

The hits of a text meet in one task by the text's own row, so a term that is frequent in
the table makes no hot key.

Defined results: null counts as empty; a text without words has n_words 0, no labels and
score 0; rows repeated or with a null id give a row each; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What counts as a word, and the phrases to find (label, phrase).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = (
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
)
STATEMENTS = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("public-domain", "dedicated to the public domain"),
)
SLACK = 2
COVER = 0.8


def words(text: Column) -> Column:
    """Words of a text after A-Z became a-z; of other characters only the kelvin sign lower-cases to a lone ASCII letter."""
    folded = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("é")))
    return F.regexp_extract_all(folded, F.lit(WORD), F.lit(0))


def templates(spark: SparkSession) -> DataFrame:
    """A row for each 2-gram of each template (at most 60 words long, so that its places fit a long)."""
    rows = []
    for base, phrases in ((True, BASE), (False, STATEMENTS)):
        for label, phrase in phrases:
            own = phrase.split()
            rows += [(len(own), base, label, phrase, k, a, b) for k, (a, b) in enumerate(zip(own, own[1:], strict=False))]
    schema = "length int, base boolean, label string, phrase string, place int, first string, second string"
    return spark.createDataFrame(rows, schema).withColumn("hash", F.xxhash64("first", "second"))


def license_scan(docs: DataFrame, slack: int = SLACK, cover: float = COVER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of ``docs``."""
    cut_up = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), words(F.col(text_col)).alias("w")
    ).withColumn("n_words", F.size("w"))
    size = F.greatest(F.col("n_words") - 1, F.lit(0))
    pair = "array<struct<a:string,b:string>>"
    grams = F.arrays_zip(F.slice("w", F.lit(1), size), F.slice("w", F.lit(2), size)).cast(pair)
    # the last element, without words, carries the row itself
    itself = F.array(F.struct(F.lit(None), F.lit(None))).cast(pair)
    rolling = cut_up.select("row", "doc_id", "n_words", F.posexplode(F.concat(grams, itself)).alias("at", "gram")).select(
        "row", "doc_id", "n_words", "at", F.col("gram.a").alias("a"), F.col("gram.b").alias("b")
    )
    marks = F.broadcast(templates(docs.sparkSession))
    hits = (
        rolling.withColumn("h", F.xxhash64("a", "b"))
        .join(marks, (F.col("h") == F.col("hash")) & (F.col("a") == F.col("first")) & (F.col("b") == F.col("second")), "left")
        .where(F.col("phrase").isNotNull() | F.col("a").isNull())
        .select("row", "doc_id", "n_words", "at", "length", "base", "label", "phrase", "place")
        .repartition("row")
    )
    votes = (
        hits.withColumn("diagonal", F.col("at") - F.col("place"))
        .groupBy("row", "doc_id", "n_words", "phrase", "base", "label", "length", "diagonal")
        .agg(
            F.bit_or(F.expr("shiftleft(1L, place)")).alias("bits"),
            F.min("at").alias("first"),
            (F.max("at") + 2).alias("stop"),
        )
        .withColumn("whole", F.col("base") & (F.col("bits") == F.expr("shiftleft(1L, length - 1) - 1")))
    )
    along = Window.partitionBy("row", "phrase").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > slack, F.lit(True))
    spans = (
        votes.withColumn("apart", apart.cast("int"))
        .withColumn("span", F.sum("apart").over(along))
        .groupBy("row", "doc_id", "n_words", "phrase", "base", "label", "length", "span")
        .agg(
            F.bit_or("bits").alias("bits"),
            F.min("first").alias("first"),
            F.max("stop").alias("stop"),
            F.count_if("whole").alias("places"),
            F.min(F.when(F.col("whole"), F.col("diagonal"))).alias("first_word"),
            F.max(F.when(F.col("whole"), F.col("diagonal"))).alias("last_word"),
        )
    )
    covered = F.bit_count(F.col("bits").bitwiseOR(F.shiftleft("bits", 1))) / F.col("length")
    near = (F.col("stop") - F.col("first")) <= 2 * F.col("length")
    verified = spans.withColumn(
        "cover", F.when(F.col("base"), F.when(F.col("places") > 0, 1.0)).when(near, covered)
    )
    joined = lambda found: F.array_join(F.array_sort(F.collect_set(found)), ",")
    return (
        verified.groupBy("row", "doc_id", "n_words")
        .agg(
            F.sum("places").alias("n_base"),
            F.min("first_word").cast("long").alias("first_word"),
            F.max("last_word").cast("long").alias("last_word"),
            joined(F.when(F.col("places") > 0, F.col("label"))).alias("base_labels"),
            joined(F.when(F.col("cover") >= cover, F.col("label"))).alias("labels"),
            F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"),
        )
        .select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    )


def oracle_sql(slack: int = SLACK, cover: float = COVER) -> str:
    """The same scan for DuckDB, on a table ``documents``."""
    values = ", ".join(f"({str(base).lower()}, '{label}', '{phrase}')" for base, phrases in ((True, BASE), (False, STATEMENTS)) for label, phrase in phrases)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH phrases AS (SELECT *, string_split(phrase, ' ') AS p FROM (VALUES {values}) v(base, label, phrase)),
marks AS (SELECT base, label, phrase, len(p) AS length, k - 1 AS place, p[k] AS a, p[k + 1] AS b
          FROM (SELECT *, unnest(range(1, len(p))) AS k FROM phrases)),
texts AS (SELECT row_number() OVER () AS r, doc_id,
                 regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{WORD}') AS w FROM documents),
grams AS (SELECT r, k - 1 AS pos, w[k] AS a, w[k + 1] AS b FROM (SELECT *, unnest(range(1, len(w))) AS k FROM texts)),
votes AS (SELECT r, phrase, base, label, length, pos - place AS diagonal, bit_or(1::BIGINT << place::INT) AS bits, min(pos) AS lo, max(pos) + 2 AS hi
          FROM grams JOIN marks USING (a, b) GROUP BY ALL),
marked AS (SELECT *, base AND bits = (1::BIGINT << (length - 1)::INT) - 1 AS whole,
                  coalesce(diagonal - lag(diagonal) OVER (PARTITION BY r, phrase ORDER BY diagonal) > {slack}, true) AS apart FROM votes),
islands AS (SELECT *, sum(apart::INT) OVER (PARTITION BY r, phrase ORDER BY diagonal) AS span FROM marked),
spans AS (SELECT r, phrase, base, label, length, span, bit_or(bits) AS bits, min(lo) AS lo, max(hi) AS hi, count_if(whole) AS places,
                 min(diagonal) FILTER (whole) AS first_word, max(diagonal) FILTER (whole) AS last_word FROM islands GROUP BY ALL),
verified AS (SELECT *, CASE WHEN base THEN CASE WHEN places > 0 THEN 1.0::DOUBLE END
                            WHEN hi - lo <= 2 * length THEN bit_count(bits | (bits << 1))::DOUBLE / length END AS cover FROM spans)
SELECT any_value(doc_id) AS doc_id, any_value(len(w))::BIGINT AS n_words, coalesce(sum(places), 0)::BIGINT AS n_base,
       min(first_word)::BIGINT AS first_word, max(last_word)::BIGINT AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (places > 0), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (cover >= {cover}), '') AS labels,
       coalesce(max(cover), 0)::DOUBLE AS score
FROM texts LEFT JOIN verified USING (r) GROUP BY r
"""
