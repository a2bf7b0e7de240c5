"""A corpus pipeline of five stages, each a filter or encoder of lamina.llm over all its predecessor kept.

``run`` applies the stages to ``documents`` in order; a caller that writes each stage to Parquet and reads
it again gets the same rows. All but the last stage return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import op01_ngram_jaccard, op02_exact_dedup, op03_decontaminate, op08_sentencepiece, op10_toxicity
from lamina.llm.queries import PIECE_MODEL, held_out
from lamina.session import cut, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, fitted on the labelled rows that are not held out, scores below its threshold."""
    model = op10_toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return op10_toxicity.drop_toxic(docs.select(*COLUMNS), model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, the one with the largest id."""
    return op02_exact_dedup.drop_copies(docs.select(*COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies, the one with the least id."""
    return op01_ngram_jaccard.drop_near_copies(docs.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no passage of a benchmark item."""
    return op03_decontaminate.drop_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, pieces, and whether the pieces decode to the text."""
    encoded = op08_sentencepiece.encode(docs.select(*COLUMNS), PIECE_MODEL, check=True)
    return encoded.select("doc_id", "lang", "source", "pieces", F.size("pieces").cast("long").alias("n_pieces"), "lossless")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("sentencepiece", encode),
]

#: The classifier, the near-duplicate classes and the pieces have no SQL form; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
