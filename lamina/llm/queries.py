"""The registered queries of the operators of this subpackage, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import op01_ngram_jaccard, op02_exact_dedup, op03_decontaminate, op04_license_scan, op05_suffix_dedup, op06_language_id, op07_substring_dedup, op08_sentencepiece, op09_sharding, op12_merkle_manifest as merkle, op13_periodic_runs
from lamina.llm import op10_toxicity as toxicity
from lamina.llm import op11_quality as quality
from lamina.session import table

PIECE_MODEL = os.environ.get("LAMINA_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
Query = Callable[[SparkSession, str], DataFrame]


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from learning: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op01_ngram_jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op02_exact_dedup.exact_groups(table(spark, sf_dir, "documents")).withColumnRenamed("digest", "text_sha256")


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (same ORDER BY doc_id DESC) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op03_decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op04_license_scan.license_scan(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op05_suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = op06_language_id.fit(docs.where(~held_out()))
    return op06_language_id.identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op07_substring_dedup.document_report(table(spark, sf_dir, "documents"))
    spans = F.transform("removed", lambda s: F.concat_ws("-", s["start"], s["stop"]))
    return found.select("doc_id", "shares_passage", "n_chars", "n_removed", F.array_join(spans, ",").alias("removed"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return op08_sentencepiece.encode(docs, PIECE_MODEL, check=True).select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        F.size("pieces").cast("long").alias("n_pieces"),
        F.sha2(F.array_join("pieces", " "), 256).alias("pieces_sha256"),
        "lossless",
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = op09_sharding.stratified_shards(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~held_out()))
    scored = toxicity.toxicity(docs, model)
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    )


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    kept_back = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = quality.fit(docs, labels.where(~kept_back))
    scored = quality.quality(docs, model)
    return scored.select("doc_id", kept_back.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    claimed = F.when(tampered, merkle.table_digest(text=lowered))
    return merkle.proofs(table(spark, sf_dir, "documents"), claimed=claimed).drop("source")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; every tenth document's text with a suffix of words made periodic, as the contract of operator 13 has it."""
    code = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", "[ \\x09-\\x0D]+"), lambda w: w != "")
    parted = docs.select("doc_id", "text", F.floor(code / 10).alias("seed"), F.when(code % 10 == 0, words).alias("words"))
    count = F.size("words")
    first = (F.col("seed") % F.nullif(count, F.lit(0))).cast("int")
    placed = parted.withColumn("first", first).withColumn("period", 1 + F.floor((count - F.col("first")) / (3 + F.col("seed") % 8)).cast("int"))
    # the period, written out as often as the suffix needs it
    period = F.slice("words", F.col("first") + 1, F.col("period"))
    needed = count - F.col("first")
    suffix = F.slice(F.flatten(F.array_repeat(period, F.ceil(needed / F.col("period")).cast("int"))), F.lit(1), needed)
    return placed.select("doc_id", F.when(count > 0, F.array_join(F.concat(F.slice("words", F.lit(1), F.col("first")), suffix), " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op13_periodic_runs.periodic_runs(planted(table(spark, sf_dir, "documents")))
    ahead = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    # runs are in the order of start and period, so of equal exponents the first stays
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda b, r: F.when(ahead(r, b), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n"))))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Query] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_license_scan": op4_license_scan,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_language_id": op6_language_id,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_sharding": op9_sharding,
    "op10_toxicity": op10_toxicity,
    "op11_quality": op11_quality,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_periodic_runs": op13_periodic_runs_query,
}
SQL: dict[str, str] = {"op2_exact_dedup": OP2_SQL, "op4_license_scan": op04_license_scan.oracle_sql(), "op12_merkle_manifest": merkle.oracle_sql(), "op13_periodic_runs": op13_periodic_runs.oracle_sql()}
