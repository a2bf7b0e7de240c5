"""Exact dedup by skew-safe combining.

Equal texts are found in three steps, each of which compares whole contents, the digest
only routing rows:

1. local: Spark's map-side combine groups by (digest, salt, text) inside every task;
2. salted: the partial groups meet by (digest, salt); a digest that holds more than
   ``HOT_SHARE`` of all rows is spread over ``SALTS`` salts, any other has salt 0;
3. global: the winners of the salts of a hot digest are grouped by text once more.

At most ``1 / HOT_SHARE`` digests can be hot, so their list is bounded whatever the input.

Defined results: null text counts as empty; a null id is smaller than any other; rows
repeated with the same id and text are one group member each, and exactly one of them
stays; an empty table gives an empty result; other columns are not read, and pass through ``drop_copies`` whatever their names. Texts that differ
but share a digest are kept apart (a second pass over those digests alone compares texts).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.rows import free_name
from lamina.session import cut

SALTS = 32
HOT_SHARE = 1e-3


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    salts: int = SALTS,
    hot_share: float = HOT_SHARE,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, digest.

    The row with the largest id stays.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn(
        "digest", digest(F.col("text"))
    )
    limit = docs.count() * hot_share
    hot = [
        r.digest
        for r in rows.groupBy("digest").count().where(F.col("count") > max(1.0, limit)).select("digest").collect()
    ]
    is_hot = F.col("digest").isin(hot) if hot else F.lit(False)
    salted = rows.withColumn(
        "salt", F.when(is_hot, F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    )
    merged = cut(
        salted.groupBy("digest", "salt", "text")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("digest", "salt", F.when(is_hot, F.col("text")).alias("text"), "keep_id", "group_size")
    )
    calm = merged.where(~is_hot).select("digest", "salt", "keep_id", "group_size")
    combined = (
        merged.where(is_hot)
        .groupBy("digest", "text")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    )
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    winners = calm.unionByName(combined.select("digest", salt, "keep_id", "group_size"))
    # digests of more than one text: none but for a collision
    mixed = calm.select("digest").union(combined.select("digest")).groupBy("digest").count().where("count > 1").select("digest")
    members = salted.select("doc_id", "digest", "salt")
    if mixed.isEmpty():
        found = _ranked(members.join(winners, ["digest", "salt"]), ["digest", "salt"])
    else:
        apart = salted.join(mixed, "digest", "left_semi")
        groups = apart.groupBy("digest", "text").agg(
            F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
        )
        plain = members.join(mixed, "digest", "left_anti").join(winners, ["digest", "salt"])
        found = _ranked(plain, ["digest", "salt"]).unionByName(
            _ranked(apart.join(groups, ["digest", "text"]), ["digest", "text"])
        )
    return found


def _ranked(joined: DataFrame, by: list[str]) -> DataFrame:
    """A row for each member; of repeated rows only the first can stay."""
    counted = joined.groupBy(*by, "doc_id", "keep_id", "group_size").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return counted.select(
        "doc_id", "keep_id", "group_size", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"), "digest"
    ).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        "digest",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept, whatever they are called."""
    own, kept_id, kept_digest = (free_name(x, docs.columns) for x in ("own_digest", "kept_id", "kept_digest"))
    stays = exact_groups(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias(kept_id), F.col("digest").alias(kept_digest))
    marked = docs.withColumn(own, sha256(F.coalesce(F.col(text_col), F.lit(""))))
    joined = marked.join(stays, F.col(id_col).cast("long").eqNullSafe(F.col(kept_id)) & (F.col(own) == F.col(kept_digest)), "left_semi")
    return joined.dropDuplicates([id_col, own]).drop(own)
