"""Sharding by proportional stratified interleaving.

Rows of each source are shuffled by a seeded hash and get the fractional rank
``(rank - 0.5) / rows of the source``; sorting all rows by it interleaves the sources in
proportion, and cutting the sorted order into equal runs gives shards that all have the
mixture of the whole table. The law is ``rows``: counts of shards differ by one at most.

Both rankings are distributed sorts: a row's rank is the offset of its range partition
(one small row for each partition) plus its place in it, so no source, however large, meets
in one task.

Defined results: null text has no bytes and the checksum of the empty text; a null source
is a source of its own; a null id sorts first; rows repeated with the same id take
neighbouring places; an empty table gives an empty result; more shards than rows leaves
shards empty. Groups of equal texts are not held together: the method balances sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.session import cut

SHARDS = 40
SEED = "lamina-shards-1"


def with_rank(df: DataFrame, *order: str, name: str = "rank") -> DataFrame:
    """``df`` with its row number from 0 in the order of ``order``, without a single-task sort."""
    placed = cut(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    # one row for each partition of the sort: bounded by the number of tasks
    sizes = {r.part: r.rows for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows")).collect()}
    starts, total = [], 0
    for k in sorted(sizes):
        starts.append((k, total))
        total += sizes[k]
    if not starts:
        return df.withColumn(name, F.lit(0).cast("long")).limit(0)
    offsets = df.sparkSession.createDataFrame(starts, "__part long, __start long")
    return (
        placed.withColumn("__part", part)
        .join(F.broadcast(offsets), "__part")
        .withColumn(name, F.col("__start") + place)
        .drop("__part", "__start", "__at")
    )


def stratified_shards(
    docs: DataFrame,
    shards: int = SHARDS,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """doc_id, source, size, text_crc32, shard, slot for each row of ``docs``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    small = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).alias("source"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.sha2(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")), 256).alias("key"),
    )
    ordered = with_rank(small, "source", "key", "doc_id", "text_crc32", name="at")
    sources = ordered.groupBy("source").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    share = (F.col("at") - F.col("first") + F.lit(0.5)) / F.col("rows")
    mixed = ordered.alias("o").join(sources.alias("s"), F.col("o.source").eqNullSafe(F.col("s.source"))).select(
        "doc_id", "o.source", "size", "text_crc32", "key", share.alias("share")
    )
    ranked = with_rank(mixed, "share", "source", "key", "doc_id", "text_crc32", name="rank")
    total = F.lit(docs.count())
    shard = F.expr(f"(rank * {shards}) div total")
    # first rank of shard s: ceil(s * total / shards)
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return (
        ranked.withColumn("total", total)
        .withColumn("shard", shard)
        .withColumn("slot", F.col("rank") - first)
        .select("doc_id", "source", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot")
    )
