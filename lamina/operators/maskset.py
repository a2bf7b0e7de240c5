"""Masks as sets of voxel keys, and as runs of them along x."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VOXEL = ("t", "y", "x")


def union(*masks: DataFrame) -> DataFrame:
    found = masks[0].select(*VOXEL)
    for other in masks[1:]:
        found = found.union(other.select(*VOXEL))
    return found.distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*VOXEL).intersect(b.select(*VOXEL))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*VOXEL).subtract(b.select(*VOXEL))


def recompose(layers: DataFrame, operations: DataFrame) -> DataFrame:
    """Voxels left by ordered layers: operations is (layer_id, ord, op) with op union, select, subtract or none.

    The last layer that touches a voxel decides; layers before the last ``select`` do not count. A
    subtract with nothing before it, or an unknown operation, is an error.
    """
    live = operations.where("op <> 'none'")
    start = live.agg(
        F.coalesce(F.max(F.when(F.col("op") == "select", F.col("ord"))), F.min("ord")).alias("start"), F.min_by("op", "ord").alias("head")
    )
    valid = F.when(F.col("head") == "subtract", F.raise_error(F.lit("subtract before any union or select"))).otherwise(True)
    effect = F.when(F.col("op").isin("union", "select"), 1).when(F.col("op") == "subtract", 0).otherwise(
        F.raise_error(F.concat(F.lit("unknown operation "), F.col("op")))
    )
    used = live.join(F.broadcast(start)).where(valid & (F.col("ord") >= F.col("start"))).select("layer_id", "ord", effect.alias("effect"))
    return (
        layers.join(F.broadcast(used), "layer_id")
        .groupBy(*VOXEL)
        .agg(F.max_by("effect", "ord").alias("effect"))
        .where("effect = 1")
        .select(*VOXEL)
    )


def overlaps(pieces: DataFrame, piece: str = "layer_id") -> DataFrame:
    """Voxels that more than one piece holds, with the number of pieces; disjoint pieces give none."""
    return pieces.groupBy(*VOXEL).agg(F.count_distinct(piece).alias("owners")).where("owners > 1")


def duplicate_ids(layers: DataFrame, key: str = "layer_id") -> DataFrame:
    return layers.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def boxes(mask: DataFrame, *keys: str) -> DataFrame:
    """Half-open bounding boxes in the plane and foreground counts for each key."""
    return mask.groupBy(*keys).agg(
        F.min("y").alias("y0"),
        (F.max("y") + 1).alias("y1"),
        F.min("x").alias("x0"),
        (F.max("x") + 1).alias("x1"),
        F.count(F.lit(1)).alias("foreground"),
    )


def runs(mask: DataFrame, *keys: str) -> DataFrame:
    """Maximal runs [x0, x1) of each row: islands of x minus its rank."""
    row = [*keys, "t", "y"]
    island = F.col("x") - F.row_number().over(Window.partitionBy(*row).orderBy("x"))
    return mask.withColumn("island", island).groupBy(*row, "island").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1")).drop("island")


def voxels(runs_: DataFrame) -> DataFrame:
    kept = [c for c in runs_.columns if c not in ("x0", "x1")]
    return runs_.select(*kept, F.explode(F.sequence("x0", F.col("x1") - 1)).alias("x"))


def semantic_index(known: Column, foreground: Column) -> Column:
    """255 where nothing is known, else 1 or 0."""
    return F.when(~known, 255).when(foreground, 1).otherwise(0)


def score_threshold(confidence: Column) -> Column:
    """Least unsigned byte that counts as at least this confidence."""
    return F.ceil(F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)) * 255 - 1e-9).cast("int")


def pack_rows(mask: DataFrame, *keys: str) -> DataFrame:
    """A row for each plane row: its box and its voxels as a bit mask of 64 columns a word (word, bits)."""
    return (
        mask.withColumn("word", F.expr("x div 64"))
        .groupBy(*keys, "t", "y", "word")
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(x % 64 as int))")).alias("bits"))
        .withColumn("foreground", F.bit_count("bits"))
    )


def unpack_rows(packed: DataFrame) -> DataFrame:
    kept = [c for c in packed.columns if c not in ("word", "bits", "foreground")]
    bit = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit")
    return (
        packed.select(*kept, "word", "bits", bit)
        .where(F.expr("shiftrightunsigned(bits, bit) & 1") == 1)
        .select(*kept, (F.col("word") * 64 + F.col("bit")).cast("int").alias("x"))
    )


def prefix_until_empty(steps: DataFrame, key: str, order: str, occupied: str) -> DataFrame:
    """Rows of each key before its first row that is not occupied."""
    so_far = F.min(F.col(occupied).cast("int")).over(Window.partitionBy(key).orderBy(order))
    return steps.withColumn("so_far", so_far).where("so_far = 1").drop("so_far")
