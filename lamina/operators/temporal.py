"""Anchors, windows, islands and ranges over integer frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Frames of a window, of them before the anchor, and the advance of a directional window.
WINDOW = 30
BEFORE = 14
ADVANCE = 29


def anchor_domains(anchors: DataFrame, start: int, stop: int, key: str = "lineage", frame: str = "frame") -> DataFrame:
    """[start, stop) of the frames nearest each anchor; a frame midway goes to the earlier anchor."""
    along = Window.partitionBy(key).orderBy(frame)
    before, after = F.lag(frame).over(along), F.lead(frame).over(along)
    halfway = lambda other: F.floor((other + F.col(frame)) / 2).cast("int") + 1
    return anchors.withColumn("start", F.coalesce(halfway(before), F.lit(start))).withColumn(
        "stop", F.coalesce(halfway(after), F.lit(stop))
    )


def domain_windows(domains: DataFrame, frame: str = "frame") -> DataFrame:
    """Windows of each domain: one about the anchor, then steps outwards that share one frame.

    Adds direction (center, forward, backward), step, lo, hi, and the owned frames [own_lo, own_hi).
    """
    size = F.least(F.lit(WINDOW), F.col("stop") - F.col("start"))
    lo = F.greatest(F.col("start"), F.least(F.col(frame) - BEFORE, F.col("stop") - size))
    based = domains.withColumn("c_lo", lo).withColumn("c_hi", lo + size)
    center = F.struct(F.lit("center").alias("direction"), F.lit(0).alias("step"), F.col("c_lo").alias("lo"), F.col("c_hi").alias("hi"), F.col("c_lo").alias("own_lo"), F.col("c_hi").alias("own_hi"))

    def steps(distance):
        return F.sequence(F.lit(1), F.ceil(distance / ADVANCE).cast("int"))

    def forward(k):
        own = F.col("c_hi") + (k - 1) * ADVANCE
        hi = F.least(F.col("stop"), own + ADVANCE)
        return F.struct(F.lit("forward").alias("direction"), k.alias("step"), (own - 1).alias("lo"), hi.alias("hi"), own.alias("own_lo"), hi.alias("own_hi"))

    def backward(k):
        own = F.col("c_lo") - (k - 1) * ADVANCE
        low = F.greatest(F.col("start"), own - ADVANCE)
        return F.struct(F.lit("backward").alias("direction"), k.alias("step"), low.alias("lo"), (own + 1).alias("hi"), low.alias("own_lo"), own.alias("own_hi"))

    right, left = F.col("stop") - F.col("c_hi"), F.col("c_lo") - F.col("start")
    none = F.filter(F.array(center), lambda _: F.lit(False))
    windows = F.concat(
        F.array(center),
        F.when(right > 0, F.transform(steps(right), forward)).otherwise(none),
        F.when(left > 0, F.transform(steps(left), backward)).otherwise(none),
    )
    return based.withColumn("w", F.explode(windows)).select(*domains.columns, "w.*")


def episodes(active: DataFrame, key: str = "lineage", frame: str = "frame") -> DataFrame:
    """Runs of consecutive frames: first, last, frames."""
    island = F.col(frame) - F.row_number().over(Window.partitionBy(key).orderBy(frame))
    return (
        active.withColumn("island", island)
        .groupBy(key, "island")
        .agg(F.min(frame).alias("first"), F.max(frame).alias("last"), F.count(F.lit(1)).alias("frames"))
        .drop("island")
    )


def merge_ranges(ranges: DataFrame, key: str, start: str = "start", stop: str = "stop") -> DataFrame:
    """Union of half-open ranges of each key; ranges that touch are one."""
    along = Window.partitionBy(key).orderBy(start, stop)
    reached = F.max(stop).over(along.rowsBetween(Window.unboundedPreceding, -1))
    return (
        ranges.withColumn("new", F.coalesce(F.col(start) > reached, F.lit(True)).cast("int"))
        .withColumn("island", F.sum("new").over(along))
        .groupBy(key, "island")
        .agg(F.min(start).alias("start"), F.max(stop).alias("stop"), F.count(F.lit(1)).alias("pieces"))
        .drop("island")
    )


def sequence_gaps(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """Missing stretches of a sequence that starts at 0: after, before, missing."""
    before = F.coalesce(F.lag(seq).over(Window.partitionBy(key).orderBy(seq)), F.lit(-1))
    return (
        rows.withColumn("after", before)
        .withColumn("missing", F.col(seq) - F.col("after") - 1)
        .where("missing > 0")
        .select(key, "after", F.col(seq).alias("before"), "missing")
    )


def channel_offsets(frames: DataFrame, key: str, frame: str, offsets: list[int], wrap: bool) -> DataFrame:
    """For each frame and offset the source frame: clamped to the ends, or wrapped with a mirror flag on odd turns.

    Frames of a key are taken to run from 0 to their number less 1.
    """
    counted = frames.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    spread = counted.withColumn("offset", F.explode(F.array(*[F.lit(o) for o in offsets])))
    at = F.col(frame) + F.col("offset")
    if wrap:
        return spread.withColumn("source", F.pmod(at, F.col("n"))).withColumn("mirrored", F.pmod(F.floor(at / F.col("n")), F.lit(2)) == 1)
    return spread.withColumn("source", F.greatest(F.lit(0), F.least(at, F.col("n") - 1)))


def nearest_asof(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """``left`` with the nearest ``value`` of ``right`` by ``at`` for its key; the earlier of two equally near.

    One sort of both sides together: the last value before and the first after, by window.
    """
    both = left.withColumn("__v", F.lit(None).cast("double")).select(key, at, "__v", F.lit(1).alias("__side")).unionByName(
        right.select(key, at, F.col(value).cast("double").alias("__v"), F.lit(0).alias("__side"))
    )
    along = Window.partitionBy(key).orderBy(at, "__side")
    found = F.struct(at, "__v")
    known = F.when(F.col("__side") == 0, found)
    both = both.withColumn("__b", F.last(known, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "__a", F.first(known, ignorenulls=True).over(along.rowsBetween(0, Window.unboundedFollowing))
    )
    nearer = F.when(F.col("__b").isNull(), F.col("__a")).when(
        F.col("__a").isNull() | (F.col(at) - F.col(f"__b.{at}") <= F.col(f"__a.{at}") - F.col(at)), F.col("__b")
    ).otherwise(F.col("__a"))
    return both.withColumn("__n", nearer).where("__side = 1").select(key, at, F.col(f"__n.{at}").alias("nearest"), F.col("__n.__v").alias(value))


def take_wave(mailboxes: DataFrame, order: list[str], key: list[str], limit: int) -> DataFrame:
    """Up to ``limit`` dirty mailboxes of the first group by ``order`` that has any, in the order of ``key``."""
    dirty = mailboxes.where("dirty")
    first = dirty.select(*order).distinct().orderBy(*order).limit(1)
    return dirty.join(F.broadcast(first), order, "left_semi").orderBy(*key).limit(limit)


def align_labels(frames: DataFrame, labels: DataFrame, key: str, origin: int) -> tuple[DataFrame, DataFrame]:
    """(frames with the columns of the label whose index is the frame plus ``origin``, labels that no frame has)."""
    placed = labels.withColumn("frame", F.col("index") - origin).drop("index")
    return frames.join(placed, [key, "frame"], "left"), placed.join(frames, [key, "frame"], "left_anti")
