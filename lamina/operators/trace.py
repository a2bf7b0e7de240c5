"""Trace analytics: phases, durations, counters, holds and queue classes of monotonic events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators.joins import lookup_join
from lamina.operators.rank import weight_before
from lamina.session import cut


def phase_pairs(events: DataFrame, key: list[str], start: str, end: str, event: str = "event", at: str = "ts_us") -> DataFrame:
    """Keys with exactly one start and one end: duration and status; others tell why not."""
    is_start, is_end = F.col(event) == start, F.col(event) == end
    paired = events.groupBy(*key).agg(
        F.count_if(is_start).alias("starts"),
        F.count_if(is_end).alias("ends"),
        F.min(F.when(is_start, F.col(at))).alias("begun"),
        F.min(F.when(is_end, F.col(at))).alias("ended"),
    )
    status = (
        F.when((F.col("starts") != 1) | (F.col("ends") != 1), "unpaired").when(F.col("ended") < F.col("begun"), "negative").otherwise("ok")
    )
    return paired.withColumn("status", status).withColumn("duration", F.when(F.col("status") == "ok", F.col("ended") - F.col("begun")))


def duration_summary(rows: DataFrame, key: str, value: str) -> DataFrame:
    """count, total, median (interpolated), p95 (the order statistic at floor(0.95 (n - 1))), greatest; negative values are left out.

    Equal values are counted before anything is sorted, so a value that most rows have is one row; places follow from the counts before it.
    """
    known = rows.where(F.col(value) >= 0).groupBy(key, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("times"))
    placed = weight_before(known, [key], "v", "times", "before")
    counts = cut(known.groupBy(key).agg(F.sum("times").alias("n"), F.sum(F.col("v") * F.col("times")).alias("total"), F.max("v").alias("greatest"), F.count(F.lit(1)).alias("values")))
    joined = lookup_join(placed, counts, key, "values", counts.agg(F.sum("values")).first()[0] or 0)
    holds = lambda place: F.expr(f"before < {place} AND {place} <= before + times")
    low, high, p95 = (F.max(F.when(holds(place), F.col("v"))) for place in ("((n + 1) div 2)", "(n div 2 + 1)", "((n - 1) * 95 div 100 + 1)"))
    found = joined.groupBy(key, "n", "total", "greatest").agg(low.alias("low"), high.alias("high"), p95.alias("p95"))
    return found.select(key, "n", "total", ((F.col("low") + F.col("high")).cast("double") / 2).alias("median"), "p95", "greatest")


def hold_intervals(samples: DataFrame, key: str, at: str, limit: int, endpoint: Column) -> DataFrame:
    """Each sample holds until the next of its key, the endpoint or ``limit`` later, whichever comes first."""
    after = F.lead(at).over(Window.partitionBy(key).orderBy(at, "event_id"))
    until = F.least(F.coalesce(after, endpoint), endpoint, F.col(at) + limit)
    return samples.withColumn("until", until).withColumn("held", F.greatest(F.lit(0), F.col("until") - F.col(at)))


def counter_deltas(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """First and last value of each key, the change between them, and how often it fell (resets)."""
    along = Window.partitionBy(key).orderBy(*order)
    fell = (F.col(value) < F.lag(value).over(along)).cast("int")
    place = F.struct(*order)
    return (
        rows.withColumn("fell", fell)
        .groupBy(key)
        .agg(
            F.min_by(value, place).alias("first"),
            F.max_by(value, place).alias("last"),
            F.coalesce(F.sum("fell"), F.lit(0)).alias("resets"),
        )
        .withColumn("delta", F.col("last") - F.col("first"))
    )


def queue_class(waiting: Column, running: Column) -> Column:
    return F.when((waiting == 0) & (running == 0), "idle").when(waiting == 0, "served").when(running == 0, "stalled").otherwise("queued")
