"""Joins that Spark has no operator for, built from equi-joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1e-3


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null; the keys come once."""
    named = right.withColumnsRenamed({k: f"of_{k}" for k in on})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in on])
    return left.join(named, same, how).drop(*[f"of_{k}" for k in on])


def lookup_join(big: DataFrame, keys: DataFrame, on: str | list[str], rows_col: str, total: int, hot_share: float = HOT_SHARE) -> DataFrame:
    """Inner join of ``big`` with ``keys`` (unique on ``on``, ``rows_col``: rows of ``big`` that have the key); null keys are equal.

    Keys with more than ``hot_share`` of all rows - ``1 / hot_share`` of them at most - are
    broadcast, so no task receives a hot key; all others are joined by shuffle.
    """
    limit = max(1.0, total * hot_share)
    often, rest = keys.where(F.col(rows_col) > limit), keys.where(F.col(rows_col) <= limit)
    on = [on] if isinstance(on, str) else on
    return null_safe_join(big, rest, on).unionByName(null_safe_join(big, F.broadcast(often), on))


def bucketed_range_join(left: DataFrame, right: DataFrame, point: str, start: str, stop: str, width: int, keys: list[str]) -> DataFrame:
    """Rows of ``left`` whose ``point`` lies in [start, stop) of ``right``, on equal ``keys``.

    The range is cut into buckets of ``width``, so that it is an equi-join on the bucket rather than a nested loop.
    """
    spread = right.where(F.col(stop) > F.col(start)).withColumn(
        "__bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(stop) - 1) / width)))
    )
    inside: Column = (F.col(point) >= F.col(start)) & (F.col(point) < F.col(stop))
    return (
        left.withColumn("__bucket", F.floor(F.col(point) / width)).join(spread, [*keys, "__bucket"]).where(inside).drop("__bucket")
    )
