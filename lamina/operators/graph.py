"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.operators.joins import lookup_join
from lamina.session import cut

FEW = 1_000_000  # so few edges (16 MB) can meet in one task whatever their nodes


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """Each (node, other) with the least of ``node`` and its neighbours; hubs are joined by broadcast."""
    least = edges.groupBy("node").agg(F.min("other").alias("least"), F.count(F.lit(1)).alias("degree"))
    found = lookup_join(edges, least, "node", "degree", total) if total > FEW else edges.join(least, "node")
    return found.withColumn("least", F.least("node", "least")).drop("degree")


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select(F.col("high").alias("node"), F.col("low").alias("other")).union(edges.select("low", "high"))
    return (
        _with_least(both, 2 * total)
        .where("other > node")
        .select(F.col("other").alias("high"), F.col("least").alias("low"))
        .distinct()
    )


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = _with_least(edges.select(F.col("high").alias("node"), F.col("low").alias("other")), total)
    pairs = down.select(F.col("other").alias("high"), F.col("least").alias("low")).union(down.select("node", "least"))
    return pairs.where("high <> low").distinct()


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all edges of one task: least labels go over edges and are followed, until nothing changes."""
    ends = [(np.asarray(b["high"]), np.asarray(b["low"])) for b in batches]
    high, low = (np.concatenate([e[k] for e in ends] or [np.zeros(0, np.int64)]) for k in (0, 1))
    nodes, at = np.unique(np.concatenate([high, low]), return_inverse=True)
    a, b = at[: len(high)], at[len(high) :]
    label = np.arange(len(nodes))
    while True:
        least = label.copy()
        np.minimum.at(least, a, label[b])
        np.minimum.at(least, b, label[a])
        np.minimum.at(least, label[a], label[b])
        np.minimum.at(least, label[b], label[a])
        least = least[least]
        if (least == label).all():
            break
        label = least
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "component"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of the components that ``FEW`` edges of a task make."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= FEW:
            yield from _finished(iter(held))
            held, n = [], 0
    if n:
        yield from _finished(iter(held))


def _contracted(edges: DataFrame, near: Callable[[str], Column], max_rounds: int, one_task: int) -> DataFrame:
    """Components of edges that are solved where they lie first: what is left to connect are the roots of nodes that several tasks have."""
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: few bytes are much work
    stars = edges.repartition(tasks, near("low")).mapInArrow(_stars, "node long, root long")
    known = cut(stars.groupBy("node").agg(F.collect_set("root").alias("roots")).withColumn("root", F.array_min("roots")))
    across = known.where(F.size("roots") > 1).select("root", F.explode("roots").alias("other"))
    joined = connected_components(across, "root", "other", max_rounds, one_task).withColumnRenamed("node", "root")
    return known.join(joined, "root", "left").select("node", F.coalesce("component", "root").alias("component"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 64, one_task: int = 0, near: Callable[[str], Column] | None = None) -> DataFrame:
    """(node, component) for each node of an edge; the component is its least node. ``one_task`` is the number of edges (16 bytes each)
    up to which they are looked at in one task rather than in rounds of joins; the result is the same. So it is with ``near``, which makes of a node's column what nodes that are
    likely to be connected have in common: more edges than that are dealt by it and solved where they lie first.

    Rounds grow with the logarithm of the longest chain. Minima are map-side combined, so a
    node with many neighbours is no hot key, and neither is it in the join back, where hubs are broadcast (1,000 at most).
    Self-edges and nulls name no component.
    """
    at = cut(
        edges.select(F.greatest(a, b).cast("long").alias("high"), F.least(a, b).cast("long").alias("low"))
        .where("high <> low")
        .distinct()
    )
    before = None
    for _ in range(max_rounds):
        seen = at.agg(F.count(F.lit(1)), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if seen == before or not seen[0]:
            break
        if seen[0] <= one_task:
            return at.coalesce(1).mapInArrow(_finished, "node long, component long")
        if near is not None:
            return _contracted(at, near, max_rounds, one_task)
        before = seen
        at = cut(_small_star(_large_star(at, seen[0]), seen[0]))
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return at.select(F.col("high").alias("node"), F.col("low").alias("component")).union(
        at.select("low", "low").distinct()
    )
