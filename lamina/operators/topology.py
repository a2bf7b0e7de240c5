"""Connected components of voxel sets and what is built on them."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions import planes
from lamina.operators import maskset
from lamina.operators.graph import connected_components
from lamina.operators.rank import distributed_rank
from lamina.session import cut

VOXEL = ("t", "y", "x")
# Voxels as one number: 2 ** 21 places an axis.
_SHIFT = 21
# Graphs of so many contacts (16 bytes each) are finished in one task.
ONE_TASK = 200_000
# Forward rows (dt, dy, reach in x) that a run touches, by connectivity.
_RUN_STEPS = {4: [(0, 1, 0)], 8: [(0, 1, 1)], 6: [(0, 1, 0), (1, 0, 0)], 18: [(0, 1, 1), (1, 0, 1), (1, 1, 0), (1, -1, 0)], 26: [(0, 1, 1), (1, 0, 1), (1, 1, 1), (1, -1, 1)]}


def voxel_id():
    return F.shiftleft(F.col("t").cast("long"), 2 * _SHIFT) + F.shiftleft(F.col("y").cast("long"), _SHIFT) + F.col("x")


def forward_steps(connectivity: int) -> list[tuple[int, int, int]]:
    """Half of the neighbours of a voxel, so that each pair is met once."""
    most = {6: 1, 18: 2, 26: 3}[connectivity]
    return [s for s in product((-1, 0, 1), repeat=3) if s > (0, 0, 0) and sum(map(abs, s)) <= most]


def adjacent_pairs(mask: DataFrame, connectivity: int) -> DataFrame:
    """(a, b) voxel numbers of touching voxels: every voxel offers its forward neighbours, an equi-join finds them."""
    steps = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(s, ("dt", "dy", "dx"), strict=True)]) for s in forward_steps(connectivity)])
    offered = mask.select(voxel_id().alias("a"), *VOXEL, F.explode(steps).alias("s")).select(
        "a", (F.col("t") + F.col("s.dt")).alias("t"), (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x")
    )
    return offered.join(mask.select(*VOXEL), list(VOXEL)).select("a", voxel_id().alias("b"))


def _run_steps(connectivity: int, both: bool = False) -> Column:
    """Rows that a run looks at, as structs (dt, dy, reach); ``reach`` 1 counts diagonal contact in x. 4 and 8 stay in the plane."""
    steps = _RUN_STEPS[connectivity]
    if both:
        steps = [*steps, *[(-t, -y, r) for t, y, r in steps]]
    return F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(s, ("dt", "dy", "reach"), strict=True)]) for s in steps])


def adjacent_runs(runs: DataFrame, connectivity: int = 6, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of touching runs (run ids a, b) of neighbouring rows, of equal ``keys``. Runs are bucketed in x, so rows of many runs make no nested loop."""
    width = 64
    spread = lambda df, lo, hi: df.withColumn("bucket", F.explode(F.sequence(F.expr(f"({lo}) div {width}"), F.expr(f"({hi}) div {width}"))))
    a = runs.select(*keys, F.col("run").alias("a"), "t", "y", F.col("x0").alias("a0"), F.col("x1").alias("a1"))
    b = spread(runs.select(*keys, F.col("run").alias("b"), "t", "y", F.col("x0").alias("b0"), F.col("x1").alias("b1")), "greatest(b0 - 1, 0)", "b1")
    offered = spread(a, "a0", "a1 - 1").withColumn("run_step", F.explode(_run_steps(connectivity)))
    offered = offered.withColumn("t", F.col("t") + F.col("run_step.dt")).withColumn("y", F.col("y") + F.col("run_step.dy")).withColumn("reach", F.col("run_step.reach")).drop("run_step")
    touching = (F.col("a0") < F.col("b1") + F.col("reach")) & (F.col("b0") < F.col("a1") + F.col("reach"))
    return offered.join(b, [*keys, "t", "y", "bucket"]).where(touching).select("a", "b").distinct()


def label(mask: DataFrame, connectivity: int = 6) -> DataFrame:
    """``mask`` with ``label``, the least voxel number of its component, found on runs."""
    runs = label_runs(cut(maskset.runs(mask.select(*VOXEL).distinct())), connectivity)  # they are read three times
    return maskset.voxels(runs.select("t", "y", "x0", "x1", "label")).select(*VOXEL, "label")


def tile(voxel: str, axes: int = 3) -> Column:
    """Of a voxel number, that of its cube of 64 places a side; with two ``axes``, of its column of such cubes along t."""
    return F.struct(*[F.shiftright(F.col(voxel), k * _SHIFT + 6).bitwiseAND((1 << _SHIFT - 6) - 1) for k in range(axes)])


def label_runs(runs: DataFrame, connectivity: int = 6, keys: tuple[str, ...] = ()) -> DataFrame:
    """``runs`` (t, y, x0, x1) with ``run`` and the connected ``label``: the graph has a node a run, not a voxel.

    A run's number is that of its first voxel; with ``keys``, of which only equal ones connect, its number in the order of keys and voxels.
    """
    if keys:
        numbered = distributed_rank(runs, *keys, "t", "y", "x0", name="run")
    else:
        numbered = runs.withColumn("run", F.shiftleft(F.col("t").cast("long"), 2 * _SHIFT) + F.shiftleft(F.col("y").cast("long"), _SHIFT) + F.col("x0"))
    found = connected_components(adjacent_runs(numbered, connectivity, keys), one_task=ONE_TASK, near=None if keys else tile)
    return numbered.join(found.withColumnRenamed("node", "run"), "run", "left").withColumn("label", F.coalesce("component", "run")).drop("component")


def component_sizes(labelled: DataFrame) -> DataFrame:
    """(label, size) of voxels, or of runs if they have the column ``voxels``."""
    size = F.sum("voxels") if "voxels" in labelled.columns else F.count(F.lit(1))
    return labelled.groupBy("label").agg(size.alias("size"))


def statistics(labelled: DataFrame) -> DataFrame:
    """One row: components, largest, foreground, largest_fraction."""
    return component_sizes(labelled).agg(
        F.count(F.lit(1)).alias("components"),
        F.coalesce(F.max("size"), F.lit(0)).alias("largest"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("foreground"),
        F.coalesce(F.max("size") / F.sum("size"), F.lit(0.0)).alias("largest_fraction"),
    )


def keep_largest(labelled: DataFrame, n: int) -> DataFrame:
    """Voxels of the ``n`` largest components; of equal sizes the greater label counts as larger."""
    kept = component_sizes(labelled).orderBy(F.desc("size"), F.desc("label")).limit(n)
    return labelled.join(kept, "label", "left_semi").select(*VOXEL)


def gate_by_support(labelled: DataFrame, support: DataFrame) -> DataFrame:
    """Voxels of components that share a voxel with ``support``; a component is kept or rejected whole."""
    touched = labelled.join(support.select(*VOXEL), list(VOXEL), "left_semi").select("label").distinct()
    return labelled.join(touched, "label", "left_semi").select(*VOXEL)


def enclosed_gaps(runs: DataFrame, connectivity: int = 6) -> DataFrame:
    """(t, y, x0, x1): the parts of the complement of ``runs`` that no path of empty voxels joins with the outside.

    Nodes are the gaps between two runs of a row, so the graph follows the runs and not the volume. What lies before the first or behind the last run of a
    row, and rows without a run, is outside; so is a gap beside these.
    """
    row = Window.partitionBy("t", "y").orderBy("x0")
    gaps = runs.select("t", "y", F.col("x1").alias("x0"), F.lead("x0").over(row).alias("x1")).where("x1 > x0")
    labelled = cut(label_runs(gaps, connectivity))
    extents = runs.groupBy(F.col("t").alias("near_t"), F.col("y").alias("near_y")).agg(F.min("x0").alias("first"), F.max("x1").alias("last"))
    sides = labelled.withColumn("s", F.explode(_run_steps(connectivity, both=True)))
    beside = (F.col("near_t") == F.col("t") + F.col("s.dt")) & (F.col("near_y") == F.col("y") + F.col("s.dy"))
    is_open = F.col("first").isNull() | (F.col("x0") - F.col("s.reach") < F.col("first")) | (F.col("x1") + F.col("s.reach") > F.col("last"))
    outside = sides.join(extents, beside, "left").where(is_open).select("label").distinct()
    return labelled.join(outside, "label", "left_anti").select("t", "y", "x0", "x1")


def fill_voids(mask: DataFrame, connectivity: int = 6) -> DataFrame:
    """``mask`` and the components of its complement that do not reach the outside."""
    runs = cut(maskset.runs(mask.select(*VOXEL).distinct()))
    return maskset.voxels(runs.select("t", "y", "x0", "x1").unionByName(enclosed_gaps(runs, connectivity))).select(*VOXEL)


def fill_holes(mask: DataFrame) -> DataFrame:
    """``mask`` and, of each plane, the background that is not 4-connected with the outside."""
    return fill_voids(mask, 4)


def slice_components(mask: DataFrame, connectivity: int = 4) -> DataFrame:
    """``mask`` with ``part``, its component within its plane (the least voxel number)."""
    return label(mask, connectivity).withColumnRenamed("label", "part")


def clean_planes(mask: DataFrame, scores: DataFrame, shape: tuple[int, int], min_score: int = 0, min_radius: float = 0.0) -> DataFrame:
    """``mask`` after the cleanup of its planes, in this order: of each plane's 8-connected components go those whose greatest score is below ``min_score``, then
    those whose greatest distance to background is below ``min_radius``; holes are filled last, so that they lend a component no radius.

    Components are labelled once; their greatest scores and their boxes come from one aggregation. Only components whose box could hold the
    radius are drawn, each on its own box. Voxels without a score count as 0.
    """
    parts = cut(slice_components(mask, 8))
    best = scores.groupBy(*VOXEL).agg(F.max("score").alias("score"))
    sized = parts.join(best, list(VOXEL), "left").groupBy("part").agg(
        F.coalesce(F.max("score"), F.lit(0)).alias("best"), (F.max("y") - F.min("y") + 2).alias("high"), (F.max("x") - F.min("x") + 2).alias("wide")
    )
    # a side at the plane's border has no background behind it, so a box may count twice there
    could = 2 * F.greatest("high", "wide") >= min_radius if min_radius > 0 else F.lit(True)
    kept = parts.join(sized.where((F.col("best") >= min_score) & could).select("part"), "part", "left_semi")
    if min_radius > 0:
        thick = part_radii(kept, shape).where(F.col("radius") >= min_radius).select("part")
        kept = kept.join(thick, "part", "left_semi")
    return fill_holes(kept.select(*VOXEL))


def part_depths(parts: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """(part, radius, y, x): the greatest distance to background of each plane component and the first pixel that has it, on the component's box and a rim of one inside the plane."""
    h, w = shape

    def measure(y: np.ndarray, x: np.ndarray) -> tuple[float, int, int]:
        y0, x0 = max(y.min() - 1, 0), max(x.min() - 1, 0)
        plane = np.zeros((min(y.max() + 2, h) - y0, min(x.max() + 2, w) - x0), bool)
        plane[y - y0, x - x0] = True
        # a component that is the whole plane has no background
        depth = np.full(plane.shape, float(h + w)) if plane.all() else planes.distance_to_background(plane)
        at = np.unravel_index(depth.argmax(), depth.shape)
        return float(depth[at]), int(at[0] + y0), int(at[1] + x0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows, so a component's are together; there are many small ones, which groups of their own would make slow."""
        held = [np.zeros(0, np.int64)] * 3
        for batch in [*batches, None]:
            if batch is not None:
                held = [np.concatenate([old, batch[c].to_numpy()]) for old, c in zip(held, ("part", "y", "x"), strict=True)]
            edges = np.flatnonzero(np.diff(held[0])) + 1
            ends = edges if batch is not None else np.append(edges, len(held[0]))
            starts = np.concatenate([[0], ends])[: len(ends)].astype(int)
            found = [(held[0][a], *measure(held[1][a:b], held[2][a:b])) for a, b in zip(starts, ends, strict=True) if b > a]
            if len(ends):
                held = [v[ends[-1] :] for v in held]
            if found:
                kinds = (pa.int64(), pa.float64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], ["part", "radius", "y", "x"])

    ordered = parts.select(F.col("part").cast("long").alias("part"), "y", "x").repartition("part").sortWithinPartitions("part")
    return ordered.mapInArrow(run, "part long, radius double, y int, x int")


def part_radii(parts: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """(part, radius) of ``part_depths``."""
    return part_depths(parts, shape).select("part", "radius")


def endpoints(parts: DataFrame) -> DataFrame:
    """(part, t, side): plane components that nothing overlaps in the plane before (side -1) or after (side 1)."""
    sides = parts.withColumn("side", F.explode(F.array(F.lit(-1), F.lit(1))))
    next_to = parts.select((F.col("t")).alias("nt"), "y", "x")
    met = (
        sides.withColumn("nt", F.col("t") + F.col("side"))
        .join(next_to, ["nt", "y", "x"], "left_semi")
        .select("part", "side")
        .distinct()
    )
    every = parts.select("part", "t").distinct().withColumn("side", F.explode(F.array(F.lit(-1), F.lit(1))))
    return every.join(met, ["part", "side"], "left_anti")


def dilate_within(seed: DataFrame, domain: DataFrame, rounds: int) -> DataFrame:
    """``seed`` grown by up to ``rounds`` 6-neighbour steps inside ``domain``."""
    steps = F.array(*[F.struct(F.lit(t).alias("dt"), F.lit(y).alias("dy"), F.lit(x).alias("dx")) for t, y, x in [(0, 0, 0), *forward_steps(6), *[tuple(-v for v in s) for s in forward_steps(6)]]])
    at = seed.select(*VOXEL).join(domain, list(VOXEL), "left_semi")
    for _ in range(rounds):
        at = (
            at.withColumn("s", F.explode(steps))
            .select((F.col("t") + F.col("s.dt")).alias("t"), (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
            .distinct()
            .join(domain, list(VOXEL), "left_semi")
        )
    return at


def component_score(labelled: DataFrame, scores: DataFrame) -> DataFrame:
    """(label, size, best): the best known score of each component, null where none is known."""
    return (
        labelled.join(scores.select(*VOXEL, F.nullif("score", F.lit(0)).alias("score")), list(VOXEL), "left")
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("size"), F.max("score").alias("best"))
    )


def slice_rank(parts: DataFrame) -> DataFrame:
    """Plane components by size within their plane."""
    sized = parts.groupBy("t", "part").agg(F.count(F.lit(1)).alias("size"))
    return sized.withColumn("place", F.row_number().over(Window.partitionBy("t").orderBy(F.desc("size"), "part")))
