"""Resampling as joins of a destination grid with source addresses; all index arithmetic is in integers where it decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VOXEL = ("t", "y", "x")


def grid(spark: SparkSession, shape: tuple[int, ...], names: tuple[str, ...] = VOXEL) -> DataFrame:
    total = 1
    for s in shape:
        total *= s
    columns, below = [], total
    for size, name in zip(shape, names, strict=True):
        below //= size
        columns.append(F.expr(f"cast(id div {below} % {size} as int)").alias(name))
    return spark.range(total).select(*columns)


def cube_shape(dims: DataFrame, percent: int = 95, keep: tuple[str, ...] = ()) -> DataFrame:
    """t, y, x padded so that no axis is below ``percent`` of the longest, beside the columns ``keep``."""
    longest = F.greatest("t", "y", "x")
    least = F.ceil(longest * percent / 100).cast("long")
    return dims.select(*keep, *[F.greatest(c, least).alias(c) for c in VOXEL])


def nearest_index(at: Column, source: int, target: int) -> Column:
    """Source place of a target place: at * source // target."""
    return F.floor(at * source / target).cast("int")


def aligned_index(at: Column, source: int, target: int) -> Column:
    """Endpoint-aligned source place, half to even."""
    return F.lit(0) if target == 1 else F.rint(at * F.lit((source - 1) / (target - 1))).cast("int")


def resize_nearest(mask: DataFrame, source: tuple[int, int, int], target: tuple[int, int, int]) -> DataFrame:
    """Foreground of the resized volume: each set voxel is pushed to the target voxels that look at it, so rows follow the foreground."""
    pushed = mask.select(*VOXEL)
    for c, s, d in zip(VOXEL, source, target, strict=True):
        at = F.col(c).cast("long")
        low, high = F.ceil(at * d / s).cast("int") - 1, F.ceil((at + 1) * d / s).cast("int")
        ends = F.sequence(F.greatest(low, F.lit(0)), F.least(high, F.lit(d - 1)))
        pushed = pushed.withColumn("own", F.col(c)).withColumn(c, F.explode(ends)).where(nearest_index(F.col(c).cast("long"), s, d) == F.col("own")).drop("own")
    return pushed.distinct()


def _cells(at: Column, source: int, target: int) -> Column:
    """Target cells i whose footprint [i * source // target, ((i + 1) * source + target - 1) // target) holds ``at``."""
    low = F.floor(at * target / source).cast("int")
    high = F.ceil((at + 1) * target / source).cast("int") - 1
    return F.sequence(low, F.least(high, F.lit(target - 1)))


def shrink(rows: DataFrame, source: tuple[int, int, int], target: tuple[int, int, int]) -> DataFrame:
    """``rows`` once for each target cell that their voxel's footprint meets."""
    for c, s, d in zip(VOXEL, source, target, strict=True):
        rows = rows.withColumn(c, F.explode(_cells(F.col(c), s, d)))
    return rows


def restore_or(mask: DataFrame, source: tuple[int, int, int], target: tuple[int, int, int]) -> DataFrame:
    """Contraction that keeps a target voxel if any source voxel meets it."""
    return shrink(mask.select(*VOXEL), source, target).distinct()


def max_pool(scores: DataFrame, source: tuple[int, int, int], target: tuple[int, int, int]) -> DataFrame:
    return shrink(scores, source, target).groupBy(*VOXEL).agg(F.max("score").alias("score"))


def presence(mask: DataFrame, factor: int) -> DataFrame:
    """Isotropic reduction: a cell is set if any voxel of it is."""
    return mask.select(*[F.expr(f"{c} div {factor}").cast("int").alias(c) for c in VOXEL]).distinct()


# Fixed values: (frame, row, column) axes of the three stack views.
VIEWS = {"transverse": ("t", "y", "x"), "sagittal": ("x", "t", "y"), "coronal": ("y", "t", "x")}


def stack_views(mask: DataFrame) -> DataFrame:
    """(view, frame, row, col) of every voxel in the three views; a projection, not a join."""
    views = [F.struct(F.lit(name).alias("view"), *[F.col(a).alias(n) for a, n in zip(axes, ("frame", "row", "col"), strict=True)]) for name, axes in VIEWS.items()]
    return mask.select(F.explode(F.array(*views)).alias("v")).select("v.*")


def azimuth_address(angle_deg: Column, u: Column, height: int, width: int) -> tuple[Column, Column]:
    """Nearest (y, x) of the point ``u`` along the line through the plane's center at an angle."""
    radians = F.radians(angle_deg)
    y = F.lit((height - 1) / 2) + u * F.sin(radians)
    x = F.lit((width - 1) / 2) + u * F.cos(radians)
    return F.floor(F.round(y, 9) + 0.5).cast("int"), F.floor(F.round(x, 9) + 0.5).cast("int")


def azimuth_slices(mask: DataFrame, angles: int, height: int, width: int) -> DataFrame:
    """(angle, t, u) foreground of ``angles`` lines over [0, 180) degrees; the address table is small and broadcast by size."""
    reach = min(height, width) // 2
    lines = grid(mask.sparkSession, (angles, 2 * reach + 1), ("angle", "u")).withColumn("u", F.col("u") - reach)
    y, x = azimuth_address(F.col("angle") * F.lit(180.0 / angles), F.col("u").cast("double"), height, width)
    addressed = lines.withColumn("y", y).withColumn("x", x)
    return mask.join(addressed, ["y", "x"]).select("angle", "t", "u")


def wrapped_azimuth(index: Column, count: int) -> tuple[Column, Column]:
    """Source angle and mirror flag of an unfolded index over 180 degrees."""
    return F.pmod(index, F.lit(count)), F.pmod(F.floor(index / count), F.lit(2)) == 1


def tilted_blend(mask: DataFrame, shape: tuple[int, int, int], run: int, rise: int) -> DataFrame:
    """Foreground of a sheared stack: depth t + x * rise / run, two planes blended, at least one half kept.

    Weights are integers out of ``run``, so the threshold is exact. A set voxel is pushed to the two places that blend it.
    """
    lean = F.floor(F.col("x") * rise / run).cast("int")
    part = F.pmod(F.col("x") * rise, F.lit(run))
    both = F.array(F.struct((F.col("t") - lean).alias("t"), (F.lit(run) - part).alias("w")), F.struct((F.col("t") - lean - 1).alias("t"), part.alias("w")))
    inside = mask.where(F.col("y").between(0, shape[1] - 1) & F.col("x").between(0, shape[2] - 1))
    spread = inside.select("y", "x", F.explode(both).alias("tap")).select("tap.t", "y", "x", "tap.w").where(F.col("t").between(0, shape[0] - 1))
    return spread.groupBy(*VOXEL).agg(F.sum("w").alias("w")).where(F.col("w") * 2 >= run).select(*VOXEL)


def rotate_nearest(mask: DataFrame, shape: tuple[int, int, int], cos: tuple[int, int], sin: tuple[int, int]) -> DataFrame:
    """In-plane rotation about the center by a rational angle (cos and sin as fractions of one denominator), inverse map, nearest.

    A set voxel is pushed: of the places around its image those stay whose inverse map is the voxel.
    """
    _, h, w = shape
    (c, d), (s, d2) = cos, sin
    if d != d2:
        raise ValueError("cos and sin need one denominator")
    # coordinates doubled, so that the center is an integer
    doubled = lambda at, size: F.col(at) * 2 - (size - 1)
    back = lambda a, b, size: F.floor((a * c + b + (size - 1) * d + d) / (2 * d)).cast("int")
    sy, sx = doubled("s_y", h), doubled("s_x", w)
    image_y, image_x = (sy * c + sx * s) / (2 * d) + (h - 1) / 2, (sx * c - sy * s) / (2 * d) + (w - 1) / 2
    around = lambda at: F.explode(F.sequence(F.floor(at).cast("int") - 1, F.floor(at).cast("int") + 2))
    spread = mask.select("t", F.col("y").alias("s_y"), F.col("x").alias("s_x")).withColumn("y", around(image_y)).withColumn("x", around(image_x))
    dy, dx = doubled("y", h), doubled("x", w)
    hits = F.col("y").between(0, h - 1) & F.col("x").between(0, w - 1) & (back(dy, -dx * s, h) == F.col("s_y")) & (back(dx, dy * s, w) == F.col("s_x"))
    return spread.where(hits).select(*VOXEL).distinct()
