"""Back-projection of view voxels into the native volume, by family of views.

The dense form lets every native voxel pull the view cell its center falls into. Here every set view voxel is pushed instead: its cell's inverse image is boxed, the box's
native voxels are listed, and those whose own address is the cell stay. The address is the same expression that a pull would use, so both give the same
voxels, but rows follow the foreground and not the grid. Several view voxels may reach one native voxel (a contracted axis, periodic columns): the greatest
score stays, which for labels is OR. Regions of interest are closed: a center on the border is inside.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators.geometry import nearest_angle, qsc_on_face
from lamina.operators.resample import grid

VOXEL = ("t", "y", "x")


def nearest(value: Column) -> Column:
    """The nearest whole number, halves up; the ninth decimal decides what a half is."""
    return F.floor(F.round(value, 9) + 0.5)


def nearest_even(value: Column) -> Column:
    """The nearest whole number, halves to the even one."""
    return F.rint(F.round(value, 9)).cast("long")


def centered(at: Column, work: int, out: int, center: float) -> Column:
    """A target place as an offset from ``center`` in cells of the working grid."""
    return (2.0 * at + (1.0 - out)) * work / (2.0 * out) + ((work - 1) / 2 - center)


@dataclass(frozen=True)
class Axis:
    """An axis of ``work`` cells shown on ``out`` places: contracted places cover all cells they meet, widened ones look up the cell of their center."""

    work: int
    out: int

    def coordinate(self, at: Column, cell: Column) -> Column:
        return cell.cast("double") if self.out < self.work else (at + 0.5) * (self.work / self.out) - 0.5

    def places(self, low: Column, high: Column) -> Column:
        """All places that may have to do with coordinates from ``low`` to ``high``."""
        first = F.floor((low - 1.0) * (self.out / self.work)).cast("int") - 1
        last = F.ceil((high + 2.0) * (self.out / self.work)).cast("int") + 1
        return F.sequence(F.least(F.greatest(first, F.lit(0)), F.lit(self.out - 1)), F.greatest(F.least(last, F.lit(self.out - 1)), F.lit(0)))

    def centers(self, low: Column, high: Column) -> Column:
        """All places whose center has a coordinate from ``low`` to ``high``, or one beside them."""
        scale = self.out / self.work
        first = F.least(F.greatest(F.ceil((low + 0.5) * scale - 0.5 - 1e-6).cast("int"), F.lit(0)), F.lit(self.out - 1))
        last = F.least(F.floor((high + 0.5) * scale - 0.5 + 1e-6).cast("int"), F.lit(self.out - 1))
        return F.sequence(first, F.greatest(first, last))

    def covers(self, at: Column, cell: Column) -> Column:
        """Whether place ``at`` looks at ``cell``."""
        if self.out < self.work:
            return (cell * self.out < (at + 1) * self.work) & ((cell + 1) * self.out > at * self.work)
        return nearest(self.coordinate(at, cell)) == cell


def _where_last(rows: DataFrame, condition: Column) -> DataFrame:
    """``rows`` for which the condition holds. A filter would be pushed below the projections before it, and each of their
    expressions be written out within the next; a generated column is not."""
    return rows.withColumn("holds", F.explode(F.array(condition))).where("holds").drop("holds")


def _strongest(pushed: DataFrame) -> DataFrame:
    return pushed.groupBy(*[F.col(c).cast("int").alias(c) for c in VOXEL]).agg(F.max("score").alias("score"))


def push_tilted(view: DataFrame, work: tuple[int, int, int], out: tuple[int, int, int], slope: float, along: str = "x", first: int = 0, frames: int | None = None) -> DataFrame:
    """(t, y, x, score) of a sheared stack (frame, v, u, score): frame f holds the voxels at depth t with t - slope * offset - first nearest to f.

    ``along`` (y or x) is the axis whose offset from its center shears the stack; ``frames`` is the number of frames.
    """
    frames = work[0] if frames is None else frames
    depth, *plane = (Axis(w, o) for w, o in zip(work, out, strict=True))
    rows = view.where(F.col("frame").between(0, frames - 1))
    for name, axis, cell in (("y", plane[0], "v"), ("x", plane[1], "u")):
        at = F.explode(axis.places(F.col(cell).cast("double"), F.col(cell).cast("double")))
        rows = rows.withColumn(name, at).where(axis.covers(F.col(name), F.col(cell)))
    cell, axis = ("v", plane[0]) if along == "y" else ("u", plane[1])
    lean = (axis.coordinate(F.col(along), F.col(cell)) - (axis.work - 1) / 2) * F.lit(float(slope)) + first
    rows = rows.withColumn("lean", lean)
    around = F.col("frame") + F.col("lean")
    if depth.out < depth.work:
        rows = rows.withColumn("cell", F.explode(F.sequence(F.floor(around).cast("int") - 1, F.ceil(around).cast("int") + 1)))
        rows = rows.where(F.col("cell").between(0, depth.work - 1) & (nearest(F.col("cell") - F.col("lean")) == F.col("frame")))
        center = F.col("cell").cast("double")
        rows = rows.withColumn("t", F.explode(depth.places(center, center))).where(depth.covers(F.col("t"), F.col("cell")))
    else:
        rows = rows.withColumn("t", F.explode(depth.places(around, around)))
        rows = rows.where(nearest(depth.coordinate(F.col("t"), F.lit(0)) - F.col("lean")) == F.col("frame"))
    return _strongest(rows)


def _pushed_plane(view: DataFrame, address: list[str], y: Column, x: Column, reach_y: Column, reach_x: Column, work: tuple[int, int], out: tuple[int, int], belongs) -> DataFrame:
    """``view`` once for each (y, x) of the plane that belongs to its address; each address of the foreground is inverted once, whatever its depth.

    ``y`` and ``x`` is the place of an address as an offset from the center, the reaches bound how far its voxels lie from it.
    """
    found = view.select(*address).distinct().withColumn("cy", y).withColumn("cx", x).withColumn("ry", reach_y).withColumn("rx", reach_x)
    for name, c, r, w, o in (("y", "cy", "ry", work[0], out[0]), ("x", "cx", "rx", work[1], out[1])):
        middle = F.col(c) + (w - 1) / 2
        found = found.withColumn(name, F.explode(Axis(w, o).centers(middle - F.col(r), middle + F.col(r))))
    dy, dx = (centered(F.col(n), w, o, (w - 1) / 2) for n, w, o in (("y", work[0], out[0]), ("x", work[1], out[1])))
    placed = found.select(*address, "y", "x", dy.alias("dy"), dx.alias("dx"))
    return view.join(belongs(placed).select(*address, "y", "x"), address)


def _stacked(rows: DataFrame, work: int, out: int, cell: str) -> DataFrame:
    """``rows`` once for each depth t that looks at their ``cell``."""
    axis = Axis(work, out)
    at = F.col(cell).cast("double")
    return rows.withColumn("t", F.explode(axis.places(at, at))).where(axis.covers(F.col("t"), F.col(cell)))


def push_azimuthal(view: DataFrame, work: tuple[int, int, int], out: tuple[int, int, int], angles: int, columns: int, radius: float) -> DataFrame:
    """(t, y, x, score) of lines through the center (angle, row, col, score): ``angles`` lines over 180 degrees, ``columns`` places from -radius to radius."""
    half = math.pi / angles / 2
    spacing = 2 * radius / max(columns - 1, 1)
    theta = F.radians(F.col("angle") * F.lit(180.0 / angles))
    at = F.col("col") * F.lit(spacing) - radius if columns > 1 else F.lit(0.0)
    # along the line half a spacing, at the ends the border of the region, too; beside it half the angle between lines
    ahead = F.lit(spacing / 2 + 0.5 if columns > 1 else radius + 0.5)
    beside = F.least((F.abs(at) + ahead) * math.tan(min(half, 1.5)), F.lit(radius + 0.5))
    reach = lambda a, b: ahead * F.abs(a) + beside * F.abs(b) + 1e-6

    def belongs(placed: DataFrame) -> DataFrame:
        inside = F.round(F.hypot("dx", "dy"), 9) <= radius + 0.5
        of = nearest_angle(F.pmod(F.degrees(F.atan2("dy", "dx")) + 360, F.lit(180.0)), angles)
        signed = F.col("dx") * F.cos(theta) + F.col("dy") * F.sin(theta)
        column = F.least(F.greatest(nearest_even((signed + radius) / max(1e-6, 2 * radius) * (columns - 1)), F.lit(0)), F.lit(columns - 1))
        return placed.where(inside & (of == F.col("angle")) & (column == F.col("col")))

    plane = _pushed_plane(view, ["angle", "col"], at * F.sin(theta), at * F.cos(theta), reach(F.sin(theta), F.cos(theta)), reach(F.cos(theta), F.sin(theta)), work[1:], out[1:], belongs)
    return _strongest(_stacked(plane, work[0], out[0], "row"))


def nearest_shell(radius: Column, least: float, gap: float, shells: int) -> Column:
    """The shell nearest to a radius; a midpoint belongs to the inner one."""
    return F.least(F.greatest(F.ceil(F.round((radius - least) / gap, 9) - 0.5), F.lit(0)), F.lit(shells - 1)) if shells > 1 else F.lit(0).cast("long")


def push_radial(view: DataFrame, work: tuple[int, int, int], out: tuple[int, int, int], least: float, gap: float, shells: int, columns: int) -> DataFrame:
    """(t, y, x, score) of cylinder shells about the t axis (shell, row, col, score): shell k has radius least + k * gap, columns lie one voxel apart on its arc.

    Where ``columns`` goes beyond a full turn, a voxel has several columns.
    """
    r = F.col("shell") * F.lit(float(gap)) + least
    theta = F.when(r > 0, F.col("col") / r).otherwise(0.0)
    # half a gap across, half a voxel along the arc of the shell; a turn of less than two voxels is listed whole
    reach = F.when(2 * math.pi * r <= 2, r + gap + 1).otherwise(gap / 2 + 0.5 * (r + gap / 2) / r + 1e-6)

    def belongs(placed: DataFrame) -> DataFrame:
        radius = F.hypot("dx", "dy")
        period = 2 * math.pi * r
        start = F.pmod(F.pmod(F.atan2("dy", "dx"), F.lit(2 * math.pi)) * r + 0.5, period) - 0.5
        turns = F.array(*[F.round((F.col("col") - start) / period) + k for k in (-1, 0, 1)])
        same = F.exists(turns, lambda m: (m >= 0) & (nearest_even(start + m * period) == F.col("col")))
        inside = (F.round(radius, 9) >= round(least, 9)) & (F.round(radius, 9) <= round(least + gap * (shells - 1), 9))
        return placed.where(inside & (nearest_shell(radius, least, gap, shells) == F.col("shell")) & ((period <= 1) | same))

    rows = view.where(F.col("shell").between(0, shells - 1) & F.col("col").between(0, columns - 1))
    plane = _pushed_plane(rows, ["shell", "col"], r * F.sin(theta), r * F.cos(theta), reach, reach, work[1:], out[1:], belongs)
    axis = Axis(work[0], out[0])
    at = F.col("row").cast("double")
    height = centered(F.col("t"), work[0], out[0], 0.0)
    row = nearest_even(F.least(F.greatest(height, F.lit(0.0)), F.lit(work[0] - 1.0)))
    return _strongest(plane.withColumn("t", F.explode(axis.places(at, at))).where((row == F.col("row")) & (F.round(height, 9) >= -0.5) & (F.round(height, 9) < work[0] - 0.5)))


def qsc_direction(rows: DataFrame, face: str = "face", u: str = "u", v: str = "v") -> DataFrame:
    """``rows`` with (dx, dy, dz), the unit direction of a place of the equal-area cube (see ``geometry.qsc_forward``)."""
    kept = [F.col(c) for c in rows.columns]
    u, v = F.col(u), F.col(v)
    flat = F.abs(u) >= F.abs(v)
    split = rows.select(*kept, flat.alias("flat"), F.when(flat, u).otherwise(v).alias("far"), F.when(flat, v).otherwise(u).alias("side"))
    slope = F.when(F.col("far") == 0, 0.0).otherwise(F.try_divide(F.col("side"), F.col("far")))
    turn = slope * (math.pi / 12)
    a, b = F.sin(turn), F.cos(turn) - math.sqrt(0.5)
    turned = split.select("*", slope.alias("slope"), (a / b).alias("tangent"))
    # the direction's two components across the face's normal are in the proportion 1 : tangent
    cosine = 1 / F.sqrt(1 + F.col("tangent") ** 2)
    part = turned.select("*", cosine.alias("cosine"), (1 - cosine / F.sqrt(1 + cosine * cosine)).alias("d"))
    square = F.col("far") * F.col("far") * F.col("d")
    across = F.col("far") * F.sqrt(F.col("d") * (2 - square)) * F.col("cosine")
    placed = part.select("*", (1 - square).alias("normal"), across.alias("major"), (across * F.col("tangent")).alias("minor"))
    right, up = F.when(F.col("flat"), F.col("major")).otherwise(F.col("minor")), F.when(F.col("flat"), F.col("minor")).otherwise(F.col("major"))
    q = F.col("normal")
    pick = lambda *c: F.element_at(F.array(*c), F.col(face) + 1)
    return placed.select(*kept, pick(q, -right, -q, right, -up, up).alias("dx"), pick(right, q, -right, -q, right, right).alias("dy"), pick(up, up, up, up, q, -q).alias("dz"))


def sphere_places(rows: DataFrame, intervals: int, least: float, gap: float) -> DataFrame:
    """``rows`` (shell, face, row, col) with the offsets (oz, oy, ox) of their places from the center; rows count down from v = 1."""
    kept = [F.col(c) for c in rows.columns]
    directed = qsc_direction(rows.withColumn("u", F.col("col") * (2 / intervals) - 1).withColumn("v", 1 - F.col("row") * (2 / intervals)))
    r = F.col("shell") * F.lit(float(gap)) + least
    return directed.select(*kept, *[(r * F.col(d)).alias(o) for d, o in (("dz", "oz"), ("dy", "oy"), ("dx", "ox"))])


def sample_sphere(mask: DataFrame, shape: tuple[int, int, int], intervals: int, least: float, gap: float, shells: int) -> DataFrame:
    """(shell, face, row, col) whose nearest voxel is set; the lattice includes the edges of its faces."""
    places = grid(mask.sparkSession, (shells, 6, intervals + 1, intervals + 1), ("shell", "face", "row", "col"))
    at = sphere_places(places, intervals, least, gap)
    # not nullable, so the join infers no filter that would be pushed below the projections
    voxel = [F.coalesce(nearest(F.col(o) + (s - 1) / 2).cast("int"), F.lit(-1)).alias(c) for o, s, c in zip(("oz", "oy", "ox"), shape, VOXEL, strict=True)]
    return at.select("shell", "face", "row", "col", *voxel).join(mask.select(*VOXEL), list(VOXEL)).select("shell", "face", "row", "col")


def push_spherical(view: DataFrame, work: tuple[int, int, int], out: tuple[int, int, int], intervals: int, least: float, gap: float, shells: int) -> DataFrame:
    """(t, y, x, score) of sphere shells on the equal-area cube (shell, face, row, col, score); an edge belongs to every face it touches."""
    address = ["shell", "face", "row", "col"]
    rows = view.where(F.col("shell").between(0, shells - 1) & F.col("row").between(0, intervals) & F.col("col").between(0, intervals))
    places = sphere_places(rows.select(*address).distinct(), intervals, least, gap)
    # a face's inverse map stretches lengths by at most sqrt(41 / 50) a unit of u or v, and a cell reaches a half interval to either side
    outer = F.col("shell") * F.lit(float(gap)) + least + gap / 2
    places = places.withColumn("reach", gap / 2 + outer * (math.sqrt(41 / 50) * math.sqrt(2) / intervals) + 1e-6)
    for c, o, w, n in zip(VOXEL, ("oz", "oy", "ox"), work, out, strict=True):
        middle = F.col(o) + (w - 1) / 2
        places = places.withColumn(c, F.explode(Axis(w, n).centers(middle - F.col("reach"), middle + F.col("reach"))))
    for c, d, w, n in zip(VOXEL, ("dz", "dy", "dx"), work, out, strict=True):
        places = places.withColumn(d, centered(F.col(c), w, n, (w - 1) / 2))
    # a fraction of the voxels survives the cheap test of radius, and is mapped to the face
    radius = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2)
    inside = (F.round(radius, 9) >= round(least, 9)) & (F.round(radius, 9) <= round(least + gap * (shells - 1), 9)) & (radius > 0)
    near = _where_last(places, inside & (nearest_shell(radius, least, gap, shells) == F.col("shell")))
    mapped = qsc_on_face(near, "dx", "dy", "dz")
    same = (nearest_even((F.col("u") + 1) * (intervals / 2)) == F.col("col")) & (nearest_even((1 - F.col("v")) * (intervals / 2)) == F.col("row"))
    return _strongest(rows.join(_where_last(mapped, F.col("on_face") & same).select(*address, *VOXEL), address))


# Bound of the squared stretch of a face's inverse map, and how far a voxel may lie from the nearest sample.
STRETCH_SQUARED = 41 / 50
BUDGET_SQUARED = (255 / 256) ** 2


def plan_shells(spans: DataFrame) -> DataFrame:
    """``spans`` (with low, high and patch) with intervals, patches an axis, shells, and frames, the least number of patch images.

    With k patches of ``patch`` places an axis the face has the greatest even number of intervals that they hold; the gap of the shells may then be what
    the budget leaves. All k that can be best are tried: beyond 2 ** 0.25 times the k whose angular share is half the budget, more patches cannot pay.
    """
    half = F.col("high") * math.sqrt(4 * STRETCH_SQUARED / BUDGET_SQUARED)
    last = F.ceil(1.2 * ((half + 3) / F.col("patch") + 1)).cast("int") + 1
    tried = spans.withColumn("k", F.explode(F.sequence(F.lit(1), last))).withColumn("intervals", (2 * F.floor((F.col("k") * F.col("patch") - 1) / 2)).cast("int")).where("intervals > 0")
    left = tried.withColumn("left", BUDGET_SQUARED - 2 * STRETCH_SQUARED * (F.col("high") / F.col("intervals")) ** 2).where("left > 0")
    span = F.col("high") - F.col("low")
    shells = F.when(span > 0, F.greatest(F.lit(2), F.ceil(F.round(span / (2 * F.sqrt("left")), 9)) + 1)).otherwise(1).cast("int")
    rated = left.withColumn("shells", shells).withColumn("frames", 6 * F.col("k").cast("long") * F.col("k") * F.col("shells"))
    best = rated.groupBy(*spans.columns).agg(F.min_by(F.struct("intervals", F.col("k").alias("patches"), "shells", "frames"), F.struct("frames", "k")).alias("best"))
    return best.select(*spans.columns, "best.*")


def plan_bands(spans: DataFrame, key: str) -> DataFrame:
    """(key, band, low, high, intervals, patches, shells, frames): the span of each ``key`` cut into 1, 2, 4 or 8 bands, whichever needs the fewest frames.

    Cuts lie at equal steps of the radius, or of the angle whose sine is proportional to it, as wide radii need closer shells. Neighbouring bands
    share their border shell.
    """
    fixed = plan_shells(spans.select(F.col(key).alias("of"), F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"), F.col("patch").cast("int").alias("patch")))
    scale = F.lit(math.sqrt(2 * STRETCH_SQUARED / BUDGET_SQUARED)) / F.col("intervals")
    ways = F.array(*[F.struct(F.lit(n).alias("bands"), F.lit(sine).alias("sine")) for n in (1, 2, 4, 8) for sine in (False, True) if n > 1 or not sine])
    cut = fixed.withColumn("scale", scale).withColumn("way", F.explode(ways)).select("of", "low", "high", "patch", "scale", "way.*").where("bands = 1 OR high > low")
    cut = cut.withColumn("band", F.explode(F.sequence(F.lit(0), F.col("bands") - 1)))
    a, b = F.asin(F.col("scale") * F.col("low")), F.asin(F.col("scale") * F.col("high"))

    def border(k: Column) -> Column:
        share = k / F.col("bands")
        between = F.when(F.col("sine"), F.sin(a + (b - a) * share) / F.col("scale")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * share)
        return F.when(k == 0, F.col("low")).when(k == F.col("bands"), F.col("high")).otherwise(between)

    planned = plan_shells(cut.select("of", "bands", "sine", "band", border(F.col("band")).alias("low"), border(F.col("band") + 1).alias("high"), "patch"))
    total = planned.groupBy("of", "bands", "sine").agg(F.sum("frames").alias("total"))
    chosen = total.groupBy("of").agg(F.min_by(F.struct("bands", "sine"), F.struct("total", "bands", "sine")).alias("best")).select("of", "best.*")
    return planned.join(chosen, ["of", "bands", "sine"]).select(F.col("of").alias(key), "band", "low", "high", "intervals", "patches", "shells", "frames")


def plan_of(spark: SparkSession, low: float, high: float, patch: int) -> DataFrame:
    """``plan_bands`` of one span."""
    return plan_bands(spark.createDataFrame([(0, float(low), float(high), patch)], "span int, low double, high double, patch int"), "span")
