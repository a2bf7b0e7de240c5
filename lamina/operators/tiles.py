"""Tiles: grids, neighbours, rebasing, ownership and relays between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def axis_starts(extents: DataFrame, size: int, stride: int, extent: str = "extent") -> DataFrame:
    """Starts of tiles along an axis: multiples of the stride, the last pinned to the far edge."""
    last = F.greatest(F.col(extent) - size, F.lit(0))
    starts = F.array_union(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last))
    return extents.withColumn("start", F.explode(F.array_sort(starts)))


def tile_grid(extents: DataFrame, size: int, stride: int) -> DataFrame:
    """(row, col, top, left, bottom, right) of the tiles that cover height x width."""
    rows = axis_starts(extents.select(F.col("height").alias("extent")), size, stride).select(F.col("start").alias("top"), F.least("extent", F.col("start") + size).alias("bottom"))
    cols = axis_starts(extents.select(F.col("width").alias("extent")), size, stride).select(F.col("start").alias("left"), F.least("extent", F.col("start") + size).alias("right"))
    numbered = lambda df, by, name: df.withColumn(name, F.row_number().over(Window.orderBy(by)) - 1)  # noqa: E731  a few starts
    across = numbered(cols, "left", "col").withColumn("columns", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    joined = numbered(rows, "top", "row").join(F.broadcast(across))
    return joined.withColumn("tile", (F.col("row") * F.col("columns") + F.col("col")).cast("int")).drop("columns")


def neighbours(tiles: DataFrame) -> DataFrame:
    """Each tile with its up to eight neighbours by grid place, and the rectangle they share."""
    a = tiles.select(*[F.col(c).alias(f"a_{c}") for c in tiles.columns])
    b = tiles.select(*[F.col(c).alias(f"b_{c}") for c in tiles.columns])
    # neighbours by equal keys: each tile offers its eight places
    steps = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c])
    offered = a.withColumn("s", F.explode(steps)).withColumn("n_row", F.col("a_row") + F.col("s.r")).withColumn("n_col", F.col("a_col") + F.col("s.c"))
    joined = offered.join(b, (F.col("n_row") == F.col("b_row")) & (F.col("n_col") == F.col("b_col")))
    return joined.select(
        F.col("a_tile").alias("tile"),
        F.col("b_tile").alias("other"),
        F.greatest("a_top", "b_top").alias("top"),
        F.least("a_bottom", "b_bottom").alias("bottom"),
        F.greatest("a_left", "b_left").alias("left"),
        F.least("a_right", "b_right").alias("right"),
    )


def in_tiles(voxels: DataFrame, size: int, stride: int, height: int, width: int) -> DataFrame:
    """Each voxel once for every tile that holds it, in the tile's own coordinates (local_y, local_x).

    The tiles of a coordinate follow by arithmetic, so no join is needed.
    """

    def starts(at: str, extent: int):
        last = max(extent - size, 0)
        top = last // stride * stride
        low = F.greatest(F.lit(0), F.ceil((F.col(at) - (size - 1)) / stride).cast("int"))
        high = F.least(F.floor(F.col(at) / stride).cast("int"), F.lit(top // stride))
        none = F.array().cast("array<int>")
        regular = F.when(low <= high, F.transform(F.sequence(low, high), lambda k: k * stride)).otherwise(none)
        pinned = F.when((F.col(at) >= last) & (F.col(at) < last + size), F.array(F.lit(last))).otherwise(none)
        return F.array_union(regular, pinned)

    spread = voxels.withColumn("top", F.explode(starts("y", height))).withColumn("left", F.explode(starts("x", width)))
    return spread.withColumn("local_y", F.col("y") - F.col("top")).withColumn("local_x", F.col("x") - F.col("left"))


def merge_relays(relays: DataFrame) -> DataFrame:
    """Relays to one (lineage, tile, frame, direction): greatest probability, next generation, all tiles visited, ordered sources."""
    return relays.groupBy("lineage", "tile", "frame", "direction").agg(
        F.max("prob").alias("prob"),
        (F.max("generation") + 1).alias("generation"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("visited")))).alias("visited"),
        F.array_sort(F.collect_set("source")).alias("sources"),
    )


def owners(objects: DataFrame, tiles: DataFrame) -> DataFrame:
    """(obj, tile): the containing tile of greatest margin, then least number; without one, every tile the box meets.

    Boxes and tiles meet by cells as large as the largest tile, so a tile lies in four cells at most and no box is compared with all tiles.
    """
    meets = (
        (F.col("y0") < F.col("bottom")) & (F.col("y1") > F.col("top")) & (F.col("x0") < F.col("right")) & (F.col("x1") > F.col("left"))
    )
    margin = F.least(F.col("y0") - F.col("top"), F.col("bottom") - F.col("y1"), F.col("x0") - F.col("left"), F.col("right") - F.col("x1"))
    cell = tiles.agg(F.max(F.greatest(F.col("bottom") - F.col("top"), F.col("right") - F.col("left")))).first()[0] or 1

    def in_cells(df: DataFrame, y0: str, y1: str, x0: str, x1: str) -> DataFrame:
        cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor((F.greatest(F.col(hi), F.col(lo) + 1) - 1) / cell)))
        return df.withColumn("cell_y", cells(y0, y1)).withColumn("cell_x", cells(x0, x1))

    boxes, places = in_cells(objects, "y0", "y1", "x0", "x1"), in_cells(tiles, "top", "bottom", "left", "right")
    met = boxes.join(places, ["cell_y", "cell_x"]).where(meets).select("obj", "tile", margin.alias("margin")).distinct()
    by = Window.partitionBy("obj").orderBy((F.col("margin") >= 0).desc(), F.col("margin").desc(), "tile")
    any_inside = F.max("margin").over(Window.partitionBy("obj")) >= 0
    return met.withColumn("place", F.row_number().over(by)).withColumn("inside", any_inside).where("NOT inside OR place = 1").select("obj", "tile", "margin")


def crop_contacts(mask: DataFrame, crops: DataFrame, margin: int = 1) -> DataFrame:
    """Foreground within ``margin`` of each side of each crop (key columns obj; box y0, y1, x0, x1)."""
    joined = mask.join(crops, "obj")
    side = lambda test: F.count_if(test)
    return joined.groupBy("obj").agg(
        side(F.col("y") < F.col("y0") + margin).alias("top"),
        side(F.col("y") >= F.col("y1") - margin).alias("bottom"),
        side(F.col("x") < F.col("x0") + margin).alias("left"),
        side(F.col("x") >= F.col("x1") - margin).alias("right"),
    )
