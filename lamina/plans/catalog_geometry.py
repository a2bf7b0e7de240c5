"""Registered queries: view geometry, shapes, bridges, view expansion, and general relational ones over the star schema."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators import centerline, geometry, maskset, packets, projection, resample, temporal, tiles, topology
from lamina.plans.catalog import _label_sql, query
from lamina.plans.catalog_curation import _OVERLAP, _grid_sql, _metrics
from lamina.session import cut, table
from lamina.sources import adapters, volumes
from lamina.sources.adapters import sql

# ---- views ----

_VIEWS = [("transverse", "orthogonal"), ("sagittal", "orthogonal"), ("coronal", "orthogonal"), ("azimuth", "azimuthal"), ("shell", "spherical")]


@query(
    f"""SELECT view, family, angle, channel FROM (VALUES {", ".join(map(str, _VIEWS))}) v(view, family), (SELECT unnest([0, 15, -15]) AS angle), (VALUES ('rgb'), ('bgr')) c(channel)
WHERE angle = 0 OR family = 'orthogonal'"""
)
def view_expansion(spark, sf_dir):
    """Physical views by angle by channel order; only orthogonal ones are rotated."""
    views = spark.createDataFrame(_VIEWS, "view string, family string")
    angles = spark.createDataFrame([(0,), (15,), (-15,)], "angle int")
    channels = spark.createDataFrame([("rgb",), ("bgr",)], "channel string")
    return views.crossJoin(angles).crossJoin(channels).where("angle = 0 OR family = 'orthogonal'")


@query(
    """WITH v AS (SELECT conv_id AS volume, max(turn) + 1 AS n FROM conversations GROUP BY 1),
c AS (SELECT volume, view, frame, unnest([-1, 0, 1, 2, 3])::INT AS tile FROM (SELECT volume, view, unnest(range(n)) AS frame FROM v, (VALUES ('a'), ('b')) w(view)))
SELECT volume, view, frame, tile, row_number() OVER (PARTITION BY volume ORDER BY view, frame, tile)::INT AS ord FROM c"""
)
def candidate_enumeration(spark, sf_dir):
    """Volume by view by frame by the full frame (-1) and its tiles, numbered in a stable order."""
    from pyspark.sql import Window

    volumes = adapters.frames(spark, sf_dir).groupBy("volume").agg((F.max("frame") + 1).alias("n"))
    spread = (
        volumes.withColumn("view", F.explode(F.array(F.lit("a"), F.lit("b"))))
        .withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        .withColumn("tile", F.explode(F.sequence(F.lit(-1), F.lit(3))))
    )
    return spread.select("volume", "view", "frame", "tile", F.row_number().over(Window.partitionBy("volume").orderBy("view", "frame", "tile")).alias("ord"))


@query("SELECT c_custkey, ((ceil(round((c_custkey % 3600) / 10.0 / 15.0, 9) - 0.5)::INT % 12) + 12) % 12 AS nearest FROM customer")
def nearest_angle(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", geometry.nearest_angle(F.col("c_custkey") % 3600 / 10, 12).alias("nearest"))


_AZIMUTH = """, a AS (SELECT angle, u FROM (SELECT unnest(range(12))::INT AS angle), (SELECT unnest(range(-(k // 2), k // 2 + 1))::INT AS u FROM km)),
p AS (SELECT angle, u, floor(round((k - 1) / 2.0 + u * sin(radians(angle * 15.0)), 9) + 0.5)::INT AS y, floor(round((k - 1) / 2.0 + u * cos(radians(angle * 15.0)), 9) + 0.5)::INT AS x FROM a, km),
s AS (SELECT angle, t, u FROM p JOIN mask USING (y, x)),
g AS (SELECT t, y, x, y - (k - 1) / 2.0 AS dy, x - (k - 1) / 2.0 AS dx FROM """


@query(
    sql(
        "mask km",
        _AZIMUTH
        + _grid_sql(8, "k", "k")
        + """ q, km), h AS (SELECT *, ((degrees(atan2(dy, dx)) + 360) % 180.0) AS theta FROM g),
n AS (SELECT *, ceil(round(theta / 15.0, 9) - 0.5)::INT % 12 AS angle FROM h)
SELECT n.t, n.y, n.x FROM n SEMI JOIN s ON s.angle = n.angle AND s.t = n.t AND s.u = floor(round(dx * cos(radians(n.angle * 15.0)) + dy * sin(radians(n.angle * 15.0)), 9) + 0.5)::INT""",
    )
)
def azimuth_back_projection(spark, sf_dir):
    k = adapters.mask_side(spark, sf_dir)
    slices = resample.azimuth_slices(adapters.mask(spark, sf_dir), 12, k, k)
    return geometry.back_project_azimuths(slices, resample.grid(spark, (8, k, k)), 12, k, k)


@query(
    sql(
        "mask km",
        """, p AS (SELECT r, a, floor(round((k - 1) / 2.0 + r * sin(a * 2 * pi() / 24), 9) + 0.5)::INT AS y, floor(round((k - 1) / 2.0 + r * cos(a * 2 * pi() / 24), 9) + 0.5)::INT AS x FROM (SELECT unnest(range(1, k // 2 + 1))::INT AS r, k FROM km), (SELECT unnest(range(24))::INT AS a))
SELECT r, t, a FROM p JOIN mask USING (y, x)""",
    )
)
def radial_shells(spark, sf_dir):
    k = adapters.mask_side(spark, sf_dir)
    places = resample.grid(spark, (k // 2, 24), ("r", "a")).withColumn("r", F.col("r") + 1)
    y, x = geometry.shell_address(F.col("r").cast("double"), F.col("a").cast("double"), 24, k, k)
    return places.withColumn("y", y).withColumn("x", x).join(adapters.mask(spark, sf_dir), ["y", "x"]).select("r", "t", "a")


def _qsc_sql(native: str) -> str:
    """CTEs from ``native`` (dx, dy, dz, face) to (u, v) of the equal-area cube."""
    return f"""turned AS (SELECT *, [dx, dy, -dx, -dy, dz, -dz][face + 1] AS q, [dy, -dx, -dy, dx, dy, dy][face + 1] AS r, [dz, dz, dz, dz, -dx, dx][face + 1] AS s FROM {native}),
sided AS (SELECT *, abs(r) >= abs(s) AS flat, CASE WHEN abs(r) >= abs(s) THEN r ELSE s END AS major, CASE WHEN abs(r) >= abs(s) THEN s ELSE r END AS minor, sqrt(q * q + r * r + s * s) AS norm
  FROM turned WHERE q > 0 AND q * (1 + 1e-12) >= greatest(abs(r), abs(s))),
rated AS (SELECT *, CASE WHEN major = 0 THEN 0.0 ELSE minor / major END AS ratio FROM sided),
bent AS (SELECT *, sign(major) * sqrt(greatest((1 - q / norm) / (1 - 1 / sqrt(2 + ratio * ratio)), 0)) AS mu, {12 / math.pi!r} * (atan(ratio) - asin(ratio / sqrt(2 * (1 + ratio * ratio)))) AS turn FROM rated),
uv AS (SELECT *, CASE WHEN flat THEN mu ELSE mu * turn END AS u, CASE WHEN flat THEN mu * turn ELSE mu END AS v FROM bent)"""


@query(
    f"""WITH d AS (SELECT unnest(range(62)) AS k, embedding FROM embeddings), e AS (SELECT embedding[k + 1]::DOUBLE AS dx, embedding[k + 2]::DOUBLE AS dy, embedding[k + 3]::DOUBLE AS dz FROM d),
native AS (SELECT *, CASE WHEN abs(dx) >= abs(dy) AND abs(dx) >= abs(dz) THEN CASE WHEN dx >= 0 THEN 0 ELSE 2 END WHEN abs(dy) >= abs(dz) THEN CASE WHEN dy >= 0 THEN 1 ELSE 3 END ELSE CASE WHEN dz >= 0 THEN 4 ELSE 5 END END AS face
  FROM e WHERE dx <> 0 OR dy <> 0 OR dz <> 0),
{_qsc_sql("native")}
SELECT face, least(floor(round((u + 1) * 4, 9)), 7)::INT AS i, least(floor(round((v + 1) * 4, 9)), 7)::INT AS j, count(*) AS n FROM uv GROUP BY ALL"""
)
def spherical_cells(spark, sf_dir):
    """Each three neighbouring values of the embeddings as a direction, counted by face and cell of the equal-area cube."""
    triples = table(spark, sf_dir, "embeddings").select("embedding", F.explode(F.sequence(F.lit(1), F.size("embedding") - 2)).alias("k"))
    directions = triples.select(*[F.element_at("embedding", F.col("k") + d).cast("double").alias(c) for d, c in enumerate("xyz")]).where("x <> 0 OR y <> 0 OR z <> 0")
    cell = lambda c: F.least(F.floor(F.round((F.col(c) + 1) * 4, 9)), F.lit(7)).cast("int")
    return geometry.qsc_forward(directions).groupBy("face", cell("u").alias("i"), cell("v").alias("j")).agg(F.count(F.lit(1)).alias("n"))


# ---- back-projection: SQL pulls every native voxel, Spark pushes the foreground ----


def _seen(spark, sf_dir, **names) -> tuple[DataFrame, int]:
    """The evidence as view voxels under other names, and the grid's side."""
    own = adapters.evidence(spark, sf_dir).select(*[F.expr(e).cast("int").alias(n) for n, e in names.items()], "score")
    return own.groupBy(*names).agg(F.max("score").alias("score")), adapters.grid_side(spark, sf_dir)


def _axis_sql(name: str, work: str, out: str) -> str:
    """CTE of (place, coordinate): cells that a contracted place meets, or the center of a place."""
    return f"""{name} AS (SELECT d, unnest(CASE WHEN {out} < {work} THEN list_transform(range(d * {work} // {out}, ((d + 1) * {work} + {out} - 1) // {out}), lambda c: c::DOUBLE) ELSE [(d + 0.5) * ({work}::DOUBLE / {out}) - 0.5] END) AS c
  FROM (SELECT unnest(range({out}::BIGINT)) AS d, k FROM kk))"""


@query(
    sql(
        "evidence kk",
        f""", s AS (SELECT t AS frame, y AS v, x AS u, max(score) AS score FROM evidence GROUP BY ALL),
{_axis_sql("depths", "16", "20")}, {_axis_sql("ay", "k", "(k // 2)")}, {_axis_sql("ax", "k", "(k * 3 // 2)")},
c AS (SELECT depths.d AS t, ay.d AS y, ax.d AS x, floor(round(depths.c - 0.4::DOUBLE * (ax.c - (k - 1) / 2.0) + 1, 9) + 0.5)::INT AS frame, floor(round(ay.c, 9) + 0.5)::INT AS v, floor(round(ax.c, 9) + 0.5)::INT AS u FROM depths, ay, ax, kk)
SELECT t, y, x, max(score) AS score FROM c JOIN s USING (frame, v, u) GROUP BY ALL""",
    )
)
def tilted_back_projection(spark, sf_dir):
    """A stack sheared along x, shown deeper, half as high and half as wide again as it was worked on."""
    view, k = _seen(spark, sf_dir, frame="t", v="y", u="x")
    return projection.push_tilted(view, (16, k, k), (20, k // 2, k * 3 // 2), 0.4, "x", first=-1)


@query(
    sql(
        "evidence kk",
        f""", s AS (SELECT t AS angle, y AS row, x AS col, max(score) AS score FROM evidence GROUP BY ALL),
{_axis_sql("depths", "k", "(k // 2)")},
p AS (SELECT y, x, (2.0::DOUBLE * y + (1 - (k + 3))) * k / (2.0 * (k + 3)) AS dy, (2.0::DOUBLE * x + (1 - k)) * k / (2.0 * k) AS dx, k, (k - 1) / 2.0::DOUBLE AS r
  FROM (SELECT unnest(range(k + 3)) AS y, k FROM kk), (SELECT unnest(range(k)) AS x FROM kk)),
a AS (SELECT *, ceil(round(((degrees(atan2(dy, dx)) + 360) % 180.0) / (180.0 / 16), 9) - 0.5)::INT % 16 AS angle FROM p WHERE round(sqrt(dx * dx + dy * dy), 9) <= r + 0.5),
q AS (SELECT *, least(greatest(round_even(round((dx * cos(radians(angle * 11.25)) + dy * sin(radians(angle * 11.25)) + r) / (2 * r) * (k - 1), 9), 0), 0), k - 1)::INT AS col FROM a)
SELECT depths.d AS t, y, x, max(score) AS score FROM q JOIN s USING (angle, col) JOIN depths ON floor(round(depths.c, 9) + 0.5) = s.row GROUP BY ALL""",
    )
)
def azimuthal_score_projection(spark, sf_dir):
    """Scores on 16 lines through the center; of the rows that meet in a contracted depth the greatest stays."""
    view, k = _seen(spark, sf_dir, angle="t", row="y", col="x")
    return projection.push_azimuthal(view, (k, k, k), (k // 2, k + 3, k), 16, k, (k - 1) / 2)


@query(
    sql(
        "evidence kk",
        """, s AS (SELECT t AS shell, y AS row, x AS col, max(score) AS score FROM evidence GROUP BY ALL),
p AS (SELECT y, x, (2.0::DOUBLE * y + (1 - k)) * k / (2.0 * k) AS dy, (2.0::DOUBLE * x + (1 - k * 2)) * k / (2.0 * k * 2) AS dx, k FROM (SELECT unnest(range(k)) AS y, k FROM kk), (SELECT unnest(range(k * 2)) AS x FROM kk)),
a AS (SELECT *, sqrt(dx * dx + dy * dy) AS radius, least(greatest(ceil(round((sqrt(dx * dx + dy * dy) - 0.75) / 0.7, 9) - 0.5), 0), 15)::INT AS shell FROM p),
b AS (SELECT *, 0.75 + shell * 0.7::DOUBLE AS r FROM a WHERE round(radius, 9) BETWEEN 0.75 AND 0.75 + 15 * 0.7),
c AS (SELECT *, 2 * pi() * r AS period, CASE WHEN atan2(dy, dx) < 0 THEN atan2(dy, dx) + 2 * pi() ELSE atan2(dy, dx) END AS theta FROM b),
d AS (SELECT *, (theta * r + 0.5) - floor((theta * r + 0.5) / period) * period - 0.5 AS start FROM c),
e AS (SELECT DISTINCT y, x, shell, round_even(round(start + m * period, 9), 0)::INT AS col FROM (SELECT *, unnest(range(20)) AS m FROM d)),
h AS (SELECT d AS t, (2.0::DOUBLE * d + (1 - k // 2)) * k / (2.0 * (k // 2)) + (k - 1) / 2.0 AS height, k FROM (SELECT unnest(range(k // 2)) AS d, k FROM kk))
SELECT t, y, x, max(score) AS score FROM e JOIN s USING (shell, col) JOIN h ON round_even(round(least(greatest(height, 0), k - 1), 9), 0)::INT = s.row AND round(height, 9) >= -0.5 AND round(height, 9) < k - 0.5 GROUP BY ALL""",
    )
)
def radial_score_projection(spark, sf_dir):
    """Scores on 16 cylinder shells; inner ones go round several times."""
    view, k = _seen(spark, sf_dir, shell="t", row="y", col="x")
    return projection.push_radial(view, (k, k, k), (k // 2, k, k * 2), 0.75, 0.7, 16, k)


_QSC = "placed AS (SELECT * FROM native, (SELECT unnest(range(6))::INT AS face)),\n" + _qsc_sql("placed")


@query(
    sql(
        "evidence kk",
        f""", seen AS (SELECT t % 8 AS shell, y % 6 AS face, (y // 6) AS row, x AS col, max(score) AS score FROM evidence GROUP BY ALL),
n AS (SELECT t, y, x, k, (2.0::DOUBLE * t + (1 - k)) * k / (2.0 * k) AS dz, (2.0::DOUBLE * y + (1 - k)) * k / (2.0 * k) AS dy, (2.0::DOUBLE * x + (1 - k * 5 // 4)) * k / (2.0 * (k * 5 // 4)) AS dx
  FROM (SELECT unnest(range(k)) AS t, k FROM kk), (SELECT unnest(range(k)) AS y FROM kk), (SELECT unnest(range(k * 5 // 4)) AS x FROM kk)),
native AS (SELECT *, least(greatest(ceil(round((sqrt(dx ** 2 + dy ** 2 + dz ** 2) - 1.5) / 1.25, 9) - 0.5), 0), 7)::INT AS shell FROM n WHERE round(sqrt(dx ** 2 + dy ** 2 + dz ** 2), 9) BETWEEN 1.5 AND 1.5 + 7 * 1.25),
{_QSC}
SELECT t, y, x, max(score) AS score FROM (SELECT *, round_even(round((u + 1) * (k / 2.0), 9), 0)::INT AS col, round_even(round((1 - v) * (k / 2.0), 9), 0)::INT AS row FROM uv) JOIN seen USING (shell, face, row, col) GROUP BY ALL""",
    )
)
def spherical_score_projection(spark, sf_dir):
    """Scores on 8 sphere shells of the equal-area cube."""
    view, k = _seen(spark, sf_dir, shell="t % 8", face="y % 6", row="y div 6", col="x")
    return projection.push_spherical(view, (k, k, k), (k, k, k * 5 // 4), k, 1.5, 1.25, 8)


_DIRECTION = f"""flatly AS (SELECT *, abs(u) >= abs(v) AS flat, CASE WHEN abs(u) >= abs(v) THEN u ELSE v END AS far, CASE WHEN abs(u) >= abs(v) THEN v ELSE u END AS side FROM places),
angled AS (SELECT *, CASE WHEN far = 0 THEN 0.0 ELSE side / far END * {math.pi / 12!r} AS turn FROM flatly),
bent AS (SELECT *, sin(turn) / (cos(turn) - sqrt(0.5)) AS tangent FROM angled),
thrown AS (SELECT *, 1 / sqrt(1 + tangent ** 2) AS cosine FROM bent),
deep AS (SELECT *, 1 - cosine / sqrt(1 + cosine * cosine) AS d FROM thrown),
cross_face AS (SELECT *, 1 - far * far * d AS q, far * sqrt(d * (2 - far * far * d)) * cosine AS major FROM deep),
local AS (SELECT *, CASE WHEN flat THEN major ELSE major * tangent END AS r, CASE WHEN flat THEN major * tangent ELSE major END AS s FROM cross_face),
directed AS (SELECT shell, face, row, col, k, [q, -r, -q, r, -s, s][face + 1] AS dx, [r, q, -r, -q, r, r][face + 1] AS dy, [s, s, s, s, q, -q][face + 1] AS dz FROM local)"""


@query(
    sql(
        "mask km",
        f""", places AS (SELECT shell, face, row, col, k, col * (2.0::DOUBLE / k) - 1 AS u, 1 - row * (2.0::DOUBLE / k) AS v
  FROM (SELECT unnest(range(6))::INT AS shell), (SELECT unnest(range(6))::INT AS face), (SELECT unnest(range(k + 1))::INT AS row, k FROM km), (SELECT unnest(range(k + 1))::INT AS col FROM km)),
{_DIRECTION}
SELECT shell, face, row, col FROM directed JOIN mask ON mask.t = floor(round((0.5 + shell * 0.6) * dz + 3.5, 9) + 0.5) AND mask.y = floor(round((0.5 + shell * 0.6) * dy + (k - 1) / 2.0, 9) + 0.5)
  AND mask.x = floor(round((0.5 + shell * 0.6) * dx + (k - 1) / 2.0, 9) + 0.5)""",
    )
)
def spherical_sampling(spark, sf_dir):
    """Six sphere shells of a mask on the equal-area cube, edges of faces included."""
    k = adapters.mask_side(spark, sf_dir)
    return projection.sample_sphere(adapters.mask(spark, sf_dir), (8, k, k), k, 0.5, 0.6, 6)


def _shells_sql(name: str, source: str, keys: str) -> str:
    return f"""{name}_k AS (SELECT *, (2 * ((k * patch - 1) // 2))::INT AS intervals FROM (SELECT *, unnest(range(1, 2 + patch_most)) AS k FROM (SELECT *, (high * 4 / patch)::BIGINT + 8 AS patch_most FROM {source}))),
{name}_s AS (SELECT *, CASE WHEN high > low THEN greatest(2, ceil(round((high - low) / (2 * sqrt({projection.BUDGET_SQUARED!r} - {2 * projection.STRETCH_SQUARED!r} * (high / intervals) ** 2)), 9)) + 1) ELSE 1 END::INT AS shells
  FROM {name}_k WHERE intervals > 0 AND {projection.BUDGET_SQUARED!r} - {2 * projection.STRETCH_SQUARED!r} * (high / intervals) ** 2 > 0),
{name} AS (SELECT *, 6 * k * k * shells AS frames FROM {name}_s QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY 6 * k * k * shells, k) = 1)"""


@query(
    f"""WITH spans AS (SELECT p_partkey, 0.5 + (p_partkey % 7)::DOUBLE AS low, 8 + (p_partkey % 113)::DOUBLE AS high, (8 + p_partkey % 57)::INT AS patch FROM part),
{_shells_sql("fixed", "spans", "p_partkey")},
ways AS (SELECT * FROM (VALUES (1, false), (2, false), (2, true), (4, false), (4, true), (8, false), (8, true)) w(bands, sine)),
scaled AS (SELECT p_partkey, low, high, patch, bands, sine, unnest(range(bands))::INT AS band, {math.sqrt(2 * projection.STRETCH_SQUARED / projection.BUDGET_SQUARED)!r} / intervals AS scale FROM fixed, ways),
angles AS (SELECT *, asin(scale * low) AS a, asin(scale * high) AS b FROM scaled),
cut AS (SELECT p_partkey, patch, bands, sine, band,
  CASE WHEN band = 0 THEN low WHEN sine THEN sin(a + (b - a) * (band::DOUBLE / bands)) / scale ELSE low + (high - low) * (band::DOUBLE / bands) END AS low,
  CASE WHEN band + 1 = bands THEN high WHEN sine THEN sin(a + (b - a) * ((band + 1)::DOUBLE / bands)) / scale ELSE low + (high - low) * ((band + 1)::DOUBLE / bands) END AS high FROM angles),
{_shells_sql("planned", "cut", "p_partkey, bands, sine, band")},
totals AS (SELECT p_partkey, bands, sine, sum(frames) AS total FROM planned GROUP BY ALL),
best AS (SELECT * FROM totals QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY total, bands, sine) = 1)
SELECT p_partkey, band, round(low, 8) AS low, round(high, 8) AS high, intervals, k::INT AS patches, shells, frames::BIGINT AS frames FROM planned JOIN best USING (p_partkey, bands, sine)"""
)
def spherical_plan(spark, sf_dir):
    """Shell bands and face grids of each part's span of radii with the fewest patch images."""
    spans = table(spark, sf_dir, "part").select(
        "p_partkey", (0.5 + F.col("p_partkey") % 7).alias("low"), (8 + F.col("p_partkey") % 113).cast("double").alias("high"), (8 + F.col("p_partkey") % 57).cast("int").alias("patch")
    )
    return projection.plan_bands(spans, "p_partkey").withColumn("low", F.round("low", 8)).withColumn("high", F.round("high", 8))


# ---- resampling ----

_RAW = [math.exp(-0.5 * k * k) for k in range(-4, 5)]
_TAPS = ", ".join(f"({k}, {w / sum(_RAW)!r}::DOUBLE)" for k, w in zip(range(-4, 5), _RAW, strict=True))


@query(
    sql(
        "evidence",
        f""", w AS (SELECT * FROM (VALUES {_TAPS}) v(d, w)), s AS (SELECT DISTINCT t, y, x FROM evidence)
SELECT s.t + a.d AS t, s.y + b.d AS y, s.x + c.d AS x FROM s, w a, w b, w c GROUP BY ALL HAVING round(sum(a.w * b.w * c.w), 9) >= 0.5""",
    )
)
def gaussian_smooth_3d(spark, sf_dir):
    return geometry.gaussian(maskset.union(adapters.evidence(spark, sf_dir)))


@query(
    sql(
        "evidence",
        f""", w AS (SELECT * FROM (VALUES {_TAPS}) v(d, w)), s AS (SELECT DISTINCT t, y, x FROM evidence)
SELECT s.t, s.y + b.d AS y, s.x + c.d AS x FROM s, w b, w c GROUP BY ALL HAVING round(sum(b.w * c.w), 9) >= 0.5""",
    )
)
def gaussian_smooth(spark, sf_dir):
    return geometry.gaussian(maskset.union(adapters.evidence(spark, sf_dir)), axes=("y", "x"))


@query(
    sql(
        "evidence kk",
        """, p AS (SELECT t, y, x, max(score) AS value FROM evidence GROUP BY ALL),
c AS (SELECT p.t, i AS y, j AS x, value, (least((p.y + 1) * 7, (i + 1) * k) - greatest(p.y * 7, i * k)) * (least((p.x + 1) * 7, (j + 1) * k) - greatest(p.x * 7, j * k)) AS w
  FROM p, kk, (SELECT unnest(range(7))::INT AS i), (SELECT unnest(range(7))::INT AS j)
  WHERE least((p.y + 1) * 7, (i + 1) * k) > greatest(p.y * 7, i * k) AND least((p.x + 1) * 7, (j + 1) * k) > greatest(p.x * 7, j * k))
SELECT t, y, x, round(sum(value * w)::DOUBLE / sum(w), 9) AS value FROM c GROUP BY t, y, x""",
    )
)
def intensity_area_resize(spark, sf_dir):
    """Sparse pixels: means are over the pixels there are."""
    k = adapters.grid_side(spark, sf_dir)
    pixels = adapters.evidence(spark, sf_dir).groupBy("t", "y", "x").agg(F.max("score").alias("value"))
    return geometry.area_resize(pixels, (k, k), (7, 7)).withColumn("value", F.round("value", 9))


@query(sql("mask", "SELECT factor, t // factor AS t, y // factor AS y, x // factor AS x FROM mask, (VALUES (2), (4), (8)) f(factor) GROUP BY ALL"))
def mirrored_downbins(spark, sf_dir):
    """One mask at several isotropic factors in one pass."""
    spread = adapters.mask(spark, sf_dir).withColumn("factor", F.explode(F.array(F.lit(2), F.lit(4), F.lit(8))))
    return spread.select("factor", *[F.expr(f"cast({c} div factor as int)").alias(c) for c in "tyx"]).distinct()


@query(
    sql(
        "mask km",
        f""", moved AS (SELECT g.t, g.y, g.x FROM {_grid_sql(5, "6", "6")} g, km SEMI JOIN mask m ON m.t = g.t * 8 // 5 AND m.y = g.y * k // 6 AND m.x = g.x * k // 6),
anchors AS (SELECT t, min(y * 1000 + x) AS place FROM mask GROUP BY t),
lost AS (SELECT t * 5 // 8 AS t, (place // 1000) * 6 // k AS y, (place % 1000) * 6 // k AS x FROM anchors, km WHERE t * 5 // 8 NOT IN (SELECT t FROM moved))
SELECT t, y, x FROM moved UNION SELECT t, y, x FROM lost""",
    )
)
def anchor_preservation(spark, sf_dir):
    """A plane that lost all its foreground in resizing gets one cell at its anchor."""
    k = adapters.mask_side(spark, sf_dir)
    mask = adapters.mask(spark, sf_dir)
    moved = resample.resize_nearest(mask, (8, k, k), (5, 6, 6))
    anchors = mask.groupBy("t").agg(F.min(F.struct("y", "x")).alias("at"))
    mapped = anchors.select(*[F.floor(F.col(c) * d / s).cast("int").alias(n) for c, n, s, d in (("t", "t", 8, 5), ("at.y", "y", k, 6), ("at.x", "x", k, 6))])
    lost = mapped.join(moved.select("t").distinct(), "t", "left_anti")
    return maskset.union(moved, lost)


@query(
    sql(
        "mask km",
        """, tiles AS (SELECT unnest(list_distinct(list_append(range(0, greatest(k - 8, 0) + 1, 6), greatest(k - 8, 0))))::INT AS top FROM km), pairs AS (SELECT a.top, b.top AS "left" FROM tiles a, tiles b),
f AS (SELECT unnest(range(8))::INT AS t)
SELECT f.t, p.top, p."left", count(m.t) > 0 AS occupied FROM f CROSS JOIN pairs p LEFT JOIN mask m ON m.t = f.t AND m.y >= p.top AND m.y < p.top + 8 AND m.x >= p."left" AND m.x < p."left" + 8 GROUP BY ALL""",
    )
)
def occupancy_by_tile(spark, sf_dir):
    """Whether each tile of each frame holds any foreground."""
    k = adapters.mask_side(spark, sf_dir)
    extents = spark.range(8).select(F.col("id").cast("int").alias("t"), F.lit(k).alias("extent"))
    rows = tiles.axis_starts(extents, 8, 6).withColumnRenamed("start", "top")
    frames = tiles.axis_starts(rows, 8, 6).withColumnRenamed("start", "left").select("t", "top", "left")
    hit = tiles.in_tiles(adapters.mask(spark, sf_dir), 8, 6, k, k)
    some = hit.select("t", "top", "left").distinct().withColumn("occupied", F.lit(True))
    return frames.join(some, ["t", "top", "left"], "left").select("t", "top", "left", F.coalesce("occupied", F.lit(False)).alias("occupied"))


# ---- packets and volumes ----


def _packets(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Packets of each layer's tiles of 10 by 10, which overlap by 2, and their declarations."""
    k = adapters.grid_side(spark, sf_dir)
    local = tiles.in_tiles(adapters.evidence(spark, sf_dir).select("layer_id", "t", "y", "x"), 10, 8, k, k)
    named = local.withColumn("artifact", F.concat_ws("/", "layer_id", F.col("top").cast("string"), F.col("left").cast("string")))
    masks = named.select("artifact", F.col("t").alias("frame"), F.col("local_y").alias("y"), F.col("local_x").alias("x"))
    places = named.select("artifact", F.lit(0).alias("frame_start"), F.lit(16).alias("frames"), F.lit(10).alias("height"), F.lit(10).alias("width"), F.col("top").alias("y0"), F.col("left").alias("x0")).distinct()
    made = cut(packets.pack(masks))
    return made, packets.declare(made, places)


def _view(spark, sf_dir) -> DataFrame:
    return packets.into_view(packets.words(packets.checked(*_packets(spark, sf_dir))))


@query(sql("evidence", "SELECT DISTINCT t AS frame, y, x FROM evidence"))
def packet_view(spark, sf_dir):
    """Every layer packed by tiles, checked, and reduced into one view again."""
    bit = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit")
    spread = _view(spark, sf_dir).select("frame", "y", "word", "bits", bit).where(F.expr("shiftrightunsigned(bits, bit) & 1") == 1)
    return spread.select("frame", "y", (F.col("word") * 64 + F.col("bit")).cast("int").alias("x"))


@query(
    sql(
        "evidence",
        """, w AS (SELECT t, y, x // 64 AS word, bit_or(1::UBIGINT << (x % 64)::UBIGINT) AS bits FROM (SELECT DISTINCT t, y, x FROM evidence) GROUP BY ALL),
r AS (SELECT t, y, sha256(string_agg(word || ':' || lower(to_hex(bits)), ',' ORDER BY word)) AS digest, sum(bit_count(bits)) AS n FROM w GROUP BY t, y)
SELECT t AS frame, sum(n)::BIGINT AS foreground, sha256(string_agg(y || '=' || digest, ';' ORDER BY y)) AS digest FROM r GROUP BY t""",
    )
)
def packet_view_digest(spark, sf_dir):
    return packets.view_digests(_view(spark, sf_dir))


@query(
    sql(
        "evidence",
        """, u AS (SELECT DISTINCT layer_id, t, y, x FROM evidence), i AS (SELECT *, x - row_number() OVER (PARTITION BY layer_id, t, y ORDER BY x) AS island FROM u)
SELECT layer_id AS path, t, y, min(x) AS x0, max(x) + 1 AS x1 FROM i GROUP BY layer_id, t, y, island""",
    )
)
def nrrd_layer_runs(spark, sf_dir):
    """Each layer as a compressed volume, and read again plane by plane."""
    k = adapters.grid_side(spark, sf_dir)
    files = volumes.encode_nrrd(adapters.evidence(spark, sf_dir), (16, k, k))
    return volumes.decode_nrrd_runs(files.withColumnRenamed("layer_id", "path"))


@query(sql("evidence kk", "SELECT DISTINCT layer_id AS filename, 16 AS planes, k::INT AS rows, k::INT AS columns FROM evidence, kk"))
def nrrd_layer_shapes(spark, sf_dir):
    """Headers of the layers' volumes against the shapes of a manifest."""
    k = adapters.grid_side(spark, sf_dir)
    files = volumes.encode_nrrd(adapters.evidence(spark, sf_dir), (16, k, k)).withColumnRenamed("layer_id", "path")
    manifest = adapters.evidence(spark, sf_dir).select(F.col("layer_id").alias("filename"), F.lit(f"16,{k},{k}").alias("shape")).distinct()
    return volumes.check_shapes(files, manifest)


# ---- shapes ----


@query(sql("evidence", ", u AS (SELECT DISTINCT t, y, x FROM evidence), i AS (SELECT t, y, x, x - row_number() OVER (PARTITION BY t, y ORDER BY x) AS island FROM u), r AS (SELECT t, y, min(x) AS x0, max(x) + 1 AS x1 FROM i GROUP BY t, y, island)\nSELECT t, sha256(string_agg(y || ':' || x0 || '-' || x1, ',' ORDER BY y, x0)) AS digest FROM r GROUP BY t"))
def logical_union_hash(spark, sf_dir):
    """A digest of each plane's foreground by its ordered runs, whatever the layout of the artifact."""
    runs = maskset.runs(maskset.union(adapters.evidence(spark, sf_dir)))
    text = F.concat(F.col("y"), F.lit(":"), F.col("x0"), F.lit("-"), F.col("x1"))
    ordered = F.array_sort(F.collect_list(F.struct("y", "x0", text.alias("text"))))
    return runs.groupBy("t").agg(F.sha2(F.array_join(F.transform(ordered, lambda r: r["text"]), ","), 256).alias("digest"))


@query(
    sql(
        "tracklets",
        "SELECT obj % 20 AS lineage, x // 4 AS tile, min(obj) AS local_id, list_sort(list_distinct(list(y // 4))) AS visited, min(frame) AS first, max(frame) AS last FROM tracklets GROUP BY 1, 2",
    )
)
def relay_chains(spark, sf_dir):
    """Episodes of one lineage and tile over chains: least object, union of visited tiles, and the end frames."""
    rows = adapters.tracklets(spark, sf_dir)
    return rows.groupBy((F.col("obj") % 20).alias("lineage"), F.expr("cast(x div 4 as int)").alias("tile")).agg(
        F.min("obj").alias("local_id"), F.array_sort(F.collect_set(F.expr("cast(y div 4 as int)"))).alias("visited"), F.min("frame").alias("first"), F.max("frame").alias("last")
    )


@query(
    sql(
        "tracklets",
        """, s AS (SELECT obj, frame, count(*) AS area FROM tracklets GROUP BY obj, frame),
m AS (SELECT *, quantile_cont(area, 0.5) OVER (PARTITION BY obj ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS local, row_number() OVER (PARTITION BY obj ORDER BY frame) AS place FROM s),
f AS (SELECT *, place - row_number() OVER (PARTITION BY obj ORDER BY frame) AS island FROM m WHERE area > 1.2 * local)
SELECT obj, min(frame) AS first, max(frame) AS last, count(*) AS samples FROM f GROUP BY obj, island""",
    )
)
def centerline_event_islands(spark, sf_dir):
    areas = adapters.tracklets(spark, sf_dir).groupBy("obj", "frame").agg(F.count(F.lit(1)).alias("area"))
    return geometry.radius_events(areas, "obj", "frame", "area", 1.2, 2)


def _branches(spark, sf_dir) -> DataFrame:
    centers = adapters.tracklets(spark, sf_dir).groupBy("obj", "frame").agg(F.sum("y").alias("sy"), F.sum("x").alias("sx"), F.count(F.lit(1)).alias("n"))
    return centers.select(F.col("obj").alias("branch"), F.col("frame").alias("ord"), (F.col("frame") * 3).alias("t"), F.expr("sy div n").alias("y"), F.expr("sx div n").alias("x"))


_CENTERLINE = """, p0 AS (SELECT obj AS branch, frame AS ord, frame * 3 AS t, sum(y) // count(*) AS y, sum(x) // count(*) AS x FROM tracklets GROUP BY obj, frame),
p AS (SELECT * FROM (SELECT *, (t - lag(t) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (x - lag(x) OVER w) ** 2 AS moved FROM p0 WINDOW w AS (PARTITION BY branch ORDER BY ord)) WHERE coalesce(moved, 1) > 0),
n AS (SELECT *, lead(t) OVER w AS nt, lead(y) OVER w AS ny, lead(x) OVER w AS nx FROM p WINDOW w AS (PARTITION BY branch ORDER BY ord)),
d AS (SELECT *, sqrt((nt - t) ** 2 + (ny - y) ** 2 + (nx - x) ** 2) AS step FROM n),
c AS (SELECT *, coalesce(sum(step) OVER (PARTITION BY branch ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f, sum(step) OVER (PARTITION BY branch) AS length FROM d),
g AS (SELECT branch, greatest(1, round_even(round(any_value(length), 9), 0)::INT) AS gaps, any_value(length) AS length FROM c WHERE length > 0 GROUP BY branch),
k AS (SELECT branch, length, gaps, unnest(range(gaps + 1)) AS s FROM g),
samples AS (SELECT k.branch, k.s, c.t + (k.s * k.length / gaps - f) / step * (nt - t) AS t, c.y + (k.s * k.length / gaps - f) / step * (ny - y) AS y, c.x + (k.s * k.length / gaps - f) / step * (nx - x) AS x
  FROM k JOIN c ON c.branch = k.branch AND step IS NOT NULL AND k.s * k.length / gaps >= f - 1e-9 QUALIFY row_number() OVER (PARTITION BY k.branch, k.s ORDER BY f DESC) = 1)"""


@query(sql("tracklets", _CENTERLINE + "\nSELECT branch, s::INT AS s, round(t, 6) AS t, round(y, 6) AS y, round(x, 6) AS x FROM samples"))
def centerline_resample(spark, sf_dir):
    samples = geometry.centerline_samples(_branches(spark, sf_dir))
    return samples.select("branch", F.col("s").cast("int").alias("s"), *[F.round(c, 6).alias(c) for c in "tyx"])


def _cross(a: str, b: str) -> list[str]:
    """Components of a cross product of (a_t, a_y, a_x) and (b_t, b_y, b_x)."""
    return [f"({a}_{p} * {b}_{q} - {a}_{q} * {b}_{p})" for p, q in (("y", "x"), ("x", "t"), ("t", "y"))]


def _dot(a: str, b: str) -> str:
    return "(" + " + ".join(f"{a}_{c} * {b}_{c}" for c in "tyx") + ")"


def _vector(name: str, values: list[str]) -> str:
    return ", ".join(f"{v} AS {name}_{c}" for c, v in zip("tyx", values, strict=True))


_FRAMES = (
    _CENTERLINE
    + """, slope AS (SELECT *, coalesce(lead(t) OVER w, t) - coalesce(lag(t) OVER w, t) AS g_t, coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) AS g_y, coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x) AS g_x
  FROM samples WINDOW w AS (PARTITION BY branch ORDER BY s)),
ahead AS (SELECT branch, s, t, y, x, """
    + ", ".join(f"g_{c} / sqrt(g_t ** 2 + g_y ** 2 + g_x ** 2) AS c_{c}" for c in "tyx")
    + """ FROM slope),
chosen AS (SELECT *, CASE WHEN abs(c_t) <= abs(c_y) AND abs(c_t) <= abs(c_x) THEN 't' WHEN abs(c_y) <= abs(c_x) THEN 'y' ELSE 'x' END AS axis FROM ahead WHERE s = 0),
leant AS (SELECT *, """
    + _vector("r", [f"(CASE WHEN axis = '{c}' THEN 1.0::DOUBLE ELSE 0.0 END - CASE axis WHEN 't' THEN c_t WHEN 'y' THEN c_y ELSE c_x END * c_{c})" for c in "tyx"])
    + """ FROM chosen),
frames AS (
  SELECT branch, s, c_t, c_y, c_x, """
    + _vector("u", [f"r_{c} / sqrt({_dot('r', 'r')})" for c in "tyx"])
    + """ FROM leant
  UNION ALL
  SELECT branch, s, c_t, c_y, c_x, """
    + _vector("u", [f"w_{c} / sqrt({_dot('w', 'w')})" for c in "tyx"])
    + """ FROM (SELECT *, """
    + _vector("w", [f"m_{c} - c_{c} * {_dot('m', 'c')}" for c in "tyx"])
    + """ FROM (SELECT *, """
    + _vector("m", [f"(CASE WHEN sine > 1e-8 THEN u_{c} * cosine + {x} * sine + k_{c} * {_dot('k', 'u')} * (1 - cosine) ELSE u_{c} END)" for c, x in zip("tyx", _cross("k", "u"), strict=True)])
    + """ FROM (SELECT *, """
    + _vector("k", [f"(CASE WHEN sine > 1e-8 THEN a_{c} / sine ELSE 0 END)" for c in "tyx"])
    + """ FROM (SELECT *, sqrt("""
    + _dot("a", "a")
    + """) AS sine FROM (SELECT *, """
    + _vector("a", _cross("b", "c"))
    + f""", least(greatest({_dot("b", "c")}, -1), 1) AS cosine FROM (SELECT n.branch, n.s, n.c_t, n.c_y, n.c_x, f.c_t AS b_t, f.c_y AS b_y, f.c_x AS b_x, u_t, u_y, u_x FROM frames f JOIN ahead n ON n.branch = f.branch AND n.s = f.s + 1)))))) q)
"""
)


@query(sql("tracklets", _FRAMES + ", v AS (SELECT *, " + _vector("v", _cross("c", "u")) + " FROM frames)\nSELECT branch, s::INT AS s, " + ", ".join(f"round({n}_{c}, 6) + 0.0 AS {n}_{c}" for n in "uv" for c in "tyx") + " FROM v", recursive=True))
def centerline_frames(spark, sf_dir):
    frames = geometry.transport_frames(geometry.centerline_samples(_branches(spark, sf_dir)))
    return frames.select("branch", "s", *[(F.round(f"{n}_{c}", 6) + 0.0).alias(f"{n}_{c}") for n in "uv" for c in "tyx"])


def _intensities(spark, sf_dir) -> DataFrame:
    """A sparse volume around the centerlines."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 36).cast("int").alias("t"), (F.col("l_orderkey") % 16).cast("int").alias("y"), (F.col("l_suppkey") % 16).cast("int").alias("x"), "l_quantity")
    return rows.groupBy("t", "y", "x").agg((F.max("l_quantity") * 5).cast("int").alias("value"))


_SECTION = (
    _FRAMES
    + ", v AS (SELECT *, "
    + _vector("v", _cross("c", "u"))
    + """ FROM frames),
vol AS (SELECT (l_partkey % 36)::INT AS t, (l_orderkey % 16)::INT AS y, (l_suppkey % 16)::INT AS x, (max(l_quantity) * 5)::INT AS value FROM lineitem GROUP BY ALL),
place AS (SELECT v.branch, v.s, i AS col, j AS row, """
    + ", ".join(f"round(m.{c} + (i - 4) * u_{c} + (j - 4) * v_{c}, 9) AS p_{c}" for c in "tyx")
    + " FROM v JOIN samples m ON m.branch = v.branch AND m.s = v.s, (SELECT unnest(range(9)) AS i), (SELECT unnest(range(9)) AS j))"
)


@query(sql("tracklets", _SECTION + "\nSELECT branch, s::INT AS s, row::INT AS row, col::INT AS col, value FROM place JOIN vol ON vol.t = floor(p_t + 0.5) AND vol.y = floor(p_y + 0.5) AND vol.x = floor(p_x + 0.5)", recursive=True))
def centerline_sections_nearest(spark, sf_dir):
    frames = geometry.transport_frames(geometry.centerline_samples(_branches(spark, sf_dir)))
    return geometry.section_raster(frames, _intensities(spark, sf_dir), 9, categorical=True)


@query(
    sql(
        "tracklets",
        _SECTION
        + """, met AS (SELECT branch, s, row, col, value, (1 - abs(p_t - vol.t)) * (1 - abs(p_y - vol.y)) * (1 - abs(p_x - vol.x)) AS weight FROM place, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b), (SELECT unnest([0, 1]) AS d), vol
  WHERE vol.t = floor(p_t) + a AND vol.y = floor(p_y) + b AND vol.x = floor(p_x) + d)
SELECT * FROM (SELECT branch, s::INT AS s, row::INT AS row, col::INT AS col, least(greatest(round_even(round(sum(weight * value), 6), 0), 0), 255)::INT AS value FROM met GROUP BY branch, s, row, col) WHERE value <> 0""",
        recursive=True,
    )
)
def centerline_sections(spark, sf_dir):
    """Sections of a sparse volume perpendicular to each object's centerline, by trilinear lookup."""
    frames = geometry.transport_frames(geometry.centerline_samples(_branches(spark, sf_dir)))
    return geometry.section_raster(frames, _intensities(spark, sf_dir), 9)


def _tubes(spark, sf_dir) -> DataFrame:
    """A bent tube for each supplier, of radius 3; of every fifth one some planes are twice as wide."""
    # few suppliers make many voxels, so they are dealt by count, not by their own bytes
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "s_suppkey")
    rows = suppliers.select((F.col("s_suppkey") % 50).alias("col"), F.floor(F.col("s_suppkey") / 50).alias("row"), (F.col("s_suppkey") % 5 == 0).alias("odd"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("t"))
    wide = F.when(F.col("odd") & F.col("t").between(18, 22), 36).otherwise(9)
    spread = rows.withColumn("dy", F.explode(F.sequence(F.lit(-6), F.lit(6)))).withColumn("dx", F.explode(F.sequence(F.lit(-6), F.lit(6)))).where(F.col("dy") ** 2 + F.col("dx") ** 2 <= wide)
    shift = F.round(3 * F.sin(F.col("t") / 8)).cast("int")
    return spread.select(F.col("t").cast("int").alias("t"), (F.col("row") * 32 + 16 + F.col("dy") + shift).cast("int").alias("y"), (F.col("col") * 32 + 16 + F.col("dx")).cast("int").alias("x"))


@query()
def centerline_bulges(spark, sf_dir):
    """Runs of wide sections of the suppliers' tubes, with their guards."""
    rows = table(spark, sf_dir, "supplier").agg(F.max("s_suppkey")).first()[0] // 50 + 1
    found = centerline.tube_bulges(_tubes(spark, sf_dir), (rows * 32, 50 * 32), 10)
    return found.withColumn("peak", F.round("peak", 6))


def _parts(spark, sf_dir) -> DataFrame:
    return cut(topology.slice_components(adapters.mask(spark, sf_dir)))


_PARTS = ", " + _label_sql("mask", "lab", 6, key="t")


@query(
    sql(
        "mask",
        _PARTS
        + """, z AS (SELECT label, count(*) AS area, avg(y) AS cy, avg(x) AS cx FROM lab GROUP BY label),
o AS (SELECT p.label AS a, q.label AS b, count(*) AS overlap FROM lab p JOIN lab q ON q.t = p.t + 1 AND q.y = p.y AND q.x = p.x GROUP BY ALL),
r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY overlap DESC, round((za.cy - zb.cy) ** 2 + (za.cx - zb.cx) ** 2, 9), zb.area DESC, b) AS place FROM o JOIN z za ON za.label = a JOIN z zb ON zb.label = b)
SELECT a AS part, b AS next FROM r WHERE place = 1""",
        recursive=True,
    )
)
def branch_follow(spark, sf_dir):
    return geometry.follow_branches(_parts(spark, sf_dir))


@query(
    sql(
        "mask",
        _PARTS
        + """, boxes AS (SELECT label AS part, t, min(y) AS y0, max(y) + 1 AS y1, min(x) AS x0, max(x) + 1 AS x1 FROM lab GROUP BY ALL),
met AS (SELECT DISTINCT p.label AS part, side FROM lab p, (VALUES (-1), (1)) s(side), mask m WHERE m.t = p.t + side AND m.y = p.y AND m.x = p.x),
ends AS (SELECT * FROM boxes, (VALUES (-1), (1)) s(side) WHERE (part, side) NOT IN (SELECT (part, side) FROM met))
SELECT DISTINCT a.part AS a, b.part AS b, step FROM ends a, (SELECT unnest([1, 2, 3]) AS step), boxes b
WHERE b.t = a.t + side * step AND greatest(0, b.y0 - a.y1 + 1, a.y0 - b.y1 + 1) ** 2 + greatest(0, b.x0 - a.x1 + 1, a.x0 - b.x1 + 1) ** 2 <= step * step""",
        recursive=True,
    )
)
def bridge_plan(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    edges, _ = geometry.bridge_groups(topology.endpoints(parts), maskset.boxes(parts, "part", "t"), 3, 1)
    return edges


def _ends(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Plane components with the labels of their volume components, and those of them that nothing overlaps on a side."""
    parts = cut(_parts(spark, sf_dir).join(topology.label(adapters.mask(spark, sf_dir)), ["t", "y", "x"]))
    return parts, parts.join(topology.endpoints(parts).select("part", "side"), "part")


@query(
    sql(
        "mask",
        _PARTS
        + ", "
        + _label_sql("mask", "vol", 6)
        + """, met AS (SELECT DISTINCT p.label AS part, side FROM lab p, (VALUES (-1), (1)) s(side), mask m WHERE m.t = p.t + side AND m.y = p.y AND m.x = p.x),
ends AS (SELECT p.label AS part, side, v.label AS own, t, y, x FROM lab p JOIN vol v USING (t, y, x), (VALUES (-1), (1)) s(side) WHERE (p.label, side) NOT IN (SELECT (part, side) FROM met)),
mid AS (SELECT part, side, avg(y) AS my, avg(x) AS mx FROM ends GROUP BY ALL),
anchor AS (SELECT part, side, y AS ay, x AS ax FROM ends JOIN mid USING (part, side) QUALIFY row_number() OVER (PARTITION BY part, side ORDER BY round((y - my) ** 2 + (x - mx) ** 2, 9), y, x) = 1),
seen AS (SELECT DISTINCT e.part, e.side, v.label AS target, step, v.t, v.y, v.x, ((v.y - ay) ** 2 + (v.x - ax) ** 2)::BIGINT AS d2 FROM ends e JOIN anchor USING (part, side), (SELECT unnest([1, 2, 3]) AS step), vol v
  WHERE v.t = e.t + e.side * step AND v.label <> e.own AND (v.y - e.y) ** 2 + (v.x - e.x) ** 2 <= (1.3 * step) ** 2),
one AS (SELECT * FROM seen QUALIFY row_number() OVER (PARTITION BY part, side, target ORDER BY step, d2, y, x) = 1)
SELECT part, side, target, step, t, y, x, d2, row_number() OVER (PARTITION BY part, side ORDER BY step, d2, target) AS place FROM one QUALIFY place <= 4""",
        recursive=True,
    )
)
def endpoint_candidates(spark, sf_dir):
    parts, ends = _ends(spark, sf_dir)
    return geometry.endpoint_candidates(ends, parts, 3, 1.3, 4)


@query()
def bridge_interpolate(spark, sf_dir):
    k = adapters.mask_side(spark, sf_dir)
    return geometry.bridge_sections(*_ends(spark, sf_dir), (k, k), 3, 1.0)


@query()
def dynamic_crops(spark, sf_dir):
    objects = adapters.tracklets(spark, sf_dir).groupBy("frame", "obj").agg(
        F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"), F.min("x").alias("x0"), (F.max("x") + 1).alias("x1")
    )
    return geometry.dynamic_crops(objects, 12, 4)


@query(
    sql(
        "evidence mask",
        ", "
        + _label_sql("mask", "lab", 6)
        + """, m AS (SELECT l.*, EXISTS (SELECT 1 FROM evidence e WHERE layer_id = 'L1' AND e.t = l.t AND e.y = l.y AND e.x = l.x) AS k, EXISTS (SELECT 1 FROM evidence e WHERE layer_id = 'L2' AND e.t = l.t AND e.y = l.y AND e.x = l.x) AS r FROM lab l),
c AS (SELECT label, bool_or(k) AS any_kept, bool_or(r) AS any_removed FROM m GROUP BY label)
SELECT t, y, x FROM m JOIN c USING (label) WHERE CASE WHEN NOT any_removed THEN true WHEN NOT any_kept THEN false ELSE NOT r END""",
        recursive=True,
    )
)
def edit_resolution(spark, sf_dir):
    layer = lambda name: adapters.evidence(spark, sf_dir).where(F.col("layer_id") == name).select("t", "y", "x").distinct()
    return geometry.resolve_edits(cut(topology.label(adapters.mask(spark, sf_dir))), layer("L1"), layer("L2"))


@query(
    sql(
        "evidence",
        ", support AS (SELECT DISTINCT (substr(layer_id, 2)::INT * 8 + t % 8) AS edge, (t // 8)::INT AS t, y, x FROM evidence WHERE score >= 128), "
        + _label_sql("support", "lab", 26, key="edge")
        + "\nSELECT DISTINCT edge FROM (SELECT DISTINCT edge, label, x >= 10 AS far FROM lab WHERE x < 6 OR x >= 10) GROUP BY edge, label HAVING count(*) = 2",
        recursive=True,
    )
)
def branch_selection(spark, sf_dir):
    """Layers and every eighth plane of their strong scores are the support of an edge, whose ends are the first and the later columns."""
    strong = adapters.evidence(spark, sf_dir).where("score >= 128")
    support = strong.select((F.substring("layer_id", 2, 9).cast("int") * 8 + F.col("t") % 8).alias("edge"), F.expr("cast(t div 8 as int)").alias("t"), "y", "x")
    ends = support.where("x < 6 OR x >= 10").withColumn("end", (F.col("x") >= 10).cast("int"))
    return geometry.connected_edges(support, ends)


@query(
    sql(
        "active",
        """, m AS (SELECT lineage, frame, frame // 29 AS sweep FROM active JOIN customer ON lineage = c_custkey WHERE frame % 3 <> 0 AND c_acctbal > 0)
SELECT lineage, frame, sweep FROM m WHERE sweep = (SELECT min(sweep) FROM m) ORDER BY lineage, frame LIMIT 20""",
    )
)
def frontier_wave(spark, sf_dir):
    """The next mailboxes of known lineages: the first sweep that has dirty ones, least keys first."""
    known = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("lineage"))
    boxes = adapters.active_frames(spark, sf_dir).join(known, "lineage").withColumn("sweep", F.expr("frame div 29").cast("int")).withColumn("dirty", F.col("frame") % 3 != 0)
    return temporal.take_wave(boxes, ["sweep"], ["lineage", "frame"], 20).select("lineage", "frame", "sweep")


@query(
    sql(
        "frames",
        """, l AS (SELECT conv_id AS volume, turn AS frame, length(role) AS mark FROM conversations WHERE role = 'user')
SELECT f.volume, f.frame, mark FROM frames f LEFT JOIN l ON l.volume = f.volume AND l.frame = f.frame""",
    )
)
def label_alignment(spark, sf_dir):
    """Labels numbered from 1 on the media frames numbered from 0; frames whose role is not labelled have none."""
    labels = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("conv_id").alias("volume"), (F.col("turn") + 1).alias("index"), F.length("role").alias("mark"))
    aligned, _ = temporal.align_labels(adapters.frames(spark, sf_dir), labels, "volume", 1)
    return aligned.select("volume", "frame", "mark")


def _accepted(found: dict) -> dict:
    """Gates and their conjunction as SQL has them: unknown where a metric is, unless another gate fails."""
    known = lambda metric, fine: pa.array(fine, mask=np.isnan(found[metric]))
    recall, area = known("iou", found["iou"] >= 0.05), known("drift_median", found["drift_median"] <= 0.7)
    return {"recall_ok": recall, "area_ok": area, "accepted": pc.and_kleene(pc.and_kleene(recall, area), pa.array(found["frames"] >= 3))}


@query(
    sql(
        "tracklets",
        _OVERLAP + "SELECT a, b, iou >= 0.05 AS recall_ok, area_ok, iou >= 0.05 AND area_ok AND frames >= 3 AS accepted FROM (SELECT *, drift_median <= 0.7 AS area_ok FROM m)",
    )
)
def proposal_policy(spark, sf_dir):
    """Proposals as a metric table, gates as columns, acceptance as their conjunction."""
    return _metrics(spark, sf_dir, ("iou", "drift_median", "frames"), then=_accepted, columns="recall_ok boolean, area_ok boolean, accepted boolean")


# ---- text and JSON of configurations ----


@query("SELECT p_partkey, regexp_extract(token, '^([0-9]+):([0-9]+)$', 1)::INT AS size, regexp_extract(token, '^([0-9]+):([0-9]+)$', 2)::INT AS stride FROM (SELECT p_partkey, (p_partkey % 64 + 1) || ':' || (p_partkey % 32 + 1) AS token FROM part)")
def token_grammar(spark, sf_dir):
    token = F.concat_ws(":", (F.col("p_partkey") % 64 + 1).cast("string"), (F.col("p_partkey") % 32 + 1).cast("string"))
    pick = lambda k: F.regexp_extract("token", "^([0-9]+):([0-9]+)$", k).cast("int")
    return table(spark, sf_dir, "part").select("p_partkey", token.alias("token")).select("p_partkey", pick(1).alias("size"), pick(2).alias("stride"))


@query("""SELECT s_suppkey, '{"key":' || s_suppkey || ',"name":"' || s_name || '"}' AS canonical FROM supplier""")
def canonical_json(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.to_json(F.struct(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))).alias("canonical"))


# ---- general relational queries: not capabilities of the reference, they come free with the engine ----


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def star_pricing_summary(spark, sf_dir):
    return (
        table(spark, sf_dir, "lineitem")
        .where("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))
    )


@query("""SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = (SELECT min(r_name) FROM region) GROUP BY n_name""")
def star_orders_by_nation(spark, sf_dir):
    region = table(spark, sf_dir, "region")
    first = region.agg(F.min("r_name").alias("r_name"))
    nations = table(spark, sf_dir, "nation").join(region.join(first, "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = table(spark, sf_dir, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    joined = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
