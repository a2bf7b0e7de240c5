"""Registered queries: each applies an operator to a view of the tables; ``SQL`` has the DuckDB form where there is one."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators import maskset, resample, sections, topology, vote
from lamina.session import cut
from lamina.sources import adapters
from lamina.sources.adapters import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


# ---- votes ----

_WEIGHT = "CASE role WHEN 'prediction' THEN 100 WHEN 'mixed' THEN 50 ELSE 35 END"


def _vote_sql(group: str = "grp", value: str = "255", threshold: int = 150, sources: int = 2, direct: int = 1, bonus: int = 0) -> str:
    return f""", votes AS (
  SELECT t, y, x, {group} AS g, max({_WEIGHT} * {value}) AS vote, bool_or(role = 'prediction' AND {_WEIGHT} * {value} > 0) AS direct,
         bool_or(role = 'prediction' AND score >= 204) AS anchor FROM evidence GROUP BY ALL),
voxels AS (
  SELECT t, y, x, sum(vote) AS votes, count_if(vote > 0) AS sources, count_if(direct) AS direct, bool_or(anchor) AS any_anchor FROM votes GROUP BY ALL),
decided AS (
  SELECT t, y, x, (votes + CASE WHEN any_anchor AND direct >= 2 THEN {bonus * 255} ELSE 0 END)::BIGINT AS total, sources, direct, any_anchor AND direct >= 2 AS anchored FROM voxels),
final AS (SELECT *, total >= {threshold * 255} AND sources >= {sources} AND direct >= {direct} AS kept FROM decided)
"""


_BY_PLANE = "SELECT t, count(*) AS candidates, count_if(kept) AS retained FROM final GROUP BY t"


@query(sql("evidence", _vote_sql() + _BY_PLANE))
def vote_weighted(spark, sf_dir):
    return vote.by_plane(vote.weighted_vote(adapters.evidence(spark, sf_dir)))


@query(sql("evidence", _vote_sql() + "SELECT t, y, x, total, sources, direct, anchored, kept FROM final"))
def vote_weighted_voxels(spark, sf_dir):
    return vote.weighted_vote(adapters.evidence(spark, sf_dir))


@query(sql("evidence", "SELECT t, count(*) AS voxels FROM (SELECT DISTINCT t, y, x FROM evidence) GROUP BY t"))
def vote_union(spark, sf_dir):
    return maskset.union(adapters.evidence(spark, sf_dir)).groupBy("t").agg(F.count(F.lit(1)).alias("voxels"))


@query(sql("evidence", _vote_sql(threshold=0, sources=3, direct=0) + _BY_PLANE))
def vote_quorum3(spark, sf_dir):
    return vote.by_plane(vote.weighted_vote(adapters.evidence(spark, sf_dir), vote.VotePolicy(0, 3, 0)))


@query(sql("evidence", _vote_sql(value="(CASE WHEN role = 'prediction' THEN score ELSE 255 END)", threshold=100, bonus=50) + _BY_PLANE))
def vote_confidence_anchored(spark, sf_dir):
    policy = vote.VotePolicy(threshold=100, use_scores=True, anchor_bonus=50)
    return vote.by_plane(vote.weighted_vote(adapters.evidence(spark, sf_dir), policy))


# Codes of the families below, from the angles themselves: tilt 15 has elevation 75, and a section at azimuth a has its normal at a + 90.
_SECTION = f"""(CASE layer_id WHEN 'L2' THEN {sections.PLANE + 1 + 75 * 360 + 180} WHEN 'L3' THEN {sections.CYLINDER} WHEN 'L4' THEN {sections.SPHERE}
  WHEN 'L5' THEN {sections.PLANE + 1} + ((round(((degrees(atan2(y - side, x - side)) + 360) % 180) / 45) * 45)::BIGINT + 90) % 180
  WHEN 'L6' THEN {sections.UNKNOWN | zlib.crc32(b"unknown:l6") & 0x1FFFFFFF} ELSE {sections.PLANE + 1 + 90 * 360} END)::BIGINT"""


@query(
    sql("evidence", _vote_sql(group=_SECTION).replace("FROM evidence", "FROM evidence, (SELECT (CASE WHEN count(*) > 100000 THEN 64 ELSE 24 END - 1) / 2.0 AS side FROM lineitem) AS grid", 1) + _BY_PLANE)
)
def vote_section_dedupe(spark, sf_dir):
    """Groups of one section code are one source: planes of one orientation, shells of one axis, nearest azimuths, unknown views by name."""
    side = (adapters.grid_side(spark, sf_dir) - 1) / 2
    layer, plane = F.col("layer_id"), sections.plane_code(*sections.tilted_normal("transverse"))
    code = (
        F.when(layer == "L2", sections.plane_code(*sections.tilted_normal("transverse", 15)))
        .when(layer == "L3", sections.cylinder_code("transverse"))
        .when(layer == "L4", sections.sphere_code())
        .when(layer == "L5", sections.azimuthal_code("transverse", F.col("x") - side, F.col("y") - side, (0, 45, 90, 135)))
        .when(layer == "L6", sections.unknown_code(F.concat(F.lit("unknown:"), F.lower(layer))))
        .otherwise(plane)
    )
    return vote.by_plane(vote.weighted_vote(adapters.evidence(spark, sf_dir).withColumn("section", code), group="section"))


@query(
    sql(
        "evidence",
        _vote_sql()
        + "SELECT layer_id, role, count(*) AS foreground, count_if(kept) AS retained FROM evidence JOIN final USING (t, y, x) GROUP BY layer_id, role",
    )
)
def vote_role_counts(spark, sf_dir):
    evidence = adapters.evidence(spark, sf_dir)
    kept = vote.weighted_vote(evidence).select("t", "y", "x", "kept")
    return (
        evidence.join(kept, ["t", "y", "x"])
        .groupBy("layer_id", "role")
        .agg(F.count(F.lit(1)).alias("foreground"), F.count_if("kept").alias("retained"))
    )


_POLICIES = [("default", 150, 2, 1), ("quorum3", 0, 3, 0), ("strict", 200, 3, 2), ("union", 0, 1, 0)]


@query(
    sql(
        "evidence",
        _vote_sql()
        + f"""SELECT name, count(*)::BIGINT AS candidates, count_if(total >= threshold * 255 AND sources >= min_sources AND direct >= min_direct)::BIGINT AS retained
FROM final, (VALUES {", ".join(map(str, _POLICIES))}) p(name, threshold, min_sources, min_direct) GROUP BY name""",
    )
)
def apply_policy_table(spark, sf_dir):
    policies = spark.createDataFrame(_POLICIES, "name string, threshold int, min_sources int, min_direct int")
    return vote.apply_policies(adapters.evidence(spark, sf_dir), policies)


def _largest_by_layer(spark, sf_dir) -> DataFrame:
    """(grp, role, largest) of the sparse mask dealt to layers by x: largest component of each."""
    layered = adapters.mask(spark, sf_dir).withColumn("layer", F.col("x") % 4)
    found = []
    for k in range(4):
        own = topology.component_sizes(topology.label(layered.where(F.col("layer") == k)))
        found.append(own.agg(F.max("size").alias("largest")).select(F.lit(f"G{k}").alias("grp"), F.lit("prediction").alias("role"), "largest"))
    both = found[0]
    for other in found[1:]:
        both = both.unionByName(other)
    return both.where("largest is not null")


_STEPS = {6: 1, 18: 2, 26: 3}


def _label_sql(source: str, name: str, connectivity: int, key: str = "") -> str:
    """CTEs that label voxels of ``source``: reachability by recursion, the least voxel number being the label."""
    near = f"abs(a.t - b.t) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND abs(a.t - b.t) + abs(a.y - b.y) + abs(a.x - b.x) <= {_STEPS[connectivity]}"
    keyed = f"{key}, " if key else ""
    of = lambda alias: f"{alias}.{key}, " if key else ""
    same = lambda a, b: f" AND {a}.{key} = {b}.{key}" if key else ""
    columns = ("" if key in ("t", "y", "x") else keyed) + "t, y, x"
    return f"""{name}_n AS (SELECT {columns}, (t::BIGINT << 42) + (y::BIGINT << 21) + x AS id FROM {source}),
{name}_e AS (SELECT {of("a")}a.id AS a, b.id AS b FROM {name}_n a JOIN {name}_n b ON {near}{same("a", "b")} WHERE a.id <> b.id),
{name}_r AS (SELECT {keyed}id AS a, id AS b FROM {name}_n UNION SELECT {of("r")}r.a, e.b FROM {name}_r r JOIN {name}_e e ON r.b = e.a{same("r", "e")}),
{name}_l AS (SELECT {keyed}a AS id, min(b) AS label FROM {name}_r GROUP BY ALL),
{name} AS (SELECT {columns}, label FROM {name}_n JOIN {name}_l USING ({keyed}id))"""


_ISLAND_SQL = (
    ", layered AS (SELECT *, x % 4 AS layer FROM mask), "
    + _label_sql("layered", "lab", 6, key="layer")
    + """, largest AS (SELECT 'G' || layer AS grp, 'prediction' AS role, max(n) AS largest FROM (SELECT layer, label, count(*) AS n FROM lab GROUP BY ALL) GROUP BY layer),
logs AS (SELECT *, ln(1 + largest) AS v FROM largest),
q AS (SELECT role, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3 FROM logs GROUP BY role),
weights AS (SELECT grp, role, CASE WHEN q3 - q1 <= 1e-12 THEN 1.0::DOUBLE ELSE least(greatest(1 + 0.25 * (v - q2) / (q3 - q1), 0.75), 1.25) END AS weight FROM logs JOIN q USING (role))
"""
)


@query(sql("mask", _ISLAND_SQL + "SELECT grp, role, round(weight, 9) AS weight FROM weights", recursive=True))
def island_weight_table(spark, sf_dir):
    return vote.island_weights(_largest_by_layer(spark, sf_dir)).withColumn("weight", F.round("weight", 9))


@query(
    sql(
        "evidence mask",
        _ISLAND_SQL
        + """, votes AS (SELECT t, y, x, grp, max(CASE e.role WHEN 'prediction' THEN 100 WHEN 'mixed' THEN 50 ELSE 35 END * round(coalesce(w.weight, 1) * 100)::BIGINT) AS vote
  FROM evidence e LEFT JOIN weights w USING (grp) GROUP BY ALL)
SELECT t, count(*) AS voxels, sum(total)::BIGINT AS total FROM (SELECT t, y, x, sum(vote) AS total FROM votes GROUP BY ALL) GROUP BY t""",
        recursive=True,
    )
)
def vote_island_weighted(spark, sf_dir):
    weights = vote.island_weights(_largest_by_layer(spark, sf_dir)).select("grp", F.round(F.col("weight") * 100).cast("long").alias("w"))
    scaled = adapters.evidence(spark, sf_dir).join(F.broadcast(weights), "grp", "left")
    votes = vote.role_weight(F.col("role"), vote.ROLE_WEIGHTS) * F.coalesce("w", F.lit(100))
    per_group = scaled.groupBy("t", "y", "x", "grp").agg(F.max(votes).alias("vote"))
    return (
        per_group.groupBy("t", "y", "x").agg(F.sum("vote").alias("total")).groupBy("t").agg(F.count(F.lit(1)).alias("voxels"), F.sum("total").alias("total"))
    )


# ---- layer algebra ----


def _layer(spark, sf_dir, *names: str) -> DataFrame:
    return adapters.evidence(spark, sf_dir).where(F.col("layer_id").isin(*names)).select("t", "y", "x")


@query(sql("evidence", "SELECT DISTINCT t, y, x FROM evidence WHERE layer_id IN ('L1', 'L4')"))
def layer_union(spark, sf_dir):
    return maskset.union(_layer(spark, sf_dir, "L1"), _layer(spark, sf_dir, "L4"))


@query(sql("evidence", "SELECT t, y, x FROM evidence WHERE layer_id = 'L1' INTERSECT SELECT t, y, x FROM evidence WHERE layer_id IN ('L2', 'L4')"))
def layer_intersect(spark, sf_dir):
    return maskset.intersect(_layer(spark, sf_dir, "L1"), _layer(spark, sf_dir, "L2", "L4"))


@query(sql("evidence", "SELECT t, y, x FROM evidence WHERE layer_id IN ('L1', 'L2') EXCEPT SELECT t, y, x FROM evidence WHERE layer_id IN ('L4', 'L5')"))
def layer_except(spark, sf_dir):
    """What a bridge pass adds: new and not old."""
    return maskset.subtract(_layer(spark, sf_dir, "L1", "L2"), _layer(spark, sf_dir, "L4", "L5"))


_OPERATIONS = [("L1", 1, "union"), ("L2", 2, "union"), ("L3", 3, "none"), ("L4", 4, "select"), ("L5", 5, "union"), ("L6", 6, "subtract"), ("L7", 7, "union")]


@query(
    sql(
        "evidence",
        f""", ops AS (SELECT * FROM (VALUES {", ".join(map(str, _OPERATIONS))}) o(layer_id, ord, op) WHERE op <> 'none'),
live AS (SELECT layer_id, ord, op <> 'subtract' AS sets FROM ops WHERE ord >= coalesce((SELECT max(ord) FROM ops WHERE op = 'select'), 0))
SELECT t, y, x FROM evidence JOIN live USING (layer_id) GROUP BY t, y, x HAVING max_by(sets, ord)""",
    )
)
def layer_recompose_ordered(spark, sf_dir):
    return maskset.recompose(adapters.evidence(spark, sf_dir), spark.createDataFrame(_OPERATIONS, "layer_id string, ord int, op string"))


@query(
    sql(
        "evidence",
        """SELECT DISTINCT t, y, x FROM (
  SELECT t, y, x FROM evidence WHERE layer_id = 'L1' AND score >= 100 UNION ALL SELECT t, y, x FROM evidence WHERE layer_id = 'L7')""",
    )
)
def protected_restore(spark, sf_dir):
    """Foreground that annotators set comes back after a destructive filter."""
    filtered = adapters.evidence(spark, sf_dir).where("layer_id = 'L1' AND score >= 100")
    return maskset.union(filtered, _layer(spark, sf_dir, "L7"))


@query(sql("evidence", "SELECT t, y, x, count(DISTINCT layer_id) AS owners FROM evidence WHERE layer_id IN ('L1', 'L2', 'L3') GROUP BY t, y, x HAVING owners > 1"))
def disjoint_overlap_check(spark, sf_dir):
    return maskset.overlaps(adapters.evidence(spark, sf_dir).where("layer_id IN ('L1', 'L2', 'L3')"))


@query(sql("evidence", "SELECT grp, t, count(*) AS voxels FROM (SELECT DISTINCT grp, t, y, x FROM evidence) GROUP BY grp, t"))
def variant_collapse(spark, sf_dir):
    """Variants of one physical view are OR-ed."""
    distinct = adapters.evidence(spark, sf_dir).select("grp", "t", "y", "x").distinct()
    return distinct.groupBy("grp", "t").agg(F.count(F.lit(1)).alias("voxels"))


@query(
    sql(
        "evidence",
        """, layers AS (SELECT layer_id, role, count(*) AS foreground FROM evidence GROUP BY ALL)
SELECT layer_id, foreground FROM layers WHERE role IN ('prediction', 'bridge')""",
    )
)
def additive_layers(spark, sf_dir):
    layers = adapters.evidence(spark, sf_dir).groupBy("layer_id", "role").agg(F.count(F.lit(1)).alias("foreground"))
    return layers.where("role IN ('prediction', 'bridge')").select("layer_id", "foreground")


@query(
    sql(
        "evidence",
        """, pred AS (SELECT t, y, x, bool_or(role = 'prediction') AS fg, bool_or(score > 0) AS known FROM evidence GROUP BY ALL)
SELECT t, CASE WHEN NOT known THEN 255 WHEN fg THEN 1 ELSE 0 END AS class, count(*) AS voxels FROM pred GROUP BY ALL""",
    )
)
def semantic_index(spark, sf_dir):
    voxels = adapters.evidence(spark, sf_dir).groupBy("t", "y", "x").agg(F.bool_or(F.col("role") == "prediction").alias("fg"), F.bool_or(F.col("score") > 0).alias("known"))
    return voxels.groupBy("t", maskset.semantic_index(F.col("known"), F.col("fg")).alias("class")).agg(F.count(F.lit(1)).alias("voxels"))


# ---- boxes, runs, packing ----


@query(sql("evidence", "SELECT layer_id, t, min(y) AS y0, max(y) + 1 AS y1, min(x) AS x0, max(x) + 1 AS x1, count(*) AS foreground FROM evidence GROUP BY layer_id, t"))
def mask_bbox_per_plane(spark, sf_dir):
    return maskset.boxes(adapters.evidence(spark, sf_dir), "layer_id", "t")


@query(sql("evidence", "SELECT layer_id, min(t) AS t0, max(t) + 1 AS t1, min(y) AS y0, max(y) + 1 AS y1, min(x) AS x0, max(x) + 1 AS x1 FROM evidence GROUP BY layer_id"))
def mask_extent(spark, sf_dir):
    ends = [e for c in "tyx" for e in (F.min(c).alias(f"{c}0"), (F.max(c) + 1).alias(f"{c}1"))]
    return adapters.evidence(spark, sf_dir).groupBy("layer_id").agg(*ends)


@query(
    sql(
        "evidence kk",
        ", b AS (SELECT layer_id, t, (max(y) + 1 - min(y)) * (max(x) + 1 - min(x)) AS area FROM evidence GROUP BY layer_id, t)\nSELECT layer_id, t, area::BIGINT AS area, round(area::DOUBLE / (k * k), 9) AS coverage FROM b, kk",
    )
)
def bbox_coverage_ratio(spark, sf_dir):
    k = adapters.grid_side(spark, sf_dir)
    box = maskset.boxes(adapters.evidence(spark, sf_dir), "layer_id", "t").withColumn("area", ((F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))).cast("long"))
    return box.select("layer_id", "t", "area", F.round(F.col("area") / (k * k), 9).alias("coverage"))


_RUNS = """, u AS (SELECT DISTINCT t, y, x FROM evidence),
i AS (SELECT t, y, x, x - row_number() OVER (PARTITION BY t, y ORDER BY x) AS island FROM u),
r AS (SELECT t, y, min(x) AS x0, max(x) + 1 AS x1 FROM i GROUP BY t, y, island)
"""


@query(sql("evidence", _RUNS + "SELECT * FROM r"))
def mask_runs_from_voxels(spark, sf_dir):
    return maskset.runs(maskset.union(adapters.evidence(spark, sf_dir)))


@query(sql("evidence", "SELECT DISTINCT t, y, x FROM evidence"))
def mask_voxels_from_runs(spark, sf_dir):
    return maskset.voxels(maskset.runs(maskset.union(adapters.evidence(spark, sf_dir))))


@query(sql("evidence", "SELECT layer_id, t, y, x // 64 AS word, bit_or(1::BIGINT << (x % 64)) AS bits, count(*) AS foreground FROM evidence GROUP BY layer_id, t, y, word"))
def crop_store_rows(spark, sf_dir):
    packed = maskset.pack_rows(adapters.evidence(spark, sf_dir), "layer_id")
    return packed.select("layer_id", "t", "y", F.col("word").cast("int").alias("word"), "bits", F.col("foreground").cast("long").alias("foreground"))


@query(sql("evidence", "SELECT layer_id, t, y, x FROM evidence"))
def crop_store_voxels(spark, sf_dir):
    return maskset.unpack_rows(maskset.pack_rows(adapters.evidence(spark, sf_dir), "layer_id"))


@query(sql("evidence", "SELECT layer_id, t, y, x FROM evidence WHERE t >= 4 AND t < 8"))
def slab_read(spark, sf_dir):
    return adapters.evidence(spark, sf_dir).where("t >= 4 AND t < 8").select("layer_id", "t", "y", "x")


# ---- scores ----


@query(sql("evidence", "SELECT layer_id, count_if(score > 0) AS known, count_if(score = 0) AS unknown, round(avg(nullif(score, 0) / 255.0::DOUBLE), 9) AS mean_known FROM evidence GROUP BY layer_id"))
def score_known(spark, sf_dir):
    known = F.nullif("score", F.lit(0))
    return adapters.evidence(spark, sf_dir).groupBy("layer_id").agg(
        F.count_if(F.col("score") > 0).alias("known"), F.count_if(F.col("score") == 0).alias("unknown"), F.round(F.avg(known / 255.0), 9).alias("mean_known")
    )


@query(sql("evidence", ", c AS (SELECT unnest([0.0, 0.1, 0.25, 0.5, 0.9, 1.0])::DOUBLE AS confidence)\nSELECT confidence, ceil(confidence * 255 - 1e-9)::INT AS threshold, (SELECT count(*) FROM evidence WHERE score >= ceil(confidence * 255 - 1e-9)) AS kept FROM c"))
def score_threshold_u8(spark, sf_dir):
    levels = spark.createDataFrame([(c,) for c in (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)], "confidence double").withColumn("threshold", maskset.score_threshold(F.col("confidence")))
    histogram = adapters.evidence(spark, sf_dir).groupBy("score").agg(F.count(F.lit(1)).alias("n"))  # 256 rows at most
    joined = levels.join(F.broadcast(histogram), F.col("score") >= F.col("threshold"), "left")
    return joined.groupBy("confidence", "threshold").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("kept"))


@query(sql("evidence kk", "SELECT t // 2 AS t, y * 8 // k AS y, x * 8 // k AS x, max(score) AS score FROM evidence, kk GROUP BY ALL"))
def score_maxpool(spark, sf_dir):
    k = adapters.grid_side(spark, sf_dir)
    return resample.max_pool(adapters.evidence(spark, sf_dir).select("t", "y", "x", "score"), (16, k, k), (8, 8, 8))


@query(
    sql(
        "evidence",
        """, refs AS (SELECT DISTINCT layer_id, 'M' || (layer_id[2:]::INT % 2) AS model FROM evidence),
readers AS (SELECT * FROM (VALUES ('L1', 'M1', 'r1'), ('L2', 'M0', 'r2'), ('L3', 'M0', 'r3'), ('L5', 'M1', 'r5')) v(layer_id, model, reader))
SELECT refs.layer_id, refs.model, reader FROM refs LEFT JOIN readers USING (layer_id, model)""",
    )
)
def score_layer_match(spark, sf_dir):
    refs = adapters.evidence(spark, sf_dir).select("layer_id").distinct().withColumn("model", F.concat(F.lit("M"), F.substring("layer_id", 2, 9).cast("int") % 2))
    readers = spark.createDataFrame([("L1", "M1", "r1"), ("L2", "M0", "r2"), ("L3", "M0", "r3"), ("L5", "M1", "r5")], "layer_id string, model string, reader string")
    one = readers.groupBy("layer_id", "model").agg(
        F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("more than one reader for a layer and model"))).otherwise(F.min("reader")).alias("reader")
    )
    return refs.join(one, ["layer_id", "model"], "left")


# ---- topology ----


def _stats_sql(connectivity: int) -> str:
    return sql(
        "mask",
        ", "
        + _label_sql("mask", "lab", connectivity)
        + """, sizes AS (SELECT label, count(*) AS size FROM lab GROUP BY label)
SELECT count(*) AS components, coalesce(max(size), 0) AS largest, coalesce(sum(size), 0)::BIGINT AS foreground,
       round(coalesce(max(size)::DOUBLE / sum(size), 0), 9) AS largest_fraction FROM sizes""",
        recursive=True,
    )


def _stats(spark, sf_dir, connectivity: int) -> DataFrame:
    runs = topology.label_runs(maskset.runs(adapters.mask(spark, sf_dir)), connectivity)
    return topology.statistics(runs.withColumn("voxels", F.col("x1") - F.col("x0"))).withColumn("largest_fraction", F.round("largest_fraction", 9))


@query(_stats_sql(6))
def comp6_stats(spark, sf_dir):
    return _stats(spark, sf_dir, 6)


@query(_stats_sql(18))
def comp18_stats(spark, sf_dir):
    return _stats(spark, sf_dir, 18)


@query(_stats_sql(26))
def comp26_stats(spark, sf_dir):
    return _stats(spark, sf_dir, 26)


@query(sql("mask", ", " + _label_sql("mask", "lab", 6) + "\nSELECT t, y, x, label FROM lab", recursive=True))
def comp6_run_labels(spark, sf_dir):
    """Labels found on runs of voxels, then spread to the voxels; a run's number is that of its first voxel."""
    return maskset.voxels(topology.label_runs(maskset.runs(adapters.mask(spark, sf_dir))).select("t", "y", "x0", "x1", "label"))


@query(sql("mask", ", " + _label_sql("mask", "lab", 6) + ", s AS (SELECT label FROM lab GROUP BY label ORDER BY count(*) DESC, label DESC LIMIT 5)\nSELECT t, y, x FROM lab JOIN s USING (label)", recursive=True))
def keep_largest_n(spark, sf_dir):
    return topology.keep_largest(topology.label(adapters.mask(spark, sf_dir)), 5)


@query(
    sql(
        "evidence mask",
        ", " + _label_sql("mask", "lab", 6) + ", hit AS (SELECT DISTINCT label FROM lab JOIN evidence USING (t, y, x) WHERE layer_id = 'L1')\nSELECT t, y, x FROM lab WHERE label IN (SELECT label FROM hit)",
        recursive=True,
    )
)
def support_gate(spark, sf_dir):
    return topology.gate_by_support(cut(topology.label(adapters.mask(spark, sf_dir))), _layer(spark, sf_dir, "L1"))


# the whole box less the sparse mask, so that there is something to fill
_SOLID_SQL = ", solid AS (SELECT t, y, x FROM (SELECT unnest(range(8))::INT AS t) CROSS JOIN (SELECT unnest(range(k))::INT AS y FROM km) CROSS JOIN (SELECT unnest(range(k))::INT AS x FROM km) WHERE (t, y, x) NOT IN (SELECT (t, y, x) FROM mask))"


@query(
    sql(
        "mask km",
        _SOLID_SQL
        + ", "
        + _label_sql("mask", "lab", 6)
        + """, open AS (SELECT DISTINCT label FROM lab, km WHERE t IN (0, 7) OR y IN (0, k - 1) OR x IN (0, k - 1))
SELECT t, y, x FROM solid UNION SELECT t, y, x FROM lab WHERE label NOT IN (SELECT label FROM open)""",
        recursive=True,
    )
)
def void_fill_3d(spark, sf_dir):
    k = adapters.mask_side(spark, sf_dir)
    solid = resample.grid(spark, (8, k, k)).join(adapters.mask(spark, sf_dir), ["t", "y", "x"], "left_anti")
    return topology.fill_voids(solid)


@query(
    sql(
        "mask",
        ", "
        + _label_sql("mask", "lab", 6, key="t")
        + """, sides AS (SELECT label, t, y, x, side FROM lab, (VALUES (-1), (1)) s(side)),
met AS (SELECT DISTINCT s.label, s.side FROM sides s JOIN mask m ON m.t = s.t + s.side AND m.y = s.y AND m.x = s.x)
SELECT DISTINCT label AS part, side, t FROM sides WHERE (label, side) NOT IN (SELECT (label, side) FROM met)""",
        recursive=True,
    )
)
def endpoint_detect(spark, sf_dir):
    return topology.endpoints(cut(topology.slice_components(adapters.mask(spark, sf_dir))))


@query(
    sql(
        "evidence mask",
        ", " + _label_sql("mask", "lab", 6) + ", s AS (SELECT t, y, x, max(nullif(score, 0)) AS score FROM evidence GROUP BY ALL)\nSELECT label, count(*) AS size, max(score) AS best FROM lab LEFT JOIN s USING (t, y, x) GROUP BY label",
        recursive=True,
    )
)
def component_max_score(spark, sf_dir):
    scores = adapters.evidence(spark, sf_dir).groupBy("t", "y", "x").agg(F.max("score").alias("score"))
    return topology.component_score(topology.label(adapters.mask(spark, sf_dir)), scores)


@query(sql("mask", "SELECT a.t, count(*) AS pairs FROM mask a JOIN mask b ON b.t = a.t + 1 AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY a.t"))
def plane_adjacency_pairs(spark, sf_dir):
    pairs = topology.adjacent_pairs(adapters.mask(spark, sf_dir), 26)
    plane = F.shiftright("a", 42).cast("int")
    return pairs.where(F.shiftright("b", 42) == plane + 1).groupBy(plane.alias("t")).agg(F.count(F.lit(1)).alias("pairs"))


@query(
    sql(
        "evidence",
        _RUNS
        + """, n AS (SELECT *, (t::BIGINT << 42) + (y::BIGINT << 21) + x0 AS run FROM r)
SELECT p.run AS a, q.run AS b FROM n p JOIN n q ON ((q.t = p.t AND q.y = p.y + 1) OR (q.t = p.t + 1 AND q.y = p.y)) AND p.x0 < q.x1 AND q.x0 < p.x1""",
    )
)
def run_adjacency_pairs(spark, sf_dir):
    runs = maskset.runs(maskset.union(adapters.evidence(spark, sf_dir)))
    return topology.adjacent_runs(runs.withColumn("run", F.shiftleft(F.col("t").cast("long"), 42) + F.shiftleft(F.col("y").cast("long"), 21) + F.col("x0")))


@query(sql("mask", ", " + _label_sql("mask", "lab", 26) + ", s AS (SELECT label, count(*) AS size FROM lab GROUP BY label)\nSELECT count(*) AS components, count_if(size = 1) AS single, round(quantile_cont(size, 0.5), 6) AS median, round(quantile_cont(size, 0.95), 6) AS p95, max(size) AS greatest FROM s", recursive=True))
def fragment_audit(spark, sf_dir):
    sizes = topology.component_sizes(topology.label(adapters.mask(spark, sf_dir), 26))
    return sizes.agg(
        F.count(F.lit(1)).alias("components"), F.count_if(F.col("size") == 1).alias("single"), F.round(F.percentile("size", F.lit(0.5)), 6).alias("median"), F.round(F.percentile("size", F.lit(0.95)), 6).alias("p95"), F.max("size").alias("greatest")
    )


@query(
    sql(
        "evidence mask",
        """, seed AS (SELECT t, y, x FROM mask), dom AS (SELECT DISTINCT t, y, x FROM evidence),
g0 AS (SELECT t, y, x FROM seed INTERSECT SELECT t, y, x FROM dom),
d AS (SELECT * FROM (VALUES (0,0,0),(1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) s(dt, dy, dx)),
g1 AS (SELECT DISTINCT t + dt AS t, y + dy AS y, x + dx AS x FROM g0, d), k1 AS (SELECT g1.* FROM g1 JOIN dom USING (t, y, x)),
g2 AS (SELECT DISTINCT t + dt AS t, y + dy AS y, x + dx AS x FROM k1, d)
SELECT g2.t, g2.y, g2.x FROM g2 JOIN dom USING (t, y, x)""",
    )
)
def geodesic_rescue(spark, sf_dir):
    return topology.dilate_within(adapters.mask(spark, sf_dir), maskset.union(adapters.evidence(spark, sf_dir)), 2)


@query(
    sql(
        "evidence mask",
        """, e AS (SELECT DISTINCT t, y, x FROM evidence)
SELECT count_if(e.t IS NOT NULL AND m.t IS NOT NULL) AS tp, count_if(m.t IS NULL) AS fp, count_if(e.t IS NULL) AS fn,
       round(count_if(e.t IS NOT NULL AND m.t IS NOT NULL)::DOUBLE / count(*), 9) AS iou
FROM e FULL JOIN mask m ON e.t = m.t AND e.y = m.y AND e.x = m.x""",
    )
)
def mask_quality(spark, sf_dir):
    found = maskset.union(adapters.evidence(spark, sf_dir)).withColumn("e", F.lit(True))
    both = found.join(adapters.mask(spark, sf_dir).withColumn("m", F.lit(True)), ["t", "y", "x"], "full_outer")
    hit = F.col("e").isNotNull() & F.col("m").isNotNull()
    return both.agg(
        F.count_if(hit).alias("tp"), F.count_if(F.col("m").isNull()).alias("fp"), F.count_if(F.col("e").isNull()).alias("fn"), F.round(F.count_if(hit) / F.count(F.lit(1)), 9).alias("iou")
    )


@query(
    sql(
        "evidence",
        _vote_sql() + "SELECT layer_id, count(*) AS voxels, count_if(kept) AS survived FROM evidence LEFT JOIN (SELECT * FROM final WHERE kept) USING (t, y, x) WHERE role = 'bridge' GROUP BY layer_id",
    )
)
def bridge_survival(spark, sf_dir):
    evidence = adapters.evidence(spark, sf_dir)
    final = vote.weighted_vote(evidence).where("kept").select("t", "y", "x", F.lit(True).alias("hit"))
    bridges = evidence.where("role = 'bridge'").join(final, ["t", "y", "x"], "left")
    return bridges.groupBy("layer_id").agg(F.count(F.lit(1)).alias("voxels"), F.count_if("hit").alias("survived"))


@query(sql("evidence", "SELECT t, count(*) AS predicted FROM evidence WHERE role = 'prediction' AND t IN (1, 5, 9) GROUP BY t"))
def known_background_audit(spark, sf_dir):
    background = spark.createDataFrame([(1,), (5,), (9,), (77,)], "t int")
    predicted = adapters.evidence(spark, sf_dir).where("role = 'prediction'").join(F.broadcast(background), "t", "left_semi")
    return predicted.groupBy("t").agg(F.count(F.lit(1)).alias("predicted"))
