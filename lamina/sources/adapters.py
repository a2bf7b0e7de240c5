"""Views of the star-schema tables in the shape of volume evidence, in Spark and as DuckDB CTEs.

Masks are sets of (t, y, x) keys; scores are sparse, 0 meaning unknown. Grid sizes follow the
rows of lineitem, so that grids stay sparse at each scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.session import table

EPOCH = "2024-01-01"
HOURS = 720


def grid_side(spark: SparkSession, sf_dir: str) -> int:
    return 64 if table(spark, sf_dir, "lineitem").count() > 100_000 else 24


def mask_side(spark: SparkSession, sf_dir: str) -> int:
    rows = table(spark, sf_dir, "lineitem").count()
    return 56 if rows > 100_000 else 20 if rows > 10_000 else 10


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """layer_id, role, grp, t, y, x, score: one row for each layer and voxel."""
    k = grid_side(spark, sf_dir)
    line = F.col("l_linenumber")
    role = F.when(line <= 3, "prediction").when(line <= 5, "bridge").when(line == 6, "mixed").otherwise("extrapolation")
    return (
        table(spark, sf_dir, "lineitem")
        .where("l_quantity <= 25")
        .select(
            F.concat(F.lit("L"), line).alias("layer_id"),
            role.alias("role"),
            F.concat(F.lit("G"), line % 4).alias("grp"),
            (F.col("l_suppkey") % 16).cast("int").alias("t"),
            (F.col("l_partkey") % k).cast("int").alias("y"),
            (F.col("l_orderkey") % k).cast("int").alias("x"),
            F.round(F.col("l_discount") * 2550).cast("int").alias("score"),
        )
        .groupBy("layer_id", "role", "grp", "t", "y", "x")
        .agg(F.max("score").alias("score"))
    )


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse binary volume of 8 planes."""
    k = mask_side(spark, sf_dir)
    return (
        table(spark, sf_dir, "lineitem")
        .where("l_quantity = 7 AND l_discount <= 0.02")
        .select(
            (F.col("l_suppkey") % 8).cast("int").alias("t"),
            (F.col("l_partkey") % k).cast("int").alias("y"),
            (F.col("l_orderkey") % k).cast("int").alias("x"),
        )
        .distinct()
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """volume, view, frame, fg, labelled, identity, ord."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id", "left").select(
        F.col("source").alias("volume"),
        F.col("lang").alias("view"),
        F.col("doc_id").alias("frame"),
        (F.coalesce("quality", F.lit(0)) == 1).alias("fg"),
        F.col("quality").isNotNull().alias("labelled"),
        F.concat_ws("|", "source", "lang", F.col("doc_id").cast("string")).alias("identity"),
        F.col("doc_id").alias("ord"),
    )


def _hour(ts: str = "ts"):
    return F.expr(f"cast((unix_micros(cast({ts} as timestamp)) - unix_micros(timestamp'{EPOCH} 00:00:00')) div 3600000000 as int)")


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineage, frame: hours in which a user signed up."""
    return (
        table(spark, sf_dir, "events")
        .where("event_type = 'signup'")
        .select(F.col("user_id").alias("lineage"), _hour().alias("frame"))
        .distinct()
    )


def active_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineage, frame: hours in which a user did anything."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("lineage"), _hour().alias("frame")).distinct()


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, event_id, event, ts_us, value."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), "event_id", F.col("event_type").alias("event"), F.expr("unix_micros(cast(ts as timestamp))").alias("ts_us"), "value"
    )


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obj, anchor, frame, y, x, pct: a voxel may have several rows."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("obj"),
        (F.col("l_linenumber") % 2).alias("anchor"),
        (F.col("l_partkey") % 12).cast("int").alias("frame"),
        (F.col("l_orderkey") % 16).cast("int").alias("y"),
        (F.col("l_partkey") % 16).cast("int").alias("x"),
        (100 - F.round(F.col("l_discount") * 100)).cast("int").alias("pct"),
    )


def tracklets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obj, anchor, frame, y, x, pct: the greatest of each voxel."""
    return sightings(spark, sf_dir).groupBy("obj", "anchor", "frame", "y", "x").agg(F.max("pct").alias("pct"))


def band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier, side, obj, frame, y, x, pct: tracklets of two neighbouring anchors that see the same suppliers; of some either side sees two parts, of some the right side sees two copies.

    A voxel has a row for each sighting; its pct is the greatest of them. Rows are dealt by supplier and frame before a row becomes those of each side, and stay so:
    a grouping by these and more needs no other shuffle.
    """
    supplier = F.col("l_suppkey")
    rows = table(spark, sf_dir, "lineitem").select(
        supplier.alias("supplier"),
        (F.col("l_orderkey") % 2).cast("byte").alias("half"),
        ((F.col("l_orderkey") + F.col("l_linenumber")) % 10).cast("byte").alias("seen"),
        (F.floor(supplier / 16) * 100 + F.col("l_partkey") % 8).alias("frame"),
        (F.col("l_orderkey") % 32).cast("int").alias("y"),
        (F.floor(F.col("l_partkey") / 8) % 32).cast("int").alias("x"),
        (100 - F.round(F.col("l_discount") * 100)).cast("int").alias("pct"),
    )
    sides = (
        ("seen <= 7", "if(supplier % 7 = 0, half, 0)"),
        ("seen >= 2", "if(supplier % 5 = 0, half, 0)"),
        ("seen >= 3 AND supplier % 11 = 3", "5"),
    )
    seen = ", ".join(f"{min(k, 1)}, if({which}, supplier * 10 + {obj}, null)" for k, (which, obj) in enumerate(sides))
    dealt = rows.repartition("supplier", "frame").select("supplier", "frame", "y", "x", "pct", F.expr(f"stack({len(sides)}, {seen}) AS (side, obj)"))
    return dealt.where("obj IS NOT NULL").select("supplier", "side", "obj", "frame", "y", "x", "pct")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """volume, frame, n: conversations as short volumes."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("volume"), F.col("turn").alias("frame"), F.length("text").alias("n")
    )


_K = "(SELECT CASE WHEN count(*) > 100000 THEN 64 ELSE 24 END FROM lineitem)"
_M = "(SELECT CASE WHEN count(*) > 100000 THEN 56 WHEN count(*) > 10000 THEN 20 ELSE 10 END FROM lineitem)"
_HOUR = f"((epoch_us(ts) - epoch_us(TIMESTAMP '{EPOCH}')) // 3600000000)::INT"

CTES = {
    "evidence": f"""evidence AS (
  SELECT 'L' || l_linenumber AS layer_id,
         CASE WHEN l_linenumber <= 3 THEN 'prediction' WHEN l_linenumber <= 5 THEN 'bridge' WHEN l_linenumber = 6 THEN 'mixed' ELSE 'extrapolation' END AS role,
         'G' || (l_linenumber % 4) AS grp, (l_suppkey % 16)::INT AS t, (l_partkey % {_K})::INT AS y, (l_orderkey % {_K})::INT AS x,
         max(round(l_discount * 2550)::INT) AS score
  FROM lineitem WHERE l_quantity <= 25 GROUP BY ALL)""",
    "mask": f"""mask AS (
  SELECT DISTINCT (l_suppkey % 8)::INT AS t, (l_partkey % {_M})::INT AS y, (l_orderkey % {_M})::INT AS x
  FROM lineitem WHERE l_quantity = 7 AND l_discount <= 0.02)""",
    "candidates": """candidates AS (
  SELECT source AS volume, lang AS view, d.doc_id AS frame, coalesce(quality, 0) = 1 AS fg, quality IS NOT NULL AS labelled,
         source || '|' || lang || '|' || d.doc_id AS identity, d.doc_id AS ord
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
    "anchors": f"anchors AS (SELECT DISTINCT user_id AS lineage, {_HOUR} AS frame FROM events WHERE event_type = 'signup')",
    "active": f"active AS (SELECT DISTINCT user_id AS lineage, {_HOUR} AS frame FROM events)",
    "trace": "trace AS (SELECT user_id AS run_id, event_id, event_type AS event, epoch_us(ts) AS ts_us, value FROM events)",
    "tracklets": """tracklets AS (
  SELECT l_suppkey AS obj, (l_linenumber % 2)::INT AS anchor, (l_partkey % 12)::INT AS frame, (l_orderkey % 16)::INT AS y, (l_partkey % 16)::INT AS x,
         max(100 - round(l_discount * 100)::INT) AS pct
  FROM lineitem GROUP BY ALL)""",
    "band": """rows_seen AS (
  SELECT l_suppkey AS supplier, l_orderkey % 2 AS half, (l_orderkey + l_linenumber) % 10 AS seen, l_suppkey // 16 * 100 + l_partkey % 8 AS frame, (l_orderkey % 32)::INT AS y,
         (l_partkey // 8 % 32)::INT AS x, 100 - round(l_discount * 100)::INT AS pct FROM lineitem),
band AS (
  SELECT side, obj, frame, y, x, max(pct) AS pct FROM (
    SELECT 0 AS side, supplier * 10 + CASE WHEN supplier % 7 = 0 THEN half ELSE 0 END AS obj, frame, y, x, pct FROM rows_seen WHERE seen <= 7
    UNION ALL SELECT 1, supplier * 10 + CASE WHEN supplier % 5 = 0 THEN half ELSE 0 END, frame, y, x, pct FROM rows_seen WHERE seen >= 2
    UNION ALL SELECT 1, supplier * 10 + 5, frame, y, x, pct FROM rows_seen WHERE seen >= 3 AND supplier % 11 = 3) GROUP BY ALL)""",
    "frames": "frames AS (SELECT conv_id AS volume, turn AS frame, length(text) AS n FROM conversations)",
    "kk": f"kk AS (SELECT {_K} AS k)",
    "km": f"km AS (SELECT {_M} AS k)",
}


def sql(views: str, body: str, recursive: bool = False) -> str:
    """DuckDB SQL of ``body`` over the named views; ``body`` may go on with CTEs after a comma."""
    named = ",\n".join(CTES[v] for v in views.split())
    return f"WITH {'RECURSIVE ' if recursive else ''}{named}{body if body.lstrip().startswith(',') else chr(10) + body}"
