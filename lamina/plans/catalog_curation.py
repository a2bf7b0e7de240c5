"""Registered queries: curation, time, tiles, resampling, tracks, planes, traces and scalars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions import planes, scalars
from lamina.operators import maskset, rank, resample, sections, temporal, tiles, topology, trace, tracks, vote
from lamina.operators.joins import bucketed_range_join
from lamina.plans.catalog import _label_sql, _vote_sql, query
from lamina.session import cut, stored, table
from lamina.sources import adapters
from lamina.sources.adapters import sql

# ---- sampling and splits ----


def _digest_sql(domain: str, column: str) -> str:
    return f"""sha256('["{domain}","' || {column} || '"]')"""


@query(sql("candidates", f"SELECT volume, view, frame, fg FROM candidates WHERE {_digest_sql(rank.FRACTION_DOMAIN, 'identity')} < '{rank.fraction_threshold(0.1)}'"))
def fraction_sample(spark, sf_dir):
    return rank.fraction_sample(adapters.candidates(spark, sf_dir), "identity", 0.1).select("volume", "view", "frame", "fg")


_RANKED = f"""r AS (SELECT *, row_number() OVER (PARTITION BY view, fg ORDER BY {_digest_sql(rank.BACKGROUND_DOMAIN, 'identity')}, ord) AS place FROM candidates),
cap AS (SELECT view, count_if(fg) // 3 AS cap FROM candidates GROUP BY view)"""


@query(sql("candidates", f", {_RANKED}\nSELECT volume, view, frame, fg FROM r JOIN cap USING (view) WHERE fg OR place <= cap"))
def background_cap(spark, sf_dir):
    return rank.background_cap(adapters.candidates(spark, sf_dir), "view").select("volume", "view", "frame", "fg")


@query(
    sql(
        "candidates",
        f""", b AS (SELECT *, {_digest_sql(rank.BACKGROUND_DOMAIN, 'identity')} AS key FROM candidates WHERE NOT fg),
turns AS (SELECT *, row_number() OVER (PARTITION BY view, volume ORDER BY key, ord) AS turn FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY view ORDER BY turn, key, ord) AS place FROM turns),
cap AS (SELECT view, count_if(fg) // 3 AS cap FROM candidates GROUP BY view)
SELECT volume, view, frame, fg FROM candidates WHERE fg UNION ALL SELECT volume, view, frame, fg FROM r JOIN cap USING (view) WHERE place <= cap""",
    )
)
def background_cap_breadth(spark, sf_dir):
    return rank.breadth_first_cap(adapters.candidates(spark, sf_dir), "volume", "view").select("volume", "view", "frame", "fg")


def _split_sql(unit: str) -> str:
    return sql(
        "candidates",
        f""", u AS (SELECT DISTINCT {unit} AS unit FROM candidates),
r AS (SELECT unit, row_number() OVER (ORDER BY {_digest_sql(rank.SPLIT_DOMAIN, 'unit')}) AS place, count(*) OVER () AS n FROM u)
SELECT volume, view, frame, CASE WHEN place <= floor(4 * n / 5.0 + 0.5) THEN 'train' ELSE 'val' END AS part FROM candidates JOIN r ON unit = {unit}""",
    )


def _split(spark, sf_dir, unit) -> DataFrame:
    return rank.train_split(adapters.candidates(spark, sf_dir), unit).select("volume", "view", "frame", "part")


@query(_split_sql("volume"))
def split_train_val_volume(spark, sf_dir):
    return _split(spark, sf_dir, F.col("volume"))


@query(_split_sql("(volume || '|' || view)"))
def split_train_val_view(spark, sf_dir):
    return _split(spark, sf_dir, F.concat_ws("|", "volume", "view"))


@query(_split_sql("identity"))
def split_train_val_slice(spark, sf_dir):
    return _split(spark, sf_dir, F.col("identity"))


@query(
    sql(
        "candidates",
        f""", n AS (SELECT count(*) AS n, floor(2.6 * count(*) + 0.5)::BIGINT - count(*) AS more FROM candidates),
r AS (SELECT *, row_number() OVER (ORDER BY NOT fg, {_digest_sql('version-v1', 'identity')}, identity) AS place FROM candidates),
c AS (SELECT volume, view, frame, more // n + CASE WHEN place <= more % n THEN 1 ELSE 0 END AS copies FROM r, n)
SELECT volume, view, frame, unnest(range(1, copies + 1))::INT AS version FROM c""",
    )
)
def version_expansion(spark, sf_dir):
    return rank.versions(adapters.candidates(spark, sf_dir), (13, 5)).select("volume", "view", "frame", "version")


@query(
    sql(
        "candidates",
        "SELECT volume, view, grouping(volume, view)::INT AS level, count_if(fg) AS foreground, count_if(NOT fg) AS background FROM candidates GROUP BY ROLLUP (volume, view)",
    )
)
def subset_rollup(spark, sf_dir):
    rolled = adapters.candidates(spark, sf_dir).rollup("volume", "view")
    return rolled.agg(F.grouping_id().cast("int").alias("level"), F.count_if("fg").alias("foreground"), F.count_if(~F.col("fg")).alias("background"))


_SPLIT_VERSIONS = f""", u AS (SELECT DISTINCT (volume || '|' || view) AS unit FROM candidates),
o AS (SELECT unit, row_number() OVER (ORDER BY {_digest_sql(rank.SPLIT_DOMAIN, 'unit')}) AS place, count(*) OVER () AS n FROM u),
split AS (SELECT c.*, CASE WHEN place <= floor(4 * n / 5.0 + 0.5) THEN 'train' ELSE 'val' END AS part FROM candidates c JOIN o ON unit = volume || '|' || view),
n AS (SELECT count(*) AS n, floor(2.6 * count(*) + 0.5)::BIGINT - count(*) AS more FROM split WHERE part = 'train'),
e AS (SELECT *, row_number() OVER (ORDER BY NOT (fg AND (ord + more // n + 1) % 5 <> 0), {_digest_sql('version-v1', 'identity')}, identity) AS place FROM split, n WHERE part = 'train'),
copies AS (SELECT volume, view, frame, fg, identity, ord, part, unnest(range(1, more // n + CASE WHEN place <= more % n THEN 1 ELSE 0 END + 1))::INT AS version FROM e)
"""


def _split_versions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Candidates with their part of the split, and the versions of the training part; every fifth copy of a foreground row has lost its foreground."""
    split = cut(rank.train_split(adapters.candidates(spark, sf_dir), F.concat_ws("|", "volume", "view")).drop("unit", "labelled"))
    n = split.where("part = 'train'").count()
    whole = ((2 * 13 * n + 5) // 10 - n) // n if n else 0
    still = F.col("fg") & ((F.col("ord") + whole + 1) % 5 != 0)
    return split, rank.versions(split, (13, 5), F.col("part") == "train", still).drop("copies")


@query(sql("candidates", _SPLIT_VERSIONS + "SELECT volume, view, frame, version FROM copies"))
def version_expansion_by_split(spark, sf_dir):
    return _split_versions(spark, sf_dir)[1].select("volume", "view", "frame", "version")


@query(
    sql(
        "candidates",
        _SPLIT_VERSIONS
        + f""", every AS (SELECT volume, view, frame, identity, ord, part, 0 AS version, fg FROM split UNION ALL SELECT volume, view, frame, identity, ord, part, version, fg AND (ord + version) % 5 <> 0 FROM copies),
b AS (SELECT *, {_digest_sql(rank.BACKGROUND_DOMAIN, "(identity || '#' || version)")} AS key, version > 0 AS copy FROM every WHERE NOT fg),
turns AS (SELECT *, CASE WHEN copy THEN row_number() OVER (PARTITION BY part, copy, identity ORDER BY key, ord) ELSE 0 END AS turn FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY copy, turn, key, ord) AS place FROM turns),
cap AS (SELECT part, count_if(fg) // 3 AS cap FROM every GROUP BY part)
SELECT volume, view, frame, version, part, fg FROM every WHERE fg UNION ALL SELECT volume, view, frame, version, part, fg FROM r JOIN cap USING (part) WHERE place <= cap""",
    )
)
def background_cap_final(spark, sf_dir):
    split, copies = _split_versions(spark, sf_dir)
    every = split.withColumn("version", F.lit(0)).unionByName(copies.withColumn("fg", F.col("fg") & ((F.col("ord") + F.col("version")) % 5 != 0)))
    return rank.final_cap(every, "identity", "part").select("volume", "view", "frame", "version", "part", "fg")


_EXEMPLARS = """, e AS (SELECT sha256(text) AS exemplar, doc_id, lang, source FROM documents),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY exemplar ORDER BY source, doc_id) AS turn FROM e) WHERE turn = 1)
"""


@query("WITH " + _EXEMPLARS[2:] + """SELECT exemplar, doc_id, CASE WHEN lang = 'en' THEN 0 WHEN source = 'src0' THEN 1 ELSE 2 END AS tier,
  row_number() OVER (PARTITION BY CASE WHEN lang = 'en' THEN 0 WHEN source = 'src0' THEN 1 ELSE 2 END ORDER BY sha256('["exemplar-v1","' || exemplar || '"]'), source, doc_id)::INT AS rank FROM f""")
def exemplar_dedupe_rank(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("exemplar"), "doc_id", "lang", "source")
    tier = F.when(F.col("lang") == "en", 0).when(F.col("source") == "src0", 1).otherwise(2)
    return rank.exemplars(docs, "exemplar", tier, ["source", "doc_id"]).select("exemplar", "doc_id", "tier", "rank")


@query(sql("candidates", ", t AS (SELECT *, row_number() OVER (PARTITION BY view ORDER BY frame) AS turn FROM candidates)\nSELECT view, frame, turn::INT AS turn, row_number() OVER (PARTITION BY turn ORDER BY view)::INT AS place FROM t"))
def round_robin(spark, sf_dir):
    return rank.round_robin(adapters.candidates(spark, sf_dir), "view", "frame").select("view", "frame", "turn", "place")


@query(sql("candidates", "SELECT volume, frame, ((row_number() OVER (PARTITION BY volume ORDER BY frame) - 1) // 8)::INT AS batch FROM candidates"))
def work_batches(spark, sf_dir):
    return rank.compatible_batches(adapters.candidates(spark, sf_dir), "volume", ["frame"], 8).select("volume", "frame", "batch")


@query()
def view_owner_lpt(spark, sf_dir):
    work = adapters.candidates(spark, sf_dir).groupBy(F.col("volume").alias("view")).agg(F.count(F.lit(1)).alias("cost"))
    return tracks.longest_first(work, 4)


@query(sql("candidates", f"SELECT frame, ('0x' || {_digest_sql('seed-v1', 'identity')}[1:8])::BIGINT AS seed FROM candidates"))
def digest_seed(spark, sf_dir):
    return adapters.candidates(spark, sf_dir).select("frame", rank.digest_seed(rank.digest("seed-v1", F.col("identity"))).alias("seed"))


# ---- inventories and labels ----


@query(
    """WITH expected AS (SELECT doc_id, sha256(text) AS sha FROM documents),
observed AS (SELECT CASE WHEN doc_id % 50 = 7 THEN doc_id + 1000000 ELSE doc_id END AS doc_id, sha256(CASE WHEN doc_id % 40 = 3 THEN text || '!' ELSE text END) AS sha FROM documents)
SELECT coalesce(e.doc_id, o.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'missing' WHEN e.doc_id IS NULL THEN 'extra' ELSE 'changed' END AS status
FROM expected e FULL JOIN observed o ON e.doc_id = o.doc_id WHERE e.sha IS DISTINCT FROM o.sha"""
)
def content_inventory(spark, sf_dir):
    """Expected against observed content; the observed side lacks, adds and changes some."""
    docs = table(spark, sf_dir, "documents")
    expected = docs.select("doc_id", F.sha2("text", 256).alias("sha"))
    observed = docs.select(
        F.when(F.col("doc_id") % 50 == 7, F.col("doc_id") + 1000000).otherwise(F.col("doc_id")).alias("doc_id"),
        F.sha2(F.when(F.col("doc_id") % 40 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha"),
    )
    return scalars.inventory_differences(expected, observed, "doc_id", "sha")


@query("SELECT user_id, count(*) AS orphans FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY user_id")
def orphan_labels(spark, sf_dir):
    known = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    return table(spark, sf_dir, "events").join(known, "user_id", "left_anti").groupBy("user_id").agg(F.count(F.lit(1)).alias("orphans"))


@query("SELECT CASE WHEN l.doc_id IS NULL THEN 'unknown' WHEN quality = 1 THEN 'foreground' ELSE 'known_background' END AS state, count(*) AS frames FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def annotation_state(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    state = F.when(F.col("quality").isNull(), "unknown").when(F.col("quality") == 1, "foreground").otherwise("known_background")
    return joined.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("frames"))


@query(sql("candidates", "SELECT volume, CASE WHEN bool_and(labelled) THEN 'full' WHEN bool_or(labelled) THEN 'partial' ELSE 'none' END AS coverage, count(*) AS frames FROM candidates GROUP BY volume"))
def label_coverage_class(spark, sf_dir):
    coverage = F.when(F.bool_and("labelled"), "full").when(F.bool_or("labelled"), "partial").otherwise("none")
    return adapters.candidates(spark, sf_dir).groupBy("volume").agg(coverage.alias("coverage"), F.count(F.lit(1)).alias("frames"))


@query("SELECT DISTINCT source, regexp_extract(source, '^(.*?)([0-9]*)$', 1) AS stem, regexp_extract(source, '([0-9]*)$', 1)::INT AS number FROM documents")
def natural_order(spark, sf_dir):
    names = table(spark, sf_dir, "documents").select("source").distinct()
    return names.select("source", F.regexp_extract("source", "^(.*?)([0-9]*)$", 1).alias("stem"), F.regexp_extract("source", "([0-9]*)$", 1).cast("int").alias("number")).orderBy("stem", "number")


@query(sql("frames", "SELECT volume, count(*) AS frames, max(frame) + 1 - count(*) AS missing, count(*) - count(DISTINCT frame) AS repeated FROM frames GROUP BY volume"))
def frame_completeness(spark, sf_dir):
    return adapters.frames(spark, sf_dir).groupBy("volume").agg(
        F.count(F.lit(1)).alias("frames"), (F.max("frame") + 1 - F.count(F.lit(1))).alias("missing"), (F.count(F.lit(1)) - F.count_distinct("frame")).alias("repeated")
    )


# ---- time ----

_DOMAINS = f""", d AS (SELECT lineage, frame,
    coalesce((lag(frame) OVER w + frame) // 2 + 1, 0) AS start, coalesce((lead(frame) OVER w + frame) // 2 + 1, {adapters.HOURS}) AS stop
  FROM anchors WINDOW w AS (PARTITION BY lineage ORDER BY frame))
"""


def _domains(spark, sf_dir) -> DataFrame:
    return temporal.anchor_domains(adapters.anchors(spark, sf_dir), 0, adapters.HOURS)


@query(sql("anchors", _DOMAINS + "SELECT lineage, frame, start, stop FROM d"))
def anchor_domains(spark, sf_dir):
    return _domains(spark, sf_dir)


_WINDOWS = (
    _DOMAINS
    + """, c AS (SELECT *, least(30, stop - start) AS size FROM d),
c2 AS (SELECT *, greatest(start, least(frame - 14, stop - size)) AS c_lo, greatest(start, least(frame - 14, stop - size)) + size AS c_hi FROM c),
w AS (
  SELECT lineage, frame, 'center' AS direction, 0 AS step, c_lo AS lo, c_hi AS hi, c_lo AS own_lo, c_hi AS own_hi FROM c2
  UNION ALL SELECT lineage, frame, 'forward', k, c_hi + (k - 1) * 29 - 1, least(stop, c_hi + k * 29), c_hi + (k - 1) * 29, least(stop, c_hi + k * 29)
  FROM (SELECT *, unnest(range(1, (stop - c_hi + 28) // 29 + 1))::INT AS k FROM c2)
  UNION ALL SELECT lineage, frame, 'backward', k, greatest(start, c_lo - k * 29), c_lo - (k - 1) * 29 + 1, greatest(start, c_lo - k * 29), c_lo - (k - 1) * 29
  FROM (SELECT *, unnest(range(1, (c_lo - start + 28) // 29 + 1))::INT AS k FROM c2))
"""
)


@query(sql("anchors", _WINDOWS + "SELECT lineage, frame, direction, step, lo, hi FROM w"))
def domain_windows(spark, sf_dir):
    return temporal.domain_windows(_domains(spark, sf_dir)).select("lineage", "frame", "direction", "step", "lo", "hi")


@query(sql("anchors", _WINDOWS + "SELECT lineage, sum(own_hi - own_lo)::BIGINT AS owned, sum(hi - lo)::BIGINT AS read, count(*) AS windows FROM w GROUP BY lineage"))
def window_ownership(spark, sf_dir):
    """Every frame is owned once: ``owned`` is the length of the range."""
    windows = temporal.domain_windows(_domains(spark, sf_dir))
    return windows.groupBy("lineage").agg(
        F.sum(F.col("own_hi") - F.col("own_lo")).alias("owned"), F.sum(F.col("hi") - F.col("lo")).alias("read"), F.count(F.lit(1)).alias("windows")
    )


@query(sql("anchors active", _DOMAINS + "SELECT a.lineage, a.frame, d.frame AS anchor FROM active a JOIN d ON a.lineage = d.lineage AND a.frame >= start AND a.frame < stop"))
def nearest_anchor_join(spark, sf_dir):
    domains = _domains(spark, sf_dir).withColumnRenamed("frame", "anchor")
    return bucketed_range_join(adapters.active_frames(spark, sf_dir), domains, "frame", "start", "stop", 64, ["lineage"]).select("lineage", "frame", "anchor")


@query(sql("active", ", i AS (SELECT *, frame - row_number() OVER (PARTITION BY lineage ORDER BY frame) AS island FROM active)\nSELECT lineage, min(frame) AS first, max(frame) AS last, count(*) AS frames FROM i GROUP BY lineage, island"))
def episodes(spark, sf_dir):
    return temporal.episodes(adapters.active_frames(spark, sf_dir))


_MERGE = """, r AS (SELECT lineage, frame AS start, frame + 6 AS stop FROM active),
n AS (SELECT *, coalesce(start > max(stop) OVER (PARTITION BY lineage ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS new FROM r),
i AS (SELECT *, sum(new::INT) OVER (PARTITION BY lineage ORDER BY start, stop) AS island FROM n),
merged AS (SELECT lineage, min(start) AS start, max(stop) AS stop, count(*) AS pieces FROM i GROUP BY lineage, island)
"""


@query(sql("active", _MERGE + "SELECT * FROM merged"))
def range_merge(spark, sf_dir):
    ranges = adapters.active_frames(spark, sf_dir).select("lineage", F.col("frame").alias("start"), (F.col("frame") + 6).alias("stop"))
    return temporal.merge_ranges(ranges, "lineage")


@query(sql("active anchors", _MERGE + "SELECT a.lineage, a.frame FROM anchors a ANTI JOIN merged m ON a.lineage = m.lineage AND a.frame + 12 >= m.start AND a.frame + 12 < m.stop"))
def coverage_novel(spark, sf_dir):
    """Anchors whose transition half a day on was not traversed yet."""
    active = adapters.active_frames(spark, sf_dir).select("lineage", F.col("frame").alias("start"), (F.col("frame") + 6).alias("stop"))
    ahead = adapters.anchors(spark, sf_dir).withColumn("to", F.col("frame") + 12)
    met = bucketed_range_join(ahead, temporal.merge_ranges(active, "lineage"), "to", "start", "stop", 64, ["lineage"]).select("lineage", "frame")
    return ahead.join(met, ["lineage", "frame"], "left_anti").select("lineage", "frame")


@query(sql("active", ", g AS (SELECT lineage, frame, coalesce(lag(frame) OVER (PARTITION BY lineage ORDER BY frame), -1) AS after FROM active)\nSELECT lineage, after, frame AS before, frame - after - 1 AS missing FROM g WHERE frame - after > 1"))
def gap_detect(spark, sf_dir):
    return temporal.sequence_gaps(adapters.active_frames(spark, sf_dir), "lineage", "frame")


@query(sql("frames", ", s AS (SELECT *, min(CASE WHEN n % 7 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY volume ORDER BY frame) AS ok FROM frames)\nSELECT volume, frame FROM s WHERE ok = 1"))
def prefix_until_empty(spark, sf_dir):
    steps = adapters.frames(spark, sf_dir).withColumn("occupied", F.col("n") % 7 != 0)
    return maskset.prefix_until_empty(steps, "volume", "frame", "occupied").select("volume", "frame")


@query(sql("active", f"SELECT direction, sweep, count(*) AS boxes FROM (SELECT lineage, direction, CASE direction WHEN 'forward' THEN frame // 29 ELSE ({adapters.HOURS - 1} - frame) // 29 END AS sweep FROM active, (VALUES ('forward'), ('backward')) v(direction)) GROUP BY ALL"))
def sweep_groups(spark, sf_dir):
    both = adapters.active_frames(spark, sf_dir).withColumn("direction", F.explode(F.array(F.lit("forward"), F.lit("backward"))))
    from_start = F.when(F.col("direction") == "forward", F.col("frame")).otherwise(adapters.HOURS - 1 - F.col("frame"))
    return both.groupBy("direction", F.floor(from_start / temporal.ADVANCE).cast("int").alias("sweep")).agg(F.count(F.lit(1)).alias("boxes"))


@query(
    """WITH o AS (SELECT o_custkey AS k, epoch_us(o_orderdate) // 86400000000 AS d FROM orders),
p AS (SELECT k, d, max(p) AS p FROM (SELECT o_custkey AS k, epoch_us(l_shipdate) // 86400000000 AS d, l_quantity AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY k, d),
c AS (SELECT o.k, o.d, p.d AS nearest, p.p AS value, row_number() OVER (PARTITION BY o.k, o.d ORDER BY abs(o.d - p.d), p.d) AS place FROM (SELECT DISTINCT * FROM o) o LEFT JOIN p ON o.k = p.k)
SELECT k, d, nearest, value FROM c WHERE place = 1"""
)
def nearest_asof(spark, sf_dir):
    day = lambda c: F.expr(f"unix_micros(cast({c} as timestamp)) div 86400000000")
    orders = table(spark, sf_dir, "orders")
    left = orders.select(F.col("o_custkey").alias("k"), day("o_orderdate").alias("d")).distinct()
    ships = (
        table(spark, sf_dir, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_custkey").alias("k"), day("l_shipdate").alias("d"))
        .agg(F.max("l_quantity").alias("value"))
    )
    return temporal.nearest_asof(left, ships, "k", "d", "value")


# ---- channels ----


def _channels_sql(source: str) -> str:
    return sql("frames", f""", c AS (SELECT volume, frame, count(*) OVER (PARTITION BY volume) AS n FROM frames),
o AS (SELECT *, unnest([-2, -1, 0, 1, 2]) AS off FROM c)
SELECT volume, frame, off AS "offset", {source} FROM o""")


@query(_channels_sql("greatest(0, least(frame + off, n - 1)) AS source"))
def channel_offsets_clamp(spark, sf_dir):
    found = temporal.channel_offsets(adapters.frames(spark, sf_dir), "volume", "frame", [-2, -1, 0, 1, 2], wrap=False)
    return found.select("volume", "frame", "offset", "source")


@query(_channels_sql("((frame + off) % n + n) % n AS source, (floor((frame + off) / n::DOUBLE)::BIGINT % 2 + 2) % 2 = 1 AS mirrored"))
def channel_offsets_wrap_mirror(spark, sf_dir):
    found = temporal.channel_offsets(adapters.frames(spark, sf_dir), "volume", "frame", [-2, -1, 0, 1, 2], wrap=True)
    return found.select("volume", "frame", "offset", "source", "mirrored")


# ---- tiles ----

_STARTS = "(SELECT DISTINCT unnest(list_append(range(0, greatest(k - 10, 0) + 1, 7), greatest(k - 10, 0)))::INT AS s FROM kk)"
_TILES = f""", s AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS i FROM {_STARTS}),
tiles AS (SELECT (a.i * (SELECT count(*) FROM s) + b.i)::INT AS tile, a.i AS row, b.i AS col, a.s AS top, least(k, a.s + 10) AS bottom, b.s AS "left", least(k, b.s + 10) AS "right" FROM s a, s b, kk)
"""


def _tiles(spark, sf_dir) -> DataFrame:
    k = adapters.grid_side(spark, sf_dir)
    return tiles.tile_grid(spark.createDataFrame([(k, k)], "height int, width int"), 10, 7)


@query("SELECT o_orderkey % 100 + 1 AS extent, unnest(list_sort(list_distinct(list_append(range(0, greatest(o_orderkey % 100 + 1 - 10, 0) + 1, 7), greatest(o_orderkey % 100 + 1 - 10, 0)))))::INT AS start FROM orders")
def tile_starts(spark, sf_dir):
    extents = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 100 + 1).alias("extent"))
    return tiles.axis_starts(extents, 10, 7).select("extent", F.col("start").cast("int").alias("start"))


@query(sql("kk", _TILES + "SELECT tile, top, bottom, \"left\", \"right\" FROM tiles"))
def tile_grid(spark, sf_dir):
    return _tiles(spark, sf_dir).select("tile", "top", "bottom", "left", "right")


@query(sql("kk", _TILES + """SELECT a.tile, b.tile AS other, greatest(a.top, b.top) AS top, least(a.bottom, b.bottom) AS bottom, greatest(a."left", b."left") AS "left", least(a."right", b."right") AS "right"
FROM tiles a JOIN tiles b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND a.tile <> b.tile"""))
def tile_neighbors(spark, sf_dir):
    return tiles.neighbours(_tiles(spark, sf_dir))


_REBASED = _TILES + """, v AS (SELECT DISTINCT t, y, x FROM evidence),
r AS (SELECT t, tile, top, "left", y - top AS local_y, x - "left" AS local_x FROM v JOIN tiles ON y >= top AND y < bottom AND x >= "left" AND x < "right")
"""


@query(sql("evidence kk", _REBASED + 'SELECT t, top, "left", local_y, local_x FROM r'))
def tile_rebase(spark, sf_dir):
    k = adapters.grid_side(spark, sf_dir)
    return tiles.in_tiles(maskset.union(adapters.evidence(spark, sf_dir)), 10, 7, k, k).select("t", "top", "left", "local_y", "local_x")


@query(
    sql(
        "tracklets",
        """SELECT obj % 20 AS lineage, x // 4 AS tile, frame, CASE anchor WHEN 0 THEN 'forward' ELSE 'backward' END AS direction, max(pct) AS prob, max(y % 3) + 1 AS generation,
  list_sort(list_distinct(list(y // 4))) AS visited, list_sort(list_distinct(list(obj))) AS sources FROM tracklets GROUP BY 1, 2, 3, 4""",
    )
)
def relay_merge(spark, sf_dir):
    relays = adapters.tracklets(spark, sf_dir).select(
        (F.col("obj") % 20).alias("lineage"), F.expr("cast(x div 4 as int)").alias("tile"), "frame", F.when(F.col("anchor") == 0, "forward").otherwise("backward").alias("direction"),
        F.col("pct").alias("prob"), (F.col("y") % 3).alias("generation"), F.array(F.expr("cast(y div 4 as int)")).alias("visited"), F.col("obj").alias("source"),
    )
    return tiles.merge_relays(relays)


_BOXES = ", b AS (SELECT obj, min(y) AS y0, min(y) + 4 + obj % 9 AS y1, min(x) + obj % 5 AS x0, min(x) + 6 + obj % 7 AS x1 FROM tracklets GROUP BY obj)\n"


def _boxes(spark, sf_dir) -> DataFrame:
    found = adapters.tracklets(spark, sf_dir).groupBy("obj").agg(F.min("y").alias("y0"), F.min("x").alias("x"))
    return found.select("obj", "y0", (F.col("y0") + 4 + F.col("obj") % 9).alias("y1"), (F.col("x") + F.col("obj") % 5).alias("x0"), (F.col("x") + 6 + F.col("obj") % 7).alias("x1"))


@query(
    sql(
        "tracklets kk",
        _TILES + _BOXES
        + """, m AS (SELECT obj, tile, least(y0 - top, bottom - y1, x0 - "left", "right" - x1) AS margin FROM b JOIN tiles ON y0 < bottom AND y1 > top AND x0 < "right" AND x1 > "left"),
r AS (SELECT *, max(margin) OVER (PARTITION BY obj) >= 0 AS inside, row_number() OVER (PARTITION BY obj ORDER BY margin >= 0 DESC, margin DESC, tile) AS place FROM m)
SELECT obj, tile, margin FROM r WHERE NOT inside OR place = 1""",
    )
)
def tile_owner(spark, sf_dir):
    return tiles.owners(_boxes(spark, sf_dir), _tiles(spark, sf_dir))


@query(
    sql(
        "tracklets",
        _BOXES
        + """, v AS (SELECT DISTINCT obj, y, x FROM tracklets)
SELECT obj, count_if(y < y0 + 1) AS top, count_if(y >= y1 - 1) AS bottom, count_if(x < x0 + 1) AS "left", count_if(x >= x1 - 1) AS "right" FROM v JOIN b USING (obj) GROUP BY obj""",
    )
)
def crop_contacts(spark, sf_dir):
    return tiles.crop_contacts(adapters.tracklets(spark, sf_dir).select("obj", "y", "x").distinct(), _boxes(spark, sf_dir))


@query("SELECT start, start + 16 AS stop, CASE WHEN lag(start) OVER w IS NULL THEN 0 ELSE (lag(start) OVER w + 16 + start) // 2 END AS own_lo, CASE WHEN lead(start) OVER w IS NULL THEN 50 ELSE (start + 16 + lead(start) OVER w) // 2 END AS own_hi FROM (SELECT unnest([0, 12, 24, 34])::INT AS start) WINDOW w AS (ORDER BY start)")
def halo_ownership(spark, sf_dir):
    """Windows of 16 at stride 12 over 50 places: halves of the overlaps are owned."""
    starts = tiles.axis_starts(spark.createDataFrame([(50,)], "extent int"), 16, 12).select(F.col("start").cast("int").alias("start"))
    by = Window.orderBy("start")
    before, after = F.lag("start").over(by), F.lead("start").over(by)
    return starts.select(
        "start", (F.col("start") + 16).alias("stop"),
        F.coalesce(F.floor((before + 16 + F.col("start")) / 2), F.lit(0)).cast("int").alias("own_lo"),
        F.coalesce(F.floor((F.col("start") + 16 + after) / 2), F.lit(50)).cast("int").alias("own_hi"),
    )


# ---- resampling ----


def _grid_sql(t: int, y: str, x: str) -> str:
    return f"(SELECT a AS t, b AS y, c AS x FROM (SELECT unnest(range({t}))::INT AS a) CROSS JOIN (SELECT unnest(range({y}))::INT AS b FROM km) CROSS JOIN (SELECT unnest(range({x}))::INT AS c FROM km))"


@query(sql("mask km", f"SELECT g.t, g.y, g.x FROM {_grid_sql(12, '30', '30')} g, km SEMI JOIN mask m ON m.t = g.t * 8 // 12 AND m.y = g.y * k // 30 AND m.x = g.x * k // 30"))
def resize_nearest(spark, sf_dir):
    k = adapters.mask_side(spark, sf_dir)
    return resample.resize_nearest(adapters.mask(spark, sf_dir), (8, k, k), (12, 30, 30))


@query(
    sql(
        "mask km",
        f"SELECT DISTINCT g.t, g.y, g.x FROM {_grid_sql(5, '7', '7')} g, km, mask m WHERE m.t >= g.t * 8 // 5 AND m.t < ((g.t + 1) * 8 + 4) // 5 AND m.y >= g.y * k // 7 AND m.y < ((g.y + 1) * k + 6) // 7 AND m.x >= g.x * k // 7 AND m.x < ((g.x + 1) * k + 6) // 7",
    )
)
def restore_or_pool(spark, sf_dir):
    k = adapters.mask_side(spark, sf_dir)
    return resample.restore_or(adapters.mask(spark, sf_dir), (8, k, k), (5, 7, 7))


@query(sql("mask", "SELECT DISTINCT t // 4 AS t, y // 4 AS y, x // 4 AS x FROM mask"))
def downbin_presence(spark, sf_dir):
    return resample.presence(adapters.mask(spark, sf_dir), 4)


@query(sql("mask", "SELECT 'transverse' AS view, t AS frame, y AS row, x AS col FROM mask UNION ALL SELECT 'sagittal', x, t, y FROM mask UNION ALL SELECT 'coronal', y, t, x FROM mask"))
def axis_permute_views(spark, sf_dir):
    return resample.stack_views(adapters.mask(spark, sf_dir))


@query(
    sql(
        "mask km",
        """, a AS (SELECT angle, u FROM (SELECT unnest(range(12))::INT AS angle), (SELECT unnest(range(-(k // 2), k // 2 + 1))::INT AS u FROM km)),
p AS (SELECT angle, u, floor(round((k - 1) / 2.0 + u * sin(radians(angle * 15.0)), 9) + 0.5)::INT AS y, floor(round((k - 1) / 2.0 + u * cos(radians(angle * 15.0)), 9) + 0.5)::INT AS x FROM a, km)
SELECT angle, t, u FROM p JOIN mask USING (y, x)""",
    )
)
def azimuth_nearest(spark, sf_dir):
    k = adapters.mask_side(spark, sf_dir)
    return resample.azimuth_slices(adapters.mask(spark, sf_dir), 12, k, k)


@query(
    sql(
        "mask km",
        f""", g AS (SELECT t, y, x, (t * 5 + x * 2) // 5 AS low, (t * 5 + x * 2) % 5 AS part FROM {_grid_sql(8, 'k', 'k')}),
s AS (SELECT t, y, x, low AS plane, 5 - part AS w FROM g UNION ALL SELECT t, y, x, low + 1, part FROM g)
SELECT s.t, s.y, s.x FROM s JOIN mask m ON m.t = plane AND m.y = s.y AND m.x = s.x GROUP BY s.t, s.y, s.x HAVING sum(w) * 2 >= 5""",
    )
)
def tilt_blend_threshold(spark, sf_dir):
    k = adapters.mask_side(spark, sf_dir)
    return resample.tilted_blend(adapters.mask(spark, sf_dir), (8, k, k), 5, 2)


@query(
    sql(
        "mask km",
        f""", g AS (SELECT t, y, x, y * 2 - (k - 1) AS dy, x * 2 - (k - 1) AS dx, k FROM {_grid_sql(8, 'k', 'k')}, km),
p AS (SELECT t, y, x, floor((dy * 4 - dx * 3 + (k - 1) * 5 + 5) / 10.0)::INT AS sy, floor((dx * 4 + dy * 3 + (k - 1) * 5 + 5) / 10.0)::INT AS sx FROM g)
SELECT p.t, p.y, p.x FROM p SEMI JOIN mask m ON m.t = p.t AND m.y = sy AND m.x = sx""",
    )
)
def affine_rotate_nearest(spark, sf_dir):
    """Rotation by the angle of cosine 4/5."""
    k = adapters.mask_side(spark, sf_dir)
    return resample.rotate_nearest(adapters.mask(spark, sf_dir), (8, k, k), (4, 5), (3, 5))


@query("SELECT p_partkey, greatest(p_partkey % 97 + 1, least95) AS t, greatest(p_partkey % 89 + 1, least95) AS y, greatest(p_partkey % 83 + 1, least95) AS x FROM (SELECT p_partkey, ceil(greatest(p_partkey % 97 + 1, p_partkey % 89 + 1, p_partkey % 83 + 1) * 95 / 100.0)::BIGINT AS least95 FROM part)")
def cube_shape(spark, sf_dir):
    dims = table(spark, sf_dir, "part").select("p_partkey", *[(F.col("p_partkey") % m + 1).alias(c) for c, m in (("t", 97), ("y", 89), ("x", 83))])
    return resample.cube_shape(dims, keep=("p_partkey",))


@query("SELECT l_orderkey, l_linenumber, ((l_orderkey - 2000) % 12 + 12) % 12 AS source, (floor((l_orderkey - 2000) / 12.0)::BIGINT % 2 + 2) % 2 = 1 AS mirrored FROM lineitem")
def cyclic_address(spark, sf_dir):
    source, mirrored = resample.wrapped_azimuth(F.col("l_orderkey") - 2000, 12)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", source.alias("source"), mirrored.alias("mirrored"))


# ---- tracks ----

# Masks hold the voxels of 95 percent or more; a frame without one is a frame with an empty mask.
_OVERLAP = """, fr AS (SELECT obj, anchor, frame, max(pct) AS p, count_if(pct >= 95) AS area, avg(y) FILTER (pct >= 95) AS cy, avg(x) FILTER (pct >= 95) AS cx FROM tracklets GROUP BY ALL),
c AS (SELECT l.obj AS a, r.obj AS b, frame, count(*) AS common FROM tracklets l JOIN tracklets r USING (frame, y, x) WHERE l.anchor = 0 AND r.anchor = 1 AND l.pct >= 95 AND r.pct >= 95 GROUP BY ALL),
f AS (SELECT a, b, frame, l.area AS area_a, r.area AS area_b, coalesce(common, 0) AS common, l.area + r.area > 0 AS useful, l.area > 0 AND r.area > 0 AS coactive,
  CASE WHEN l.area + r.area > 0 THEN coalesce(common, 0)::DOUBLE / (l.area + r.area - coalesce(common, 0)) END AS iou, sqrt((l.cy - r.cy) ** 2 + (l.cx - r.cx) ** 2) / sqrt(512) AS apart,
  CASE WHEN l.area > 0 AND r.area > 0 THEN abs(ln(l.area::DOUBLE / r.area)) END AS drift, CASE WHEN l.area + r.area > 0 THEN l.p / 100 END AS p_a, CASE WHEN l.area + r.area > 0 THEN r.p / 100 END AS p_b, sqrt(p_a * p_b) AS joint
  FROM (SELECT DISTINCT a, b FROM c) JOIN (SELECT obj AS a, * FROM fr WHERE anchor = 0) l USING (a) JOIN (SELECT obj AS b, * FROM fr WHERE anchor = 1) r USING (b, frame) LEFT JOIN c USING (a, b, frame)),
m AS (SELECT a, b, count(*) AS frames, count_if(useful) AS useful, count_if(coactive) AS coactive, count_if(coactive)::DOUBLE / count_if(useful) AS coverage, sum(common)::BIGINT AS intersection,
  (sum(area_a) + sum(area_b) - sum(common))::BIGINT AS union_voxels, sum(common)::DOUBLE / (sum(area_a) + sum(area_b) - sum(common)) AS iou, 2.0 * sum(common)::DOUBLE / (sum(area_a) + sum(area_b)) AS dice,
  avg(iou) AS iou_mean, quantile_cont(iou, 0.5) AS iou_median, quantile_cont(iou, 0.1) AS iou_p10, min(iou) AS iou_min, max(iou) AS iou_max,
  avg(apart) AS apart_mean, quantile_cont(apart, 0.5) AS apart_median, quantile_cont(apart, 0.95) AS apart_p95, avg(drift) AS drift_mean, quantile_cont(drift, 0.5) AS drift_median, quantile_cont(drift, 0.95) AS drift_p95,
  avg(p_a) AS left_mean, avg(p_b) AS right_mean, avg(joint) AS joint_mean, min(joint) AS joint_min FROM f GROUP BY a, b)
"""
_COUNTS = ("frames", "useful", "coactive", "intersection", "union_voxels")
_METRICS = ("coverage", "iou", "dice", "iou_mean", "iou_median", "iou_p10", "iou_min", "iou_max", "apart_mean", "apart_median", "apart_p95", "drift_mean", "drift_median", "drift_p95", "left_mean", "right_mean", "joint_mean", "joint_min")


def _metrics(spark, sf_dir, names: tuple[str, ...], best: int = 0, then=None, columns: str = "") -> DataFrame:
    rows = stored(tracks.mask_rows_of(adapters.sightings(spark, sf_dir), F.col("pct") >= 95, "anchor"))
    return tracks.overlap_of_rows(*[rows.where(F.col("anchor") == k) for k in (0, 1)], 512**0.5, names, best, then, columns)


@query(sql("tracklets", _OVERLAP + "SELECT a, b, " + ", ".join(_COUNTS) + ", " + ", ".join(f"round({c}, 8) AS {c}" for c in _METRICS) + " FROM m"))
def tracklet_overlap(spark, sf_dir):
    names = (*_COUNTS, *_METRICS)
    columns = ", ".join(f"{n} {'long' if n in _COUNTS else 'double'}" for n in names)
    return _metrics(spark, sf_dir, names, then=lambda found: {n: found[n] if n in _COUNTS else tracks.rounded(found[n]) for n in names}, columns=columns)


@query(
    sql(
        "tracklets",
        _OVERLAP
        + "SELECT a, b, concat_ws(',', "
        + ", ".join(f"CASE WHEN NOT coalesce({m} {way} {bound}, false) THEN '{reason}' END" for reason, m, bound, way in tracks.GATES)
        + ") AS failed FROM m",
    )
)
def tracklet_gates(spark, sf_dir):
    coded = _metrics(spark, sf_dir, tracks.GATED, then=lambda found: {"code": tracks.gate_codes(found)}, columns="code int")
    return coded.select("a", "b", tracks.gate_reasons(F.col("code")).alias("failed"))


@query(
    sql(
        "tracklets",
        _OVERLAP
        + """SELECT a, b, round((0.3 * iou + 0.1 * dice + 0.15 * coalesce(iou_median, 0) + 0.15 * coverage + 0.1 * coalesce(exp(-4 * apart_median), 0) + 0.05 * coalesce(exp(-drift_median), 0)
  + 0.15 * coalesce(joint_mean, 0))::DOUBLE, 8) AS score FROM m""",
    )
)
def tracklet_similarity(spark, sf_dir):
    return _metrics(spark, sf_dir, tuple(tracks.WEIGHTS), then=lambda found: {"score": tracks.rounded(tracks.similarities(found))}, columns="score double")


@query(sql("tracklets", "SELECT obj, frame, count(*) AS area FROM (SELECT DISTINCT obj, frame, y, x FROM tracklets) GROUP BY obj, frame"))
def tracklet_union_frames(spark, sf_dir):
    """Both anchors of each object, OR-ed by frame."""
    own = adapters.tracklets(spark, sf_dir)
    return tracks.union_by_frame(own.where("anchor = 0"), own.where("anchor = 1"), ["obj"])


_PREFER = ", p AS (SELECT obj, frame, sum(CASE anchor WHEN 0 THEN pct ELSE 0 END)::BIGINT AS l, sum(CASE anchor WHEN 1 THEN pct ELSE 0 END)::BIGINT AS r FROM tracklets GROUP BY ALL)"


@query(
    sql(
        "tracklets",
        _PREFER
        + """, o AS (SELECT obj, frame, coalesce(sum(l) OVER (PARTITION BY obj ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + sum(r) OVER (PARTITION BY obj ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS objective,
  row_number() OVER (PARTITION BY obj ORDER BY frame) - 1 AS before FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY obj ORDER BY objective DESC, abs(frame - 6), before) AS place FROM o)
SELECT obj, frame AS cut, objective::BIGINT AS objective FROM k WHERE place = 1""",
    )
)
def handoff_cut(spark, sf_dir):
    side = lambda k: F.sum(F.when(F.col("anchor") == k, F.col("pct")).otherwise(0))
    preference = adapters.tracklets(spark, sf_dir).groupBy("obj", "frame").agg(side(0).alias("left"), side(1).alias("right"))
    return tracks.handoff_cut(preference, "obj")


@query(sql("tracklets", ", p AS (SELECT frame, y, obj, max(pct) AS pct, obj % 17 = 0 AS authoritative, obj % 5 = 0 AS preferred FROM tracklets GROUP BY frame, y, obj), k AS (SELECT *, row_number() OVER (PARTITION BY frame, y ORDER BY authoritative DESC, preferred DESC, pct DESC, obj) AS place FROM p)\nSELECT frame, y, obj, pct FROM k WHERE place = 1"))
def lineage_compose(spark, sf_dir):
    proposals = adapters.tracklets(spark, sf_dir).groupBy("frame", "y", "obj").agg(F.max("pct").alias("pct"))
    marked = proposals.withColumn("authoritative", F.col("obj") % 17 == 0).withColumn("preferred", F.col("obj") % 5 == 0)
    return tracks.compose(marked, ["frame", "y"]).select("frame", "y", "obj", "pct")


@query(
    sql(
        "tracklets",
        _OVERLAP + "SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY iou DESC, apart_median, b) AS place FROM m) WHERE place <= 3",
    )
)
def nearest_candidates(spark, sf_dir):
    by = Window.partitionBy("a").orderBy(F.desc("iou"), "apart_median", "b")
    return _metrics(spark, sf_dir, ("iou", "apart_median"), 3).withColumn("place", F.row_number().over(by)).where("place <= 3").select("a", "b")


def _metrics_sql(name: str, left: str, right: str, left_frames: str, right_frames: str, same: bool = False) -> str:
    """CTE ``name`` with the metrics of pairs of tracklets (obj, frame, y, x; obj, frame, p)."""
    only = "AND l.obj = r.obj" if same else ""
    return f""", {name}_c AS (SELECT l.obj AS a, r.obj AS b, frame, count(*) AS common FROM {left} l JOIN {right} r USING (frame, y, x) WHERE true {only} GROUP BY ALL),
{name}_l AS (SELECT obj, frame, p, coalesce(area, 0) AS area, cy, cx FROM {left_frames} LEFT JOIN (SELECT obj, frame, count(*) AS area, avg(y) AS cy, avg(x) AS cx FROM {left} GROUP BY ALL) USING (obj, frame)),
{name}_r AS (SELECT obj, frame, p, coalesce(area, 0) AS area, cy, cx FROM {right_frames} LEFT JOIN (SELECT obj, frame, count(*) AS area, avg(y) AS cy, avg(x) AS cx FROM {right} GROUP BY ALL) USING (obj, frame)),
{name}_f AS (SELECT a, b, frame, l.area AS area_a, r.area AS area_b, coalesce(common, 0) AS common, l.area + r.area > 0 AS useful, l.area > 0 AND r.area > 0 AS coactive,
  CASE WHEN l.area + r.area > 0 THEN coalesce(common, 0)::DOUBLE / (l.area + r.area - coalesce(common, 0)) END AS iou, sqrt((l.cy - r.cy) ** 2 + (l.cx - r.cx) ** 2) / sqrt(2048) AS apart,
  CASE WHEN l.area > 0 AND r.area > 0 THEN abs(ln(l.area::DOUBLE / r.area)) END AS drift, CASE WHEN l.area + r.area > 0 THEN sqrt(l.p * r.p) END AS joint
  FROM (SELECT DISTINCT a, b FROM {name}_c) JOIN (SELECT obj AS a, * FROM {name}_l) l USING (a) JOIN (SELECT obj AS b, * FROM {name}_r) r USING (b, frame) LEFT JOIN {name}_c USING (a, b, frame)),
{name}_m AS (SELECT a, b, count(*) AS frames, count_if(useful) AS useful, count_if(coactive) AS coactive, count_if(coactive)::DOUBLE / count_if(useful) AS coverage, sum(common)::BIGINT AS intersection,
  sum(area_a)::BIGINT AS area_a, sum(common)::DOUBLE / (sum(area_a) + sum(area_b) - sum(common)) AS iou, 2.0 * sum(common)::DOUBLE / (sum(area_a) + sum(area_b)) AS dice,
  quantile_cont(iou, 0.5) AS iou_median, quantile_cont(apart, 0.5) AS apart_median, quantile_cont(drift, 0.5) AS drift_median, avg(joint) AS joint_mean FROM {name}_f GROUP BY a, b),
{name} AS (SELECT *, (0.3 * iou + 0.1 * dice + 0.15 * coalesce(iou_median, 0) + 0.15 * coverage + 0.1 * coalesce(exp(-4 * apart_median), 0) + 0.05 * coalesce(exp(-drift_median), 0)
  + 0.15 * coalesce(joint_mean, 0))::DOUBLE AS similarity, concat_ws(',', {", ".join(f"CASE WHEN NOT coalesce({m} {way} {bound}, false) THEN '{reason}' END" for reason, m, bound, way in tracks.GATES)}) AS gates FROM {name}_m)"""


_SIDES = ", ".join(
    f"{n}v AS (SELECT obj, frame, y, x FROM band WHERE side = {k} AND pct >= 92), {n}f AS (SELECT obj, frame, max(pct) / 100.0 AS p FROM band WHERE side = {k} GROUP BY ALL)" for n, k in (("l", 0), ("r", 1))
)
_ASSESSED = (
    ", "
    + _SIDES
    + _metrics_sql("pair", "lv", "rv", "lf", "rf")
    + """, margins AS (SELECT p.*,
  similarity - coalesce((SELECT max(similarity) FROM pair o WHERE o.a = p.a AND o.b <> p.b AND o.gates = ''), 0) AS left_margin,
  similarity - coalesce((SELECT max(similarity) FROM pair o WHERE o.b = p.b AND o.a <> p.a AND o.gates = ''), 0) AS right_margin FROM pair p),
assessed AS (SELECT *, concat_ws(',', nullif(gates, ''), CASE WHEN similarity < 0.45 THEN 'similarity_below_minimum' END, CASE WHEN left_margin < 0.08 THEN 'left_runner_up_margin_below_minimum' END,
  CASE WHEN right_margin < 0.08 THEN 'right_runner_up_margin_below_minimum' END) AS failed FROM margins),
matched AS (SELECT a, b FROM assessed WHERE failed = '')
"""
)


def _union_sql(kind: str, key: str, member: str, own: str, other: str) -> str:
    return (
        f""", {kind}_pool AS (SELECT q.{key} AS key, q.{member} AS member, q.similarity, q.iou, k.a IS NOT NULL AS accepted FROM assessed q LEFT JOIN matched k USING (a, b)
  WHERE k.a IS NOT NULL OR q.{member} NOT IN (SELECT {member} FROM matched)),
{kind}_ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY similarity DESC, accepted, member) AS place FROM {kind}_pool),
{kind}_few AS (SELECT * FROM (SELECT *, coalesce(max(place) FILTER (accepted) OVER (PARTITION BY key), 0) > 6 AS late FROM {kind}_ranked) WHERE accepted OR place <= 6 - late::INT),
{kind}_sets AS (SELECT x.key, [x.member, y.member] AS members, [x.place, y.place] AS places, x.accepted OR y.accepted AS has, greatest(x.iou, y.iou) AS single FROM {kind}_few x JOIN {kind}_few y ON x.key = y.key AND x.place < y.place
  UNION ALL SELECT x.key, [x.member, y.member, z.member], [x.place, y.place, z.place], x.accepted OR y.accepted OR z.accepted, greatest(x.iou, y.iou, z.iou)
  FROM {kind}_few x JOIN {kind}_few y ON x.key = y.key AND x.place < y.place JOIN {kind}_few z ON y.key = z.key AND y.place < z.place),
{kind}_union AS (SELECT *, row_number() OVER () AS obj FROM {kind}_sets s WHERE has OR s.key NOT IN (SELECT {key} FROM matched)),
{kind}_ov AS (SELECT u.obj, frame, y, x FROM {kind}_union u JOIN {own}v v ON v.obj = u.key), {kind}_of AS (SELECT u.obj, frame, p FROM {kind}_union u JOIN {own}f v ON v.obj = u.key),
{kind}_e AS (SELECT obj AS union_obj, unnest(members) AS member FROM {kind}_union),
{kind}_uv AS (SELECT DISTINCT union_obj AS obj, frame, y, x FROM {kind}_e JOIN {other}v v ON v.obj = member),
{kind}_uf AS (SELECT union_obj AS obj, frame, max(CASE WHEN EXISTS (SELECT 1 FROM {other}v w WHERE w.obj = v.obj AND w.frame = v.frame) THEN p ELSE 0 END) AS p FROM {kind}_e JOIN {other}f v ON v.obj = member GROUP BY ALL)"""
        + _metrics_sql(f"{kind}_u", f"{kind}_ov", f"{kind}_uv", f"{kind}_of", f"{kind}_uf", same=True)
        + f""", {kind}_best AS (SELECT '{kind}' AS kind, u.key, list_sort(u.members) AS members, m.iou, m.iou - u.single AS gain, m.similarity FROM {kind}_u m JOIN {kind}_union u ON u.obj = m.a
  WHERE gates = '' AND m.iou >= 0.55 AND m.iou - u.single >= 0.15 AND m.similarity >= 0.55
  QUALIFY row_number() OVER (PARTITION BY u.key ORDER BY round(m.iou, 9) DESC, round(m.similarity, 9) DESC, len(u.members), u.places) = 1)"""
    )


def _band(spark, sf_dir) -> list[DataFrame]:
    """Frames of both sides with their masks; a mask holds the voxels of 92 percent or more, so some frames have none."""
    rows = stored(tracks.mask_rows_of(adapters.band(spark, sf_dir), F.col("pct") >= 92, by=("supplier",)))
    return [rows.where(F.col("side") == k) for k in (0, 1)]


def _assessed(sides: list[DataFrame]) -> DataFrame:
    names = (*tracks.RATED, "intersection", "area_a", "area_b")
    return tracks.assess(tracks.overlap_of_rows(*sides, 2048**0.5, names))


@query(sql("band", _ASSESSED + "SELECT a, b, round(similarity, 8) AS similarity, round(left_margin, 8) AS left_margin, round(right_margin, 8) AS right_margin, failed, failed = '' AS matched FROM assessed"))
def tracklet_match(spark, sf_dir):
    """With the margins asked for, a candidate has no rival on either side, so the candidates are the matching (``tracks.match``)."""
    assessed = _assessed(_band(spark, sf_dir))
    rounded = [F.round(c, 8).alias(c) for c in ("similarity", "left_margin", "right_margin")]
    return assessed.select("a", "b", *rounded, F.concat_ws(",", "failed").alias("failed"), F.col("candidate").alias("matched"))


@query(
    sql(
        "band",
        _ASSESSED
        + _union_sql("split", "a", "b", "l", "r")
        + _union_sql("merge", "b", "a", "r", "l")
        + "SELECT kind, key, array_to_string(members, ',') AS members, round(iou, 8) AS iou, round(gain, 8) AS gain, round(similarity, 8) AS similarity FROM (FROM split_best UNION ALL FROM merge_best)",
    )
)
def tracklet_hypotheses(spark, sf_dir):
    """Unions of unmatched tracklets of one side that would make up one of the other."""
    sides = _band(spark, sf_dir)
    assessed = cut(_assessed(sides))
    found = tracks.hypotheses(assessed, tracks.match(assessed), *sides, None, None, diagonal=2048**0.5)
    return found.select("kind", "key", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"), *[F.round(c, 8).alias(c) for c in ("iou", "gain", "similarity")])


@query()
def tracklet_assign(spark, sf_dir):
    """The greatest total similarity of the pairs that pass all gates, whatever their margins."""
    passing = cut(_assessed(_band(spark, sf_dir))).where(~F.exists("failed", lambda r: ~r.contains("runner_up")))
    return tracks.assign(passing, "similarity").select("a", "b", F.round("similarity", 8).alias("score"))


@query()
def seed_sessions(spark, sf_dir):
    return tracks.seed_sessions(adapters.tracklets(spark, sf_dir), 8, 50)


# ---- planes ----


def _plane_query(spark, sf_dir, kernel) -> DataFrame:
    k = adapters.grid_side(spark, sf_dir)
    return planes.per_plane(maskset.union(adapters.evidence(spark, sf_dir)), kernel, (k, k))


_GRID_16 = ", u AS (SELECT DISTINCT t, y, x FROM evidence), g AS (SELECT t, y, x, k FROM (SELECT unnest(range(16))::INT AS t), (SELECT unnest(range(k))::INT AS y, k FROM kk), (SELECT unnest(range(k))::INT AS x FROM kk)), hole AS (SELECT g.t, g.y, g.x, k FROM g ANTI JOIN u USING (t, y, x))"


@query(
    sql(
        "evidence kk",
        _GRID_16 + ", " + _label_sql("hole", "lab", 6, key="t") + """, open AS (SELECT DISTINCT t, label FROM lab, kk WHERE y IN (0, k - 1) OR x IN (0, k - 1))
SELECT t, y, x FROM u UNION ALL SELECT t, y, x FROM lab ANTI JOIN open USING (t, label)""",
        recursive=True,
    )
)
def hole_fill_2d(spark, sf_dir):
    return topology.fill_holes(maskset.union(adapters.evidence(spark, sf_dir)))


def _strong(spark, sf_dir, least: int = 170) -> DataFrame:
    """Voxels of strong scores: enough for parts of many sizes in a plane."""
    return maskset.union(adapters.evidence(spark, sf_dir).where(F.col("score") >= least))


_STRONG = """, st AS (SELECT DISTINCT t, y, x FROM evidence WHERE score >= 170),
g AS (SELECT t, y, x FROM (SELECT unnest(range(16))::INT AS t), (SELECT unnest(range(k))::INT AS y FROM kk), (SELECT unnest(range(k))::INT AS x FROM kk)), bare AS (SELECT * FROM g ANTI JOIN st USING (t, y, x)),
deep AS (SELECT a.t, a.y, a.x, coalesce(sqrt(min((a.y - b.y) ** 2 + (a.x - b.x) ** 2)), 1e9) AS far FROM st a LEFT JOIN bare b ON a.t = b.t GROUP BY ALL)"""


@query(
    sql(
        "evidence kk",
        _STRONG + ", " + _label_sql("st", "lab", 26, key="t") + """, radii AS (SELECT t, label, max(far) AS radius FROM lab JOIN deep USING (t, y, x) GROUP BY t, label)
SELECT t, y, x FROM lab JOIN radii USING (t, label) WHERE radius >= 2""",
        recursive=True,
    )
)
def min_radius_filter(spark, sf_dir):
    k = adapters.grid_side(spark, sf_dir)
    parts = cut(topology.slice_components(_strong(spark, sf_dir), 8))
    thick = topology.part_radii(parts, (k, k)).where("radius >= 2").select("part")
    return parts.join(thick, "part", "left_semi").select("t", "y", "x")


@query(
    sql(
        "evidence kk",
        _STRONG
        + ", "
        + _label_sql("st", "lab", 26, key="t")
        + """, best AS (SELECT t, y, x, max(score) AS score FROM evidence WHERE layer_id IN ('L1', 'L2') GROUP BY ALL),
rated AS (SELECT t, label, max(far) AS radius, coalesce(max(score), 0) AS score FROM lab JOIN deep USING (t, y, x) LEFT JOIN best USING (t, y, x) GROUP BY t, label),
kept AS (SELECT t, y, x FROM lab JOIN rated USING (t, label) WHERE score >= 210 AND radius >= 1.4), """
        + "hole AS (SELECT * FROM g ANTI JOIN kept USING (t, y, x)), "
        + _label_sql("hole", "empty", 6, key="t")
        + """, open AS (SELECT DISTINCT t, label FROM empty, kk WHERE y IN (0, k - 1) OR x IN (0, k - 1))
SELECT t, y, x FROM kept UNION ALL SELECT t, y, x FROM empty ANTI JOIN open USING (t, label)""",
        recursive=True,
    )
)
def plane_cleanup(spark, sf_dir):
    """Parts of a plane by their greatest score in two layers, then by their greatest radius; holes last."""
    k = adapters.grid_side(spark, sf_dir)
    scores = adapters.evidence(spark, sf_dir).where("layer_id IN ('L1', 'L2')")
    return topology.clean_planes(_strong(spark, sf_dir), scores, (k, k), 210, 1.4)


@query(
    sql(
        "evidence kk",
        _STRONG
        + """, d AS (SELECT * FROM (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) s(dy, dx)),
less AS (SELECT s.t, s.y, s.x FROM st s, d JOIN st n ON n.t = s.t AND n.y = s.y + dy AND n.x = s.x + dx GROUP BY ALL HAVING count(*) = 5)
SELECT DISTINCT t, y + dy AS y, x + dx AS x FROM less, d""",
    )
)
def binary_opening(spark, sf_dir):
    k = adapters.grid_side(spark, sf_dir)
    return planes.per_plane(_strong(spark, sf_dir), planes.opened, (k, k))


@query()
def contour_polygons(spark, sf_dir):
    k = adapters.grid_side(spark, sf_dir)
    return planes.outlines(maskset.union(adapters.evidence(spark, sf_dir)), (k, k))


@query()
def edited_shape_resize(spark, sf_dir):
    """Planes as previews at half size, brought back by their signed distance."""
    k = adapters.grid_side(spark, sf_dir)
    preview = resample.presence(maskset.union(adapters.evidence(spark, sf_dir)).withColumn("t", F.col("t") * 2), 2)
    return planes.per_plane(preview, lambda p: planes.resize_by_distance(p[: k // 2, : k // 2], (k, k)), (k, k))


@query()
def policy_inverse_grid(spark, sf_dir):
    """Planes as they were before a smooth displacement."""
    k = adapters.grid_side(spark, sf_dir)

    def undo(plane):
        place = np.arange(k) * (2 * np.pi / k)
        return planes.undo_displacement(plane, *np.broadcast_arrays(np.sin(place)[None, :], np.cos(place)[:, None]))

    return _plane_query(spark, sf_dir, undo)


@query()
def unique_tags(spark, sf_dir):
    return rank.unique_tags(table(spark, sf_dir, "documents"), "doc_id", 4)


@query(sql("evidence", _vote_sql() + """SELECT DISTINCT f.t, f.y, f.x FROM final f JOIN final g ON f.t = g.t AND g.kept AND abs(f.y - g.y) + abs(f.x - g.x) <= 1"""))
def policy_decide_udf(spark, sf_dir):
    """A plug-in decides a plane at a time; what it adds beyond the candidates is dropped by a join."""
    k = adapters.grid_side(spark, sf_dir)
    voxels = vote.weighted_vote(adapters.evidence(spark, sf_dir))
    decided = planes.per_plane(voxels.where("kept"), lambda p: planes.dilate(p), (k, k))
    return decided.join(voxels.select("t", "y", "x"), ["t", "y", "x"], "left_semi")


# ---- traces ----


@query(
    sql(
        "trace",
        """, d AS (SELECT run_id, ts_us // 86400000000 AS day, event, ts_us FROM trace),
p AS (SELECT run_id, day, count_if(event = 'view') AS starts, count_if(event = 'purchase') AS ends, min(ts_us) FILTER (event = 'view') AS begun, min(ts_us) FILTER (event = 'purchase') AS ended FROM d GROUP BY run_id, day),
s AS (SELECT *, CASE WHEN starts <> 1 OR ends <> 1 THEN 'unpaired' WHEN ended < begun THEN 'negative' ELSE 'ok' END AS status FROM p)
SELECT run_id, day, status, CASE WHEN status = 'ok' THEN ended - begun END AS duration FROM s""",
    )
)
def trace_phase_pairs(spark, sf_dir):
    daily = adapters.trace(spark, sf_dir).withColumn("day", F.expr("ts_us div 86400000000"))
    return trace.phase_pairs(daily, ["run_id", "day"], "view", "purchase").select("run_id", "day", "status", "duration")


@query(
    sql(
        "trace",
        """, v AS (SELECT event, (value * 1000)::BIGINT - 5000 AS v FROM trace), r AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY v) AS place, count(*) OVER (PARTITION BY event) AS n FROM v WHERE v >= 0)
SELECT event, count(*) AS n, sum(v)::BIGINT AS total, quantile_cont(v, 0.5)::DOUBLE AS median, max(v) FILTER (place = (n - 1) * 95 // 100 + 1) AS p95, max(v) AS greatest FROM r GROUP BY event""",
    )
)
def trace_duration_summary(spark, sf_dir):
    values = adapters.trace(spark, sf_dir).select("event", (F.round(F.col("value") * 1000).cast("long") - 5000).alias("v"))
    return trace.duration_summary(values, "event", "v")


@query(
    sql(
        "trace",
        """, e AS (SELECT max(ts_us) + 3600000000 AS e FROM trace), h AS (SELECT run_id, event_id, ts_us, least(coalesce(lead(ts_us) OVER (PARTITION BY run_id ORDER BY ts_us, event_id), e), e, ts_us + 15000000) AS until FROM trace, e)
SELECT run_id, count(*) AS samples, sum(greatest(0, until - ts_us))::BIGINT AS held FROM h GROUP BY run_id""",
    )
)
def gpu_hold_interval(spark, sf_dir):
    samples = adapters.trace(spark, sf_dir)
    end = samples.agg(F.max("ts_us")).first()[0] or 0
    held = trace.hold_intervals(samples, "run_id", "ts_us", 15_000_000, F.lit(end + 3_600_000_000))
    return held.groupBy("run_id").agg(F.count(F.lit(1)).alias("samples"), F.sum("held").alias("held"))


@query(
    sql(
        "trace",
        """, f AS (SELECT *, value < lag(value) OVER (PARTITION BY run_id ORDER BY ts_us, event_id) AS fell FROM trace)
SELECT run_id, arg_min(value, (ts_us, event_id)) AS first, arg_max(value, (ts_us, event_id)) AS last, count_if(fell) AS resets, round(arg_max(value, (ts_us, event_id)) - arg_min(value, (ts_us, event_id)), 9) AS delta FROM f GROUP BY run_id""",
    )
)
def counter_delta(spark, sf_dir):
    return trace.counter_deltas(adapters.trace(spark, sf_dir), "run_id", ["ts_us", "event_id"], "value").withColumn("delta", F.round("delta", 9))


@query(
    sql(
        "trace",
        """, s AS (SELECT run_id, count_if(event = 'view') % 4 AS waiting, count_if(event = 'click') % 4 AS running FROM trace GROUP BY run_id)
SELECT CASE WHEN waiting = 0 AND running = 0 THEN 'idle' WHEN waiting = 0 THEN 'served' WHEN running = 0 THEN 'stalled' ELSE 'queued' END AS class, count(*) AS n FROM s GROUP BY 1""",
    )
)
def queue_class(spark, sf_dir):
    state = adapters.trace(spark, sf_dir).groupBy("run_id").agg((F.count_if(F.col("event") == "view") % 4).alias("waiting"), (F.count_if(F.col("event") == "click") % 4).alias("running"))
    return state.groupBy(trace.queue_class(F.col("waiting"), F.col("running")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


# ---- scalars ----


@query("SELECT vec_id, k - 1 AS k, round(1 / (1 + exp(-least(greatest(embedding[k]::DOUBLE * 10, -80), 80))), 9) AS p FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings)")
def sigmoid_decode(spark, sf_dir):
    values = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "v"))
    return values.select("vec_id", "k", F.round(scalars.sigmoid(F.col("v").cast("double") * 10), 9).alias("p"))


@query("SELECT vec_id, k, round(1 / (1 + exp(-least(greatest((embedding[2 * k + 2]::DOUBLE - embedding[2 * k + 1]::DOUBLE) * 10, -80), 80))), 9) AS p FROM (SELECT *, unnest(range(0, len(embedding) // 2)) AS k FROM embeddings)")
def softmax_decode(spark, sf_dir):
    """Values in twos: background and foreground of one cell."""
    values = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.expr("cast(size(embedding) div 2 as int)") - 1)).alias("k"))
    at = lambda n: F.element_at("embedding", 2 * F.col("k") + n).cast("double") * 10
    return values.select("vec_id", "k", F.round(scalars.softmax_foreground(at(1), at(2)), 9).alias("p"))


@query("SELECT vec_id, concat_ws(',', CASE WHEN NOT list_min(embedding)::DOUBLE >= -0.25 THEN 'low' END, CASE WHEN NOT list_max(embedding)::DOUBLE <= 0.25 THEN 'far' END, CASE WHEN NOT label % 2 = 0 THEN 'odd' END) AS reasons FROM embeddings")
def gate_reason_array(spark, sf_dir):
    low, high = F.array_min("embedding").cast("double"), F.array_max("embedding").cast("double")
    reasons = scalars.failed_gates(("low", low >= -0.25), ("far", high <= 0.25), ("odd", F.col("label") % 2 == 0))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.concat_ws(",", reasons).alias("reasons"))


@query(
    """WITH n AS (SELECT c_custkey, c_nationkey - 12 AS x, c_custkey % 7 - 3 AS y, c_custkey % 5 - 2 AS t FROM customer),
s AS (SELECT c_custkey, sqrt(x * x + y * y + t * t) AS length, CASE WHEN t < 0 OR (t = 0 AND (y < 0 OR (y = 0 AND x < 0))) THEN -1 ELSE 1 END AS s, x, y, t FROM n),
c AS (SELECT c_custkey, length, round_even(degrees(acos(-s * t / length)) - 90, 0)::BIGINT AS up, round_even((degrees(atan2(s * y, s * x)) + 360) % 360, 0)::BIGINT % 360 AS around FROM s WHERE length > 0)
SELECT c_custkey, 536870913 + up * 360 + CASE up WHEN 0 THEN around % 180 WHEN 90 THEN 0 ELSE around END AS code FROM c
UNION ALL SELECT c_custkey, NULL FROM s WHERE length = 0"""
)
def normal_bin_codes(spark, sf_dir):
    normal = (F.col("c_nationkey") - 12, F.col("c_custkey") % 7 - 3, F.col("c_custkey") % 5 - 2)
    return table(spark, sf_dir, "customer").select("c_custkey", sections.plane_code(*[c.cast("double") for c in normal]).alias("code"))


@query("SELECT o_orderkey, 4 * (o_orderkey % 7 + 1) >= 3 * (o_custkey % 9 + 1) AS pass FROM orders")
def ratio_threshold(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.ratio_at_least(F.col("o_orderkey") % 7 + 1, F.col("o_custkey") % 9 + 1, 3, 4).alias("pass"))


@query("SELECT p_partkey, CASE WHEN length(p_name || '-' || p_type) <= 16 THEN p_name || '-' || p_type ELSE (p_name || '-' || p_type)[1:7] || '-' || sha256(p_name || '-' || p_type)[1:8] END AS name FROM part")
def bounded_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalars.bounded_name(F.concat_ws("-", "p_name", "p_type"), 16).alias("name"))


_DIGITS_62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


@query(
    f"""WITH d AS (SELECT doc_id, list_transform(range(1, 65), lambda k: strpos('0123456789abcdef', substr(sha256(doc_id::VARCHAR), k, 1)) - 1) AS hex FROM documents),
n AS (SELECT doc_id, list_reduce(list_concat([0::HUGEINT], list_transform(hex, lambda h: h::HUGEINT)), lambda a, h: (a * 16 + h) % {62**16}::HUGEINT) AS n FROM d),
p AS (SELECT doc_id, n, unnest(range(16)) AS k FROM n)
SELECT doc_id, string_agg(substr('{_DIGITS_62}', ((n // CASE k {" ".join(f"WHEN {k} THEN {62 ** (15 - k)}::HUGEINT" for k in range(16))} END) % 62)::INT + 1, 1), '' ORDER BY k) AS tag FROM p GROUP BY doc_id"""
)
def base62_tags(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scalars.base62_tag(F.sha2(F.col("doc_id").cast("string"), 256), 16).alias("tag"))


_CRC = """xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(1, length({0}) + 1), lambda k: ascii(substr({0}, k, 1))::UBIGINT)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], list_transform(range(8), lambda z: 0::UBIGINT)), lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))), 4294967295::UBIGINT)"""


@query(f"SELECT doc_id, (({_CRC.format('own_key')} & 536870911::UBIGINT)::BIGINT | {sections.UNKNOWN}) AS code FROM (SELECT doc_id, source || '|' || lang AS own_key FROM documents)")
def section_group_codes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", sections.unknown_code(F.concat_ws("|", "source", "lang")).alias("code"))


@query("SELECT p_partkey, 'a' || replace(CASE WHEN (p_partkey * 25 % 1000) % 100 = 0 THEN (p_partkey * 25 % 1000 // 100)::VARCHAR WHEN (p_partkey * 25 % 1000) % 10 = 0 THEN (p_partkey * 25 % 1000 // 100)::VARCHAR || '.' || ((p_partkey * 25 % 1000) % 100 // 10)::VARCHAR ELSE (p_partkey * 25 % 1000 // 100)::VARCHAR || '.' || lpad(((p_partkey * 25 % 1000) % 100)::VARCHAR, 2, '0') END, '.', 'p') AS name FROM part")
def angle_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalars.angle_name(F.col("p_partkey") * 25 % 1000 / 100).alias("name"))
