"""Registered queries: fixed points and Structured Streaming over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators import tiles
from lamina.plans.catalog import query
from lamina.plans.catalog_curation import _TILES
from lamina.plans.catalog_curation import _tiles as tile_table
from lamina.session import table
from lamina.sources.adapters import sql
from lamina.streaming import state

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _events(spark, sf_dir) -> DataFrame:
    # as a pattern, so that the table may be one file or a folder
    return state.file_stream(spark, f"{sf_dir}/[e]vents.parquet", EVENTS)


@query(
    sql(
        "kk",
        _TILES
        + """, links AS (SELECT a.tile, b.tile AS other FROM tiles a JOIN tiles b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND a.tile <> b.tile),
seeds AS (SELECT DISTINCT s_suppkey % 10 AS lineage, (s_suppkey % 2) * 1000 AS tile FROM supplier),
walk AS (SELECT lineage, tile, 0 AS round FROM seeds UNION SELECT lineage, other, round + 1 FROM walk JOIN links USING (tile) WHERE round < 12)
SELECT lineage, tile, min(round) AS round FROM walk GROUP BY lineage, tile""",
        recursive=True,
    )
)
def frontier_fixed_point(spark, sf_dir):
    links = tiles.neighbours(tile_table(spark, sf_dir)).select("tile", "other")
    seeds = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 10).alias("lineage"), (F.col("s_suppkey") % 2 * 1000).cast("int").alias("tile"))
    return state.relay_fixed_point(seeds, links)


@query("SELECT user_id % 16 AS tile, max(value) AS prob, list_sort(list_distinct(list(event_id % 50))) AS sources FROM events GROUP BY 1")
def frontier_stream(spark, sf_dir):
    """Mailboxes after the stream: the last revision of each, the same for every order of arrival."""
    offers = _events(spark, sf_dir).select((F.col("user_id") % 16).alias("tile"), (F.col("event_id") % 50).alias("source"), F.col("value").alias("prob"))
    found = state.run_available(state.mailbox_stream(offers))
    return found.groupBy("tile").agg(F.max_by(F.struct("prob", "sources"), F.struct("batch", "revision")).alias("s")).select("tile", "s.prob", "s.sources")


@query("SELECT DISTINCT event_id % 700 AS work_id, sha256((event_id % 700)::VARCHAR) AS sha FROM events")
def coverage_ledger_stream(spark, sf_dir):
    work = F.col("event_id") % 700
    return state.run_ingestion(_events(spark, sf_dir).select(work.alias("work_id"), F.sha2(work.cast("string"), 256).alias("sha")))


@query("SELECT epoch_us(ts) // 21600000000 * 21600 AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_window_counts(spark, sf_dir):
    events = _events(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp"))
    found = state.run_available(state.windowed_counts(events, "at", "6 hours", None, "event_type"))
    last = found.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"))
    return last.select(F.unix_seconds("start").alias("start"), "event_type", "n")
