"""Relays between mailboxes until a fixed point, in batch rounds and as keyed streaming state; and idempotent ingestion.

The merge of a mailbox - union of voxels and sources, greatest probability - is associative, commutative
and idempotent, so every order of arrival, and late or repeated data, ends in one state.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lamina.session import checkpoint_dir, cut

STATE = "prob double, revision long, sources array<long>"
MAILBOX = "tile long, prob double, revision long, sources array<long>"


def relay_fixed_point(seeds: DataFrame, links: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(lineage, tile, round): tiles that a lineage reaches over links (tile, other), each in the round that first reaches it.

    A round relays only what the last one reached; the state is checkpointed, so each round's plan is as long as the first's.
    """
    state = cut(seeds.select("lineage", "tile").distinct().withColumn("round", F.lit(0)))
    front = state
    for number in range(1, max_rounds):
        reached = front.join(links, "tile").select("lineage", F.col("other").alias("tile")).distinct()
        front = cut(reached.join(state, ["lineage", "tile"], "left_anti").withColumn("round", F.lit(number)))
        if front.isEmpty():
            return state
        state = cut(state.unionByName(front))
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def _offer(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    prob, revision, sources = state.get if state.exists else (0.0, 0, [])
    known, best = set(sources), prob
    for pdf in batches:
        known |= {int(s) for s in pdf.source}
        best = max(best, float(pdf.prob.max()))
    if best != prob or len(known) != len(sources) or not state.exists:
        # new foreground makes the mailbox dirty again, however late it comes
        revision += 1
        state.update((best, revision, sorted(known)))
    yield pd.DataFrame({"tile": [key[0]], "prob": [best], "revision": [revision], "sources": [sorted(known)]})


def mailbox_stream(offers: DataFrame) -> DataFrame:
    """State of each tile's mailbox after each batch of offers (tile, source, prob)."""
    return offers.groupBy("tile").applyInPandasWithState(_offer, MAILBOX, STATE, "update", GroupStateTimeout.NoTimeout)


LEDGER, HELD = "work_id long, sha string", "sha string"


def _ingest(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    held = state.get[0] if state.exists else None
    for pdf in batches:
        for sha in pdf.sha.unique():
            if held is None:
                held = str(sha)
                state.update((held,))
                yield pd.DataFrame({"work_id": [key[0]], "sha": [held]})
            elif sha != held:
                raise ValueError(f"packet with two contents: {key[0]}")


def ledger_stream(packets: DataFrame) -> DataFrame:
    """Each packet (work_id, sha) once, in the batch that brings it first; one id with another content is an error, however much later it comes.

    What is known of an id is its keyed state, so a batch costs what it holds and not what came before it.
    """
    return packets.select("work_id", "sha").groupBy("work_id").applyInPandasWithState(_ingest, LEDGER, HELD, "append", GroupStateTimeout.NoTimeout)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, mode: str = "update") -> DataFrame:
    """All that a stream yields of the files there are, written batch by batch to the shared folder, with its ``batch`` number."""
    spark = stream.sparkSession
    target = _folder(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/rows/batch={number}")

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{target}/state")
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    return spark.read.schema(f"{fields}, batch int").parquet(f"{target}/rows")


def run_ingestion(packets: DataFrame) -> DataFrame:
    """The ledger (work_id, sha) after a stream of packets."""
    return run_available(ledger_stream(packets), "append").select("work_id", "sha")


def file_stream(spark: SparkSession, path: str, schema: str, files_a_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def windowed_counts(events: DataFrame, at: str, width: str, late: str | None, key: str) -> DataFrame:
    """Tumbling counts by event time. Without ``late`` every event counts, however late it comes, and all windows stay open; with it, windows that
    are so far behind the latest event are closed and their state is dropped, as are later events of theirs."""
    timed = events if late is None else events.withWatermark(at, late)
    return (
        timed.groupBy(F.window(at, width).alias("w"), key)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("start"), key, "n")
    )


def sessions(events: DataFrame, at: str, gap: str, late: str, key: str) -> DataFrame:
    return (
        events.withWatermark(at, late)
        .groupBy(F.session_window(at, gap).alias("s"), key)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), key, "n")
    )
