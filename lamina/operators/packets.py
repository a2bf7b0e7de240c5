"""Sparse crop packets: packed masks of the nonempty frames of a tile, checked, and OR-ed into a view by 64-bit words.

A packet (a row of ``pack``) is one frame's crop: its place in the tile, its size, and its rows of bits, lowest first, each padded to whole bytes. An artifact
is the packets of one tile over a range of frames, declared by a row: shape, place in the view, bytes, foreground and the SHA-256 of its payloads in frame order.
Nothing larger than a crop, or the digests of one plane's rows, meets in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PACKET = "artifact string, frame int, top int, left int, height int, width int, stride int, size long, foreground long, payload binary"
_WORD = 64


def pack(masks: DataFrame) -> DataFrame:
    """Packets of (artifact, frame, y, x), whose y and x count from the tile's corner. ``at`` is the offset of a payload in its artifact.

    Bits meet by byte, and the bytes of a crop (the empty ones between them come from its box) in one array.
    """
    keys = ["artifact", "frame"]
    cells = masks.select("artifact", F.col("frame").cast("int").alias("frame"), "y", "x").distinct()
    boxes = cells.groupBy(*keys).agg(
        F.min("y").alias("top"), F.min("x").alias("left"), (F.max("y") - F.min("y") + 1).alias("height"), (F.max("x") - F.min("x") + 1).alias("width"), F.count(F.lit(1)).alias("foreground")
    )
    boxes = boxes.withColumn("stride", F.floor((F.col("width") + 7) / 8).cast("int")).withColumn("size", F.col("height").cast("long") * F.col("stride"))
    off = F.col("x") - F.col("left")
    set_bits = cells.join(boxes, keys).select(*keys, ((F.col("y") - F.col("top")) * F.col("stride") + F.floor(off / 8)).cast("long").alias("byte"), F.expr("shiftleft(1, (x - left) % 8)").alias("bits"))
    empty = boxes.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)).alias("byte"), F.lit(0).alias("bits"))
    filled = set_bits.unionByName(empty).groupBy(*keys, "byte").agg(F.bit_or("bits").alias("bits"))
    ordered = F.array_sort(F.collect_list(F.struct("byte", "bits")))
    payload = F.unhex(F.array_join(F.transform(ordered, lambda b: F.lpad(F.hex(b["bits"]), 2, "0")), ""))
    packed = boxes.join(filled.groupBy(*keys).agg(payload.alias("payload")), keys)
    before = Window.partitionBy("artifact").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    return packed.select(*[c.split()[0] for c in PACKET.split(", ")]).withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0)))


def declare(packets: DataFrame, tiles: DataFrame) -> DataFrame:
    """A row for each artifact of ``tiles`` (artifact, frame_start, frames, height, width, y0, x0) with its bytes, foreground and digest."""
    totals = packets.groupBy("artifact").agg(F.sum("size").alias("bytes"), F.sum("foreground").alias("pixels"), _payload_digest().alias("sha256"))
    filled = tiles.join(totals, "artifact", "left")
    return filled.withColumn("bytes", F.coalesce("bytes", F.lit(0))).withColumn("pixels", F.coalesce("pixels", F.lit(0))).withColumn("sha256", F.coalesce("sha256", F.sha2(F.lit(b""), 256)))


def _payload_digest() -> Column:
    """SHA-256 of an artifact's digests of payloads in frame order, so payloads themselves are not gathered."""
    ordered = F.array_sort(F.collect_list(F.struct("frame", F.sha2("payload", 256).alias("digest"))))
    return F.sha2(F.array_join(F.transform(ordered, lambda p: p["digest"]), ""), 256)


def checked(packets: DataFrame, artifacts: DataFrame) -> DataFrame:
    """``packets`` with the place (y0, x0) of their artifact. Anything that differs from the declaration is an error:

    frames twice or out of range, crops outside the tile, wrong stride or length, gaps or overlaps of payloads, other totals or another digest, and packets without an artifact.
    """
    fail = lambda test, what: F.when(test, F.raise_error(F.concat(F.lit(f"{what}: "), "artifact")))
    along = Window.partitionBy("artifact").orderBy("at", "frame")
    joined = packets.join(artifacts.withColumnsRenamed({"height": "tile_height", "width": "tile_width"}), "artifact", "left")
    placed = joined.withColumn("stop", F.lag(F.col("at") + F.col("size")).over(along)).withColumn("prior", F.lag("frame").over(along))
    c = F.col
    each = F.coalesce(
        fail(c("prior") >= c("frame"), "frames out of order or twice"),
        fail((c("frame") < c("frame_start")) | (c("frame") >= c("frame_start") + c("frames")), "frame out of range"),
        fail((c("top") < 0) | (c("left") < 0) | (c("top") + c("height") > c("tile_height")) | (c("left") + c("width") > c("tile_width")), "crop outside its tile"),
        fail((c("height") < 1) | (c("width") < 1) | (c("stride") != F.floor((c("width") + 7) / 8)) | (c("size") != c("height") * c("stride")) | (F.octet_length("payload") != c("size")), "wrong packed size"),
        fail(c("at") != F.coalesce("stop", F.lit(0)), "payloads not contiguous"),
        F.lit(True),
    )
    totals = packets.groupBy("artifact").agg(F.sum("size").alias("got_bytes"), F.sum("foreground").alias("got_pixels"), _payload_digest().alias("got_sha256"))
    whole = artifacts.join(totals, "artifact", "left")
    every = F.coalesce(
        fail((F.coalesce("got_bytes", F.lit(0)) != c("bytes")) | (F.coalesce("got_pixels", F.lit(0)) != c("pixels")), "other totals"),
        fail(F.coalesce("got_sha256", F.sha2(F.lit(b""), 256)) != c("sha256"), "other digest"),
        F.lit(True),
    )
    sound = whole.select("artifact", every.alias("sound"))
    # a left join, so that no packet leaves unseen
    known = F.coalesce("sound", F.raise_error(F.concat(F.lit("packet without an artifact: "), "artifact")))
    kept = placed.join(sound, "artifact", "left").where(known).where(each)
    return kept.select(*packets.columns, "y0", "x0")


def words(packets: DataFrame) -> DataFrame:
    """(frame, y, word, bits): the set bits of checked packets in the view, by words of 64 columns. A payload with another count of bits, or with bits
    in its padding, is an error."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                bits = np.unpackbits(np.frombuffer(r["payload"], np.uint8).reshape(r["height"], r["stride"]), axis=1, bitorder="little")
                if bits[:, r["width"] :].any() or int(bits.sum()) != r["foreground"]:
                    raise ValueError(f"foreground of a packet of {r['artifact']} differs from its payload")
                x = r["x0"] + r["left"]
                wide = np.zeros((r["height"], -(-(x % _WORD + r["width"]) // _WORD) * _WORD), np.uint8)
                wide[:, x % _WORD : x % _WORD + r["width"]] = bits[:, : r["width"]]
                packed = np.packbits(wide, axis=1, bitorder="little").view("<i8")
                y, word = np.nonzero(packed)
                columns = [np.full(len(y), r["frame"], np.int32), (y + r["y0"] + r["top"]).astype(np.int32), (word + x // _WORD).astype(np.int32), packed[y, word]]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], ["frame", "y", "word", "bits"])

    return packets.mapInArrow(decode, "frame int, y int, word int, bits long")


def into_view(found: DataFrame) -> DataFrame:
    """Words of one view: packets of overlapping tiles are OR-ed, before and after the shuffle."""
    return found.groupBy("frame", "y", "word").agg(F.bit_or("bits").alias("bits"))


def view_digests(view: DataFrame) -> DataFrame:
    """(frame, foreground, digest): of each row the hash of its words, of each plane the hash of its rows' hashes, so no plane is gathered."""
    word = F.struct("word", F.concat("word", F.lit(":"), F.lower(F.hex("bits"))).alias("text"))
    row = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(word)), lambda w: w["text"]), ","), 256)
    rows = view.groupBy("frame", "y").agg(row.alias("digest"), F.sum(F.bit_count("bits")).alias("n"))
    line = F.struct("y", F.concat("y", F.lit("="), "digest").alias("text"))
    plane = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda r: r["text"]), ";"), 256)
    return rows.groupBy("frame").agg(F.sum("n").alias("foreground"), plane.alias("digest"))
