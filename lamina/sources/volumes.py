"""Sources and sinks of masks, labels, manifests, archives and telemetry, as Spark readers and Python data sources."""

from __future__ import annotations

import glob
import gzip
import io
import json
import os
import tarfile
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RUNS = "path string, t int, y int, x0 int, x1 int"


def nrrd_header(content: bytes) -> tuple[dict[str, str], int]:
    """Fields of an NRRD header, and where the payload begins."""
    stop = content.index(b"\n\n") + 2
    lines = content[:stop].decode("ascii").split("\n")
    if not lines[0].startswith("NRRD"):
        raise ValueError("not an NRRD file")
    fields = dict(line.split(":", 1) for line in lines[1:] if ":" in line and not line.startswith("#"))
    return {k.strip().lower(): v.strip().lstrip("=") for k, v in fields.items()}, stop


def volume_shape(fields: dict[str, str]) -> tuple[int, int, int]:
    """(planes, rows, columns) of an 8-bit volume."""
    if fields["type"] not in ("uint8", "uchar", "unsigned char"):
        raise ValueError(f"unsupported type {fields['type']}")
    width, height, depth = map(int, fields["sizes"].split())
    return depth, height, width


def plane_runs(plane: np.ndarray) -> np.ndarray:
    """Rows (y, x0, x1) of the foreground of a plane."""
    edge = np.diff(np.pad(plane != 0, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    starts, stops = np.argwhere(edge == 1), np.argwhere(edge == -1)
    return np.column_stack([starts, stops[:, 1]])


def nrrd_planes(file: BinaryIO, first: int = 0, stop: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(t, plane) of an open volume, a plane in memory at a time: raw data are read from plane ``first`` on, gzip data are inflated up to ``stop``."""
    head = b""
    while b"\n\n" not in head:
        more = file.read(4096)
        if not more:
            raise ValueError("not an NRRD file")
        head += more
    fields, at = nrrd_header(head)
    depth, height, width = volume_shape(fields)
    stop, size = depth if stop is None else min(stop, depth), height * width
    if fields.get("encoding") in ("gzip", "gz"):
        file.seek(at)
        data, skip = gzip.GzipFile(fileobj=file), first * size
        while skip:  # inflated and dropped in pieces
            skip -= len(data.read(min(skip, 1 << 20)) or _short())
    else:
        file.seek(at + first * size)
        data = file
    for t in range(first, stop):
        plane = data.read(size)
        if len(plane) != size:
            _short()
        yield t, np.frombuffer(plane, np.uint8).reshape(height, width)


def _short() -> bytes:
    raise ValueError("a volume ends before its last plane")


def run_batches(name: str, planes: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for t, plane in planes:
        runs = plane_runs(plane).astype(np.int32)
        if len(runs):
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(runs), pa.string()), pa.array(np.full(len(runs), t, np.int32)), *[pa.array(runs[:, k]) for k in range(3)]], ["path", "t", "y", "x0", "x1"]
            )


def decode_nrrd_runs(files: DataFrame) -> DataFrame:
    """Runs of the foreground of volumes (path, content), inflated a plane at a time."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                yield from run_batches(name, nrrd_planes(io.BytesIO(content.as_buffer())))

    return files.select("path", "content").mapInArrow(cut, RUNS)


def read_nrrd_runs(spark: SparkSession, path: str) -> DataFrame:
    """Runs of the foreground of every volume under ``path``; files are read by Spark, so any store it knows will do."""
    return decode_nrrd_runs(spark.read.format("binaryFile").option("pathGlobFilter", "*.nrrd").load(path))


class _Slab(InputPartition):
    def __init__(self, path: str, first: int, stop: int):
        self.path, self.first, self.stop = path, first, stop


class _SlabReader(DataSourceReader):
    def __init__(self, path: str, planes: int, shape: str):
        self.path, self.planes, self.shape = path, planes, shape

    def partitions(self) -> list[InputPartition]:
        """Ranges of planes of raw volumes, whole gzip ones; a shape other than the one given is an error, before any plane is read."""
        found: list[InputPartition] = []
        for path in sorted(glob.glob(f"{self.path}/*.nrrd") if os.path.isdir(self.path) else [self.path]):
            with open(path, "rb") as file:
                fields, at = nrrd_header(file.read(1 << 16))
            depth, height, width = volume_shape(fields)
            if self.shape and self.shape != f"{depth},{height},{width}":
                raise ValueError(f"{path} has shape {depth},{height},{width}, not {self.shape}")
            if fields.get("encoding") in ("gzip", "gz"):
                found.append(_Slab(path, 0, depth))
                continue
            if os.path.getsize(path) != at + depth * height * width:
                raise ValueError(f"{path} has not the length of its shape")
            found += [_Slab(path, k, min(k + self.planes, depth)) for k in range(0, depth, self.planes)]
        return found

    def read(self, slab: _Slab) -> Iterator[pa.RecordBatch]:
        with open(slab.path, "rb") as file:
            yield from run_batches(slab.path, nrrd_planes(file, slab.first, slab.stop))


class NrrdSlabs(DataSource):
    """``spark.read.format("nrrd_slabs").option("planes", 16).option("shape", "t,y,x").load(folder)``: runs of the foreground, a partition a slab.

    The folder is one that every executor mounts; ``read_nrrd_runs`` reads volumes of any store, one a task.
    """

    @classmethod
    def name(cls) -> str:
        return "nrrd_slabs"

    def schema(self) -> str:
        return RUNS

    def reader(self, schema) -> DataSourceReader:
        return _SlabReader(self.options["path"], max(1, int(self.options.get("planes", 16))), self.options.get("shape", ""))


def check_shapes(volumes: DataFrame, manifest: DataFrame) -> DataFrame:
    """(filename, planes, rows, columns) of the layers of ``manifest`` (filename, shape as text t,y,x); a layer without a volume, or with another shape, is an error.

    ``volumes`` has path and content; only the headers are looked at.
    """

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = [volume_shape(nrrd_header(bytes(c.as_buffer()[: 1 << 16]))[0]) for c in batch["content"]]
            names = [p.rsplit("/", 1)[-1] for p in batch["path"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([s[k] for s in shapes], pa.int32()) for k in range(3)]], ["filename", "planes", "rows", "columns"])

    found = volumes.select("path", "content").mapInArrow(head, "filename string, planes int, rows int, columns int")
    joined = manifest.select("filename", "shape").join(found, "filename", "left")
    has = F.concat_ws(",", "planes", "rows", "columns")
    ok = F.when(F.col("planes").isNull(), F.raise_error(F.concat(F.lit("no volume: "), "filename"))).when(
        has != F.col("shape"), F.raise_error(F.concat(F.lit("other shape: "), "filename"))
    ).otherwise(True)
    return joined.where(ok).select("filename", "planes", "rows", "columns")


def nrrd_bytes(volume: np.ndarray, name: str = "Segment_1") -> bytes:
    """A gzip-encoded segmentation of one binary segment."""
    if not np.isin(volume, (0, 1)).all():
        raise ValueError("a mask holds 0 and 1 only")
    depth, height, width = volume.shape
    header = f"NRRD0004\ntype: uint8\ndimension: 3\nsizes: {width} {height} {depth}\nencoding: gzip\nSegment0_Name:={name}\n\n"
    return header.encode() + gzip.compress(volume.astype(np.uint8).tobytes(), mtime=0)


def encode_nrrd(voxels: DataFrame, shape: tuple[int, int, int], key: str = "layer_id") -> DataFrame:
    """(key, content): a file for each layer. A layer is one bounded volume of ``shape``, made in one group."""

    def make(table: pa.Table) -> pa.Table:
        volume = np.zeros(shape, np.uint8)
        volume[tuple(table[c].to_numpy() for c in ("t", "y", "x"))] = 1
        return pa.table({key: table[key].slice(0, 1), "content": pa.array([nrrd_bytes(volume)], pa.binary())})

    return voxels.select(key, "t", "y", "x").groupBy(key).applyInArrow(make, f"{key} string, content binary")


def read_polygon_labels(spark: SparkSession, path: str) -> DataFrame:
    """(path, class, points) of label files with a class and normalised x y pairs a line."""
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), F.split(F.trim("value"), r"\s+").alias("f"))
    numbers = F.transform(F.slice("f", 2, F.size("f")), lambda v: v.cast("double"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.expr("cast((size(f) - 1) div 2 as int)") - 1),
        lambda k: F.struct(F.get(numbers, k * 2).alias("x"), F.get(numbers, k * 2 + 1).alias("y")),
    )
    return lines.where((F.size("f") >= 7) & (F.size("f") % 2 == 1)).select("path", F.col("f")[0].cast("int").alias("class"), pairs.alias("points"))


def annotation_states(frames: DataFrame, labels: DataFrame, files: DataFrame) -> DataFrame:
    """State of each frame: foreground with polygons, known background with an empty file, else unknown."""
    some = labels.select("frame").distinct().withColumn("has", F.lit(True))
    known = files.select("frame").distinct().withColumn("file", F.lit(True))
    state = F.when(F.col("has"), "foreground").when(F.col("file"), "known_background").otherwise("unknown")
    return frames.join(some, "frame", "left").join(known, "frame", "left").select("frame", state.alias("state"))


def read_manifest_layers(spark: SparkSession, path: str) -> DataFrame:
    """Additive union layers of a manifest; duplicate names, or axes other than (X,Y,t), are errors."""
    manifest = spark.read.option("multiLine", True).json(path)
    layers = manifest.select("exported_axes", F.explode("layers").alias("l")).select("exported_axes", "l.*")
    layers = layers.where("layer_role = 'additive_component' AND recomposition_op = 'union'")
    checked = layers.groupBy("filename").agg(F.count(F.lit(1)).alias("n"), F.min("exported_axes").alias("axes"), F.min("mask_kind").alias("mask_kind"))
    ok = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("layer listed twice: "), "filename"))).when(
        F.col("axes") != "(X,Y,t)", F.raise_error(F.lit("unexpected axes"))
    ).otherwise(True)
    return checked.where(ok).select("filename", "mask_kind")


def write_with_manifest(df: DataFrame, path: str) -> None:
    """Write ``df``, then a one-row manifest whose presence means that the table is complete."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}/data")
    rows = spark.read.parquet(f"{path}/data").count()
    text = json.dumps({"status": "complete", "rows": rows, "columns": df.columns}, sort_keys=True, allow_nan=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def read_complete(spark: SparkSession, path: str) -> DataFrame:
    """A table written by ``write_with_manifest``; one without its manifest, or with other rows, is an error."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first().value)
    found = spark.read.parquet(f"{path}/data")
    if manifest["status"] != "complete" or found.count() != manifest["rows"]:
        raise ValueError(f"{path} is not complete")
    return found


TELEMETRY = "trace_session string, sequence long, event string, run_id string, task_id string, hostname string, monotonic_ns long"


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """Events of JSON lines: torn lines are left out, repeated ones count once, and one identity with two contents is an error."""
    raw = spark.read.schema(f"{TELEMETRY}, torn string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "torn").json(path)
    events = raw.where("torn IS NULL AND sequence IS NOT NULL").drop("torn").distinct()
    content: Column = F.struct(*[c for c in events.columns if c not in ("trace_session", "sequence")])
    one = events.groupBy("trace_session", "sequence").agg(F.min(content).alias("content"), F.count(F.lit(1)).alias("n"))
    ok = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("conflicting event "), F.col("sequence").cast("string")))).otherwise(True)
    return one.where(ok).select("trace_session", "sequence", "content.*")


def discover_volumes(paths: DataFrame) -> DataFrame:
    """(stem, frames, missing) of indexed files: names that end in an underscore and a number are frames of one volume."""
    name = F.regexp_extract("path", r"([^/]+?)(?:_(\d+))?\.[^.]+$", 1)
    index = F.regexp_extract("path", r"([^/]+?)(?:_(\d+))?\.[^.]+$", 2)
    return (
        paths.select(name.alias("stem"), F.nullif(index, F.lit("")).cast("int").alias("index"))
        .groupBy("stem")
        .agg(F.count(F.lit(1)).alias("frames"), F.coalesce(F.max("index") - F.min("index") + 1 - F.count_distinct("index"), F.lit(0)).alias("missing"))
    )


class _Member(InputPartition):
    def __init__(self, name: str, offset: int, size: int):
        self.name, self.offset, self.size = name, offset, size


class _TarReader(DataSourceReader):
    def __init__(self, path: str, prefix: str):
        self.path, self.prefix = path, prefix

    def partitions(self) -> list[InputPartition]:
        """The index of the archive; a torn tail ends it."""
        found: list[InputPartition] = []
        with tarfile.open(self.path) as archive:
            try:
                for member in archive:
                    if member.isfile() and member.name.startswith(self.prefix):
                        found.append(_Member(member.name, member.offset_data, member.size))
            except tarfile.ReadError:
                pass
        return found

    def read(self, partition: _Member) -> Iterator[tuple]:
        with open(self.path, "rb") as file:
            file.seek(partition.offset)
            content = file.read(partition.size)
        if len(content) == partition.size:
            yield partition.name, partition.size, content


class TarMembers(DataSource):
    """``spark.read.format("tar_members").load(path)``: name, size and content of members, a partition each.

    The archive lies in a folder that every executor mounts; ``read_tar`` reads archives of any store.
    """

    @classmethod
    def name(cls) -> str:
        return "tar_members"

    def schema(self) -> str:
        return "name string, size long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _TarReader(self.options["path"], self.options.get("prefix", ""))


def read_tar(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """(archive, name, content) of the members of archives that Spark reads; an archive is one row and fits a task."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                with tarfile.open(fileobj=io.BytesIO(content)) as archive:
                    for member in archive:
                        if member.isfile() and member.name.startswith(prefix):
                            data = archive.extractfile(member).read()
                            yield pa.RecordBatch.from_pydict({"archive": [name], "name": [member.name], "content": pa.array([data], pa.binary())})

    return files.mapInArrow(members, "archive string, name string, content binary")


def write_polygon_lines(outlines: DataFrame, shape: tuple[int, int], path: str) -> None:
    """Label lines of outlines (t, points as text of x y pairs), partitioned by frame."""
    height, width = shape
    scaled = F.transform(
        F.split("points", " "), lambda v, k: F.format_string("%.6f", v.cast("double") / F.when(k % 2 == 0, float(width)).otherwise(float(height)))
    )
    outlines.select("t", F.concat_ws(" ", F.lit("0"), scaled).alias("value")).write.mode("overwrite").partitionBy("t").text(path)
