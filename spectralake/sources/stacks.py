"""Image stack files as a data source: partitions are frame ranges, read as streams.

A camera's format is a codec, a class that opens no files itself:

``header(stream)`` reads the head of a stream and returns a dictionary with ``frames``
(their number), ``first`` (the number of the first one) and whatever ``rows`` needs;
``rows(stream, header, first, last)`` seeks and yields ``(frame, y, block)`` for the frames
from ``first`` to ``last``: ``block`` holds some image rows as a two-dimensional array, the
first of them row ``y``.

No task holds more than one such block. ``RawStack`` is the codec of the plain files that
``write_stacks`` makes.
"""

import fnmatch
import importlib
import json
import os
import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from spectralake.sources.files import opened, write_files
from spectralake.sources.shots import FRAME_ROWS

FORMAT = "image_stacks"
BLOCK_BYTES = 4 << 20
HEADER_THREADS = 32
RAW_CODEC = "spectralake.sources.stacks:RawStack"


class RawStack:
    """One line of JSON, then the frames' pixels by row: little-endian numbers of one type.

    Where a file's frames do not all have each row once, ``index`` is the length of a second
    line: the stretches ``[frame, y, n]`` of rows that the file holds, in their order.
    """

    @staticmethod
    def header(stream):
        line = b""
        while not line.endswith(b"\n"):
            some = stream.read(4096)
            if not some:
                raise ValueError("no header line")
            line = (line + some).split(b"\n")[0] + (b"\n" if b"\n" in some else b"")
        head = json.loads(line)
        return {"first": 0, **head, "at": len(line) + head.get("index", 0)}

    @staticmethod
    def rows(stream, header, first, last):
        kind = np.dtype(header["dtype"]).newbyteorder("<")
        height, width = header["height"], header["width"]
        step = max(1, BLOCK_BYTES // (width * kind.itemsize))
        for frame, start, rows, before in RawStack.stretches(stream, header, first, last):
            stream.seek(header["at"] + before * width * kind.itemsize)
            for y in range(start, start + rows, step):
                n = min(step, start + rows - y)
                data = stream.read(n * width * kind.itemsize)
                yield frame, y, np.frombuffer(data, kind).reshape(n, width)

    @staticmethod
    def stretches(stream, header, first, last):
        """(frame, first y, rows, rows of the file before it) of what the frames hold."""
        if not header.get("index"):
            for frame in range(first, last + 1):
                yield frame, 0, header["height"], (frame - header["first"]) * header["height"]
            return
        stream.seek(header["at"] - header["index"])
        before = 0
        for frame, y, n in json.loads(stream.read(header["index"])):
            if first <= frame <= last:
                yield frame, y, n, before
            before += n

    @staticmethod
    def head(first, frames, height, width, dtype):
        """The header line of a file."""
        return (json.dumps({"first": first, "frames": frames, "height": height, "width": width, "dtype": dtype}) + "\n").encode()


def codec_of(name):
    """The codec that ``module:Class`` names."""
    module, _, cls = name.partition(":")
    return getattr(importlib.import_module(module), cls)


def shot_of(path):
    """The shot number a file name begins with, or None."""
    found = re.match(r"([^_.]*)", os.path.basename(path))[1]
    return int(found) if re.fullmatch(r"\s*[+-]?\d+\s*", found) else None


class Span:
    """The values that a column's pushed filters leave: an interval and, if given, a set."""

    def __init__(self):
        self.lo, self.hi, self.some = None, None, None

    def add(self, f):
        v = f.value
        if isinstance(f, EqualTo):
            self.some = {v} if self.some is None else self.some & {v}
        elif isinstance(f, In):
            self.some = set(v) if self.some is None else self.some & set(v)
        elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            v = v + isinstance(f, GreaterThan)
            self.lo = v if self.lo is None else max(self.lo, v)
        else:
            v = v - isinstance(f, LessThan)
            self.hi = v if self.hi is None else min(self.hi, v)

    def cut(self, first, last):
        """The part of first..last that may hold values, as a smaller range, or None."""
        inside = None if self.some is None else [v for v in self.some if first <= v <= last]
        if inside is not None:
            first, last = (min(inside), max(inside)) if inside else (1, 0)
        first = first if self.lo is None else max(first, self.lo)
        last = last if self.hi is None else min(last, self.hi)
        return (first, last) if first <= last else None


@dataclass
class FrameRange(InputPartition):
    """Some frames of one file."""

    path: str
    shot: int
    first: int
    last: int
    header: dict


class StackSource(DataSource):
    """Options: ``path``, ``glob`` of file names, ``codec``, ``frames`` of a partition at most."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return FRAME_ROWS

    def reader(self, schema):
        return StackReader(self.options)


class StackReader(DataSourceReader):
    """Plans frame ranges from file names and headers, and streams them.

    Filters on ``shot`` drop files by name before any is opened, filters on ``frame`` drop
    ranges; Spark applies them to the rows once more. Of several files of a shot with the
    same first frame the newest counts, as in the shot index. Files without a shot number
    are not read.
    """

    def __init__(self, options):
        self.path, self.glob = options["path"], options.get("glob", "*")
        self.codec, self.frames = options.get("codec", RAW_CODEC), int(options.get("frames", 64))
        self.spans = {"shot": Span(), "frame": Span()}

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in self.spans and isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                self.spans[column].add(f)
            yield f

    def files(self):
        """(shot, path, time) of the files that filters on ``shot`` leave."""
        fs, path = opened(self.path)
        for info in fs.get_file_info(pafs.FileSelector(path, recursive=True)):
            shot = shot_of(info.path)
            if info.is_file and shot is not None and fnmatch.fnmatch(info.base_name, self.glob) and self.spans["shot"].cut(shot, shot):
                yield shot, info.path, info.mtime_ns or 0

    def partitions(self):
        codec, fs = codec_of(self.codec), opened(self.path)[0]

        def header(found):
            with fs.open_input_file(found[1]) as stream:
                return codec.header(stream)

        files = list(self.files())
        with ThreadPoolExecutor(HEADER_THREADS) as pool:
            heads = list(pool.map(header, files))
        newest = {}
        for (shot, path, time), head in zip(files, heads):
            key = shot, head["first"]
            if key not in newest or newest[key][:2] < (time, path):
                newest[key] = time, path, head
        ranges = []
        for (shot, start), (_, path, head) in sorted(newest.items()):
            for first in range(start, start + head["frames"], self.frames):
                kept = self.spans["frame"].cut(first, min(first + self.frames, start + head["frames"]) - 1)
                if kept:
                    ranges.append(FrameRange(path, shot, *kept, head))
        return ranges

    def read(self, partition):
        if partition is None:      # Spark's stand-in where nothing is left to read
            return
        codec, fs = codec_of(self.codec), opened(self.path)[0]
        with fs.open_input_file(partition.path) as stream:
            for frame, y, block in codec.rows(stream, partition.header, partition.first, partition.last):
                n, width = block.shape
                row = pa.ListArray.from_arrays(np.arange(0, n * width + 1, width, dtype=np.int32), np.ascontiguousarray(block, np.float64).ravel())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, partition.shot)), pa.array(np.full(n, frame)), pa.array(np.arange(y, y + n)), row],
                    ["shot", "frame", "y", "row"])


def scan_stacks(spark, path, codec=RAW_CODEC, glob="*", frames=64):
    """``FRAME_ROWS`` of all stack files below ``path``; ``frames`` is the most a task reads of a file.

    ``codec`` is ``module:Class`` of a module that the workers can import. Filters on
    ``shot`` and ``frame`` right behind the scan choose files and frames before any is read.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StackSource)
    return spark.read.format(FORMAT).option("codec", codec).option("glob", glob).option("frames", frames).load(path)


def write_stacks(frame_rows, path, dtype="uint16", frames=1024, suffix="stk"):
    """Write image rows as ``RawStack`` files, one for every ``frames`` frames of a shot.

    All rows are as wide; frames and rows may be missing or come again, which the file's head
    then lists. A hot shot is spread over its files. The head is one more row before the
    first image row. Image rows without pixels (NULL) are not written.
    """
    packed = frame_rows.where(F.col("row").isNotNull()).select("shot", "frame", "y", F.transform("row", lambda v: v.cast("double")).alias("row")).withColumn(
        "file", F.concat_ws("_", "shot", F.format_string(f"%06d.{suffix}", F.floor(F.col("frame") / frames))))

    def encoded(batches):
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index("row"))
            data = [np.asarray(r.values).astype(dtype).tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([*batch.select(["file", "frame", "y"]).columns, pa.array(data, pa.binary())], ["file", "frame", "y", "data"])

    order = F.struct(F.col("frame").cast("long").alias("frame"), F.col("y").cast("long").alias("y"))
    pixels = packed.select("file", "frame", "y", "row").mapInArrow(encoded, "file string, frame long, y long, data binary")
    # stretches of rows that follow each other; file rows lie by frame and y
    lie = W.partitionBy("file").orderBy("frame", "y")
    follows = (F.col("frame") == F.lag("frame").over(lie)) & (F.col("y") == F.lag("y").over(lie) + 1)
    some = packed.select("file", F.col("frame").cast("long").alias("frame"), F.col("y").cast("long").alias("y"), F.size("row").alias("width"))
    some = some.withColumn("starts", F.when(follows, 0).otherwise(1)).withColumn("stretch", F.sum("starts").over(lie.rowsBetween(W.unboundedPreceding, 0)))
    some = some.groupBy("file", "stretch", "frame").agg(F.min("y").alias("y"), F.count("*").alias("n"), F.max("width").alias("width"))
    heads = some.groupBy("file").agg(
        F.min("frame").alias("first"), (F.max("frame") - F.min("frame") + 1).alias("frames"), F.max(F.col("y") + F.col("n")).alias("height"),
        F.max("width").alias("width"), F.count("*").alias("stretches"), F.max("y").alias("y"), F.min("y").alias("y0"), F.min("n").alias("n"),
        F.array_sort(F.collect_list(F.struct("stretch", "frame", "y", "n"))).alias("held"))
    whole = (F.col("stretches") == F.col("frames")) & (F.col("y") == 0) & (F.col("y0") == 0) & (F.col("n") == F.col("height"))
    held = F.transform("held", lambda s: F.concat(F.lit("["), F.concat_ws(",", s["frame"], s["y"], s["n"]), F.lit("]")))
    listed = F.when(~whole, F.concat(F.lit("["), F.array_join(held, ","), F.lit("]\n")))
    fields = F.struct("first", "frames", "height", "width", F.lit(dtype).alias("dtype"), F.length("listed").alias("index"))
    heads = heads.withColumn("listed", listed)
    line = F.concat(F.to_json(fields), F.lit("\n"), F.coalesce("listed", F.lit("")))
    head = heads.select("file", F.struct(F.lit(-1).cast("long").alias("frame"), F.lit(-1).cast("long").alias("y")).alias("part"),
                        F.encode(line, "UTF-8").alias("data"))
    write_files(head.unionByName(pixels.select("file", order.alias("part"), "data")), path)
