"""Reader of raw recordings as a Spark data source, `raw_recording`.

A file has a header of five little-endian unsigned 64-bit numbers, columns, rows, frames, sample rate and version;
records start at byte 30720. A record is an unsigned 64-bit clock tick and then a byte for each pixel. The place of a frame
follows from its number, so each task reads a range of frames on its own, and filters on n leave ranges out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

HEADER = 30 * 1024
SCHEMA = "n long, ticks long, px binary"


def read_header(path: str, swap: bool = False) -> dict:
    import struct

    with open(path, "rb") as f:
        a, b, n, rate, version = struct.unpack("<5Q", f.read(40))
    w, h = (b, a) if swap else (a, b)
    return {"width": w, "height": h, "frames": n, "sample_rate": rate, "version": version}


@dataclass
class Range(InputPartition):
    start: int
    stop: int


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.head = read_header(self.path, options.get("swap", "false").lower() == "true")
        limit = options.get("max_frames")
        self.low, self.high = 0, min(self.head["frames"], int(limit)) if limit else self.head["frames"]
        self.per_task = int(options.get("frames_per_task", 512))

    def pushFilters(self, filters):
        for f in filters:
            if getattr(f, "attribute", None) == ("n",) and isinstance(getattr(f, "value", None), int):
                if isinstance(f, EqualTo):
                    self.low, self.high = max(self.low, f.value), min(self.high, f.value + 1)
                elif isinstance(f, GreaterThan):
                    self.low = max(self.low, f.value + 1)
                elif isinstance(f, GreaterThanOrEqual):
                    self.low = max(self.low, f.value)
                elif isinstance(f, LessThan):
                    self.high = min(self.high, f.value)
                elif isinstance(f, LessThanOrEqual):
                    self.high = min(self.high, f.value + 1)
            yield f  # Spark filters the rows, too

    def partitions(self):
        return [Range(a, min(a + self.per_task, self.high)) for a in range(self.low, self.high, self.per_task)] or [Range(0, 0)]

    def read(self, part: Range):
        import struct

        size = self.head["width"] * self.head["height"]
        with open(self.path, "rb") as f:
            f.seek(HEADER + part.start * (8 + size))
            for n in range(part.start, part.stop):
                tick = struct.unpack("<Q", f.read(8))[0]
                if tick >= 1 << 63:
                    raise ValueError(f"frame {n}: clock tick over 2**63")
                yield n, tick, f.read(size)


class RawRecording(DataSource):
    @classmethod
    def name(cls):
        return "raw_recording"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(dict(self.options))


def load(spark, path: str, max_frames: int | None = None, frames_per_task: int = 512):
    """The recording as a FramePipe; the file has to be at the same path on all machines."""
    from ..plans.index import Shape
    from ..plans.pipe import FramePipe

    spark.dataSource.register(RawRecording)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # the reader takes filters on n
    head = read_header(path)
    n = min(head["frames"], max_frames) if max_frames else head["frames"]
    packed = spark.read.format("raw_recording").option("frames_per_task", frames_per_task).options(**({"max_frames": max_frames} if max_frames else {})).load(path)
    bytes_ = packed.select("n", F.posexplode(_values()("px")).alias("p", "v"))
    frame = bytes_.select("n", F.lit(0).alias("c"), F.floor(F.col("p") / head["width"]).cast("int").alias("y"), (F.col("p") % head["width"]).cast("int").alias("x"), "v")
    return FramePipe(frame, Shape(n, 1, head["height"], head["width"]), ticks=packed.select("n", "ticks"))


def _values():
    """The bytes of a frame as numbers, a batch of frames at once."""
    @F.pandas_udf("array<double>")
    def values(frames: pd.Series) -> pd.Series:
        return frames.map(lambda b: np.frombuffer(b, np.uint8).astype(np.float64))

    return values


def blocks(spark, path: str, max_frames: int | None = None, frames_per_task: int = 64, layout=None):
    """The recording as a BlockPipe: a row of bytes for each frame, no row for a pixel."""
    from ..plans.blocks import BlockPipe, Layout, Source, Table
    from ..plans.index import Shape

    spark.dataSource.register(RawRecording)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # the reader takes filters on n
    head = read_header(path)
    n = min(head["frames"], max_frames) if max_frames else head["frames"]
    packed = spark.read.format("raw_recording").option("frames_per_task", frames_per_task).options(**({"max_frames": max_frames} if max_frames else {})).load(path)
    h, w = head["height"], head["width"]

    def read(batch):
        for number, frame in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield 0, number, 0, 0, np.frombuffer(frame.as_buffer(), np.uint8).reshape(1, h, w)

    shape, one = Shape(n, 1, h, w), Layout(1, h, w)
    return BlockPipe([Table(packed.select(F.col("n"), F.col("px")), read, "n", one, shape, "u1")], Source(0, shape), layout or one)
