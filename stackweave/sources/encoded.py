"""Encoded stacks: a Parquet folder with one row for each frame, n, ticks, offset, length, payload, and a header beside it.

offset is the sum of the lengths before a frame, ticks its clock tick or null. Frames are stored in order of n, so that a
filter on n skips files and row groups. The header is a `Header` record, see records, and so is any metadata of a type of
one's own: all of it is read and written by Spark. A stack that grows (streaming.windows.append_encoded) has a log of its batches instead
of a number of frames in its header.
"""

from __future__ import annotations

import dataclasses
import zlib
from typing import Literal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregate import digest
from ..operators.window import exclusive_offsets
from ..plans.index import Shape
from ..plans.pipe import FramePipe
from . import records
from .stacks import to_arrays

FORMAT = "stackweave.frames"
KINDS = {"uint8": "u1", "float64": "<f8"}


@dataclasses.dataclass
class Codec:
    """How frames are encoded; a step rounds values to its multiples and so loses some."""

    kind: Literal["uint8", "float64"] = "uint8"
    name: Literal["zlib"] = "zlib"
    step: float = 0.0


@dataclasses.dataclass
class Header:
    """What a stack's folder says of it. frames is None where a log of batches says how many there are."""

    format: Literal["stackweave.frames"]
    channels: int
    height: int
    width: int
    codec: Codec
    frames: int | None = None
    attributes: dict[str, str] = dataclasses.field(default_factory=dict)

    version = 2
    upgrades = {1: lambda old: {"format": old["format"], "channels": old["c"], "height": old["y"], "width": old["x"], "codec": {"kind": old["kind"], "name": old["codec"], "step": old["step"]}, "frames": old["n"], "attributes": {}}}


def _encode(kind: str, step: float):
    import numpy as np

    @F.pandas_udf("binary")
    def encode(px: pd.Series) -> pd.Series:
        def one(values):
            a = np.asarray(values, np.float64)
            a = np.round(a / step) * step if step else a
            a = np.clip(a, 0, 255) if kind == "uint8" else a
            return zlib.compress(np.ascontiguousarray(a.astype(KINDS[kind])).tobytes())

        return px.map(one)

    return encode


def _decode(kind: str):
    import numpy as np

    @F.pandas_udf("array<double>")
    def decode(payload: pd.Series) -> pd.Series:
        return payload.map(lambda b: np.frombuffer(zlib.decompress(b), KINDS[kind]).astype(np.float64))

    return decode


def encode(pipe: FramePipe, kind: str = "uint8", step: float = 0.0) -> DataFrame:
    """n, ticks, offset, length, payload of each frame. Values have to fit the kind; a step rounds them and so loses some."""
    coded = to_arrays(pipe).select("n", _encode(kind, step)("px").alias("payload")).withColumn("length", F.length("payload").cast("long"))
    ticks = pipe.timestamps().select("n", F.col("ticks").cast("long").alias("ticks")) if pipe.ticks is not None else None
    coded = coded.join(ticks, "n", "left") if ticks is not None else coded.withColumn("ticks", F.lit(None).cast("long"))
    return exclusive_offsets(coded).select("n", "ticks", "offset", "length", "payload")


def _head(pipe: FramePipe, codec: Codec, attributes: dict | None) -> Header:
    s = pipe.shape
    return Header(FORMAT, s.c, s.y, s.x, codec, s.n, attributes or {})


def put_header(spark: SparkSession, path: str, head: Header, mode: str = "error") -> None:
    records.frame(spark, [head], Header).coalesce(1).write.mode(mode).parquet(f"{path}/header")


def save(pipe: FramePipe, path: str, kind: str = "uint8", step: float = 0.0, mode: str = "error", metadata=None, attributes: dict[str, str] | None = None) -> None:
    """Writes a stack with the pipe's ticks. metadata: a record of a type of one's own; attributes: texts by name."""
    spark = pipe.frame.sparkSession
    encode(pipe, kind, step).repartitionByRange("n").sortWithinPartitions("n").write.mode(mode).parquet(f"{path}/frames")
    if metadata is not None:
        records.frame(spark, [metadata], type(metadata)).coalesce(1).write.mode(mode).parquet(f"{path}/metadata")
    put_header(spark, path, _head(pipe, Codec(kind, "zlib", float(step)), attributes), mode)  # last: a folder with a header is whole


def metadata(spark: SparkSession, path: str, kind: type):
    """The metadata of a stack as a record of this type."""
    [found] = records.read(spark.read.parquet(f"{path}/metadata"), kind)
    return found


def header(spark: SparkSession, path: str) -> Header:
    [head] = records.read(spark.read.parquet(f"{path}/header"), Header)
    return head


def batches(spark: SparkSession, path: str) -> DataFrame:
    """batch, frames, bytes and last (the greatest number of a frame) of each batch that has been added to a growing stack."""
    return spark.read.schema("frames long, bytes long, last long, batch long").parquet(f"{path}/log")


def stored(spark: SparkSession, path: str) -> DataFrame:
    """n, ticks, offset, length, payload of the frames of a stack; of a growing one those of the batches in its log."""
    kind = "n long, ticks long, offset long, length long, payload binary"
    if header(spark, path).frames is not None:
        return spark.read.schema(kind).parquet(f"{path}/frames")
    frames = spark.read.schema(f"{kind}, batch long").parquet(f"{path}/frames")
    return frames.join(batches(spark, path).select("batch"), "batch", "left_semi").drop("batch")


def load(spark: SparkSession, path: str) -> FramePipe:
    head = header(spark, path)
    n = head.frames
    if n is None:
        last = batches(spark, path).agg(F.max("last")).head()[0]
        n = 0 if last is None else last + 1
    shape, rows = Shape(n, head.channels, head.height, head.width), stored(spark, path)
    frames = rows.select("n", F.posexplode(_decode(head.codec.kind)("payload")).alias("p", "v"))
    area, w = shape.y * shape.x, shape.x
    pixels = frames.select("n", F.floor(F.col("p") / area).cast("int").alias("c"), F.floor(F.col("p") % area / w).cast("int").alias("y"), (F.col("p") % w).cast("int").alias("x"), "v")
    return FramePipe(pixels, shape, ticks=rows.select("n", "ticks"))


def _times(pipe: FramePipe) -> str | None:
    """A digest of the ticks, or None if there are none: sums of hashes, in any order."""
    if pipe.ticks is None:
        return None
    held = pipe.timestamps().where("ticks is not null")
    count, total = held.agg(F.count(F.lit(1)), F.sum(F.xxhash64("n", F.col("ticks").cast("long")).cast("decimal(38,0)"))).head()
    return f"{count} {total}" if count else None


def verify(pipe: FramePipe, path: str) -> bool:
    """Whether what is stored has the digest of the pipe's frames, and its ticks."""
    back = load(pipe.frame.sparkSession, path)
    return digest(pipe.all()).head() == digest(back.all()).head() and _times(pipe) == _times(back)


def compress(pipe: FramePipe, path: str, kind: str = "uint8", **options) -> dict:
    """Saves a stack, verifies what was written and says so: ok, ratio, frames. What is not equal is left in its place."""
    save(pipe, path, kind, **options)
    return {"ok": verify(pipe, path), "ratio": ratio(pipe.frame.sparkSession, path), "frames": pipe.shape.n}


def ratio(spark: SparkSession, path: str) -> float:
    """Encoded bytes over those of the values."""
    import numpy as np

    head = header(spark, path)
    frames, total = stored(spark, path).agg(F.count(F.lit(1)), F.sum("length")).head()
    return (total or 0) / max(1, frames * head.channels * head.height * head.width * np.dtype(KINDS[head.codec.kind]).itemsize)


def inspect(spark: SparkSession, path: str) -> str:
    """The fields of a stack's frames, header and metadata, as an indented list."""
    from pyspark.errors import AnalysisException

    out = []
    for part in ("frames", "header", "metadata"):
        try:
            out.append(records.structure(spark.read.parquet(f"{path}/{part}").schema, part))
        except AnalysisException:
            continue  # there is no metadata
    return "\n".join(out)
