"""Chunked array folders of the second Zarr format, uncompressed or with zlib, as packed blocks.

A stack is a group: `frames` (frame, channel, row, column), and, if there are any, `metadata/timestamps` and
`metadata/frame_index_in_recording` by frame. Each chunk is a file, named by its place in the grid, and a row for Spark: a
chunk is a block, so a plan that keeps the layout exchanges nothing. The name says where a chunk lies, and Spark filters files
by name before it opens them: a range reads its own chunks. Chunks that are not there hold the fill value.

Writing: tasks write whole chunks under a name of their own and rename them, so a task that runs again leaves the same
file; an array's description is written last, and only what is described can be read. The folder has to be at the same
path on all machines.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.blocks import SCHEMA, Block, BlockPipe, Layout, Source, Table, read_blocks
from ..plans.index import Shape
from ..plans.pipe import FramePipe

FRAMES, TICKS, INDEX = "frames", "metadata/timestamps", "metadata/frame_index_in_recording"
#: Types that doubles hold exactly, and the type that pieces of them are exchanged as.
KINDS = {"|u1": "u1", "|i1": "i1", "<u2": "<u2", "<i2": "<i2", "<u4": "<u4", "<i4": "<i4", "<f4": "<f4", "<f8": "<f8", ">u2": "<u2", ">i2": "<i2", ">f4": "<f4", ">f8": "<f8"}


def _text(spark: SparkSession, path: str) -> str:
    """A small file of any store that Spark reaches. Spark's readers leave out names that begin with a dot."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _has(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def describe(spark: SparkSession, path: str) -> dict:
    """The description of an array."""
    d = json.loads(_text(spark, f"{path}/.zarray"))
    coder = d["compressor"]
    if d["zarr_format"] != 2 or d["order"] != "C" or d.get("filters") or (coder and coder["id"] != "zlib"):
        raise ValueError(f"{path}: only arrays of format 2 in row order, uncompressed or with zlib, are read")
    return d


def _chunks(spark: SparkSession, path: str, d: dict) -> DataFrame:
    """i0, i1, ... (a chunk's place in the grid) and content of each chunk's file."""
    mark, parts = d.get("dimension_separator", "."), len(d["shape"])
    if mark != ".":
        raise ValueError(f"{path}: chunks in nested folders are not read")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[0-9]*").load(path)
    at = [F.split_part("_metadata.file_name", F.lit("."), F.lit(k + 1)).cast("long").alias(f"i{k}") for k in range(parts)]
    return files.select(*at, "content")


def _values(content: bytes, d: dict) -> np.ndarray:
    raw = zlib.decompress(content) if d["compressor"] else content
    return np.frombuffer(raw, d["dtype"]).reshape(d["chunks"])


def blocks(spark: SparkSession, path: str, max_frames: int | None = None, array: str = FRAMES) -> BlockPipe:
    """The stack as a plan over its chunks."""
    d = describe(spark, f"{path}/{array}")
    if d["dtype"] not in KINDS or len(d["shape"]) != 4:
        raise ValueError(f"{path}: frames have to be numbers by frame, channel, row and column")
    n, c, h, w = d["shape"]
    n = min(n, max_frames) if max_frames else n
    shape, (cn, cc, ch, cw) = Shape(n, c, h, w), d["chunks"]
    layout = Layout(cn, ch, cw)
    held = _chunks(spark, f"{path}/{array}", d).select((F.col("i0") * cn).alias("n0"), (F.col("i1") * cc).alias("c0"), (F.col("i2") * ch).alias("y0"), (F.col("i3") * cw).alias("x0"), "content")
    fill = float(d["fill_value"] or 0) if d["fill_value"] not in ("NaN", "Infinity", "-Infinity") else float(d["fill_value"].replace("Infinity", "inf"))
    grid = [-(-size // step) for size, step in zip((n, c, h, w), d["chunks"], strict=True)]
    # the whole grid is met with the files' names only where some are missing
    missing = held.where(F.col("n0") < n).select("n0", "c0", "y0", "x0").count() < int(np.prod(grid))
    if missing:
        every = spark.range(int(np.prod(grid))).select("id")
        steps = [int(np.prod(grid[k + 1 :])) for k in range(4)]
        places = every.select(*((F.floor(F.col("id") / steps[k]) % grid[k] * d["chunks"][k]).cast("long").alias(a) for k, a in enumerate(("n0", "c0", "y0", "x0"))))
        held = places.join(held, ["n0", "c0", "y0", "x0"], "left")

    def read(batch: pa.RecordBatch) -> Iterator[Block]:
        head = [batch.column(k).to_pylist() for k in range(4)]
        for n0, c0, y0, x0, content in zip(*head, batch.column(4), strict=True):
            if n0 >= n:
                continue
            a = _values(content.as_buffer(), d) if content.is_valid else np.full(d["chunks"], fill)
            a = a[: n - n0, : c - c0, : h - y0, : w - x0]  # chunks at the edge are padded
            for k in range(a.shape[1]):
                yield c0 + k, n0, y0, x0, a[:, k]

    kind = "<f8" if missing and not np.can_cast(np.min_scalar_type(fill), np.dtype(d["dtype"])) else KINDS[d["dtype"]]
    return BlockPipe([Table(held, read, "n0", layout, shape, kind, "y0", "x0")], Source(0, shape), layout)


def series(spark: SparkSession, path: str, array: str = TICKS, name: str = "ticks") -> DataFrame:
    """n and the value of each frame of an array by frame; chunks without a file are left out."""
    d = describe(spark, f"{path}/{array}")
    [total], [step] = d["shape"], d["chunks"]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                v = _values(content.as_buffer(), d)[: max(0, total - i * step)].astype(np.int64)
                yield pa.record_batch([pa.array(np.arange(i * step, i * step + len(v))), pa.array(v)], names=["n", name])

    return _chunks(spark, f"{path}/{array}", d).mapInArrow(run, f"n long, {name} long")


def load(spark: SparkSession, path: str, max_frames: int | None = None) -> FramePipe:
    """The stack as pixels, with its timestamps if it has them."""
    pipe = blocks(spark, path, max_frames)
    ticks = series(spark, path) if _has(spark, f"{path}/{TICKS}/.zarray") else None
    return FramePipe(pipe.all(), pipe.shape, ticks=ticks)


def _put(path: str, content: bytes) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    own = f"{path}.{uuid.uuid4().hex}.part"
    with open(own, "wb") as f:
        f.write(content)
    os.replace(own, path)


def _array(path: str, shape: tuple[int, ...], chunks: tuple[int, ...], kind: str, level: int | None) -> None:
    d = {"zarr_format": 2, "shape": list(shape), "chunks": list(chunks), "dtype": kind, "compressor": None if level is None else {"id": "zlib", "level": level}, "fill_value": 0, "order": "C", "filters": None}
    _put(f"{path}/.zarray", json.dumps(d, indent=1).encode())


def _range_of(kind: str) -> tuple[float, float] | None:
    t = np.dtype(kind)
    return (float(np.iinfo(t).min), float(np.iinfo(t).max)) if t.kind in "iu" else None


def _put_series(path: str, step: int, level: int | None):
    def put(table: pa.Table) -> pa.Table:
        i = table.column("i")[0].as_py()
        v = np.zeros(step, "<i8")
        v[table.column("n").to_numpy() - i * step] = table.column("ticks").to_numpy()
        _put(f"{path}/{i}", v.tobytes() if level is None else zlib.compress(v.tobytes(), level))
        return pa.table({"i": pa.array([i], pa.int64())})

    return put


def save(pipe: BlockPipe, path: str, kind: str = "|u1", chunks: Layout | None = None, ticks: DataFrame | None = None, level: int | None = None, overwrite: bool = False) -> None:
    """Writes a stack; values are cut off to the kind's range and towards 0. ticks: n and ticks of the frames.

    level: that of zlib, none for uncompressed chunks.
    """
    if os.path.exists(f"{path}/.zgroup") and not overwrite:
        raise FileExistsError(path)
    s, layout = pipe.shape, chunks or pipe.layout
    size, ends = (layout.n, min(layout.y, s.y), min(layout.x, s.x)), _range_of(kind)

    def write(batches) -> Iterator[pa.RecordBatch]:
        written = 0
        for b in batches:
            for c, n, y, x, a in read_blocks(b):
                whole = np.zeros(size)
                whole[: a.shape[0], : a.shape[1], : a.shape[2]] = np.clip(a, *ends) if ends else a
                content = whole.astype(kind).tobytes()
                _put(f"{path}/{FRAMES}/{n // size[0]}.{c}.{y // size[1]}.{x // size[2]}", content if level is None else zlib.compress(content, level))
                written += 1
        yield pa.record_batch([pa.array([written], pa.int64())], names=["written"])

    laid = pipe.laid(*size)
    laid.blocks().select(*(f.split()[0] for f in SCHEMA.split(", "))).mapInArrow(write, "written long").agg(F.sum("written")).collect()  # numbers of chunks
    _array(f"{path}/{FRAMES}", (s.n, s.c, s.y, s.x), (size[0], 1, *size[1:]), kind, level)
    step = 1 << 16
    for name, source in ((TICKS, ticks), (INDEX, pipe.tables[0].frame.sparkSession.range(s.n).select(F.col("id").alias("n"), F.col("id").alias("ticks")))):
        if source is None:
            continue
        numbered = source.select(F.col("n").cast("long").alias("n"), F.col("ticks").cast("long").alias("ticks"), F.floor(F.col("n") / step).cast("long").alias("i"))
        numbered.groupBy("i").applyInArrow(_put_series(f"{path}/{name}", step, level), "i long").count()
        _array(f"{path}/{name}", (s.n,), (step,), "<i8", level)
    _put(f"{path}/metadata/.zgroup", b'{"zarr_format": 2}')
    _put(f"{path}/.zgroup", b'{"zarr_format": 2}')


def arrays(spark: SparkSession, path: str) -> dict[str, dict]:
    """The description of each known array of a stack, by its name."""
    return {name: describe(spark, f"{path}/{name}") for name in (FRAMES, TICKS, INDEX) if _has(spark, f"{path}/{name}/.zarray")}
