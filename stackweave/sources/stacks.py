"""Stacks from tables: frames as arrays, signals of events, and sums of sales."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.index import Shape
from ..plans.ordered import Numbered, scanned
from ..plans.pipe import FramePipe


def from_arrays(df: DataFrame, n: str, values: str, height: int, width: int, frames: int | None = None) -> FramePipe:
    """Frames from an array column in row order, (c height + y) width + x; `n` numbers them without gaps."""
    px = df.select(F.col(n).cast("long").alias("n"), F.posexplode(values).alias("p", "v"))
    area = height * width
    frame = px.select("n", F.floor(F.col("p") / area).cast("int").alias("c"), F.floor(F.col("p") % area / width).cast("int").alias("y"), (F.col("p") % width).cast("int").alias("x"), F.col("v").cast("double").alias("v"))
    if frames is None:
        frames = df.agg(F.max(n)).head()[0]
        frames = 0 if frames is None else frames + 1
    return FramePipe(frame, Shape(frames, 1, height, width))


def from_pixels(df: DataFrame, shape: Shape) -> FramePipe:
    return FramePipe(df.select("n", "c", "y", "x", "v"), shape)


def to_arrays(pipe: FramePipe) -> DataFrame:
    """n and px, the values of each frame in row order: the packed layout. A frame is one row."""
    px = F.transform(F.array_sort(F.collect_list(F.struct("c", "y", "x", "v"))), lambda p: p.v)
    return pipe.all().groupBy("n").agg(px.alias("px"))


def signals(events: DataFrame, by: str, time: str, order: str, value: str) -> DataFrame:
    """n, ticks (microseconds) and v of each event within its kind, in order of time."""
    rows = events.select(by, order, F.unix_micros(F.col(time).cast("timestamp")).alias("ticks"), F.col(value).alias("v"))
    return scanned(rows, [by], ["ticks", order], Numbered()).select(by, "n", "ticks", "v")


def summed_grid(df: DataFrame, n, y, x, value, shape: Shape) -> FramePipe:
    """A stack of sums; places without rows are 0."""
    sums = df.groupBy(n.cast("long").alias("n"), y.cast("int").alias("y"), x.cast("int").alias("x")).agg(F.sum(value).cast("double").alias("v"))
    spark = df.sparkSession
    grid = spark.range(shape.n * shape.y * shape.x).select(F.floor(F.col("id") / (shape.y * shape.x)).alias("n"), F.floor(F.col("id") / shape.x % shape.y).cast("int").alias("y"), (F.col("id") % shape.x).cast("int").alias("x"))
    full = grid.join(sums, ["n", "y", "x"], "left").select("n", F.lit(0).alias("c"), "y", "x", F.coalesce("v", F.lit(0.0)).alias("v"))
    return FramePipe(full, shape)
