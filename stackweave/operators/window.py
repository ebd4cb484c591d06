"""Operators over neighbouring frames of each pixel.

Windows are valid and left-aligned: output i comes from the frames i to i + k - 1, and there are N - k + 1 outputs. Each
pixel's frames are one window partition, so the work is spread over the pixels; frames have to be numbered without gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.index import Halo, Reach, Shape
from ..plans.ordered import EmaRate, scanned
from ..plans.pipe import Op

PIXEL = ("c", "y", "x")


def _ahead(k: int):
    return Window.partitionBy(*PIXEL).orderBy("n").rowsBetween(0, k - 1)


def _valid(df: DataFrame, k: int, value: Column) -> DataFrame:
    full = F.count(F.lit(1)).over(_ahead(k))
    return df.select("n", *PIXEL, value.alias("v"), full.alias("_k")).where(F.col("_k") == k).drop("_k")


def moving_mean(k: int) -> Op:
    return Op(f"moving_mean({k})", lambda df, _: _valid(df, k, F.avg("v").over(_ahead(k))), Halo({"n": Reach(k)}))


def temporal_contrast(k: int = 7, eps: float = 1e-6) -> Op:
    """sqrt(|E[v^2] - E[v]^2| + eps) / (E[v] + eps) over k frames."""

    def value() -> Column:
        mean, square = F.avg("v").over(_ahead(k)), F.avg(F.col("v") * F.col("v")).over(_ahead(k))
        return F.sqrt(F.abs(square - mean * mean) + eps) / (mean + eps)

    return Op(f"temporal_contrast({k})", lambda df, _: _valid(df, k, value()), Halo({"n": Reach(k)}))


def running_temporal_contrast(k: int, eps: float = 1e-6) -> Op:
    """temporal_contrast from two running sums: work that does not grow with k, but more rounding."""

    def apply(df: DataFrame, _: Shape) -> DataFrame:
        w = Window.partitionBy(*PIXEL).orderBy("n")
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        sums = df.select("n", *PIXEL, F.sum("v").over(upto).alias("s"), F.sum(F.col("v") * F.col("v")).over(upto).alias("q"), F.row_number().over(w).alias("_k"))
        last = lambda c: (F.col(c) - F.coalesce(F.lag(c, k).over(w), F.lit(0.0))) / k
        both = sums.select(F.col("n") - (k - 1), *PIXEL, last("s").alias("m"), last("q").alias("q"), "_k").where(F.col("_k") >= k)
        value = F.sqrt(F.abs(F.col("q") - F.col("m") * F.col("m")) + eps) / (F.col("m") + eps)
        return both.toDF("n", *PIXEL, "m", "q", "_k").select("n", *PIXEL, value.alias("v"))

    return Op(f"running_temporal_contrast({k})", apply, Halo({"n": Reach(k)}))


def cumulative_mean(df: DataFrame) -> DataFrame:
    """The mean of each pixel's frames up to each frame."""
    upto = Window.partitionBy(*PIXEL).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("v", F.avg("v").over(upto))


def elapsed(df: DataFrame, by: list[str], ticks: str = "ticks", order: str = "n", frequency: int = 1000) -> DataFrame:
    """Adds elapsed_ns: nanoseconds since the first frame of each recording, from its clock ticks."""
    starts = df.groupBy(*by).agg(F.min_by(F.col(ticks), F.col(order)).alias("_first"))  # one row for each recording
    both = df.alias("r").join(starts.alias("s"), [F.col(f"r.`{c}`").eqNullSafe(F.col(f"s.`{c}`")) for c in by])
    elapsed_ns = ((F.col(f"r.`{ticks}`") - F.col("s._first")) * (1e9 / frequency)).cast("long")
    return both.select(*(F.col(f"r.`{c}`") for c in df.columns), elapsed_ns.alias("elapsed_ns"))


def exclusive_offsets(df: DataFrame, length: str = "length", order: str = "n", block: int = 1 << 16) -> DataFrame:
    """Adds offset: the sum of the lengths before each row.

    Sums of blocks of rows are summed up first, so no task orders more than one block or the short list of blocks.
    """
    blocks = df.withColumn("_b", F.floor(F.col(order) / block))
    sums = blocks.groupBy("_b").agg(F.sum(length).alias("_s"))
    before = sums.select("_b", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.coalesce(F.sum(length).over(Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return blocks.withColumn("_own", own).join(before, "_b").withColumn("offset", (F.col("_own") + F.col("_before")).cast("long")).drop("_b", "_own", "_before")


def ema_rate(df: DataFrame, by: list[str], time: str, value: str, alpha: float = 0.2) -> DataFrame:
    """Adds ema: the rate of growth of a counter, averaged exponentially; rows without growth leave it as it is.

    The first positive rate is the start. What a stretch of rows does to the average is a linear map, and maps of
    neighbouring stretches are combined, so a key's rows are spread over tasks, see plans.ordered. Times and values may not be
    null.
    """
    return scanned(df, by, [time], EmaRate(time, value, alpha))
