"""Aggregates of stacks: per pixel over frames, per frame, and of the whole stack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import stack_quantiles
from .window import PIXEL, cumulative_mean


def sum_frame(df: DataFrame) -> DataFrame:
    return df.groupBy(*PIXEL).agg(F.sum("v").alias("v"))


def mean_frame(df: DataFrame) -> DataFrame:
    """The mean over the frames that are in the range."""
    return df.groupBy(*PIXEL).agg(F.avg("v").alias("v"))


def total_temporal_contrast(df: DataFrame, eps: float = 1e-6) -> DataFrame:
    return df.groupBy(*PIXEL).agg((F.stddev_pop("v") / (F.avg("v") + eps)).alias("v"))


def frame_contrast(df: DataFrame, by: tuple[str, ...] = ("n",), eps: float = 1e-6) -> DataFrame:
    """Sample standard deviation over the mean of each frame."""
    return df.groupBy(*by).agg((F.stddev_samp("v") / (F.avg("v") + eps)).alias("v"))


def frame_mean(df: DataFrame) -> DataFrame:
    return df.groupBy("n").agg(F.avg("v").alias("v"))


def cumulative_contrast(df: DataFrame) -> DataFrame:
    """The contrast of the mean of all frames up to each one."""
    return frame_contrast(cumulative_mean(df))


def minmax(df: DataFrame, *by: str) -> DataFrame:
    """Minimum, maximum and their first places in row order."""
    place = F.struct("n", "c", "y", "x")
    return df.groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.min(F.struct("v", place.alias("p")))["p"].alias("at_lo"), F.min(F.struct((-F.col("v")).alias("v"), place.alias("p")))["p"].alias("at_hi"))


def quantiles(df: DataFrame, levels: list[float], *by: str) -> DataFrame:
    """Quantiles with linear interpolation, an array: of each group, or of the whole stack by counts."""
    if not by:
        return stack_quantiles(df, levels)
    return df.groupBy(*by).agg(F.expr(f"percentile(v, array({', '.join(map(str, levels))}))").alias("q"))


def histogram(df: DataFrame, bins: int = 256) -> DataFrame:
    """bin, count and p = (count + 1e-12) / (all + 1e-12) over the values mapped to 0..1; the last edge belongs to the last bin."""
    ends = F.broadcast(df.agg(F.min("v").alias("_lo"), F.max("v").alias("_hi")))
    z = (F.col("v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-8)
    # equal bins from the smallest to the largest mapped value
    top = (F.col("_hi") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-8)
    at = F.when(top > 0, F.least(F.floor(z / top * bins), F.lit(bins - 1))).otherwise(0)
    counts = df.crossJoin(ends).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    full = every.join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("count", F.lit(0)).cast("long").alias("count"))
    return full.withColumn("p", (F.col("count") + 1e-12) / (F.sum("count").over(Window.partitionBy()) + 1e-12))  # as many rows as bins


def valley_cutoff(df: DataFrame, bins: int = 256, level: float = 0.9) -> DataFrame:
    """peak, upper and cutoff: the emptiest bin from the fullest one up to the level's quantile, over the number of bins.

    Values are mapped to 0..1; of equal bins the first counts.
    """
    h = histogram(df, bins)
    ends = df.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).crossJoin(F.broadcast(stack_quantiles(df, [level]).select(F.get("q", F.lit(0)).alias("q"))))  # one row each
    upper = ends.select(F.ceil((F.col("q") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-8) * bins).cast("int").alias("upper"))
    peak = h.agg(F.min(F.struct((-F.col("count")).alias("m"), "bin"))["bin"].alias("peak"))
    both = h.crossJoin(F.broadcast(peak)).crossJoin(F.broadcast(upper)).where((F.col("bin") >= F.col("peak")) & (F.col("bin") < F.col("upper")))
    return both.groupBy("peak", "upper").agg((F.min(F.struct("count", "bin"))["bin"] / bins).alias("cutoff"))


def radial_profile(df: DataFrame, height: int, width: int) -> DataFrame:
    """The mean by whole distance from the centre, for each frame."""
    dx, dy = F.col("x") - width // 2, F.col("y") - height // 2
    return df.groupBy("n", F.floor(F.sqrt(dx * dx + dy * dy)).cast("int").alias("r")).agg(F.avg("v").alias("v"))


def bounding_box(mask: DataFrame, height: int, width: int, margin: int = 50, *by: str) -> DataFrame:
    """top, bottom, left and right of the places with m > 0, with a margin, within the frame."""
    return mask.where("m > 0").groupBy(*by).agg(
        F.greatest(F.min("y") - margin, F.lit(0)).alias("top"), F.least(F.max("y") + margin, F.lit(height - 1)).alias("bottom"), F.greatest(F.min("x") - margin, F.lit(0)).alias("left"), F.least(F.max("x") + margin, F.lit(width - 1)).alias("right")
    )


def tiled(df: DataFrame, window: int, stride: int | None = None, axis: str = "n", size: int | None = None) -> DataFrame:
    """Adds tile, the number of each tile along an axis that a pixel is in; overlapping tiles repeat their pixels.

    Tiles start at each multiple of the stride below the size, the last ones are cut off.
    """
    s = stride or window
    first = F.greatest(F.ceil((F.col(axis) - (window - 1)) / s), F.lit(0))
    last = F.floor(F.col(axis) / s)
    last = F.least(last, F.lit((size - 1) // s)) if size else last
    return df.select("*", F.explode(F.when(first <= last, F.sequence(first, last))).alias("tile"))


def block_mask(df: DataFrame, frames: int = 256) -> DataFrame:
    """A mask of each pixel for each block of frames: where its mean is over the mean of the block."""
    block = F.floor(F.col("n") / frames)
    per_pixel = df.groupBy(block.alias("block"), *PIXEL).agg(F.avg("v").alias("mean"), F.sum("v").alias("s"), F.count("v").alias("k"))
    per_block = per_pixel.groupBy("block").agg((F.sum("s") / F.sum("k")).alias("all"))
    return per_pixel.join(F.broadcast(per_block), "block").select("block", *PIXEL, (F.col("mean") > F.col("all")).cast("int").alias("m"))


def size_of(df: DataFrame, bytes_per_value: int = 4) -> DataFrame:
    """Frames, values and logical bytes of a stack."""
    return df.agg(F.countDistinct("n").alias("frames"), F.count("v").alias("values"), (F.count("v") * bytes_per_value).alias("bytes"))


def digest(df: DataFrame, by: str = "n", value: Column | None = None, block: int = 4096) -> DataFrame:
    """frames and digest of a stack, from the digests of its frames in order; equal for equal frames however they are stored.

    Each frame's values are joined in order, and the frames' digests again for each block of frames.
    """
    text = (F.col("v") if value is None else value).cast("string")
    # the values of one frame, then the digests of one block, then those of all blocks: each list has a bounded part of the stack
    frames = df.groupBy(by).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "y", "x", text.alias("t")))), lambda p: p.t), ","), 256).alias("d"))
    blocks = frames.groupBy(F.floor(F.col(by) / block).alias("b")).agg(F.count(F.lit(1)).alias("k"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, "d"))), lambda p: p.d), ""), 256).alias("d"))
    return blocks.agg(F.sum("k").alias("frames"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda p: p.d), ""), 256).alias("digest"))
