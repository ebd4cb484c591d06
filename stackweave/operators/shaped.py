"""Noise from a tile, and the scale at which its spectrum fits that of frames turned upside down.

The tile is a small array: it goes to every task with the plan. All scales are tried in one plan: their profiles are a
table of as many rows as scales times radii, which meets the profiles of the frames by radius.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.blocks import PIXELS, Block, BlockPipe, write_pixels

#: Values of a tile, which every task gets.
MOST_VALUES = 1 << 22


def tiled(tile: np.ndarray, height: int, width: int, scale: float, period: float = 128) -> np.ndarray:
    """The tile, repeated with a period, at a scale: place y lies at ((y / scale) mod period) / period of the tile, bilinear.

    The tile is spread over one period from its first to its last row, whatever its size.
    """

    def axis(size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(size) / scale % period / period * (n - 1)
        low = np.minimum(np.floor(at).astype(np.int64), max(n - 2, 0))
        return low, at - low

    (y, v), (x, u) = axis(height, tile.shape[0]), axis(width, tile.shape[1])
    below, right = np.minimum(y + 1, tile.shape[0] - 1), np.minimum(x + 1, tile.shape[1] - 1)
    v, u = v[:, None], u[None, :]
    return tile[np.ix_(y, x)] * (1 - v) * (1 - u) + tile[np.ix_(below, x)] * v * (1 - u) + tile[np.ix_(y, right)] * (1 - v) * u + tile[np.ix_(below, right)] * v * u


def radii(height: int, width: int) -> np.ndarray:
    """The whole distance of each place from the centre."""
    y, x = np.indices((height, width))
    return np.sqrt((x - width // 2) ** 2 + (y - height // 2) ** 2).astype(np.int64)


def profile(frames: np.ndarray) -> np.ndarray:
    """The mean magnitude of the spectrum by whole distance from frequency 0, for each frame."""
    size = np.fft.fftshift(np.abs(np.fft.fft2(frames)), (-2, -1)).reshape(len(frames), -1)
    r = radii(*frames.shape[-2:]).ravel()
    sums = np.stack([np.bincount(r, one) for one in size]) if len(size) else np.zeros((0, r.max() + 1))
    return sums / np.maximum(np.bincount(r), 1)


def log_scales(n: int = 25, low: float = 0.25, high: float = 4.0) -> list[float]:
    return [float(low * (high / low) ** (k / max(1, n - 1))) for k in range(n)]


def _by_radius(profiles: Iterable[tuple[int, np.ndarray]], name: str) -> pa.RecordBatch:
    rows = [(n, r, v) for n, p in profiles for r, v in enumerate(p.tolist())]
    columns = list(zip(*rows, strict=True)) or [()] * 3
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.float64()), strict=True)], names=[name, "r", "v"])


def frame_profiles(pipe: BlockPipe) -> DataFrame:
    """n, r, v: the spectrum's profile of each frame."""
    if pipe.shape.c != 1:
        raise ValueError("frames of one channel are needed")

    def write(blocks: Iterable[Block]) -> pa.RecordBatch:
        return _by_radius(((n + k, p) for _, n, _, _, a in blocks for k, p in enumerate(profile(a))), "n")

    whole = pipe.laid(y=pipe.shape.y, x=pipe.shape.x)
    return whole.run(whole.whole(), write, "n long, r int, v double")


def scale_profiles(spark: SparkSession, tile: np.ndarray, height: int, width: int, scales: list[float], period: float = 128) -> DataFrame:
    """k, r, v: the profile of the tile at each scale; every scale is a task's own work."""
    if tile.size > MOST_VALUES:
        raise ValueError(f"a tile of over {MOST_VALUES} values")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _by_radius(((k, profile(tiled(tile, height, width, scales[k], period)[None])[0]) for k in b.column(0).to_pylist()), "k")

    return spark.range(0, len(scales), 1, len(scales)).mapInArrow(run, "k long, r int, v double")


def _scaled(profiles: DataFrame, key: str, eps: float) -> DataFrame:
    top = profiles.groupBy(key).agg(F.max("v").alias("_top"))
    return profiles.join(top, key).select(key, "r", (F.col("v") / (F.col("_top") + eps)).alias("v"))


def matching_scale(pipe: BlockPipe, tile: np.ndarray, scales: list[float] | None = None, period: float = 128, eps: float = 1e-6) -> DataFrame:
    """n, scale, loss: the scale at which the tile's profile is nearest to the inverse of each frame's profile.

    Both are divided by their maximum; the loss is the mean square of their differences; of equal losses the smallest scale
    counts.
    """
    scales = scales or log_scales()
    spark, s = pipe.tables[0].frame.sparkSession, pipe.shape
    wanted = _scaled(frame_profiles(pipe).withColumn("v", 1 / (F.col("v") + eps)), "n", eps)
    tried = _scaled(scale_profiles(spark, tile, s.y, s.x, scales, period), "k", eps)
    both = wanted.join(F.broadcast(tried.withColumnRenamed("v", "t")), "r")  # scales times radii
    loss = both.groupBy("n", "k").agg(F.avg((F.col("v") - F.col("t")) * (F.col("v") - F.col("t"))).alias("loss"))
    best = loss.groupBy("n").agg(F.min_by(F.col("k"), F.struct("loss", "k")).alias("k"), F.min("loss").alias("loss"))
    table = F.array(*(F.lit(v) for v in scales))
    return best.select("n", F.get(table, F.col("k").cast("int")).alias("scale"), "loss")


def matching_noise(pipe: BlockPipe, tile: np.ndarray, scales: list[float] | None = None, period: float = 128, eps: float = 1e-6) -> DataFrame:
    """n, c, y, x, v: for each frame the tile at its best scale, mapped to 0..1."""
    s = pipe.shape

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blocks = []
            for n, scale in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                noise = tiled(tile, s.y, s.x, scale, period)
                noise = noise - noise.min()
                blocks.append((0, n, 0, 0, (noise / (noise.max() + eps))[None]))
            yield write_pixels(blocks)

    return matching_scale(pipe, tile, scales, period, eps).select("n", "scale").mapInArrow(run, PIXELS)
