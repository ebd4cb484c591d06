"""The mask of what moves or shines in a stack, for each block of frames, and gradients inside a mask.

Deviation and mean over a block's frames are summed up tile by tile; then the two frames of a block, which is all that is
left of it, meet in one task, where the mask is made.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.blocks import Block, BlockPipe, read_blocks, write_blocks, write_pixels
from ..plans.pipe import Chain
from . import scalar, spatial

BINS = 256


def map01(a: np.ndarray) -> np.ndarray:
    return (a - a.min()) / (a.max() - a.min() + 1e-8)


def valley(a: np.ndarray, bins: int = BINS, level: float = 0.9) -> float:
    """The emptiest bin's number from the fullest one up to the level's quantile, over the number of bins; of equal ones the first.

    Values are from 0 to 1. Bins are equal, from the smallest to the largest value. If the quantile lies below the fullest bin,
    that one counts.
    """
    z = map01(a)
    top = z.max()
    at = np.minimum(np.floor(z / top * bins), bins - 1).astype(int) if top > 0 else np.zeros(a.shape, int)
    counts = np.bincount(at.ravel(), minlength=bins)
    peak, upper = int(np.argmax(counts)), int(np.ceil(np.quantile(a, level) * bins))
    return (peak + int(np.argmin(counts[peak:upper])) if upper > peak else peak) / bins


def _window(a: np.ndarray, k: int, f, fill: float) -> np.ndarray:
    """f over k x k places from k // 2 before a place on; places beyond the edge have a value of their own."""
    before, behind = k // 2, k - k // 2 - 1
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (before, behind)
        a = f(np.lib.stride_tricks.sliding_window_view(np.pad(a, pad, constant_values=fill), k, axis), axis=-1)
    return a


def _dilated(a: np.ndarray, k: int) -> np.ndarray:
    return _window(a, k, np.max, -np.inf)


def _eroded(a: np.ndarray, k: int) -> np.ndarray:
    return _window(a, k, np.min, np.inf)


def union(deviation: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Where the deviation or the root of the mean is over its valley, without places that most neighbours don't share."""
    spread, light = map01(deviation), np.sqrt(map01(mean) + 1e-6)
    both = ((spread > valley(spread)) | (light > valley(light))).astype(float)
    wide = np.pad(map01(both), 1, mode="edge")
    h, w = both.shape
    blurred = sum(wide[y : y + h, x : x + w] for y in range(3) for x in range(3)) / 9
    return (blurred > 0.5) * both


def cleaned(mask: np.ndarray, coarse: int = 8, median: int = 11, area: int = 31) -> np.ndarray:
    """Small parts go: what an opening leaves, widened, within the mask; inside of it as it is, elsewhere by its median.

    Inside is where the squared mean of the median's result over the area is over a half; beyond the edge there is nothing.
    """
    opened = _dilated(_dilated(_eroded(mask, coarse), coarse), coarse) * mask
    level = map01(opened)
    share = _window(level, median, np.sum, 0.0) / max(level.max(), 1e-300)  # two values: the median is the one that most have
    smooth = np.where(share > median * median / 2, level.max(), 0.0)
    inside = (_window(smooth, area, np.sum, 0.0) / (area * area)) ** 2 > 0.5
    return np.where(inside, opened > 0, smooth > 0).astype(float)


def foreground_mask(pipe: BlockPipe, frames: int = 256, clean: bool = True) -> DataFrame:
    """block, c, y, x, m: the mask of each block of frames, 0 or 1. A block of one frame has no deviation."""
    whole = pipe.laid(n=min(pipe.layout.n, frames))
    height, width = whole.shape.y, whole.shape.x

    def sums(blocks: Iterable[Block]) -> pa.RecordBatch:
        out = []
        for c, n, y, x, a in blocks:
            for block in range(n // frames, (n + len(a) - 1) // frames + 1 if len(a) else 0):
                part = a[max(block * frames - n, 0) : (block + 1) * frames - n]
                out.append((c, block, y, x, np.stack([np.full(part.shape[1:], float(len(part))), part.sum(0), (part * part).sum(0)])))
        return write_blocks(out)

    def mask(table: pa.Table) -> pa.Table:
        total, at = np.zeros((3, height, width)), None
        for batch in table.to_batches():
            for c, block, y, x, a in read_blocks(batch):
                total[:, y : y + a.shape[1], x : x + a.shape[2]] += a
                at = c, block
        count, s, q = total
        mean = s / count
        deviation = np.sqrt(np.maximum(q - count * mean * mean, 0) / np.maximum(count - 1, 1))
        made = union(deviation, mean)
        pixels = write_pixels([(at[0], at[1], 0, 0, (cleaned(made) if clean else made)[None])])
        return pa.Table.from_batches([pixels])

    parts = whole.run(whole.whole(), sums, "c int, n0 long, y0 int, x0 int, nn int, yy int, xx int, data binary")
    found = parts.groupBy("c", "n0").applyInArrow(mask, "n long, c int, y int, x int, v double")
    return found.select(F.col("n").alias("block"), "c", "y", "x", F.col("v").cast("int").alias("m"))


def prepared_gradient(axis: str, mask: DataFrame, per: str = "frame") -> Chain:
    """x, y or z of the surface normals of the logarithm, mapped to 0..1, inside a mask (y, x, m); values have to be positive."""
    return Chain(scalar.log(0.0), scalar.map01(per), spatial.normals(axis), scalar.apply_mask(mask))
