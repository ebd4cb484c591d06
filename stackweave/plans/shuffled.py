"""Frames in random order, a few at a time, from a permutation that is computed and not sorted.

The place of frame n in the order is a keyed bijection of 0..N-1: four rounds of a Feistel network on the two halves of
its bits, again until the result is below N. So nobody holds or sorts the order, the place of a frame and the frame at a
place cost the same, and the order depends on the seed and N alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pipe import FramePipe

_ROUNDS = 4


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A hash of 64 bits; overflow is wanted."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


class Permutation:
    """A random order of n numbers."""

    def __init__(self, n: int, seed: int = 0):
        self.n, self.half = n, max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.keys = [int(_mixed(np.array([seed % 2**64], np.uint64), k + 1)[0]) for k in range(_ROUNDS)]

    def _network(self, x: np.ndarray, keys: list[int]) -> np.ndarray:
        bits, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> bits, x & mask
        for key in keys:
            left, right = right, left ^ (_mixed(right, key) & mask)
        return right << bits | left  # halves swapped: the same network with the keys turned round leads back

    def _walk(self, x, keys: list[int]) -> np.ndarray:
        out = np.asarray(x).astype(np.uint64)
        if out.size and int(out.max()) >= self.n:
            raise IndexError(f"a number over {self.n - 1}")
        out = self._network(out, keys)
        while (beyond := out >= np.uint64(self.n)).any():
            out[beyond] = self._network(out[beyond], keys)
        return out.astype(np.int64)

    def place(self, n) -> np.ndarray:
        """Where each number stands in the order."""
        return self._walk(n, self.keys)

    def at(self, place) -> np.ndarray:
        """The number at each place."""
        return self._walk(place, self.keys[::-1])


def with_batches(df: DataFrame, frames: int, size: int, seed: int = 0, n: str = "n") -> DataFrame:
    """Adds batch and place: the random batch of `size` frames that a row's frame is in, and its place there."""
    order = Permutation(frames, seed)

    @F.pandas_udf("long")
    def place(numbers: pd.Series) -> pd.Series:
        return pd.Series(order.place(numbers.to_numpy()))

    return df.withColumn("_at", place(F.col(n))).withColumn("batch", F.floor(F.col("_at") / size)).withColumn("place", F.col("_at") % size).drop("_at")


def random_batches(pipe: FramePipe, size: int = 128, seed: int = 0, shuffle: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The frames' numbers and values, batch after batch, each frame once; values have the axes of the stack.

    A batch's frames are filtered by number in the scan, and only they are fetched. The last batch may be smaller.
    """
    total, s = len(pipe), pipe.shape
    order = Permutation(total, seed)
    for first in range(0, total, size):
        place = np.arange(first, min(first + size, total))
        numbers = order.at(place) if shuffle else place
        if any(op.halo.reach.get("n") for op in pipe.ops):  # windows over frames: every frame has its own range
            out = np.stack([pipe.to_numpy(slice(int(n), int(n) + 1))[0] for n in numbers])
        else:
            rows = FramePipe(pipe.frame.where(F.col("n").isin(numbers.tolist())), pipe.source_shape, pipe.ops).all().select("n", "c", "y", "x", "v").toArrow()
            out = np.full((len(numbers), s.c, s.y, s.x), np.nan)
            sort = np.argsort(numbers)
            at = sort[np.searchsorted(numbers[sort], rows.column("n").to_numpy())]
            out[at, *(rows.column(a).to_numpy() for a in "cyx")] = rows.column("v").to_numpy()
        yield numbers, out
