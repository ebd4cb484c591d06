"""Operators that pass frames through and count them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .index import Shape
from .pipe import Op


class FrameCounter:
    """Counts the frames that pass a place in a pipe, in the jobs that run anyway: pipe | counter.op.

    Each time the pipe is read there is one more count, which is there when an action has run on that DataFrame. A frame
    counts by its pixels, so a slice of half a frame is half a frame.
    """

    def __init__(self):
        self._seen: list[tuple[Observation, int]] = []

    @property
    def op(self) -> Op:
        def apply(df: DataFrame, shape: Shape) -> DataFrame:
            seen = Observation()
            self._seen.append((seen, max(1, shape.c * shape.y * shape.x)))
            return df.observe(seen, F.count(F.lit(1)).alias("pixels"))

        return Op("count_frames", apply)

    @property
    def counts(self) -> list[float]:
        """The frames of each time the pipe was read, in order; waits for actions that have not run yet."""
        return [seen.get["pixels"] / size for seen, size in self._seen]

    @property
    def count(self) -> float:
        return sum(self.counts)

    def reset(self) -> None:
        self._seen = []
