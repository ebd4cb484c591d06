"""FramePipe: a stack of frames as a lazy DataFrame with operators on it.

A stack is a DataFrame (n, c, y, x, v), one row for each pixel, with a shape. Indexing a pipe works out, from the last
operator back to the first, which source range the wanted output needs, filters the scan by it, so that Parquet
statistics and partitions can prune, applies the operators, and filters the output exactly. Catalyst cannot push such
a filter below a window by itself, as it does not know the halo.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .index import AXES, Halo, Reach, Shape, normalise


@dataclass(frozen=True)
class Op:
    """An operator: apply(frame, shape) takes the source and its whole shape.

    framewise: it needs the pixels of a frame together. The pipe deals them out by frame once for a run of such operators.
    shape: overrides the shape that follows from the halo.
    """

    name: str
    apply: Callable[[DataFrame, Shape], DataFrame]
    halo: Halo = Halo()
    framewise: bool = False
    shape: Callable[[Shape], Shape] | None = None

    def out(self, shape: Shape) -> Shape:
        return self.shape(shape) if self.shape else self.halo.shape(shape)


def within(ranges: dict) -> Column:
    """The condition that a pixel is in the ranges."""
    return reduce(lambda a, b: a & b, ((F.col(k) >= a) & (F.col(k) < b) for k, (a, b) in ranges.items()))


class FramePipe:
    """ticks: a table (n, ticks) of the source frames' clock ticks, if the source has them."""

    def __init__(self, frame: DataFrame, shape: Shape, ops: tuple[Op, ...] = (), ticks: DataFrame | None = None):
        self.frame, self.source_shape, self.ops, self.ticks = frame, shape, ops, ticks

    def then(self, op: Op | Chain | Callable[[Column], Column]) -> FramePipe:
        """Adds an operator, a chain of them, or a function of the value column."""
        if isinstance(op, Chain):
            return FramePipe(self.frame, self.source_shape, (*self.ops, *op.ops), self.ticks)
        if not isinstance(op, Op):
            op = elementwise(getattr(op, "__name__", "function"), op)
        return FramePipe(self.frame, self.source_shape, (*self.ops, op), self.ticks)

    __or__ = then

    @property
    def shapes(self) -> list[Shape]:
        """The shape of the source and behind each operator."""
        out = [self.source_shape]
        for op in self.ops:
            out.append(op.out(out[-1]))
        return out

    @property
    def shape(self) -> Shape:
        return self.shapes[-1]

    def __len__(self) -> int:
        return self.shape.n

    def needs(self, ranges: dict) -> list[dict]:
        """The ranges of the source and behind each operator that the output's ranges need."""
        out = [ranges]
        for op, shape in zip(reversed(self.ops), reversed(self.shapes[:-1]), strict=True):
            out.append(op.halo.source(out[-1], shape))
        return out[::-1]

    def explain_halo(self) -> str:
        """Each operator with the shape behind it."""
        return "\n".join(f"{name}: {s.n} x {s.c} x {s.y} x {s.x}" for name, s in zip(["source", *(op.name for op in self.ops)], self.shapes, strict=True))

    def _run(self, ranges: dict) -> DataFrame:
        wanted = self.needs(ranges)
        whole = {a: (0, self.source_shape[a]) for a in AXES}
        cut = {a: r for a, r in wanted[0].items() if r != whole[a]}
        frame = self.frame.where(within(cut)) if cut else self.frame
        together = False
        for op, shape in zip(self.ops, self.shapes, strict=False):
            if op.framewise and not together:
                frame = frame.repartition("n", "c")
            together = op.framewise or (together and op.halo.reach.get("n") is None)
            frame = op.apply(frame, shape)
        edge = {a: r for a, r in ranges.items() if r != (0, self.shape[a]) or self.needs(ranges)[0][a] != whole[a]}
        return frame.where(within(edge)) if edge else frame

    def all(self) -> DataFrame:
        return self._run({a: (0, self.shape[a]) for a in AXES})

    def __getitem__(self, index) -> DataFrame:
        """The pixels of a range, with the coordinates of the whole output; axes picked by an int lose their column."""
        ranges, picked = normalise(index, self.shape)
        return self._run(ranges).drop(*picked)

    def timestamps(self, index=slice(None)) -> DataFrame:
        """n and ticks of the output's frames in a range: those of the first source frame that each one reads."""
        if self.ticks is None:
            raise ValueError("the source has no ticks")
        ranges, _ = normalise(index, self.shape)
        step = 1
        for op in self.ops:
            step *= op.halo.reach.get("n", Reach()).stride
        a, b = ranges["n"]
        first = self.needs(ranges | {"n": (0, 1)})[0]["n"][0] if b > a else 0
        at = F.col("n") - first
        return self.ticks.where((at >= a * step) & (at < b * step) & (at % step == 0)).select(F.floor(at / step).cast("long").alias("n"), "ticks")

    def batches(self, size: int, frames: int | None = None):
        """Consecutive ranges of `size` frames, lazily: start, stop and the DataFrame of each."""
        n = min(len(self), frames if frames is not None else len(self))
        for a in range(0, n, size):
            yield a, min(a + size, n), self[a : min(a + size, n)]

    def to_numpy(self, index=slice(None)):
        """A small range as an array in the order of the axes."""
        import numpy as np

        ranges, picked = normalise(index, self.shape)
        rows = self._run(ranges).select(*AXES, "v").toPandas()
        out = np.full([b - a for a, b in ranges.values()], np.nan)
        out[tuple((rows[a] - ranges[a][0]).to_numpy() for a in AXES)] = rows["v"].to_numpy()
        return out.squeeze(tuple(AXES.index(a) for a in picked))


class Chain:
    """Operators without a source, to be joined with | and put behind a pipe."""

    def __init__(self, *ops: Op):
        self.ops = ops

    def __iter__(self):
        return iter(self.ops)

    def __or__(self, other: Op | Chain) -> Chain:
        return Chain(*self.ops, *(other.ops if isinstance(other, Chain) else (other,)))


def elementwise(name: str, f: Callable[[Column], Column]) -> Op:
    return Op(name, lambda df, _: df.withColumn("v", f(F.col("v"))))


def custom(name: str, f: Callable[[DataFrame, Shape], DataFrame], reach: dict | None = None, framewise: bool = False) -> Op:
    """Any function on pixel rows, with its reach by axis: {"n": (extent, stride)} or {"y": Reach(radius=2)}."""
    return Op(name, f, Halo({a: r if isinstance(r, Reach) else Reach(*r) for a, r in (reach or {}).items()}), framewise)
