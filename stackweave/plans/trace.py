"""Traced functions of several stacks: f(R, a, b, ...) with ranges relative to the requested one.

R.n, R.y and R.x are the ranges that are wanted of the output. f reads its stacks by slices whose bounds are sums of R's
bounds and whole numbers, times whole numbers or divided by them: a[R.n.start : R.n.stop + 4, :] is not allowed to leave
a bound out, but axes at the end, or under an ellipsis, are those of R. f is called once with symbolic bounds and zeros
to learn which range of each stack a range of the output reads; that gives the output's size and the halo of each
read, so a slice of the result reads no more than it needs. Then each task calls f with numbers and arrays for its
blocks.

Arrays have the axes frame, row and column; channels are treated one by one.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from .blocks import SPACE, BlockPipe, Layout, Ranges, bounding
from .index import Shape

#: Sizes of the output with which f is called to learn its reads.
_PROBE = {"n": 3, "y": 4, "x": 5}


@dataclass(frozen=True)
class Bound:
    """floor((p * start + q * stop + r) / d) of an axis of the output."""

    axis: str
    p: int
    q: int
    r: int = 0
    d: int = 1

    def at(self, start: int, stop: int) -> int:
        return (self.p * start + self.q * stop + self.r) // self.d

    def __index__(self) -> int:
        return self.at(0, _PROBE[self.axis])

    def __add__(self, other):
        if isinstance(other, Bound):
            if other.axis != self.axis or self.d != 1 or other.d != 1:
                raise ValueError("bounds of different axes, or that have been divided, can't be added")
            return Bound(self.axis, self.p + other.p, self.q + other.q, self.r + other.r)
        return Bound(self.axis, self.p, self.q, self.r + operator.index(other) * self.d, self.d)

    __radd__ = __add__

    def __neg__(self):
        if self.d != 1:
            raise ValueError("a bound that has been divided can't change its sign")
        return Bound(self.axis, -self.p, -self.q, -self.r)

    def __sub__(self, other):
        return self + (-other)

    def __rsub__(self, other):
        return -self + other

    def __mul__(self, by: int):
        if self.d != 1:
            raise ValueError("a bound that has been divided can't be multiplied")
        by = operator.index(by)
        return Bound(self.axis, self.p * by, self.q * by, self.r * by)

    __rmul__ = __mul__

    def __floordiv__(self, by: int):
        by = operator.index(by)
        if by <= 0:
            raise ValueError("bounds are divided by positive numbers")
        return Bound(self.axis, self.p, self.q, self.r, self.d * by)


class Requested:
    """The wanted range of each axis: R.n is a slice, R["n"] the same."""

    def __init__(self, **axes: slice):
        self.__dict__.update(axes)

    def __getitem__(self, axis: str) -> slice:
        return self.__dict__[axis]


def _expand(index, requested: Requested) -> list[slice]:
    """One slice with both bounds for each axis."""
    parts = list(index) if isinstance(index, tuple) else [index]
    dots = [k for k, p in enumerate(parts) if p is Ellipsis]
    if len(dots) > 1:
        raise IndexError("only one ellipsis is allowed")
    if any(p is not Ellipsis and not isinstance(p, slice) for p in parts):
        raise TypeError("stacks are read by slices and one ellipsis")
    if len(parts) - len(dots) > len(SPACE):
        raise IndexError("too many indices")
    missing = len(SPACE) - (len(parts) - len(dots))
    at = dots[0] if dots else len(parts)
    own = [requested[a] for a in SPACE[at : at + missing]]
    out = parts[:at] + own + parts[at + len(dots) :]
    for s in out:
        if s.step is not None:
            raise ValueError("a step is not allowed")
        if s.start is None or s.stop is None:
            raise ValueError("both bounds of a slice have to be given; R has those of the wanted range")
    return out


class _Recorder:
    """Stands for a stack while f is traced: remembers what is read and gives zeros."""

    def __init__(self, requested: Requested):
        self.requested, self.reads = requested, []

    def __getitem__(self, index) -> np.ndarray:
        read = _expand(index, self.requested)
        self.reads.append([(s.start, s.stop) for s in read])
        return np.zeros([max(0, operator.index(s.stop) - operator.index(s.start)) for s in read])


class _Reader:
    """Stands for a stack in a task: cuts what is read out of the array that the task holds."""

    def __init__(self, requested: Requested, held: Ranges, a: np.ndarray):
        self.requested, self.held, self.a = requested, held, a

    def __getitem__(self, index) -> np.ndarray:
        read = _expand(index, self.requested)
        return self.a[tuple(slice(s.start - self.held[x][0], s.stop - self.held[x][0]) for s, x in zip(read, SPACE, strict=True))]


def _fits(reads: list, sizes: list[int], a: int, b: int) -> tuple[bool, bool]:
    """Whether all reads of the range a to b - 1 stay behind the first and before the last place."""
    at = [[(lo.at(a, b) if isinstance(lo, Bound) else lo), (hi.at(a, b) if isinstance(hi, Bound) else hi), size] for (lo, hi), size in zip(reads, sizes, strict=True)]
    return all(lo >= 0 for lo, _, _ in at), all(hi <= size for _, hi, size in at)


@dataclass(frozen=True)
class Traced:
    """A traced function as a part of a plan. reads: of each stack, the bounds of each read on each axis."""

    f: Callable
    names: tuple[str, ...]
    inners: tuple
    reads: tuple
    base: dict
    shape: Shape

    def _moved(self, ranges: Ranges) -> Ranges:
        """The wanted ranges as f counts them."""
        return {a: (lo + self.base.get(a, 0), hi + self.base.get(a, 0)) for a, (lo, hi) in ranges.items()}

    def _source(self, k: int, ranges: Ranges) -> Ranges | None:
        """The smallest range of a stack that holds all reads."""
        own, out = self._moved(ranges), None
        for read in self.reads[k]:
            one = {"c": ranges["c"]}
            for axis, bounds in zip(SPACE, read, strict=True):
                lo, hi = (b.at(*own[b.axis]) if isinstance(b, Bound) else b for b in bounds)
                one[axis] = (lo, max(lo, hi))
            out = one if out is None else bounding(out, one)
        return out

    def need(self, ranges: Ranges) -> dict[int, Ranges]:
        out: dict[int, Ranges] = {}
        for k, inner in enumerate(self.inners):
            source = self._source(k, ranges)
            if source is None:
                continue
            for table, r in inner.need(source).items():
                out[table] = bounding(out[table], r) if table in out else r
        return out

    def compute(self, ranges: Ranges, arrays: dict) -> np.ndarray:
        requested = Requested(**{a: slice(*r) for a, r in self._moved(ranges).items()})
        readers = {}
        for k, (name, inner) in enumerate(zip(self.names, self.inners, strict=True)):
            source = self._source(k, ranges)
            if source is not None:
                readers[name] = _Reader(requested, source, inner.compute(source, arrays))
        got = np.asarray(self.f(requested, **readers), np.float64)
        return np.broadcast_to(got, [ranges[a][1] - ranges[a][0] for a in SPACE])

    def moved(self, by: int) -> Traced:
        return Traced(self.f, self.names, tuple(i.moved(by) for i in self.inners), self.reads, self.base, self.shape)


def trace(f: Callable, layout: Layout | None = None, **stacks: BlockPipe) -> BlockPipe:
    """The stack of f(R, **stacks) wherever all reads are inside their stacks, counted from 0.

    On each axis the output starts at the first place whose reads don't begin before their stacks and ends with the last
    one whose reads don't end behind them. f has to give an array of R's sizes (or one that broadcasts to them), and the
    same values however the output is cut. A stack that is given twice is read once.
    """
    requested = Requested(**{a: slice(Bound(a, 1, 0), Bound(a, 0, 1)) for a in SPACE})
    recorders = {name: _Recorder(requested) for name in stacks}
    got = np.asarray(f(requested, **recorders))
    np.broadcast_to(got, [_PROBE[a] for a in SPACE])  # fails if the sizes don't fit
    if not any(r.reads for r in recorders.values()):
        raise ValueError("the function reads no stack")
    base, sizes = {}, {}
    for k, axis in enumerate(SPACE):
        reads, ends = [], []
        for name, r in recorders.items():
            for read in r.reads:
                if any(isinstance(b, Bound) and b.axis != axis for b in read[k]):
                    raise ValueError(f"axis {axis} is read by a bound of another axis")
                if any(isinstance(b, Bound) and (b.p < 0 or b.q < 0) for b in read[k]):
                    raise ValueError("bounds have to rise with the wanted range")
                reads.append(read[k])
                ends.append(stacks[name].shape[axis])
        most = 1 + max(ends) * max([b.d for read in reads for b in read if isinstance(b, Bound)], default=1)
        first = _smallest(most, lambda b: _fits(reads, ends, b, b + 1)[0])
        if not any(isinstance(b, Bound) for read in reads for b in read):
            raise ValueError(f"no read depends on axis {axis}")
        last = _smallest(most + 1, lambda b: not _fits(reads, ends, b, b + 1)[1])
        base[axis], sizes[axis] = first, max(0, last - first)
    channels = {p.shape.c for p in stacks.values()}
    if len(channels) > 1:
        raise ValueError("the stacks have different channels")
    tables, inners = [], []
    for name, pipe in stacks.items():
        moved = pipe.plan
        places = []
        for t in pipe.tables:
            same = next((k for k, u in enumerate(tables) if u is t), None)
            places.append(len(tables) if same is None else same)
            if same is None:
                tables.append(t)
        if places != list(range(places[0], places[0] + len(places))):
            raise ValueError(f"{name} shares some of its tables with another stack")
        inners.append(moved.moved(places[0]))
    shape = Shape(sizes["n"], channels.pop(), sizes["y"], sizes["x"])
    plan = Traced(f, tuple(stacks), tuple(inners), tuple(tuple(map(tuple, recorders[n].reads)) for n in stacks), base, shape)
    return BlockPipe(tables, plan, layout or next(iter(stacks.values())).layout)


def _smallest(most: int, holds: Callable[[int], bool]) -> int:
    """The smallest number from 0 on for which a rising condition holds; `most` if there is none below it."""
    lo, hi = 0, most
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if holds(mid) else (mid + 1, hi)
    return lo
