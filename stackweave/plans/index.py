"""Ranges, index normalisation and the halo rules by which a wanted range says what has to be read."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

AXES = ("n", "c", "y", "x")


@dataclass(frozen=True)
class Shape:
    """Frames, channels, rows and columns of a stack."""

    n: int
    c: int
    y: int
    x: int

    def __getitem__(self, axis: str) -> int:
        return getattr(self, axis)

    def with_(self, **sizes: int) -> Shape:
        return replace(self, **sizes)


@dataclass(frozen=True)
class Reach:
    """What one output place of an axis reads: `extent` places from place * stride on, or `radius` on both sides.

    A radius means that the edge is repeated: the size stays, and reads are cut off at the stack's edges. `whole` means
    that every output place reads the whole axis.
    """

    extent: int = 1
    stride: int = 1
    radius: int = 0
    whole: bool = False

    def size(self, n: int) -> int:
        return n if self.radius or self.whole else max(0, (n - self.extent) // self.stride + 1)

    def source(self, a: int, b: int, n: int) -> tuple[int, int]:
        if b <= a:
            return a, a
        if self.whole:
            return 0, n
        if self.radius:
            return max(0, a - self.radius), min(n, b + self.radius)
        return a * self.stride, (b - 1) * self.stride + self.extent


@dataclass(frozen=True)
class Halo:
    """The reach of an operator on each axis; axes that are not named are read place by place."""

    reach: dict = field(default_factory=dict)

    def shape(self, shape: Shape) -> Shape:
        return shape.with_(**{a: r.size(shape[a]) for a, r in self.reach.items()})

    def source(self, ranges: dict, shape: Shape) -> dict:
        """The ranges of a source of this shape that the given output ranges read."""
        return {a: self.reach.get(a, Reach()).source(*ranges[a], shape[a]) for a in AXES}


def whole(*axes: str) -> Halo:
    """The reach of an operator that looks at all of these axes."""
    return Halo({a: Reach(whole=True) for a in axes})


def normalise(index, shape: Shape) -> tuple[dict, list[str]]:
    """Ranges for each axis from an index as of an array, and the axes that an int picks.

    Ints are checked against the shape, slices are cut off at it, steps other than 1 are refused, and one ellipsis
    stands for as many whole axes as are left.
    """
    parts = list(index) if isinstance(index, tuple) else [index]
    if sum(p is Ellipsis for p in parts) > 1:
        raise IndexError("only one ellipsis is allowed")
    if Ellipsis in [p for p in parts if not isinstance(p, slice)]:
        at = next(k for k, p in enumerate(parts) if p is Ellipsis)
        parts[at : at + 1] = [slice(None)] * (len(AXES) - len(parts) + 1)
    if len(parts) > len(AXES):
        raise IndexError("too many indices")
    parts += [slice(None)] * (len(AXES) - len(parts))
    ranges, picked = {}, []
    for axis, part in zip(AXES, parts, strict=True):
        size = shape[axis]
        if isinstance(part, slice):
            if part.step not in (None, 1):
                raise ValueError("only step 1 is supported")
            a, b, _ = part.indices(size)
            ranges[axis] = (a, max(a, b))
        else:
            k = part + size if part < 0 else part
            if not 0 <= k < size:
                raise IndexError(f"index {part} is out of range for axis {axis} of size {size}")
            ranges[axis] = (k, k + 1)
            picked.append(axis)
    return ranges, picked


def tiles(shape: Shape, window: dict, stride: dict | None = None) -> list[dict]:
    """Ranges that start at each multiple of the stride, in row-major order; the last ones are cut off at the edge.

    An axis without a window is taken whole; the stride is the window where none is given.
    """
    out = [{}]
    for axis in AXES:
        w = window.get(axis) or shape[axis]
        s = (stride or {}).get(axis) or w
        out = [o | {axis: (a, min(a + w, shape[axis]))} for o in out for a in range(0, shape[axis], s)]
    return out
