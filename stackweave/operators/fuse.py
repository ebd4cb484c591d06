"""Functions of several stacks at once, each read at its own offsets.

fuse(f, a=pipe, b=pipe) calls f once with a recorder for each stack. a(n=1) stands for a's pixel one frame ahead; the
result is a Column. Each stack is read once: its offsets become shifted copies of its rows, summed up by an aggregate
over the coordinates, and different stacks meet in an equi-join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.index import AXES, Shape
from ..plans.pipe import FramePipe


class _Recorder:
    def __init__(self, name: str):
        self.name, self.offsets = name, []

    def __call__(self, **offset: int) -> Column:
        at = tuple(offset.get(a, 0) for a in AXES)
        if unknown := set(offset) - set(AXES):
            raise ValueError(f"no axis {unknown}")
        if at not in self.offsets:
            self.offsets.append(at)
        return F.col(f"{self.name}_{self.offsets.index(at)}")


def fuse(f: Callable[..., Column], **stacks: FramePipe) -> FramePipe:
    """The stack of f's values wherever all reads are inside their stacks, counted from 0.

    On each axis the output starts at max(0, -smallest offset) and ends where the first stack would be left.
    """
    recorders = {name: _Recorder(name) for name in stacks}
    value = f(**recorders)
    base, sizes = [], []
    for k, axis in enumerate(AXES):
        reads = [(o[k], stacks[name].shape[axis]) for name, r in recorders.items() for o in r.offsets]
        if not reads:
            raise ValueError("the function reads no stack")
        first = max(0, *(-o for o, _ in reads))
        base.append(first)
        sizes.append(max(0, min(size - o for o, size in reads) - first))
    joined = None
    for name, r in recorders.items():
        if not r.offsets:
            continue
        shifts = F.array(*(F.struct(*(F.lit(o + b).alias(f"d{a}") for o, b, a in zip(at, base, AXES, strict=True)), F.lit(k).alias("k")) for k, at in enumerate(r.offsets)))
        rows = stacks[name].all().select(*AXES, "v", F.explode(shifts).alias("s"))
        rows = rows.select(*((F.col(a) - F.col(f"s.d{a}")).cast("long" if a == "n" else "int").alias(a) for a in AXES), "v", "s.k")
        for a, size in zip(AXES, sizes, strict=True):
            rows = rows.where(F.col(a).between(0, size - 1))
        got = rows.groupBy(*AXES).agg(*(F.max(F.when(F.col("k") == k, F.col("v"))).alias(f"{name}_{k}") for k in range(len(r.offsets))))
        joined = got if joined is None else joined.join(got, list(AXES))
    return FramePipe(joined.select(*AXES, value.alias("v")), Shape(*sizes))


def crop_to_common(*pipes: FramePipe) -> list[FramePipe]:
    """Each stack cut to the centred rectangle of the smallest height and width."""
    from .scalar import roi

    h, w = min(p.shape.y for p in pipes), min(p.shape.x for p in pipes)
    return [p | roi((p.shape.x - w) // 2, (p.shape.y - h) // 2, w, h) for p in pipes]
