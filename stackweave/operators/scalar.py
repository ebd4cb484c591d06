"""Operators on single pixels and on coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.index import AXES, Halo, Shape, whole
from ..plans.pipe import Op, elementwise
from .order import stack_quantiles

bytes_to_float01 = elementwise("bytes_to_float01", lambda v: v / F.lit(255.0))
#: Cut off to 0..1 first, then towards zero.
float01_to_bytes = elementwise("float01_to_bytes", lambda v: F.least(F.greatest(v * 255, F.lit(0.0)), F.lit(255.0)).cast("int"))
log1p = elementwise("log1p", F.log1p)
#: Blood-flow index; null where the contrast is 0.
bfi = elementwise("bfi", lambda v: F.try_divide(F.lit(1.0), v * v))


def cast(kind: str) -> Op:
    return elementwise(f"cast to {kind}", lambda v: v.cast(kind))


def log(eps: float = 1e-6) -> Op:
    return elementwise("log", lambda v: F.log(v + eps))


def sqrt(eps: float = 1e-6) -> Op:
    return elementwise("sqrt", lambda v: F.sqrt(F.greatest(v, F.lit(0.0)) + eps))


def sigmoid(v: Column) -> Column:
    return 1 / (1 + F.exp(-v))


def threshold(cutoff: float) -> Op:
    return elementwise("threshold", lambda v: (v > cutoff).cast("int"))


def _scope(per: str) -> list[str]:
    if per not in ("frame", "stack"):
        raise ValueError("per is frame or stack")
    return ["n"] if per == "frame" else []


def scope_reach(per: str) -> Halo:
    """What an operator with statistics of each frame, or of the stack, reads."""
    return whole("c", "y", "x") if _scope(per) else whole("n", "c", "y", "x")


def with_scope(df: DataFrame, per: str, **aggs: Column) -> DataFrame:
    """Adds aggregates over each frame, or over the whole stack by one row that is sent to all tasks."""
    keys = _scope(per)
    if keys:
        w = Window.partitionBy("n")
        return df.withColumns({name: a.over(w) for name, a in aggs.items()})
    return df.crossJoin(F.broadcast(df.agg(*(a.alias(name) for name, a in aggs.items()))))  # one row


def map01(per: str = "frame") -> Op:
    """(v - min) / (max - min + 1e-8) over each frame or the stack."""

    def apply(df: DataFrame, _: Shape) -> DataFrame:
        both = with_scope(df, per, _lo=F.min("v"), _hi=F.max("v"))
        return both.withColumn("v", (F.col("v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-8)).drop("_lo", "_hi")

    return Op("map01", apply, scope_reach(per))


def clip_space(per: str = "frame") -> Op:
    inner = map01(per)
    return Op("clip_space", lambda df, s: inner.apply(df, s).withColumn("v", 2 * (F.col("v") - 0.5)), inner.halo)


def qtile(low: float = 0.02, high: float = 0.98, per: str = "stack") -> Op:
    """Cuts values off at two quantiles, interpolated linearly."""

    def apply(df: DataFrame, _: Shape) -> DataFrame:
        # percentile() keeps counts of the distinct values of a group: of a frame, but not of a stack
        ends = df.groupBy("n").agg(F.expr(f"percentile(v, array({low}, {high}))").alias("_q")) if _scope(per) else stack_quantiles(df, [low, high]).withColumnRenamed("q", "_q")
        both = df.join(ends, "n") if _scope(per) else df.crossJoin(F.broadcast(ends))
        return both.withColumn("v", F.least(F.greatest(F.col("v"), F.get("_q", F.lit(0))), F.get("_q", F.lit(1)))).drop("_q")

    return Op("qtile", apply, scope_reach(per))


def roi(left: int, top: int, width: int, height: int) -> Op:
    """Cuts out a rectangle and counts its coordinates from 0."""

    def apply(df: DataFrame, _: Shape) -> DataFrame:
        inside = F.col("y").between(top, top + height - 1) & F.col("x").between(left, left + width - 1)
        return df.where(inside).withColumn("y", F.col("y") - top).withColumn("x", F.col("x") - left)

    return Op("roi", apply, _Moved(top, left), shape=lambda s: s.with_(y=height, x=width))


class _Moved(Halo):
    """The reach of an operator that moves rows and columns."""

    def __init__(self, top: int, left: int):
        super().__init__({})
        object.__setattr__(self, "by", {"y": top, "x": left})

    def source(self, ranges: dict, shape: Shape) -> dict:
        return {a: (lo + self.by.get(a, 0), hi + self.by.get(a, 0)) for a, (lo, hi) in ranges.items()}


def center_crop(shape: Shape, side: int | None = None) -> Op:
    """The centred square of the smaller side, its offset rounded down."""
    side = side or min(shape.y, shape.x)
    return roi((shape.x - side) // 2, (shape.y - side) // 2, side, side)


class _Swapped(Halo):
    def source(self, ranges: dict, shape: Shape) -> dict:
        return ranges | {"y": ranges["x"], "x": ranges["y"]}


#: Swaps rows and columns.
transpose = Op("transpose", lambda df, _: df.select(*(F.col({"y": "x", "x": "y"}.get(c, c)).alias(c) for c in df.columns)), _Swapped(), shape=lambda s: s.with_(y=s.x, x=s.y))


class _Permuted(Halo):
    """The reach of an operator whose axes are the source's in another order."""

    def __init__(self, axes: tuple[str, ...]):
        super().__init__({})
        object.__setattr__(self, "axes", axes)

    def source(self, ranges: dict, shape: Shape) -> dict:
        return {old: ranges[new] for new, old in zip(AXES, self.axes, strict=True)}


def permute(*axes: str) -> Op:
    """The axes in another order: permute("x", "c", "y", "n") counts columns as frames, rows as rows and frames as columns."""
    if sorted(axes) != sorted(AXES):
        raise ValueError("each of the four axes has to be named once")

    def apply(df: DataFrame, _: Shape) -> DataFrame:
        kinds = {"n": "long"}
        return df.select(*(F.col(old).cast(kinds.get(new, "int")).alias(new) for new, old in zip(AXES, axes, strict=True)), "v")

    return Op(f"permute({', '.join(axes)})", apply, _Permuted(axes), shape=lambda s: Shape(*(s[old] for old in axes)))


#: Columns, rows and frames, as environments that count the first axis fastest lay them out; and back.
columns_first = permute("x", "c", "y", "n")


def apply_mask(mask: DataFrame) -> Op:
    """Multiplies each frame by a mask (y, x, m). A mask has a frame's size; Spark sends it to all tasks if it is small."""
    return Op("apply_mask", lambda df, _: df.join(mask.select("y", "x", "m"), ["y", "x"]).withColumn("v", F.col("v") * F.col("m")).select(*df.columns))


def flat_field(mean_frame: DataFrame) -> Op:
    """Divides each frame by a mean frame (c, y, x, m); null where that is 0."""
    return Op("flat_field", lambda df, _: df.join(mean_frame.select("c", "y", "x", "m"), ["c", "y", "x"]).withColumn("v", F.try_divide(F.col("v"), F.col("m"))).select(*df.columns))


class _Refilled(Halo):
    """The reach of an operator whose places on these axes are new ones: it reads all old ones."""

    def __init__(self, *axes: str):
        super().__init__({})
        object.__setattr__(self, "axes", axes)

    def source(self, ranges: dict, shape: Shape) -> dict:
        return ranges | {a: (0, shape[a]) for a in self.axes if ranges[a][0] < ranges[a][1]}


def pad_to(height: int, width: int) -> Op:
    """Centres each frame in a larger one that is filled with the frame's minimum."""

    def apply(df: DataFrame, shape: Shape) -> DataFrame:
        top, left = (height - shape.y) // 2, (width - shape.x) // 2
        frames = df.groupBy("n", "c").agg(F.min("v").alias("_lo"))
        grid = frames.select("*", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y")).select("*", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
        moved = df.withColumn("y", F.col("y") + top).withColumn("x", F.col("x") + left)
        return grid.join(moved, ["n", "c", "y", "x"], "left").select("n", "c", "y", "x", F.coalesce("v", "_lo").alias("v"))

    return Op("pad_to", apply, _Refilled("y", "x"), True, lambda s: s.with_(y=height, x=width))


def colormap(table: list[tuple[float, float, float]], low: float = 0.0, high: float = 1.0) -> Op:
    """Turns values into colours: channels 0 to 2 from a table of 256 rows."""
    lut = F.array(*(F.array(*(F.lit(float(p)) for p in row)) for row in table))

    def apply(df: DataFrame, _: Shape) -> DataFrame:
        at = F.least(F.greatest((F.col("v") - low) / (high - low), F.lit(0.0)), F.lit(1.0))
        colour = F.get(lut, (at * (len(table) - 1)).cast("int"))
        return df.select("n", F.posexplode(colour).alias("c", "v"), "y", "x").select("n", F.col("c").cast("int").alias("c"), "y", "x", "v")

    return Op("colormap", apply, _Refilled("c"), shape=lambda s: s.with_(c=3))
