"""Operators over the neighbourhood of each pixel within its frame.

Convolutions do not turn the kernel. A pixel's value is sent to each output place that reads it, with the kernel's
weight, and summed there. The pipe has dealt out the pixels by frame before, so all of this stays within a task. `valid`
keeps the places that have all neighbours; `same` repeats the edge, and reads at a cut-off place more than once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.index import Halo, Reach, Shape
from ..plans.pipe import Chain, Op
from .scalar import map01

Kernel = list[tuple[int, int, float]]  #: (row, column, weight), counted from the kernel's first place


def disk(k: int) -> Kernel:
    """The places within radius k // 2 of the centre, with equal weights."""
    r = k // 2
    inside = [(y, x) for y in range(-r, r + 1) for x in range(-r, r + 1) if x * x + y * y <= r * r]
    return [(y + r, x + r, 1 / len(inside)) for y, x in inside]


def box(k: int) -> Kernel:
    return [(y, x, 1 / (k * k)) for y in range(k) for x in range(k)]


def gaussian(k: int, sigma: float) -> Kernel:
    if k % 2 == 0:
        raise ValueError("k has to be odd")
    one = [math.exp(-(t * t) / (2 * sigma * sigma)) for t in range(-(k // 2), k // 2 + 1)]
    one = [v / sum(one) for v in one]
    return [(y, x, a * b) for y, a in enumerate(one) for x, b in enumerate(one)]


def dense(rows: list[list[float]]) -> Kernel:
    """A kernel from its rows; zeros are left out."""
    return [(y, x, float(w)) for y, row in enumerate(rows) for x, w in enumerate(row) if w]


LAPLACIAN = dense([[math.sqrt(2), 1, math.sqrt(2)], [1, -(4 * math.sqrt(2) + 4), 1], [math.sqrt(2), 1, math.sqrt(2)]])
SOBEL_Y = dense([[-1, -2, -1], [0, 0, 0], [1, 2, 1]])
SOBEL_X = dense([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])
HESSIAN_XX = dense([[w / 4 for w in row] for row in ([1, -2, 1], [2, -4, 2], [1, -2, 1])])
HESSIAN_YY = dense([[w / 4 for w in row] for row in ([1, 2, 1], [-2, -4, -2], [1, 2, 1])])
HESSIAN_XY = dense([[w / 4 for w in row] for row in ([1, 0, -1], [0, 0, 0], [-1, 0, 1])])


def _spread(df: DataFrame, shape: Shape, k: int, weights: dict[str, Kernel], padding: str) -> DataFrame:
    """One row for each pixel and each output place that reads it: n, c, y, x, v and a weight for each kernel."""
    places = sorted({(y, x) for kernel in weights.values() for y, x, _ in kernel})
    table = {name: {(y, x): w for y, x, w in kernel} for name, kernel in weights.items()}
    r = k // 2

    def struct(y: int, x: int) -> Column:
        return F.struct(F.lit(y).alias("dy"), F.lit(x).alias("dx"), *(F.lit(t.get((y, x), 0.0)).alias(name) for name, t in table.items()))

    if padding == "valid":
        out = df.select("n", "c", "y", "x", "v", F.explode(F.array(*(struct(*p) for p in places))).alias("k"))
        out = out.select("n", "c", (F.col("y") - F.col("k.dy")).alias("y"), (F.col("x") - F.col("k.dx")).alias("x"), "v", *(f"k.{name}" for name in table))
        return out.where(F.col("y").between(0, shape.y - k) & F.col("x").between(0, shape.x - k))
    # an edge pixel stands for all places beyond it

    def beyond(axis: str, size: int) -> Column:
        at = F.col(axis)
        first, last = F.when(at == 0, F.lit(-r)).otherwise(at), F.when(at == size - 1, F.lit(size - 1 + r)).otherwise(at)
        return F.sequence(first, last)

    spread = df.select("n", "c", F.explode(beyond("y", shape.y)).alias("y"), "x", "v").select("n", "c", "y", F.explode(beyond("x", shape.x)).alias("x"), "v")
    out = spread.select("n", "c", "y", "x", "v", F.explode(F.array(*(struct(*p) for p in places))).alias("k"))
    out = out.select("n", "c", (F.col("y") - F.col("k.dy") + r).alias("y"), (F.col("x") - F.col("k.dx") + r).alias("x"), "v", *(f"k.{name}" for name in table))
    return out.where(F.col("y").between(0, shape.y - 1) & F.col("x").between(0, shape.x - 1))


def _reach(k: int, padding: str) -> Halo:
    if padding not in ("valid", "same"):
        raise ValueError("padding is valid or same")
    one = Reach(extent=k) if padding == "valid" else Reach(radius=k // 2)
    return Halo({"y": one, "x": one})


def neighbourhood(name: str, k: int, weights: dict[str, Kernel], value: Column, padding: str = "valid") -> Op:
    """A function of weighted sums over the neighbourhood: columns s_NAME of w v and q_NAME of w v^2 for each kernel."""

    def apply(df: DataFrame, shape: Shape) -> DataFrame:
        spread = _spread(df, shape, k, weights, padding)
        places = len({(y, x) for kernel in weights.values() for y, x, _ in kernel})
        sums = [F.sum(F.col(w) * F.col("v")).alias(f"s_{w}") for w in weights] + [F.sum(F.col(w) * F.col("v") * F.col("v")).alias(f"q_{w}") for w in weights]
        got = spread.groupBy("n", "c", "y", "x").agg(*sums, F.count(F.lit(1)).alias("_n")).where(F.col("_n") == places)
        return got.select("n", "c", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), value.alias("v"))

    return Op(name, apply, _reach(k, padding), True)


def convolve(kernel: Kernel, k: int, padding: str = "valid", name: str = "convolve") -> Op:
    return neighbourhood(name, k, {"w": kernel}, F.col("s_w"), padding)


def laplacian_contrast() -> Op:
    return neighbourhood("laplacian_contrast", 3, {"w": LAPLACIAN}, F.abs(F.col("s_w")))


def spatial_contrast(k: int = 7, eps: float = 1e-6) -> Op:
    """sqrt(|E[v^2] - E[v]^2| + eps) / (E[v] + eps) over a disk."""
    mean, square = F.col("s_w"), F.col("q_w")
    return neighbourhood(f"spatial_contrast({k})", 2 * (k // 2) + 1, {"w": disk(k)}, F.sqrt(F.abs(square - mean * mean) + eps) / (mean + eps))


def disk_blur(k: int, padding: str = "same") -> Op:
    """The mean over a disk; over a box for k = 3."""
    return convolve(box(3) if k == 3 else disk(k), 2 * (k // 2) + 1, padding, f"disk_blur({k})")


def gaussian_blur(k: int, sigma: float) -> Op:
    return convolve(gaussian(k, sigma), k, "same", f"gaussian_blur({k})")


def difference_of_gaussians(k: int, low: float = 2, high: float = 3, per: str = "frame") -> Chain:
    """The blur with `high` minus that with `low`, of values that are mapped to 0..1 first."""
    return Chain(map01(per), neighbourhood("difference_of_gaussians", k, {"a": gaussian(k, high), "b": gaussian(k, low)}, F.col("s_a") - F.col("s_b"), "same"))


def sobel(axis: str) -> Op:
    """The derivative along y or x."""
    return convolve({"y": SOBEL_Y, "x": SOBEL_X}[axis], 3, name=f"sobel({axis})")


def _eigen(sign: int) -> Column:
    a, b, c = F.col("s_xx"), F.col("s_xy"), F.col("s_yy")
    return (a + c) / 2 + sign * F.sqrt(((a - c) / 2) * ((a - c) / 2) + b * b)


_HESSIAN = {"xx": HESSIAN_XX, "xy": HESSIAN_XY, "yy": HESSIAN_YY}


def hessian(part: str) -> Op:
    """xx, xy or yy of the matrix of second derivatives."""
    return neighbourhood(f"hessian({part})", 3, _HESSIAN, F.col(f"s_{part}"))


def hessian_eigenvalue(which: str) -> Op:
    """The smaller (low) or larger (high) eigenvalue of the matrix of second derivatives, in closed form."""
    return neighbourhood(f"hessian_eigenvalue({which})", 3, _HESSIAN, _eigen(-1 if which == "low" else 1))


def vesselness(per: str = "frame") -> Chain:
    """max(0, -larger eigenvalue), divided by its maximum + 1e-8."""
    from .scalar import scope_reach, with_scope

    def scaled(df: DataFrame, _: Shape) -> DataFrame:
        return with_scope(df, per, _hi=F.max("v")).withColumn("v", F.col("v") / (F.col("_hi") + 1e-8)).drop("_hi")

    return Chain(neighbourhood("vesselness", 3, _HESSIAN, F.greatest(-_eigen(1), F.lit(0.0))), Op("scale", scaled, scope_reach(per)))


def patches(name: str, k: int, value) -> Op:
    """value(p) of the array p of a pixel's k x k patch times a disk mask, in rows; the edge is repeated."""

    def apply(df: DataFrame, shape: Shape) -> DataFrame:
        mask = {(y, x): 1.0 for y, x, _ in disk(k)}
        spread = _spread(df, shape, k, {"m": [(y, x, mask.get((y, x), 0.0)) for y in range(k) for x in range(k)]}, "same")
        # sums over a patch of bounded size: no array is needed for their parts
        return value(spread.withColumn("p", F.col("v") * F.col("m")).groupBy("n", "c", "y", "x")).select("n", "c", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "v")

    return Op(name, apply, _reach(k, "same"), True)


def local_softmax(k: int) -> Op:
    """The mean of a patch with weights softmax(p). Places outside the disk take part with p = 0."""
    return patches(f"local_softmax({k})", k, lambda g: g.agg((F.sum(F.col("p") * F.exp("p")) / F.sum(F.exp("p"))).alias("v")))


def local_softmin(k: int) -> Op:
    """The mean of a patch with weights softmax(1 - p)."""
    weight = F.exp(1 - F.col("p"))
    return patches(f"local_softmin({k})", k, lambda g: g.agg((F.sum(F.col("p") * weight) / F.sum(weight)).alias("v")))


def remove_background(k: int) -> Op:
    """-(sum of sqrt(p s + 1e-5)) with s = softmin(10 p) over the patch."""

    def value(g):
        q = g.agg(F.collect_list("p").alias("ps"))  # k x k values
        total = F.aggregate("ps", F.lit(0.0), lambda a, p: a + F.exp(-10 * p))
        return q.withColumn("v", -F.aggregate("ps", F.lit(0.0), lambda a, p: a + F.sqrt(p * F.exp(-10 * p) / total + 1e-5)))

    return patches(f"remove_background({k})", k, value)


def rank_filter(name: str, k: int, agg, padding: str = "same") -> Op:
    """min, max or median over a k x k neighbourhood."""

    def apply(df: DataFrame, shape: Shape) -> DataFrame:
        spread = _spread(df, shape, k, {"m": box(k)}, padding)
        return spread.groupBy("n", "c", "y", "x").agg(agg("v").alias("v")).select("n", "c", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "v")

    return Op(name, apply, _reach(k, padding), True)


def dilate(k: int) -> Op:
    return rank_filter(f"dilate({k})", k, F.max)


def erode(k: int) -> Op:
    return rank_filter(f"erode({k})", k, F.min)


def median(k: int) -> Op:
    return rank_filter(f"median({k})", k, F.median)


def opening(k: int) -> Chain:
    return Chain(erode(k), dilate(k))


def closing(k: int) -> Chain:
    return Chain(dilate(k), erode(k))


def normals(axis: str) -> Op:
    """x, y or z of the surface normal (-gx, -gy, 1) / (length + 1e-6); beyond the edge the surface is 0."""

    def apply(df: DataFrame, shape: Shape) -> DataFrame:
        one = {"gx": SOBEL_X, "gy": SOBEL_Y, "m": box(3)}
        wide = _spread(df.withColumn("y", F.col("y") + 1).withColumn("x", F.col("x") + 1), shape.with_(y=shape.y + 2, x=shape.x + 2), 3, one, "valid")
        g = wide.groupBy("n", "c", "y", "x").agg(F.sum(F.col("gx") * F.col("v")).alias("gx"), F.sum(F.col("gy") * F.col("v")).alias("gy"))
        length = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy") + 1) + 1e-6
        return g.select("n", "c", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), ({"x": -F.col("gx"), "y": -F.col("gy"), "z": F.lit(1.0)}[axis] / length).alias("v"))

    return Op(f"normals({axis})", apply, _reach(3, "same"), True)


def downsample(factor: int) -> Op:
    """The mean of blocks of factor x factor pixels; what does not fill a block is left out."""

    def apply(df: DataFrame, shape: Shape) -> DataFrame:
        y, x = F.floor(F.col("y") / factor).cast("int"), F.floor(F.col("x") / factor).cast("int")
        inside = (F.col("y") < shape.y // factor * factor) & (F.col("x") < shape.x // factor * factor)
        got = df.where(inside).groupBy("n", "c", y.alias("y"), x.alias("x")).agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("_n"))
        return got.where(F.col("_n") == factor * factor).drop("_n")

    one = Reach(factor, factor)
    return Op(f"downsample({factor})", apply, Halo({"y": one, "x": one}), True)
