"""Noise with the shape of a stack, drawn from hashes of the coordinates: equal on every run and however rows are dealt."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.pipe import FramePipe, Op
from .fuse import fuse


def unit(seed: int, draw: int = 0) -> Column:
    """Uniform in (0, 1) for each pixel."""
    h = F.xxhash64("n", "c", "y", "x", F.lit(seed), F.lit(draw))
    return (F.pmod(h, F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _normal(seed: int) -> Column:
    return F.sqrt(-2 * F.log(unit(seed))) * F.cos(2 * math.pi * unit(seed, 1))


def _poisson(seed: int, rate: float) -> Column:
    """By adding up probabilities, to six deviations over the mean."""
    u, term, total, count = unit(seed), math.exp(-rate), 0.0, F.lit(0)
    for k in range(int(rate + 6 * math.sqrt(rate)) + 8):
        total += term
        count = count + F.when(u > total, 1).otherwise(0)
        term *= rate / (k + 1)
    return count.cast("double")


KINDS = {
    "gaussian": lambda seed, scale: scale * _normal(seed),
    "uniform": lambda seed, scale: scale * unit(seed),
    "exponential": lambda seed, scale: -scale * F.log(unit(seed)),
    "laplace": lambda seed, scale: -scale * F.signum(unit(seed) - 0.5) * F.log(1 - 2 * F.abs(unit(seed) - 0.5)),
    "rayleigh": lambda seed, scale: scale * F.sqrt(-2 * F.log(1 - unit(seed))),
    "poisson": lambda seed, scale: _poisson(seed, scale),
}


def noise_like(kind: str, seed: int = 0, scale: float = 1.0) -> Op:
    """Independent noise in place of a stack's values; scale is the deviation, range, mean or rate of its kind."""
    value = KINDS[kind](seed, scale)
    return Op(f"{kind} noise", lambda df, _: df.withColumn("v", value))


def multiplicative(noise: FramePipe, pipe: FramePipe, gain: float) -> FramePipe:
    """v (1 + 2 gain (noise - 0.5))."""
    return fuse(lambda a, b: a() * (1 + gain * 2 * (b() - 0.5)), a=pipe, b=noise)


def noise_shaped(clean: FramePipe, noisy: FramePipe) -> FramePipe:
    """clean / (noisy + 1e-6), moved to the clean mean."""
    ratio = fuse(lambda a, b: a() / (b() + 1e-6), a=clean, b=noisy)
    means = F.broadcast(ratio.all().agg(F.avg("v").alias("_r")).crossJoin(clean.all().agg(F.avg("v").alias("_c"))))
    return ratio | Op("centre", lambda df, _: df.crossJoin(means).withColumn("v", F.col("v") - F.col("_r") + F.col("_c")).drop("_r", "_c"))
