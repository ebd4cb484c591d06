"""Spectra of frames: power, magnitude and low-pass. One frame is one group, transformed with numpy in its task."""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.index import Halo, Reach, Shape
from ..plans.pipe import Op


def window(kind: str, h: int, w: int) -> np.ndarray:
    """hann (periodic), raised_cosine or uniform weights of a frame."""
    if kind == "hann":
        one = [0.5 - 0.5 * np.cos(2 * np.pi * np.arange(k) / k) for k in (h, w)]
        return np.outer(*one)
    if kind == "raised_cosine":
        y, x = np.meshgrid(np.linspace(-1, 1, h), np.linspace(-1, 1, w), indexing="ij")
        r = np.sqrt(y * y + x * x)
        return np.where(r <= 1, 0.5 * (1 + np.cos(np.pi * r)), 0.0)
    if kind == "uniform":
        return np.ones((h, w))
    raise ValueError("kind is hann, raised_cosine or uniform")


def framed(name: str, f, shape_of=lambda s: s) -> Op:
    """An operator from f(frame as a 2-D array) to another one; it needs whole frames."""

    def apply(df: DataFrame, shape: Shape) -> DataFrame:
        h, w = shape.y, shape.x

        def one(rows: pd.DataFrame) -> pd.DataFrame:
            frame = np.zeros((h, w))
            frame[rows.y.to_numpy(), rows.x.to_numpy()] = rows.v.to_numpy()
            got = f(frame)
            y, x = np.indices(got.shape)
            return pd.DataFrame({"n": np.int64(rows.n.iloc[0]), "c": np.int32(rows.c.iloc[0]), "y": y.ravel().astype(np.int32), "x": x.ravel().astype(np.int32), "v": got.ravel()})

        return df.groupBy("n", "c").applyInPandas(one, "n long, c int, y int, x int, v double")

    return Op(name, apply, _WholeFrame({}), True, shape_of)


class _WholeFrame(Halo):
    def source(self, ranges: dict, shape: Shape) -> dict:
        return ranges | {"y": (0, shape.y), "x": (0, shape.x)}


def _square(frames: np.ndarray) -> np.ndarray:
    h, w = frames.shape[-2:]
    side = min(h, w)
    top, left = (h - side) // 2, (w - side) // 2
    return frames[..., top : top + side, left : left + side]


# on one frame, or on many along the first axis


def psd_of(frames: np.ndarray, kind: str = "hann") -> np.ndarray:
    square = _square(frames - frames.mean((-2, -1), keepdims=True))
    size = square.shape[-2:]
    return np.fft.fftshift(np.abs(np.fft.fft2(square * window(kind, *size))) ** 2 / (size[0] * size[1]), (-2, -1))


def magnitude_of(frames: np.ndarray, kind: str = "hann", log: bool = False) -> np.ndarray:
    square = _square(frames)
    got = np.fft.fftshift(np.abs(np.fft.fft2(square * window(kind, *square.shape[-2:]))), (-2, -1))
    return np.log1p(got) if log else got


def lowpass_of(frames: np.ndarray, cutoff: float = 0.5, width: float = 0.1) -> np.ndarray:
    fy, fx = np.meshgrid(*(np.fft.fftfreq(k) for k in frames.shape[-2:]), indexing="ij")
    r = np.sqrt(fy * fy + fx * fx)
    r = r / max(r.max(), 1e-12)
    lo, hi = cutoff - width / 2, cutoff + width / 2
    slope = np.where(r <= lo, 1.0, np.where(r >= hi, 0.0, 0.5 * (1 + np.cos(np.pi * (r - lo) / max(hi - lo, 1e-12))))) if width > 0 else (r <= cutoff).astype(float)
    return np.fft.ifft2(np.fft.fft2(frames) * slope).real


def _to_square(s: Shape) -> Shape:
    return s.with_(y=min(s.y, s.x), x=min(s.y, s.x))


def psd(kind: str = "hann") -> Op:
    """|FFT|^2 / pixels of the centred square less the frame's mean, weighted by a window; frequency 0 in the middle."""

    return framed("psd", partial(psd_of, kind=kind), _to_square)


def magnitude(kind: str = "hann", log: bool = False) -> Op:
    """|FFT| of the weighted centred square, or ln(1 + |FFT|)."""

    return framed("magnitude", partial(magnitude_of, kind=kind, log=log), _to_square)


def lowpass(cutoff: float = 0.5, width: float = 0.1) -> Op:
    """Keeps frequencies up to the cutoff, a part of the largest radius, with a raised-cosine slope."""

    return framed("lowpass", partial(lowpass_of, cutoff=cutoff, width=width))


def pink(seed: int = 0) -> Op:
    """Noise of each pixel along the frames with power 1 / frequency and unit deviation; a pixel's frames are one group."""

    def apply(df: DataFrame, shape: Shape) -> DataFrame:
        def one(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("n")
            rng = np.random.default_rng([seed, int(rows.c.iloc[0]), int(rows.y.iloc[0]), int(rows.x.iloc[0])])
            f = np.fft.rfftfreq(len(rows))
            f[0] = f[1] if len(f) > 1 else 1
            v = np.fft.irfft(np.fft.rfft(rng.standard_normal(len(rows))) / np.sqrt(f), len(rows))
            return rows.assign(v=v / (v.std() + 1e-12))

        return df.groupBy("c", "y", "x").applyInPandas(one, "n long, c int, y int, x int, v double")

    return Op("pink", lambda df, s: apply(df.select("n", "c", "y", "x", "v"), s), Halo({"n": Reach(whole=True)}))


def inverse_spectrum_scale(frames: DataFrame, target: DataFrame, scales: list[float]) -> DataFrame:
    """The scale whose radial profile (scale, r, v) is nearest to 1 / the target profile (r, v), both of unit sum."""
    goal = target.select("r", (1 / (F.col("v") + 1e-8)).alias("g"))
    goal = goal.crossJoin(F.broadcast(goal.agg(F.sum("g").alias("_g")))).select("r", (F.col("g") / F.col("_g")).alias("g"))
    total = frames.groupBy("scale").agg(F.sum("v").alias("_s"))
    loss = frames.where(F.col("scale").isin(scales)).join(total, "scale").join(goal, "r").groupBy("scale").agg(F.sqrt(F.sum(F.pow(F.col("v") / F.col("_s") - F.col("g"), 2))).alias("loss"))
    return loss.agg(F.min(F.struct("loss", "scale")).alias("b")).select("b.scale", "b.loss")
