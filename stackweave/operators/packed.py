"""Operators on packed blocks: the same results as those on pixel rows, from whole arrays.

A kernel gets its block with the halo and gives the places that have all neighbours. Sums over frames are differences of
running sums that start anew in each block; Gaussian and box are one pass along each axis; a disk is one difference of
running sums for each of its rows; minimum and maximum are taken along one axis after the other.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np

from ..plans.blocks import BlockChain, BlockOp, Place
from ..plans.index import Halo, Reach, Shape
from . import spatial, spectral


def elementwise(name: str, f: Callable[[np.ndarray], np.ndarray]) -> BlockOp:
    return BlockOp(name, lambda a, _: f(a))


bytes_to_float01 = elementwise("bytes_to_float01", lambda a: a / 255.0)
float01_to_bytes = elementwise("float01_to_bytes", lambda a: np.trunc(np.clip(a * 255, 0, 255)))


def threshold(cutoff: float) -> BlockOp:
    return elementwise("threshold", lambda a: (a > cutoff).astype(np.float64))


def running(a: np.ndarray, k: int, axis: int = 0) -> np.ndarray:
    """Sums of k neighbours along an axis."""
    total = np.cumsum(a, axis=axis)
    first = np.take(total, [k - 1], axis)
    return np.concatenate([first, np.take(total, range(k, a.shape[axis]), axis) - np.take(total, range(a.shape[axis] - k), axis)], axis)


def _contrast(mean: np.ndarray, square: np.ndarray, eps: float) -> np.ndarray:
    return np.sqrt(np.abs(square - mean * mean) + eps) / (mean + eps)


def moving_mean(k: int) -> BlockOp:
    return BlockOp(f"moving_mean({k})", lambda a, _: running(a, k) / k, Halo({"n": Reach(k)}))


def temporal_contrast(k: int = 7, eps: float = 1e-6) -> BlockOp:
    return BlockOp(f"temporal_contrast({k})", lambda a, _: _contrast(running(a, k) / k, running(a * a, k) / k, eps), Halo({"n": Reach(k)}))


def _correlate(a: np.ndarray, kernel: spatial.Kernel, k: int) -> np.ndarray:
    """Weighted sums over the places of a kernel."""
    h, w = a.shape[1] - k + 1, a.shape[2] - k + 1
    out = np.zeros((a.shape[0], h, w))
    for y, x, weight in kernel:
        out += weight * a[:, y : y + h, x : x + w]
    return out


def _separable(a: np.ndarray, weights: np.ndarray) -> np.ndarray:
    k = len(weights)
    h, w = a.shape[1] - k + 1, a.shape[2] - k + 1
    rows = sum(weight * a[:, j : j + h] for j, weight in enumerate(weights))
    return sum(weight * rows[:, :, j : j + w] for j, weight in enumerate(weights))


def _disk_mean(a: np.ndarray, k: int) -> np.ndarray:
    """The mean over the places within radius k // 2: one span of columns for each row."""
    r = k // 2
    spans = [(dy, int(np.sqrt(r * r - dy * dy))) for dy in range(-r, r + 1)]
    h, w = a.shape[1] - 2 * r, a.shape[2] - 2 * r
    total = np.concatenate([np.zeros((*a.shape[:2], 1)), np.cumsum(a, axis=2)], 2)
    out = np.zeros((a.shape[0], h, w))
    for dy, half in spans:
        rows = total[:, r + dy : r + dy + h]
        out += rows[:, :, r + half + 1 : r + half + 1 + w] - rows[:, :, r - half : r - half + w]
    return out / sum(2 * half + 1 for _, half in spans)


def convolve(kernel: spatial.Kernel, k: int, padding: str = "valid", name: str = "convolve") -> BlockOp:
    return BlockOp(name, lambda a, _: _correlate(a, kernel, k), spatial._reach(k, padding))


def gaussian_blur(k: int, sigma: float) -> BlockOp:
    if k % 2 == 0:
        raise ValueError("k has to be odd")
    one = np.exp(-((np.arange(k) - k // 2) ** 2) / (2 * sigma * sigma))
    one /= one.sum()
    return BlockOp(f"gaussian_blur({k})", lambda a, _: _separable(a, one), spatial._reach(k, "same"))


def difference_of_gaussians(k: int, low: float = 2, high: float = 3) -> BlockChain:
    wide, near = (gaussian_blur(k, s).kernel for s in (high, low))
    return BlockChain((map01(), BlockOp("difference_of_gaussians", lambda a, p: wide(a, p) - near(a, p), spatial._reach(k, "same"))))


def disk_blur(k: int, padding: str = "same") -> BlockOp:
    """The mean over a disk; over a box for k = 3."""
    size = 2 * (k // 2) + 1
    box = np.full(size, 1 / size)
    return BlockOp(f"disk_blur({k})", lambda a, _: _separable(a, box) if k == 3 else _disk_mean(a, k), spatial._reach(size, padding))


def spatial_contrast(k: int = 7, eps: float = 1e-6) -> BlockOp:
    return BlockOp(f"spatial_contrast({k})", lambda a, _: _contrast(_disk_mean(a, k), _disk_mean(a * a, k), eps), spatial._reach(2 * (k // 2) + 1, "valid"))


def laplacian_contrast() -> BlockOp:
    return BlockOp("laplacian_contrast", lambda a, _: np.abs(_correlate(a, spatial.LAPLACIAN, 3)), spatial._reach(3, "valid"))


def sobel(axis: str) -> BlockOp:
    return convolve({"y": spatial.SOBEL_Y, "x": spatial.SOBEL_X}[axis], 3, name=f"sobel({axis})")


def hessian_eigenvalue(which: str) -> BlockOp:
    sign = -1 if which == "low" else 1

    def kernel(a: np.ndarray, _: Place) -> np.ndarray:
        xx, xy, yy = (_correlate(a, k, 3) for k in (spatial.HESSIAN_XX, spatial.HESSIAN_XY, spatial.HESSIAN_YY))
        return (xx + yy) / 2 + sign * np.sqrt(((xx - yy) / 2) ** 2 + xy * xy)

    return BlockOp(f"hessian_eigenvalue({which})", kernel, spatial._reach(3, "valid"))


def _along(f, k: int) -> Callable[[np.ndarray, Place], np.ndarray]:
    def kernel(a: np.ndarray, _: Place) -> np.ndarray:
        for axis in (1, 2):
            a = f(np.lib.stride_tricks.sliding_window_view(a, k, axis), axis=-1)
        return a

    return kernel


def dilate(k: int) -> BlockOp:
    return BlockOp(f"dilate({k})", _along(np.max, k), spatial._reach(k, "same"))


def erode(k: int) -> BlockOp:
    return BlockOp(f"erode({k})", _along(np.min, k), spatial._reach(k, "same"))


def median(k: int) -> BlockOp:
    """The median over k x k places, frame by frame: k * k values a pixel are held for one frame of a block."""

    def kernel(a: np.ndarray, _: Place) -> np.ndarray:
        views = np.lib.stride_tricks.sliding_window_view(a, (k, k), (1, 2))
        return np.stack([np.median(v.reshape(*v.shape[:2], k * k), axis=-1) for v in views]) if len(a) else np.zeros((0, *views.shape[1:3]))

    return BlockOp(f"median({k})", kernel, spatial._reach(k, "same"))


def opening(k: int) -> BlockChain:
    return BlockChain((erode(k), dilate(k)))


def closing(k: int) -> BlockChain:
    return BlockChain((dilate(k), erode(k)))


class _Frame(Halo):
    """The reach of an operator that reads whole frames."""

    def source(self, ranges: dict, shape: Shape) -> dict:
        return ranges | {"y": (0, shape.y), "x": (0, shape.x)}


def framed(name: str, f: Callable[[np.ndarray], np.ndarray], shape: Callable[[Shape], Shape] | None = None) -> BlockOp:
    """An operator from f(frames, the last two axes are a frame's) to others; lay such a pipe out in whole frames."""
    return BlockOp(name, lambda a, _: f(a), _Frame(), shape or (lambda s: s))


def map01() -> BlockOp:
    def f(a: np.ndarray) -> np.ndarray:
        lo, hi = a.min((1, 2), keepdims=True), a.max((1, 2), keepdims=True)
        return (a - lo) / (hi - lo + 1e-8)

    return framed("map01", f)


def psd(kind: str = "hann") -> BlockOp:
    return framed("psd", partial(spectral.psd_of, kind=kind), spectral._to_square)


def magnitude(kind: str = "hann", log: bool = False) -> BlockOp:
    return framed("magnitude", partial(spectral.magnitude_of, kind=kind, log=log), spectral._to_square)


def lowpass(cutoff: float = 0.5, width: float = 0.1) -> BlockOp:
    return framed("lowpass", partial(spectral.lowpass_of, cutoff=cutoff, width=width))


def _taps(mode: str, scale: float, a: int, b: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each output place of a range the source places it reads and their weights; places beyond the edge are the edge."""
    out = np.arange(a, b)
    if mode in ("nearest", "nearest-exact"):
        at = np.floor((out + (0.5 if mode == "nearest-exact" else 0.0)) / scale).astype(np.int64)[:, None]
        return np.clip(at, 0, size - 1), np.ones(at.shape)
    if mode == "area":
        total = max(1, int(np.floor(size * scale)))
        first, last = out * size // total, -(-(out + 1) * size // total)
        span = int((last - first).max(initial=1))
        at = first[:, None] + np.arange(span)
        inside = at < last[:, None]
        return np.clip(at, 0, size - 1), inside / (last - first)[:, None]
    place = (out + 0.5) / scale - 0.5
    if mode == "bilinear":
        place = np.maximum(place, 0.0)
        low = np.floor(place).astype(np.int64)
        t = place - low
        return np.clip(np.stack([low, low + 1], 1), 0, size - 1), np.stack([1 - t, t], 1)
    low = np.floor(place).astype(np.int64)
    t = place - low
    distance = np.abs(t[:, None] - np.arange(-1, 3))
    near = ((_CUBIC + 2) * distance - (_CUBIC + 3)) * distance * distance + 1
    far = ((_CUBIC * distance - 5 * _CUBIC) * distance + 8 * _CUBIC) * distance - 4 * _CUBIC
    return np.clip(low[:, None] + np.arange(-1, 3), 0, size - 1), np.where(distance <= 1, near, far)


#: The slope of the cubic kernel, a fixed value.
_CUBIC = -0.75
MODES = ("nearest", "nearest-exact", "bilinear", "bicubic", "area")


class _Scaled(Halo):
    """The reach of a resampling: a rational scale, so the places read are those of the range's first and last place."""

    def __init__(self, scale: float, mode: str):
        super().__init__({})
        object.__setattr__(self, "by", (scale, mode))

    def shape(self, shape: Shape) -> Shape:
        scale, _ = self.by
        return shape.with_(y=int(np.floor(shape.y * scale)), x=int(np.floor(shape.x * scale)))

    def source(self, ranges: dict, shape: Shape) -> dict:
        scale, mode = self.by
        out = dict(ranges)
        for axis in ("y", "x"):
            a, b = ranges[axis]
            if a < b:
                ends = [_taps(mode, scale, k, k + 1, shape[axis])[0] for k in (a, b - 1)]
                out[axis] = int(ends[0].min()), int(ends[1].max()) + 1
        return out


def resample(scale: float, mode: str = "bicubic") -> BlockOp:
    """Frames of floor(size * scale) rows and columns. Pixels are areas: the centre of place i is (i + 0.5) / scale - 0.5.

    nearest, nearest-exact, bilinear, bicubic (without anti-aliasing; what lies beyond the edge is the edge) or area, the mean
    of all source pixels that an output pixel covers a part of.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    if scale <= 0:
        raise ValueError("the scale has to be positive")

    def kernel(a: np.ndarray, place: Place) -> np.ndarray:
        for k, axis in ((1, "y"), (2, "x")):
            (lo, hi), (first, last) = place.wanted[axis], place.source[axis]
            at, weights = _taps(mode, scale, lo, hi, place.shape[axis])
            rows = np.zeros((hi - lo, last - first))
            np.add.at(rows, (np.arange(hi - lo)[:, None], np.clip(at - first, 0, last - first - 1)), weights)
            a = np.moveaxis(np.tensordot(rows, a, (1, k)), 0, k)
        return a

    return BlockOp(f"resample({scale}, {mode})", kernel, _Scaled(scale, mode))
