import numpy as np
import pytest

from stackweave.operators import packed, shaped
from stackweave.plans import blocks
from stackweave.plans.blocks import Layout


@pytest.fixture(scope="module")
def data(spark):
    a = np.random.default_rng(3).random((5, 1, 14, 19))
    return a[:, 0], blocks.from_arrays(spark.createDataFrame([(i, f.ravel().tolist()) for i, f in enumerate(a)], "n long, px array<double>").cache(), "n", "px", 14, 19, layout=Layout(2, 4, 6))


def cubic(t):
    t = abs(t)
    return 1.25 * t**3 - 2.25 * t**2 + 1 if t <= 1 else -0.75 * t**3 + 3.75 * t**2 - 6 * t + 3 if t < 2 else 0.0


def brute(row, scale, mode):
    n, out = len(row), []
    for i in range(int(np.floor(n * scale))):
        at = (i + 0.5) / scale - 0.5
        if mode == "nearest":
            out.append(row[min(int(np.floor(i / scale)), n - 1)])
        elif mode == "nearest-exact":
            out.append(row[min(int(np.floor((i + 0.5) / scale)), n - 1)])
        elif mode == "area":
            m = int(np.floor(n * scale))
            part = row[i * n // m : -(-(i + 1) * n // m)]
            out.append(sum(part) / len(part))
        elif mode == "bilinear":
            at = max(at, 0)
            k = int(np.floor(at))
            out.append(row[k] * (1 - at + k) + row[min(k + 1, n - 1)] * (at - k))
        else:
            k = int(np.floor(at))
            out.append(sum(row[min(max(k + j, 0), n - 1)] * cubic(at - k - j) for j in range(-1, 3)))
    return np.array(out)


@pytest.mark.parametrize("mode", packed.MODES)
@pytest.mark.parametrize("scale", [0.5, 0.37, 1.5, 2, 1])
def test_equals_numpy_whole_and_sliced(data, scale, mode):
    a, pipe = data
    want = np.stack([np.apply_along_axis(lambda c: brute(c, scale, mode), 0, np.apply_along_axis(lambda r: brute(r, scale, mode), 1, f)) for f in a])
    made = pipe | packed.resample(scale, mode)
    assert (made.shape.y, made.shape.x) == want.shape[1:] and np.allclose(made.to_numpy()[:, 0], want)
    part = (slice(1, 3), 0, slice(2, 5), slice(3, 6))
    assert np.allclose(made.to_numpy(part), want[1:3, 2:5, 3:6])


def test_a_slice_reads_only_its_places(data):
    need = (data[1] | packed.resample(0.5, "bilinear")).plan.need({"n": (1, 2), "c": (0, 1), "y": (2, 4), "x": (3, 4)})
    assert need[0] == {"n": (1, 2), "c": (0, 1), "y": (4, 8), "x": (6, 8)}
    with pytest.raises(ValueError):
        packed.resample(0.5, "spline")


def test_chained_with_windows(data):
    a, pipe = data
    both = pipe | packed.moving_mean(2) | packed.resample(2, "nearest") | packed.gaussian_blur(3, 1.0)
    want = np.repeat(np.repeat((a[1:] + a[:-1]) / 2, 2, 1), 2, 2)
    one = np.exp(-np.array([1, 0, 1]) / 2)
    one /= one.sum()
    wide = np.pad(want, ((0, 0), (1, 1), (1, 1)), mode="edge")
    rows = sum(w * wide[:, k : k + want.shape[1]] for k, w in enumerate(one))
    want = sum(w * rows[:, :, k : k + want.shape[2]] for k, w in enumerate(one))
    assert np.allclose(both.to_numpy()[:, 0], want)


def test_tiled_noise_and_the_best_scale(spark, data):
    a, pipe = data
    tile = np.random.default_rng(4).random((6, 7))
    scales = shaped.log_scales()
    assert len(scales) == 25 and scales[0] == 0.25 and abs(scales[-1] - 4) < 1e-12
    noise = shaped.tiled(tile, 14, 19, 1.3, 8)
    for y, x in ((0, 0), (5, 11), (13, 18)):
        p, q = y / 1.3 % 8 / 8 * 5, x / 1.3 % 8 / 8 * 6
        i, j = int(p), int(q)
        v, u = p - i, q - j
        assert abs(noise[y, x] - (tile[i, j] * (1 - v) * (1 - u) + tile[i + 1, j] * v * (1 - u) + tile[i, j + 1] * (1 - v) * u + tile[i + 1, j + 1] * v * u)) < 1e-12
    got = {r.n: r for r in shaped.matching_scale(pipe, tile, period=8).collect()}
    made = shaped.matching_noise(pipe, tile, period=8).toPandas()
    for n, frame in enumerate(a):
        inverse = 1 / (shaped.profile(frame[None])[0] + 1e-6)
        inverse /= inverse.max() + 1e-6
        losses = []
        for s in scales:
            p = shaped.profile(shaped.tiled(tile, 14, 19, s, 8)[None])[0]
            losses.append(np.mean((p / (p.max() + 1e-6) - inverse) ** 2))
        assert abs(got[n].loss - min(losses)) < 1e-12 and got[n].scale == scales[int(np.argmin(losses))]
        want = shaped.tiled(tile, 14, 19, got[n].scale, 8)
        want = want - want.min()
        rows = made[made.n == n].sort_values(["y", "x"])
        assert np.allclose(rows.v.to_numpy().reshape(14, 19), want / (want.max() + 1e-6))
