import numpy as np
import pytest

from stackweave.operators import masks, scalar
from stackweave.plans import blocks
from stackweave.plans.blocks import Layout
from stackweave.plans.index import Shape
from stackweave.sinks.recording import copy_files
from stackweave.sources import stacks


def slow(a, k, f, fill):
    out, before = np.zeros_like(a), k // 2
    for y in range(a.shape[0]):
        for x in range(a.shape[1]):
            out[y, x] = f([a[j, i] if 0 <= j < a.shape[0] and 0 <= i < a.shape[1] else fill for j in range(y - before, y - before + k) for i in range(x - before, x - before + k)])
    return out


def slow_cleaned(mask):
    opened = slow(slow(slow(mask, 8, min, np.inf), 8, max, -np.inf), 8, max, -np.inf) * mask
    level = masks.map01(opened)
    smooth = slow(level, 11, np.median, 0.0)
    inside = (slow(smooth, 31, np.mean, 0.0)) ** 2 > 0.5
    return np.where(inside, opened > 0, smooth > 0).astype(float)


@pytest.mark.parametrize("seed", range(4))
def test_cleaning(seed):
    r = np.random.default_rng(seed)
    mask = np.zeros((46, 52))
    mask[4:40, 6:46] = 1
    mask *= r.random(mask.shape) > (0.0, 0.02, 0.3, 0.0)[seed]
    mask[42:44, 2:4] = 1
    assert np.array_equal(masks.cleaned(mask), slow_cleaned(mask))


def test_a_bright_part_is_found(spark):
    r = np.random.default_rng(1)
    a = 0.1 + 0.01 * r.random((600, 40, 48))
    a[:, 10:30, 12:36] += 0.5 + 0.2 * r.random((600, 20, 24))
    frames = spark.createDataFrame([(i, f.ravel().tolist()) for i, f in enumerate(a)], "n long, px array<double>")
    got = masks.foreground_mask(blocks.from_arrays(frames, "n", "px", 40, 48, layout=Layout(100, 16, 20)), 256).toPandas()
    assert sorted(got.block.unique()) == [0, 1, 2] and len(got) == 3 * 40 * 48
    for block in range(3):
        made = got[got.block == block].sort_values(["y", "x"]).m.to_numpy().reshape(40, 48)
        part = a[block * 256 : (block + 1) * 256]
        assert np.array_equal(made, masks.cleaned(masks.union(part.std(0, ddof=1), part.mean(0))))
        assert made[14:26, 16:32].all() and not made[:6].any() and not made[:, 42:].any()


def test_valley():
    a = np.r_[np.full(50, 0.1), np.full(30, 0.9), 0.0, 1.0]
    assert 0.1 < masks.valley(a) < 0.2 and masks.valley(np.zeros(5)) == 0


def test_axes_in_another_order(spark):
    a = np.random.default_rng(2).random((5, 2, 3, 4))
    pixels = spark.createDataFrame([(n, c, y, x, float(a[n, c, y, x])) for n in range(5) for c in range(2) for y in range(3) for x in range(4)], "n long, c int, y int, x int, v double")
    pipe = stacks.from_pixels(pixels, Shape(*a.shape))
    turned = pipe | scalar.columns_first
    assert turned.shape == Shape(4, 2, 3, 5) and np.array_equal(turned.to_numpy(), a.transpose(3, 1, 2, 0))
    assert np.array_equal(turned.to_numpy((slice(1, 3), 0, slice(0, 2), slice(2, 4))), a.transpose(3, 1, 2, 0)[1:3, 0, 0:2, 2:4])
    assert np.array_equal((turned | scalar.columns_first).to_numpy(), a)
    with pytest.raises(ValueError):
        scalar.permute("n", "c", "y", "y")


def test_files_are_copied_and_compared(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for k in range(5):
        (tmp_path / "a" / f"f{k}").write_bytes(bytes([k]) * 1000)
    got = copy_files(spark, str(tmp_path / "a"), str(tmp_path / "b")).collect()
    assert len(got) == 5 and all(r.equal for r in got) and sorted(p.name for p in (tmp_path / "b").iterdir() if p.name[0] != ".") == [f"f{k}" for k in range(5)]
    assert all(r.equal for r in copy_files(spark, str(tmp_path / "a"), str(tmp_path / "b")).collect())  # again: nothing to do
    (tmp_path / "b" / "f1").write_bytes(b"other")
    with pytest.raises(Exception, match="FileExistsError"):
        copy_files(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert all(r.equal for r in copy_files(spark, str(tmp_path / "a"), str(tmp_path / "b"), overwrite=True).collect())
