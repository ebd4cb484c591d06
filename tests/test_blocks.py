import numpy as np
import pytest

from stackweave.operators import packed, scalar, spatial, spectral, window
from stackweave.plans import blocks
from stackweave.plans.blocks import Layout
from stackweave.plans.index import Shape
from stackweave.sources import stacks

SHAPE = Shape(23, 2, 11, 13)


@pytest.fixture(scope="module")
def array():
    return np.random.default_rng(1).random((SHAPE.n, SHAPE.c, SHAPE.y, SHAPE.x))


@pytest.fixture(scope="module")
def frames(spark, array):
    return spark.createDataFrame([(i, f.ravel().tolist()) for i, f in enumerate(array)], "n long, px array<double>").repartition(3).cache()


def packed_pipe(frames, layout=None):
    return blocks.from_arrays(frames, "n", "px", SHAPE.y, SHAPE.x, SHAPE.c, layout=layout)


def pixel_pipe(frames):
    both = stacks.from_arrays(frames, "n", "px", SHAPE.y, SHAPE.x, SHAPE.n)
    return stacks.from_pixels(both.frame, SHAPE)


PAIRS = {
    "moving_mean": (packed.moving_mean(4), lambda: window.moving_mean(4)),
    "temporal_contrast": (packed.temporal_contrast(5), lambda: window.temporal_contrast(5)),
    "gaussian": (packed.gaussian_blur(5, 1.5), lambda: spatial.gaussian_blur(5, 1.5)),
    "disk": (packed.disk_blur(5), lambda: spatial.disk_blur(5)),
    "box": (packed.disk_blur(3), lambda: spatial.disk_blur(3)),
    "disk_valid": (packed.disk_blur(7, "valid"), lambda: spatial.disk_blur(7, "valid")),
    "spatial_contrast": (packed.spatial_contrast(5), lambda: spatial.spatial_contrast(5)),
    "laplacian": (packed.laplacian_contrast(), lambda: spatial.laplacian_contrast()),
    "sobel": (packed.sobel("x"), lambda: spatial.sobel("x")),
    "hessian": (packed.hessian_eigenvalue("low"), lambda: spatial.hessian_eigenvalue("low")),
    "median": (packed.median(3), lambda: spatial.median(3)),
    "opening": (packed.opening(3), lambda: spatial.opening(3)),
    "closing": (packed.closing(3), lambda: spatial.closing(3)),
    "dog": (packed.difference_of_gaussians(5), lambda: spatial.difference_of_gaussians(5)),
    "psd": (packed.psd(), lambda: spectral.psd()),
    "magnitude": (packed.magnitude("raised_cosine", True), lambda: spectral.magnitude("raised_cosine", True)),
    "lowpass": (packed.lowpass(), lambda: spectral.lowpass()),
    "map01": (packed.map01(), lambda: scalar.map01("frame")),
    "threshold": (packed.threshold(0.5), lambda: scalar.threshold(0.5)),
}


@pytest.mark.parametrize("name", PAIRS)
def test_equals_the_operator_on_pixels(frames, name):
    mine, theirs = PAIRS[name]
    theirs = theirs()
    if name in ("map01", "dog"):  # the scope of a frame is all its channels on pixels, and one channel in blocks
        one = stacks.from_pixels(pixel_pipe(frames).frame.where("c = 0"), SHAPE.with_(c=1))
        want = (one | theirs).to_numpy()
        got = (blocks.from_pixels(one, Layout(6, 4, 5)) | mine).to_numpy()
    else:
        want = (pixel_pipe(frames) | theirs).to_numpy()
        got = (packed_pipe(frames, Layout(6, 4, 5)) | mine).to_numpy()
    assert got.shape == want.shape and np.allclose(got, want, atol=1e-9, equal_nan=True)


CHAIN = packed.gaussian_blur(3, 1.0), packed.temporal_contrast(4), packed.spatial_contrast(3)


@pytest.mark.parametrize("layout", [Layout(1, 11, 13), Layout(5, 3, 4), Layout(64, 64, 64), Layout(2, 1, 13)])
@pytest.mark.parametrize("index", [slice(None), (slice(3, 9), slice(1, 2), slice(2, 7), slice(5, 6)), (5, 0), (slice(0, 0),)])
def test_slices_and_layouts_change_nothing(frames, layout, index):
    pipe = packed_pipe(frames, layout)
    whole = packed_pipe(frames, Layout(64, 64, 64))
    for op in CHAIN:
        pipe, whole = pipe | op, whole | op
    assert np.array_equal(pipe.to_numpy(index), whole.to_numpy()[index]) or np.allclose(pipe.to_numpy(index), whole.to_numpy()[index], atol=1e-12)


def test_pixels_of_a_slice(frames):
    pipe = packed_pipe(frames, Layout(5, 3, 4)) | packed.temporal_contrast(4)
    rows = pipe[3:5, 1, 2:4, 7].toPandas()
    assert sorted(rows.columns) == ["n", "v", "y"] and len(rows) == 4
    want = pipe.to_numpy()
    assert all(abs(want[r.n, 1, r.y, 7] - r.v) < 1e-12 for r in rows.itertuples())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_frames_by_themselves_need_no_exchange(frames):
    pipe = packed_pipe(frames) | packed.gaussian_blur(5, 1.0) | packed.psd()
    assert pipe.aligned(pipe.whole()) and "Exchange hashpartitioning" not in plan_of(pipe.blocks())
    assert "no exchange" in pipe.explain_plan()


def test_windows_have_one_exchange_by_block(frames):
    pipe = packed_pipe(frames, Layout(8, 11, 13)) | packed.temporal_contrast(5) | packed.gaussian_blur(3, 1.0)
    plan = plan_of(pipe.blocks())
    keys = {k.split(")")[0] for k in plan.split("Exchange hashpartitioning(")[1:]}
    assert len(keys) == 1 and [k.split("#")[0] for k in keys.pop().split(", ")[:3]] == ["c", "i", "tile"]


def test_a_slice_filters_the_source(spark, frames, tmp_path):
    pipe = packed_pipe(frames, Layout(4, 11, 13)).kept(f"{tmp_path}/blocks") | packed.moving_mean(3)
    plan = plan_of(pipe.blocks((slice(9, 11),)))
    assert "PushedFilters: [IsNotNull(n0), GreaterThan(n0,5), LessThan(n0,13)]" in plan
    assert np.allclose(pipe.to_numpy((slice(9, 11),)), (packed_pipe(frames) | packed.moving_mean(3)).to_numpy()[9:11])


def test_means(frames, array):
    pipe = packed_pipe(frames, Layout(6, 4, 5))
    got = blocks.mean_frame(pipe, (slice(2, 19),)).toPandas()
    assert len(got) == SHAPE.c * SHAPE.y * SHAPE.x
    want = array[2:19].mean(0)
    assert all(abs(want[r.c, r.y, r.x] - r.v) < 1e-12 for r in got.itertuples())
    of = blocks.frame_means(pipe).toPandas()
    assert all(abs(array[r.n].mean() - r.mean) < 1e-12 and abs(array[r.n].std(ddof=1) - r.deviation) < 1e-9 for r in of.itertuples())


def test_subbatches_cover_the_stack(frames, array):
    pipe, seen = packed_pipe(frames, Layout(6, 11, 13)), np.zeros(array.shape)
    for r, df in pipe.subbatches({"n": 10, "y": 6}):
        rows = df.toArrow()
        for batch in rows.to_batches():
            for c, n, y, x, a in blocks.read_blocks(batch):
                seen[n : n + a.shape[0], c, y : y + a.shape[1], x : x + a.shape[2]] += a
                assert r["n"][0] <= n and n + a.shape[0] <= r["n"][1]
    assert np.allclose(seen, array)


def test_no_frames(spark):
    pipe = blocks.from_arrays(spark.createDataFrame([], "n long, px array<double>"), "n", "px", 2, 2) | packed.moving_mean(3)
    assert pipe.shape.n == 0 and pipe.all().count() == 0
