import os
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stackweave.functions import floor_div, floor_mod, readable_size, readable_time, recording_file
from stackweave.operators import aggregate, fuse, geometry, noise, scalar, spatial, spectral, window
from stackweave.plans.index import AXES, Halo, Reach, Shape, normalise, tiles
from stackweave.plans.pipe import Chain, FramePipe, custom
from stackweave.plans.results import kept
from stackweave.sinks.recording import manifest, save_recording
from stackweave.sources import encoded, registry, rls, stacks


def pipe_of(spark, a: np.ndarray) -> FramePipe:
    at = np.indices(a.shape).reshape(4, -1)
    rows = [(int(n), int(c), int(y), int(x), float(v)) for n, c, y, x, v in zip(*at, a.ravel(), strict=True)]
    return FramePipe(spark.createDataFrame(rows, "n long, c int, y int, x int, v double"), Shape(*a.shape))


@pytest.fixture(scope="module")
def stack():
    return np.random.default_rng(1).integers(0, 255, (12, 1, 6, 7)).astype(float)


@pytest.fixture(scope="module")
def pipe(spark, stack):
    out = pipe_of(spark, stack)
    return FramePipe(out.frame.persist(), out.source_shape)


def sliding(a, k):
    return np.lib.stride_tricks.sliding_window_view(a, k, 0)


def contrast(a, k, eps=1e-6):
    w = sliding(a, k)
    m = w.mean(-1)
    return np.sqrt(np.abs((w * w).mean(-1) - m * m) + eps) / (m + eps)


def conv(a, kernel, k):
    out = np.zeros((*a.shape[:2], a.shape[2] - k + 1, a.shape[3] - k + 1))
    for y, x, w in kernel:
        out += w * a[:, :, y : y + out.shape[2], x : x + out.shape[3]]
    return out


def edge(a, r):
    return np.pad(a, ((0, 0), (0, 0), (r, r), (r, r)), "edge")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(1, 4), st.booleans()), max_size=4), st.integers(1, 60), st.data())
def test_halo_reads_what_an_array_would(ops, size, data):
    """Marks that run through a chain of operators say which source places a range of the output needs."""
    reaches = [Reach(radius=e) if same else Reach(e, s) for e, s, same in ops]
    sizes = [size]
    for r in reaches:
        sizes.append(r.size(sizes[-1]))
    if sizes[-1] < 1:
        return
    a = data.draw(st.integers(0, sizes[-1] - 1))
    b = data.draw(st.integers(a + 1, sizes[-1]))
    need = set(range(a, b))
    low, high = a, b
    for r, n in zip(reversed(reaches), reversed(sizes[:-1]), strict=True):
        need = {min(max(p, 0), n - 1) for i in need for p in (range(i - r.radius, i + r.radius + 1) if r.radius else range(i * r.stride, i * r.stride + r.extent))}
        low, high = r.source(low, high, n)
    assert (low, high) == (min(need), max(need) + 1)


def test_index_rules():
    s = Shape(10, 1, 4, 5)
    assert normalise((slice(2, 5), ..., -1), s) == ({"n": (2, 5), "c": (0, 1), "y": (0, 4), "x": (4, 5)}, ["x"])
    assert normalise(slice(-3, 99), s)[0]["n"] == (7, 10)
    assert normalise(3, s)[1] == ["n"]
    for bad in (10, -11, (0, 0, 0, 0, 0), (..., ...)):
        with pytest.raises(IndexError):
            normalise(bad, s)
    with pytest.raises(ValueError):
        normalise(slice(0, 4, 2), s)
    assert [t["n"] for t in tiles(s, {"n": 4}, {"n": 3})] == [(0, 4), (3, 7), (6, 10), (9, 10)]
    assert len(tiles(s, {"n": 5, "y": 2})) == 4
    assert Halo({"n": Reach(4)}).shape(s) == Shape(7, 1, 4, 5)


def test_windows(pipe, stack):
    for k in (1, 4, 5):
        assert np.allclose((pipe | window.moving_mean(k)).to_numpy(), sliding(stack, k).mean(-1))
        assert np.allclose((pipe | window.temporal_contrast(k)).to_numpy(), contrast(stack, k))
        assert np.allclose((pipe | window.running_temporal_contrast(k)).to_numpy(), contrast(stack, k), rtol=1e-4)
    assert (pipe | window.moving_mean(12)).shape.n == 1 and len(pipe | window.moving_mean(13)) == 0
    assert (pipe | window.moving_mean(13)).all().count() == 0


def test_slice_then_operate_is_operate_then_slice(pipe, stack):
    chain = Chain(scalar.bytes_to_float01) | window.temporal_contrast(3) | spatial.disk_blur(3) | window.moving_mean(2) | spatial.laplacian_contrast()
    whole = pipe | chain
    full = whole.to_numpy()
    assert full.shape == (whole.shape.n, 1, whole.shape.y, whole.shape.x)
    for index in (np.s_[2:5], np.s_[:, :, 1:3, 2:4], np.s_[4:, ..., 0:1], np.s_[3, 0]):
        assert np.allclose(whole.to_numpy(index), full[index])
    parts = np.concatenate([whole.to_numpy(slice(a, b)) for a, b, _ in whole.batches(4)])
    assert np.allclose(parts, full)


def test_the_scan_gets_the_halo(pipe):
    plan = (pipe | window.temporal_contrast(3))[4:6]._jdf.queryExecution().optimizedPlan().toString()
    assert "n#" in plan and ">= 4" in plan and "< 8" in plan  # the source range, behind the window


def test_kernels(pipe, stack):
    assert np.allclose((pipe | spatial.laplacian_contrast()).to_numpy(), np.abs(conv(stack, spatial.LAPLACIAN, 3)))
    k = spatial.disk(5)
    m, q = conv(stack, k, 5), conv(stack * stack, k, 5)
    assert np.allclose((pipe | spatial.spatial_contrast(5)).to_numpy(), np.sqrt(np.abs(q - m * m) + 1e-6) / (m + 1e-6))
    assert np.allclose((pipe | spatial.gaussian_blur(5, 1.2)).to_numpy(), conv(edge(stack, 2), spatial.gaussian(5, 1.2), 5))
    assert np.allclose((pipe | spatial.disk_blur(5)).to_numpy(), conv(edge(stack, 2), k, 5))
    assert np.allclose((pipe | spatial.disk_blur(3, "valid")).to_numpy(), conv(stack, spatial.box(3), 3))
    xx, xy, yy = (conv(stack, h, 3) for h in (spatial.HESSIAN_XX, spatial.HESSIAN_XY, spatial.HESSIAN_YY))
    eig = np.linalg.eigvalsh(np.stack([np.stack([xx, xy], -1), np.stack([xy, yy], -1)], -1))
    assert np.allclose((pipe | spatial.hessian_eigenvalue("low")).to_numpy(), eig[..., 0])
    assert np.allclose((pipe | spatial.hessian_eigenvalue("high")).to_numpy(), eig[..., 1])
    view = np.lib.stride_tricks.sliding_window_view(edge(stack, 1), (3, 3), (2, 3))
    for op, f in ((spatial.dilate(3), np.max), (spatial.erode(3), np.min), (spatial.median(3), np.median)):
        assert np.allclose((pipe | op).to_numpy(), f(view, axis=(-1, -2)))
    impulse = np.zeros((1, 1, 7, 7))
    impulse[0, 0, 3, 3] = 1
    got = (pipe_of(pipe.frame.sparkSession, impulse) | spatial.sobel("y")).to_numpy()[0, 0]
    assert np.allclose(got[1:4, 1:4], np.array([[1, 2, 1], [0, 0, 0], [-1, -2, -1]]))
    with pytest.raises(ValueError):
        spatial.gaussian(4, 1)


def test_downsample_and_crop(pipe, stack):
    assert np.allclose((pipe | spatial.downsample(2)).to_numpy(), stack[:, :, :6, :6].reshape(12, 1, 3, 2, 3, 2).mean((3, 5)))
    assert np.allclose((pipe | spatial.downsample(2)).to_numpy(np.s_[1:3, :, 1:2, 1:3]), stack[1:3, :, 2:4, 2:6].reshape(2, 1, 1, 2, 2, 2).mean((3, 5)))
    assert np.allclose((pipe | scalar.roi(2, 1, 3, 4)).to_numpy(), stack[:, :, 1:5, 2:5])
    assert np.allclose((pipe | scalar.transpose).to_numpy(np.s_[:, :, 2:4]), stack.transpose(0, 1, 3, 2)[:, :, 2:4])
    padded = (pipe | scalar.pad_to(8, 9)).to_numpy()
    assert np.allclose(padded[:, :, 1:7, 1:8], stack) and np.allclose(padded[:, 0, 0, 0], stack.min((1, 2, 3)))


def test_scalars(pipe, stack):
    assert np.allclose((pipe | scalar.bytes_to_float01 | scalar.float01_to_bytes).to_numpy(), stack, atol=1)
    assert np.allclose((pipe | scalar.map01("stack")).to_numpy(), (stack - stack.min()) / (stack.max() - stack.min() + 1e-8))
    q = np.quantile(stack, [0.02, 0.98])
    assert np.allclose((pipe | scalar.qtile()).to_numpy(), np.clip(stack, *q))
    assert np.allclose((pipe | (lambda v: v * 2 + 1)).to_numpy(), stack * 2 + 1)
    assert (pipe | (lambda v: v * 0) | scalar.bfi).all().where("v is not null").count() == 0
    assert (pipe | custom("every third", lambda df, s: df.where("n % 3 = 0").withColumn("n", df.n / 3), {"n": (1, 3)})).shape.n == 4


def test_aggregates(pipe, stack):
    flat = stack[:, 0]

    def frame(df):
        out = np.zeros((6, 7))
        for r in df.collect():
            out[r.y, r.x] = r.v
        return out

    assert np.allclose(frame(aggregate.mean_frame(pipe[2:9])), flat[2:9].mean(0))
    assert np.allclose(frame(aggregate.total_temporal_contrast(pipe.all())), flat.std(0) / (flat.mean(0) + 1e-6))
    got = {r.n: r.v for r in aggregate.cumulative_contrast(pipe.all()).collect()}
    run = np.cumsum(flat, 0) / np.arange(1, 13)[:, None, None]
    assert np.allclose([got[n] for n in range(12)], run.std((1, 2), ddof=1) / (run.mean((1, 2)) + 1e-6))
    h = {r.bin: r["count"] for r in aggregate.histogram(pipe.all()).collect()}
    want, _ = np.histogram(flat, 256)
    assert sum(h.values()) == flat.size and abs(np.array([h[k] for k in range(256)]) - want).sum() <= 4
    assert {r.tile for r in aggregate.tiled(pipe.all(), 5, 3, size=12).select("tile").distinct().collect()} == {0, 1, 2, 3}
    a, b = (aggregate.digest(p.all()).head() for p in (pipe, FramePipe(pipe.frame.repartition(5), pipe.source_shape)))
    assert a == b and a.frames == 12 and aggregate.digest((pipe | (lambda v: v + 1)).all()).head() != a


def test_fuse(pipe, stack):
    got = fuse.fuse(lambda a, b: a(n=2) - a(n=-1) + b(x=1), a=pipe, b=pipe | window.moving_mean(2))
    m = sliding(stack, 2).mean(-1)
    want = stack[3:, ..., :-1] - stack[:-3, ..., :-1] + m[1:10, ..., 1:]
    assert got.shape == Shape(9, 1, 6, 6) and np.allclose(got.to_numpy(), want)
    small = fuse.crop_to_common(pipe, pipe | scalar.roi(0, 0, 4, 5))
    assert [p.shape for p in small] == [Shape(12, 1, 5, 4)] * 2
    with pytest.raises(ValueError):
        fuse.fuse(lambda a: a(t=1), a=pipe)


def test_spectra(pipe, stack):
    square = stack[:, :, :, :6] - stack.mean((2, 3), keepdims=True)
    w = spectral.window("hann", 6, 6)
    assert np.allclose((pipe | spectral.psd()).to_numpy(), np.fft.fftshift(np.abs(np.fft.fft2(square * w)) ** 2 / 36, (2, 3)))
    assert np.allclose((pipe | spectral.lowpass(2.0)).to_numpy(), stack)
    mean = (pipe | spectral.lowpass(0.0, 0.0)).to_numpy()
    assert np.allclose(mean, stack.mean((2, 3), keepdims=True) * np.ones_like(stack))
    pink = (pipe | spectral.pink(3)).to_numpy()
    assert np.allclose(pink.std(0), 1) and np.allclose(pink, (pipe | spectral.pink(3)).to_numpy())


def test_noise(spark):
    big = pipe_of(spark, np.zeros((40, 1, 10, 10)))
    for kind, mean, deviation in (("gaussian", 0, 1), ("uniform", 0.5, 0.2887), ("exponential", 1, 1), ("laplace", 0, 1.414), ("rayleigh", 1.2533, 0.655), ("poisson", 1, 1)):
        v = (big | noise.noise_like(kind, 1)).to_numpy()
        assert abs(v.mean() - mean) < 0.1 and abs(v.std() - deviation) < 0.1, kind
    one = big | noise.noise_like("uniform", 2)
    assert np.allclose(one.to_numpy(), FramePipe(big.frame.repartition(7), big.source_shape).then(noise.noise_like("uniform", 2)).to_numpy())
    assert np.allclose(noise.multiplicative(one, big | (lambda v: v + 1), 0.5).to_numpy(), 1 + (one.to_numpy() - 0.5))


def test_geometry(spark, pipe):
    markers = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.5)], "id int, x double, y double")
    px = geometry.denormalise(markers, 5, 9)
    assert [tuple(r) for r in px.orderBy("id").collect()] == [(1, 0.0, 0.0), (2, 8.0, 2.0)]
    mid = geometry.along(px, 1, 2, 0.25, 3).head()
    assert (mid.x, mid.y) == (2.0, 0.5)
    lines = geometry.segments(px, [(1, 2), (2, 1)])
    near = geometry.nearest_segment(pipe.all(), lines, "n").where("n = 0").collect()
    assert len(near) == 42 and {r.label for r in near} <= {1, 2}
    assert abs(next(r.distance for r in near if (r.y, r.x) == (0, 0))) < 1e-9
    assert geometry.labels(["a"]) == {"background": 0, "a": 1}


def test_recordings(spark, pipe, stack, tmp_path):
    path = str(tmp_path / "r.rls")
    ticks = spark.createDataFrame([(n, 1000 + 7 * n) for n in range(12)], "n long, ticks long")
    save_recording(pipe, path, ticks)
    assert os.path.getsize(path) == 30720 + 12 * 50
    with open(path, "rb") as f:
        f.seek(30720)
        assert struct.unpack("<Q", f.read(8))[0] == 1000
    with pytest.raises(FileExistsError):
        save_recording(pipe, path)
    back = registry.load(spark, path)
    assert back.shape == pipe.shape and np.allclose(back.to_numpy(), stack)
    assert rls.load(spark, path, max_frames=5).shape.n == 5
    assert sorted(map(tuple, back.timestamps(slice(2, 4)).collect())) == [(2, 1014), (3, 1021)]
    packed = rls.blocks(spark, path)
    assert packed.tables[0].kind == "u1" and np.allclose(packed.to_numpy(), stack)
    raw = spark.read.format("raw_recording").option("frames_per_task", 3).load(path)
    assert sorted(r.ticks for r in raw.where("n >= 4 and n < 6").collect()) == [1028, 1035]
    assert raw.where("n >= 4 and n < 6").rdd.getNumPartitions() == 1


def test_encoded(spark, pipe, stack, tmp_path):
    path = str(tmp_path / "a.frames.parquet")
    encoded.save(pipe, path)
    assert encoded.verify(pipe, path) and not encoded.verify(pipe | (lambda v: 255 - v), path)
    assert np.allclose(registry.load(spark, path, "cache_raw_reuse").to_numpy(), stack)
    assert registry.load(spark, path, "cache_raw_reuse") is registry.load(spark, path, "cache_raw_reuse")
    registry.release()
    assert 0 < encoded.ratio(spark, path) < 2
    rows = spark.read.parquet(f"{path}/frames").orderBy("n").collect()
    assert [r.offset for r in rows] == [sum(q.length for q in rows[:k]) for k in range(12)]
    encoded.save(pipe, str(tmp_path / "b.frames.parquet"), step=16)
    assert np.allclose(encoded.load(spark, str(tmp_path / "b.frames.parquet")).to_numpy(), np.minimum(np.round(stack / 16) * 16, 255))
    with pytest.raises(ValueError):
        registry.reader_of("x.unknown")
    registry.register("*.special.rls", lambda *a: None)
    assert registry.reader_of("/a/b.special.rls") is registry.READERS["*.special.rls"]


def test_files(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        for k in (10, 9):
            (tmp_path / folder / f"cam__s1__20240101_120000_{k}.tiff").write_bytes(b"x" * k)
    (tmp_path / "b" / "cam__s1__20240101_120000_9.tiff").write_bytes(b"changed")
    got = {r.name: r.equal for r in manifest(spark, str(tmp_path / "a"), str(tmp_path / "b")).collect()}
    assert sorted(got.values()) == [False, True]
    files = registry.image_folder(spark, str(tmp_path / "a")).orderBy("n").collect()
    assert [len(r.content) for r in files] == [9, 10] and files[0].stamp == "20240101_120000"


def test_functions(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1536, -1, "/a/cam__7__d_t_12.tif"), (3 << 30, 9_792_340_000_000, "/a/other.tif")], "b long, ns long, p string")
    r = df.select(readable_size(F.col("b")).alias("s"), readable_time(F.col("ns")).alias("t"), recording_file(F.col("p")).alias("f"), floor_div(F.col("ns"), 2).alias("d"), floor_mod(F.col("ns"), 2).alias("m")).collect()
    assert [x.s for x in r] == ["1.50 KB", "3.00 GB"] and [x.t for x in r] == ["0ms", "2h 43m 12s 340ms"]
    assert (r[0].f.camera, r[0].f.number, r[1].f.camera) == ("cam", 12, None) and (r[0].d, r[0].m) == (-1, 1)


def test_results_are_kept(spark, tmp_path):
    calls = []

    @kept(str(tmp_path))
    def squares(spark, n):
        calls.append(n)
        return spark.range(n).selectExpr("id * id AS v")

    assert squares(spark, 4).count() == squares(spark, 4).count() == 4 and calls == [4]
    squares(spark, 4, force=True)
    squares(spark, 5)
    assert calls == [4, 4, 5]


def test_stacks(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0, 4.0]), (1, [5.0, 6.0, 7.0, 8.0])], "id long, px array<double>")
    pipe = stacks.from_arrays(df, "id", "px", 2, 2)
    assert pipe.shape == Shape(2, 1, 2, 2) and pipe.to_numpy()[1, 0, 1, 0] == 7
    assert sorted(tuple(r) for r in stacks.to_arrays(pipe).collect()) == [(0, [1, 2, 3, 4]), (1, [5, 6, 7, 8])]
    assert stacks.from_arrays(df.limit(0), "id", "px", 2, 2).shape.n == 0
    assert AXES == ("n", "c", "y", "x")


def test_whole_stack_queries_grow_with_the_table(spark):
    import duckdb

    from stackweave.queries import ORACLE, QUERIES

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    for name in ("sum_frame_all", "mean_temporal_contrast"):
        got = QUERIES[name](spark, sf).orderBy("c", "y", "x").collect()
        want = con.execute(f"SELECT c, y, x, v FROM ({ORACLE[name]}) ORDER BY c, y, x").fetchall()
        assert len(got) == len(want) == 64
        assert np.allclose([tuple(r) for r in got], want, atol=2e-6)
