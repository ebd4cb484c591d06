import json
import os
import zlib

import numpy as np
import pytest

from stackweave.operators import packed
from stackweave.plans import blocks
from stackweave.plans.blocks import Layout
from stackweave.sources import registry, zarr


@pytest.fixture(scope="module")
def made(spark):
    a = np.random.default_rng(1).integers(0, 256, (23, 2, 9, 10)).astype(float)
    frames = spark.createDataFrame([(i, f.ravel().tolist()) for i, f in enumerate(a)], "n long, px array<double>").cache()
    return a, blocks.from_arrays(frames, "n", "px", 9, 10, 2, layout=Layout(5, 4, 6))


@pytest.mark.parametrize("level", [None, 3])
def test_round_trip(spark, made, tmp_path, level):
    a, pipe = made
    path = f"{tmp_path}/a.zarr"
    zarr.save(pipe, path, ticks=spark.createDataFrame([(i, 70 + i) for i in range(23)], "n long, ticks long"), level=level)
    back = zarr.blocks(spark, path)
    assert back.shape == pipe.shape and np.array_equal(back.to_numpy(), a) and np.array_equal(back.to_numpy((slice(7, 9), 1, slice(2, 5))), a[7:9, 1, 2:5])
    loaded = registry.load(spark, path)
    assert np.array_equal(loaded.to_numpy(), a) and sorted(map(tuple, loaded.timestamps(slice(3, 5)).collect())) == [(3, 73), (4, 74)]
    assert sorted(map(tuple, zarr.series(spark, path, zarr.INDEX, "i").collect()))[-1] == (22, 22)
    assert zarr.blocks(spark, path, 7).shape.n == 7 and np.array_equal(zarr.blocks(spark, path, 7).to_numpy(), a[:7])
    names = {name: d["shape"] for name, d in zarr.arrays(spark, path).items()}
    assert names == {"frames": [23, 2, 9, 10], zarr.TICKS: [23], zarr.INDEX: [23]}
    with pytest.raises(FileExistsError):
        zarr.save(pipe, path)
    # by the format's own rules, without this library
    d = json.load(open(f"{path}/frames/.zarray"))
    raw = open(f"{path}/frames/4.1.2.1", "rb").read()
    chunk = np.frombuffer(zlib.decompress(raw) if level else raw, d["dtype"]).reshape(d["chunks"])
    assert d["chunks"] == [5, 1, 4, 6] and np.array_equal(chunk[:3, 0, :1, :4], a[20:23, 1, 8:9, 6:10]) and not chunk[3:].any()
    assert len([f for f in os.listdir(f"{path}/frames") if f[0] != "."]) == 5 * 2 * 3 * 2


def files_read(df):
    df.write.format("noop").mode("overwrite").save()
    rows, plan = df.collect(), df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves() if plan.getClass().getSimpleName() != "AdaptiveSparkPlanExec" else plan.executedPlan().collectLeaves()
    total = 0
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        while leaf.getClass().getSimpleName().endswith("QueryStageExec"):
            leaf = leaf.plan().collectLeaves().apply(0)
        found = leaf.metrics().get("numFiles")
        total += found.get().value() if found.isDefined() else 0
    return total, rows


def test_a_slice_opens_only_its_chunks(spark, made, tmp_path):
    a, pipe = made
    path = f"{tmp_path}/b.zarr"
    zarr.save(pipe, path)
    back = zarr.blocks(spark, path)
    few, rows = files_read(back.laid(2, 4, 4)[6:8, :, 0:3, 0:5])
    assert few == 2 and len(rows) == 2 * 2 * 3 * 5  # one chunk of each channel
    assert all(a[r.n, r.c, r.y, r.x] == r.v for r in rows)
    ahead, _ = files_read((back | packed.moving_mean(3))[3:5, :, 0:3, 0:5])
    assert ahead == 4  # frames 3 to 6 lie in two chunks


def test_missing_chunks_hold_the_fill_value(spark, made, tmp_path):
    a, pipe = made
    path = f"{tmp_path}/c.zarr"
    zarr.save(pipe, path)
    os.remove(f"{path}/frames/1.0.1.0")
    want = a.copy()
    want[5:10, 0, 4:8, 0:6] = 0
    assert np.array_equal(zarr.blocks(spark, path).to_numpy(), want)


def test_arrays_of_others(spark, tmp_path):
    a = np.arange(2 * 1 * 3 * 4).reshape(2, 1, 3, 4).astype(">f4")
    path = f"{tmp_path}/d.zarr/frames"
    os.makedirs(path)
    d = {"zarr_format": 2, "shape": [2, 1, 3, 4], "chunks": [2, 1, 3, 4], "dtype": ">f4", "compressor": None, "fill_value": "NaN", "order": "C", "filters": None}
    json.dump(d, open(f"{path}/.zarray", "w"))
    open(f"{path}/0.0.0.0", "wb").write(a.tobytes())
    assert np.array_equal(zarr.blocks(spark, f"{tmp_path}/d.zarr").to_numpy(), a) and zarr.load(spark, f"{tmp_path}/d.zarr").ticks is None
    for change in ({"compressor": {"id": "blosc"}}, {"order": "F"}, {"zarr_format": 3}):
        json.dump({**d, **change}, open(f"{path}/.zarray", "w"))
        with pytest.raises(ValueError):
            zarr.blocks(spark, f"{tmp_path}/d.zarr")


def test_a_chunk_wise_plan_exchanges_nothing(spark, made, tmp_path):
    _, pipe = made
    path = f"{tmp_path}/e.zarr"
    zarr.save(pipe, path)
    same = zarr.blocks(spark, path) | packed.threshold(100)
    assert same.aligned(same.whole()) and "Exchange" not in same.blocks()._jdf.queryExecution().executedPlan().toString()
