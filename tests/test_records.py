import dataclasses
import datetime
from typing import Literal

import numpy as np
import pytest

from stackweave.operators import window
from stackweave.plans.index import Shape
from stackweave.plans.pipe import FramePipe
from stackweave.sources import encoded, records, stacks


@dataclasses.dataclass
class Lens:
    name: str
    focal: float
    coating: Literal["none", "single", "multi"] = "none"


@dataclasses.dataclass
class Setup:
    operator: str | None
    started: datetime.datetime
    lenses: list[Lens]
    rates: dict[str, float]
    notes: dict[str, Lens] = dataclasses.field(default_factory=dict)
    raw: bytes = b""
    flags: list[bool] = dataclasses.field(default_factory=list)
    depth: int | None = None

    version = 3
    upgrades = {1: lambda old: {k: v for k, v in {**old, "rates": {"main": old["rate"]}}.items() if k != "rate"}, 2: lambda old: {**old, "operator": None}}


SETUP = Setup("A", datetime.datetime(2020, 1, 2, 3, 4), [Lens("x", 1.5), Lens("y", 2, "multi")], {"a": 1.0}, {"n": Lens("z", 0.5)}, b"\x00\xff", [True, False], 3)


def test_nested_round_trip(spark, tmp_path):
    records.frame(spark, [SETUP, dataclasses.replace(SETUP, operator=None, lenses=[], notes={}, depth=None)], Setup).write.parquet(f"{tmp_path}/t")
    back = list(records.read(spark.read.parquet(f"{tmp_path}/t"), Setup))
    assert sorted(back, key=lambda s: s.operator or "") == [dataclasses.replace(SETUP, operator=None, lenses=[], notes={}, depth=None), dataclasses.replace(SETUP, lenses=[Lens("x", 1.5), Lens("y", 2.0, "multi")])]
    assert records.structure(Setup).split("\n")[:5] == ["operator?: string", "started: timestamp", "lenses[]", "  name: string", "  focal: double"]


@pytest.mark.parametrize("change", [{"operator": 5}, {"lenses": [Lens("x", "far")]}, {"lenses": [None]}, {"lenses": [Lens("x", 1, "thick")]}, {"rates": {"a": "b"}}, {"flags": [1]}, {"started": None}])
def test_wrong_values_are_refused(change):
    with pytest.raises(ValueError):
        records.to_plain(dataclasses.replace(SETUP, **change), Setup)


def test_unknown_and_missing_fields_are_refused():
    plain = records.to_plain(SETUP, Setup)
    assert records.from_plain(plain, Setup).lenses[1] == Lens("y", 2.0, "multi")
    with pytest.raises(ValueError, match="unknown fields: colour"):
        records.from_plain({**plain, "lenses": [{"name": "x", "focal": 1.0, "colour": "red"}]}, Setup)
    with pytest.raises(ValueError, match="started is missing"):
        records.from_plain({k: v for k, v in plain.items() if k != "started"}, Setup)
    assert records.from_plain({k: v for k, v in plain.items() if k not in ("notes", "depth")}, Setup).notes == {}
    with pytest.raises(TypeError):
        records.spark_type(dict[int, str])
    with pytest.raises(TypeError):
        records.spark_type(int | str)


def test_versions():
    old = records.to_plain(SETUP, Setup)
    del old["operator"], old["rates"]
    made = records.from_plain(records.upgraded({**old, "rate": 2.0, records.VERSION: 1}, Setup), Setup)
    assert made.rates == {"main": 2.0} and made.operator is None
    with pytest.raises(ValueError, match="newer"):
        records.upgraded({**old, records.VERSION: 4}, Setup)


def test_a_table_is_checked_by_one_expression(spark):
    good = records.frame(spark, [SETUP] * 3, Setup)
    assert records.invalid(good, Setup).count() == 0
    from pyspark.sql import functions as F

    bad = good.withColumn("lenses", F.transform("lenses", lambda x: x.withField("coating", F.lit("thick")))).unionByName(good.withColumn("started", F.lit(None).cast("timestamp"))).unionByName(good)
    assert records.invalid(bad, Setup).count() == 6


def stack(spark, n=9):
    a = np.random.default_rng(1).integers(0, 256, (n, 1, 3, 4)).astype(float)
    pipe = stacks.from_arrays(spark.createDataFrame([(i, f.ravel().tolist()) for i, f in enumerate(a)], "n long, px array<double>"), "n", "px", 3, 4, n)
    ticks = spark.createDataFrame([(i, 500 + 3 * i) for i in range(n)], "n long, ticks long")
    return a, FramePipe(pipe.frame, pipe.source_shape, ticks=ticks)


def test_ticks_and_metadata_are_kept_with_frames(spark, tmp_path):
    a, pipe = stack(spark)
    path = f"{tmp_path}/a.frames.parquet"
    encoded.save(pipe, path, metadata=SETUP, attributes={"site": "B"})
    back = encoded.load(spark, path)
    assert np.allclose(back.to_numpy(), a) and back.shape == Shape(9, 1, 3, 4)
    assert sorted(map(tuple, back.timestamps().collect())) == [(i, 500 + 3 * i) for i in range(9)]
    assert encoded.metadata(spark, path, Setup).lenses[0] == Lens("x", 1.5) and encoded.header(spark, path).attributes == {"site": "B"}
    assert encoded.verify(pipe, path)
    other = FramePipe(pipe.frame, pipe.source_shape, ticks=pipe.ticks.withColumn("ticks", pipe.ticks.ticks + 1))
    assert not encoded.verify(other, path) and not encoded.verify(FramePipe(pipe.frame, pipe.source_shape), path)
    assert "payload" in encoded.inspect(spark, path) and "coating" in encoded.inspect(spark, path)
    assert encoded.compress(pipe, f"{tmp_path}/b")["ok"]


def test_ticks_follow_windows_and_slices(spark):
    _, pipe = stack(spark)
    ahead = pipe | window.moving_mean(3)
    assert sorted(map(tuple, ahead.timestamps(slice(2, 4)).collect())) == [(2, 506), (3, 509)]


def test_a_header_of_the_first_version(spark):
    old = {"format": "stackweave.frames", "c": 1, "y": 2, "x": 3, "kind": "uint8", "codec": "zlib", "step": 0.0, "n": 7}
    head = records.from_plain(records.upgraded(old, encoded.Header), encoded.Header)
    assert (head.frames, head.width, head.codec.kind) == (7, 3, "uint8")
