import numpy as np

from stackweave.plans.index import Shape
from stackweave.sources import encoded, registry
from stackweave.streaming.windows import append_encoded, streamed_moving, windowed_mean


def drained(query):
    query.processAllAvailable()
    query.stop()


def test_moving_contrast_of_a_stream(spark, tmp_path):
    a = np.random.default_rng(2).random((9, 2))
    schema = "n long, c int, y int, x int, v double"
    source = str(tmp_path / "in")
    for part in ([0, 1, 2], [5, 3], [4, 7, 6], [8]):  # out of order
        spark.createDataFrame([(n, 0, 0, x, float(a[n, x])) for n in part for x in range(2)], schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    drained(streamed_moving(stream, 3, "contrast").writeStream.format("memory").queryName("moving").outputMode("append").start())
    got = {(r.n, r.x): r.v for r in spark.table("moving").collect()}
    w = np.lib.stride_tricks.sliding_window_view(a, 3, 0)
    m = w.mean(-1)
    want = np.sqrt(np.abs((w * w).mean(-1) - m * m) + 1e-6) / (m + 1e-6)
    assert len(got) == 14 and all(abs(got[n, x] - want[n, x]) < 1e-9 for n, x in got)


def test_event_time_windows(spark, tmp_path):
    source = str(tmp_path / "ev")
    spark.sql("SELECT timestamp_seconds(id) AS ts, 'a' AS kind, cast(id AS double) AS value FROM range(100)").write.parquet(source)
    stream = spark.readStream.schema("ts timestamp, kind string, value double").parquet(source)
    drained(windowed_mean(stream, "ts", "value", ["kind"], "10 seconds", "5 seconds").writeStream.format("memory").queryName("means").outputMode("complete").start())
    got = sorted((r.start.timestamp(), r["mean"], r.n) for r in spark.table("means").collect())
    assert len(got) == 10 and got[3][1:] == (34.5, 10)


def test_frames_are_appended(spark, tmp_path):
    source, target, held = str(tmp_path / "in"), str(tmp_path / "out.frames.parquet"), str(tmp_path / "cp")
    kind, frames = "n long, px array<double>, ticks long", np.random.default_rng(1).integers(0, 256, (13, 4)).astype(float)

    def more(a, b):
        spark.createDataFrame([(n, frames[n].tolist(), 100 + n) for n in range(a, b)], kind).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(source)
        append_encoded(stream, target, held, 1, 2, 2).awaitTermination(120)

    more(0, 5)
    more(5, 8)
    run()
    assert encoded.load(spark, target).shape.n == 8
    more(8, 13)
    run()
    pipe = registry.load(spark, target)
    assert pipe.shape == Shape(13, 1, 2, 2) and np.allclose(pipe.to_numpy()[:, 0].reshape(13, 4), frames)
    assert sorted(map(tuple, pipe.timestamps(slice(3, 5)).collect())) == [(3, 103), (4, 104)]
    rows = sorted(map(tuple, encoded.stored(spark, target).select("n", "offset", "length").collect()))
    assert [o for _, o, _ in rows] == np.cumsum([0, *(n for _, _, n in rows)])[:-1].tolist()  # exclusive, over batches, too
    assert encoded.batches(spark, target).count() == 3 and encoded.ratio(spark, target) > 0


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path):
    source, target, held = str(tmp_path / "in"), str(tmp_path / "out"), tmp_path / "cp"
    spark.createDataFrame([(n, [float(n)] * 4) for n in range(6)], "n long, px array<double>").coalesce(1).write.parquet(source)

    def run():
        append_encoded(spark.readStream.schema("n long, px array<double>").parquet(source), target, str(held), 1, 2, 2).awaitTermination(120)

    run()
    for name in ("0", ".0.crc"):  # the batch was written, but its end was not noted
        (held / "commits" / name).unlink(missing_ok=True)
    run()
    assert sorted(r.n for r in encoded.stored(spark, target).collect()) == list(range(6)) and encoded.load(spark, target).shape.n == 6
    # frames of a batch that never came to its line in the log are not read
    spark.createDataFrame([(9, None, 0, 1, b"x")], "n long, ticks long, offset long, length long, payload binary").write.parquet(f"{target}/frames/batch=7")
    assert encoded.stored(spark, target).count() == 6
