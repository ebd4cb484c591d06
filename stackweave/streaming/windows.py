"""Streams of frames: moving statistics with state, event-time windows, and appended encoded frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def streamed_moving(frames: DataFrame, k: int, statistic: str = "mean", eps: float = 1e-6) -> DataFrame:
    """n, c, y, x, v of moving means or contrasts over k frames of a stream of pixels.

    Each pixel keeps frames that wait for an earlier one, and the last k - 1 in order: frames may come out of order, but
    each has to come once. Results come as soon as all k frames are there, and are those of the batch operators.
    """
    if statistic not in ("mean", "contrast"):
        raise ValueError("statistic is mean or contrast")

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, values, early_n, early_v = state.get if state.exists else (0, [], [], [])
        values, waiting = list(values), dict(zip(early_n, early_v, strict=True))
        for p in parts:
            waiting |= dict(zip(p.n.tolist(), p.v.tolist(), strict=True))
        while first + len(values) in waiting:
            values.append(waiting.pop(first + len(values)))
        done = max(0, len(values) - k + 1)
        if done:
            view = np.lib.stride_tricks.sliding_window_view(np.array(values), k)
            mean = view.mean(1)
            v = mean if statistic == "mean" else np.sqrt(np.abs((view * view).mean(1) - mean * mean) + eps) / (mean + eps)
            yield pd.DataFrame({"n": np.arange(first, first + done), "c": key[0], "y": key[1], "x": key[2], "v": v})
        state.update((first + done, values[done:], list(waiting), list(waiting.values())))

    return frames.groupBy("c", "y", "x").applyInPandasWithState(step, "n long, c int, y int, x int, v double", "first long, ahead array<double>, early_n array<long>, early_v array<double>", "append", GroupStateTimeout.NoTimeout)


def windowed_mean(events: DataFrame, time: str, value: str, by: list[str], length: str, late: str) -> DataFrame:
    """Mean and number of values in event-time windows; rows later than `late` are left out."""
    t = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return t.groupBy(F.window(time, length), *by).agg(F.avg(value).alias("mean"), F.count(value).alias("n")).select(F.col("window.start").alias("start"), *by, "mean", "n")


def append_encoded(frames: DataFrame, path: str, checkpoint: str, channels: int, height: int, width: int, kind: str = "uint8"):
    """Starts a stream that encodes packed frames (n, px and, if there are any, ticks) and adds them to a growing encoded stack.

    Each batch is a folder of its own and a line in the log; both are written over when Spark runs a batch again, so a
    frame is there once. Offsets go on from the bytes of the batches before. encoded.load reads what the log names, while
    the stream runs, too. A new stream with the same checkpoint goes on where the last one ended.
    """
    from pyspark.errors import AnalysisException

    from ..operators.window import exclusive_offsets
    from ..sources import encoded

    spark = frames.sparkSession
    try:
        encoded.header(spark, path)
    except AnalysisException:
        encoded.put_header(spark, path, encoded.Header(encoded.FORMAT, channels, height, width, encoded.Codec(kind)))

    def before(batch: int) -> int:
        try:
            return encoded.batches(spark, path).where(F.col("batch") < batch).agg(F.sum("bytes")).head()[0] or 0
        except AnalysisException:
            return 0  # no log yet

    def add(df: DataFrame, batch: int) -> None:
        ticks = F.col("ticks").cast("long") if "ticks" in df.columns else F.lit(None).cast("long")
        coded = df.select("n", ticks.alias("ticks"), encoded._encode(kind, 0.0)("px").alias("payload")).withColumn("length", F.length("payload").cast("long"))
        start, folder = before(batch), f"{path}/frames/batch={batch}"
        placed = exclusive_offsets(coded).select("n", "ticks", (F.col("offset") + start).alias("offset"), "length", "payload")
        placed.repartitionByRange("n").sortWithinPartitions("n").write.mode("overwrite").parquet(folder)
        line = spark.read.schema(placed.schema).parquet(folder).agg(F.count(F.lit(1)).alias("frames"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.max("n").alias("last"))
        line.coalesce(1).write.mode("overwrite").parquet(f"{path}/log/batch={batch}")

    return frames.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
