"""Exact quantiles of a whole stack by counts, without sorting it and without one task that holds its values.

Doubles are mapped to whole numbers of the same order. Values are counted by the first 16 bits of those; the bucket that
holds a wanted rank is looked up in the running counts, and only its values are counted by the next 16 bits, and so
on: after four counts each bucket is one value. Every count sums up in its tasks first and has at most 65,536 rows for each
wanted rank, however large the stack is. It is one lazy plan that reads its source four times.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS, ROUNDS = 16, 4


def ordered(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles; both zeros are one."""
    bits = (np.asarray(values, np.float64) + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits)


def _ordered() -> Column:
    @F.pandas_udf("long")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(ordered(v.to_numpy()))

    return run(F.col("v"))


def _part(k: int) -> Column:
    """The k-th 16 bits of the key, and the sign with the first."""
    moved = F.shiftright("key", 64 - BITS * (k + 1))
    return moved if k == 0 else moved.bitwiseAND(F.lit((1 << BITS) - 1))


def stack_quantiles(df: DataFrame, levels: list[float]) -> DataFrame:
    """One row with q, an array of the quantiles of v with linear interpolation; of an empty stack it holds nulls.

    Nulls and values that are no numbers are left out.
    """
    if not all(0 <= x <= 1 for x in levels):
        raise ValueError("levels are from 0 to 1")
    keyed = df.where("v is not null and not isnan(v)").select(F.col("v").cast("double").alias("v")).select("v", _ordered().alias("key"))
    wanted = F.array(*(F.struct(F.lit(k).alias("level"), F.lit(float(x)).alias("q")) for k, x in enumerate(levels)))
    found = None
    for k in range(ROUNDS):
        source = keyed
        if found is not None:
            held = found.select("prefix").distinct()
            source = keyed.withColumn("prefix", F.shiftright("key", 64 - BITS * k)).join(F.broadcast(held), "prefix")  # a row for each wanted rank at most
        else:
            source = source.withColumn("prefix", F.lit(0).cast("long"))
        counts = source.groupBy("prefix", _part(k).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("v"))
        before = Window.partitionBy("prefix").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # 65,536 rows at most
        counts = counts.select("prefix", "part", "n", "v", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
        if found is None:
            ends = counts.agg(F.sum("n").alias("total"))
            place = (F.col("total") - 1) * F.col("w.q")
            ranks = ends.select("total", F.explode(wanted).alias("w")).select("w.level", place.alias("place"), F.explode(F.array(F.floor(place), F.ceil(place))).alias("rest"))
            ranks = ranks.select("level", "place", F.col("rest").alias("rank"), "rest", F.lit(0).cast("long").alias("prefix")).distinct()
        else:
            ranks = found
        met = F.broadcast(ranks.select("level", "place", "rank", "rest", F.col("prefix").alias("_p")))
        hit = counts.join(met, (F.col("prefix") == F.col("_p")) & (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("n")))
        joined = F.col("part") if k == 0 else F.shiftleft("prefix", BITS) + F.col("part")
        found = hit.select("level", "place", "rank", (F.col("rest") - F.col("before")).alias("rest"), joined.alias("prefix"), "v")
    each = found.groupBy("level").agg(F.min(F.struct("rank", "v"))["v"].alias("lo"), F.max(F.struct("rank", "v"))["v"].alias("hi"), F.first("place").alias("place"))
    each = each.select("level", (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("place") - F.floor("place"))).alias("v"))
    held = each.agg(F.map_from_entries(F.collect_list(F.struct("level", "v"))).alias("m"))  # a row for each level
    return held.select(F.array(*(F.try_element_at("m", F.lit(k)) for k in range(len(levels)))).alias("q"))
