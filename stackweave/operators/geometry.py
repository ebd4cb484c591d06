"""Markers, line segments and labels of regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def denormalise(markers: DataFrame, height: int, width: int) -> DataFrame:
    """Markers (id, x, y) from 0..1 to pixels: x (width - 1), y (height - 1)."""
    return markers.withColumn("x", F.col("x") * (width - 1)).withColumn("y", F.col("y") * (height - 1))


def along(markers: DataFrame, start: int, stop: int, part: float, new_id: int) -> DataFrame:
    """A new marker on the way from one marker to another."""
    ends = markers.where(F.col("id").isin(start, stop)).agg(*(F.max(F.when(F.col("id") == i, F.col(c))).alias(f"{c}{n}") for n, i in (("0", start), ("1", stop)) for c in ("x", "y")))
    return ends.select(F.lit(new_id).alias("id"), *((F.col(f"{c}0") + (F.col(f"{c}1") - F.col(f"{c}0")) * part).alias(c) for c in ("x", "y")))


def segments(markers: DataFrame, links: list[tuple[int, int]]) -> DataFrame:
    """Segments (id, ax, ay, bx, by) between pairs of markers, numbered from 1."""
    table = markers.sparkSession.createDataFrame([(k, a, b) for k, (a, b) in enumerate(links, 1)], "id int, a int, b int")
    a = markers.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = markers.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return table.join(a, "a").join(b, "b").select("id", "ax", "ay", "bx", "by")


def segment_distance() -> tuple[Column, Column]:
    """Distance of (x, y) to a segment, and the place 0..1 of the nearest point on it."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    t = ((F.col("x") - F.col("ax")) * dx + (F.col("y") - F.col("ay")) * dy) / (dx * dx + dy * dy + 1e-12)
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    px, py = F.col("ax") + t * dx - F.col("x"), F.col("ay") + t * dy - F.col("y")
    return F.sqrt(px * px + py * py), t


#: Segments that nearest_segment() compares with each pixel.
MOST_SEGMENTS = 10_000


def nearest_segment(pixels: DataFrame, lines: DataFrame, *by: str) -> DataFrame:
    """label and distance of the nearest segment of each place (y, x); of equal ones the smallest id.

    The segments of a figure are few; more than MOST_SEGMENTS are refused, since each is compared with each pixel.
    """
    rows = lines.limit(MOST_SEGMENTS + 1).collect()
    if len(rows) > MOST_SEGMENTS:
        raise ValueError(f"more than {MOST_SEGMENTS} segments")
    held = F.array(*(F.struct(*(F.lit(r[c]).cast("int" if c == "id" else "double").alias(c) for c in ("id", "ax", "ay", "bx", "by"))) for r in rows))

    def distance(s):
        dx, dy = s["bx"] - s["ax"], s["by"] - s["ay"]
        t = F.least(F.greatest(((F.col("x") - s["ax"]) * dx + (F.col("y") - s["ay"]) * dy) / (dx * dx + dy * dy + 1e-12), F.lit(0.0)), F.lit(1.0))
        px, py = s["ax"] + t * dx - F.col("x"), s["ay"] + t * dy - F.col("y")
        return F.struct(F.sqrt(px * px + py * py).alias("d"), s["id"].alias("id"))

    best = F.array_min(F.transform(held, distance))
    return pixels.select(*by, "y", "x", best.alias("b")).select(*by, "y", "x", F.col("b.id").alias("label"), F.col("b.d").alias("distance"))


def labels(names: list[str]) -> dict[str, int]:
    """Region names to label values; 0 is the background."""
    return {"background": 0} | {n: k for k, n in enumerate(names, 1)}
