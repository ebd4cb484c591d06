"""Columns for reports: sizes and times for people, file names, integer rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def readable_size(n: Column) -> Column:
    """Bytes in units of 1024 with two decimals: 1536 is 1.50 KB."""
    out = F.format_string("%.2f PB", n / float(1 << 50))
    for k, unit in reversed(list(enumerate(("B", "KB", "MB", "GB", "TB")))):
        out = F.when(F.abs(n) < float(1 << (10 * (k + 1))), F.format_string(f"%.2f {unit}", n / float(1 << (10 * k)))).otherwise(out)
    return out


def readable_time(ns: Column) -> Column:
    """Nanoseconds as hours, minutes, seconds and milliseconds; units of 0 are left out, the sign stays."""
    ms = F.floor(F.abs(ns) / 1_000_000)
    parts = [(F.floor(ms / 3_600_000), "h"), (F.floor(ms / 60_000) % 60, "m"), (F.floor(ms / 1000) % 60, "s"), (ms % 1000, "ms")]
    text = F.concat_ws(" ", *(F.when(v > 0, F.concat(v.cast("long").cast("string"), F.lit(u))) for v, u in parts))
    return F.concat(F.when((ns < 0) & (text != ""), "-").otherwise(""), F.when(text == "", "0ms").otherwise(text))


def recording_file(path: Column) -> Column:
    """camera, serial, stamp and number from a name camera__serial__date_time_number.ext; nulls for other names."""
    name = F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)
    rule = r"^(.+)__(.+)__(.+_.+)_([0-9]+)$"
    part = lambda k: F.nullif(F.regexp_extract(name, rule, k), F.lit(""))
    return F.struct(part(1).alias("camera"), part(2).alias("serial"), part(3).alias("stamp"), part(4).cast("long").alias("number"))


def floor_div(a: Column, b: int) -> Column:
    """Division towards minus infinity."""
    return F.floor(a / b).cast("long")


def floor_mod(a: Column, b: int) -> Column:
    """The remainder with the divisor's sign."""
    return a - floor_div(a, b) * b
