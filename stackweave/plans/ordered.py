"""Running results in the order of each key's rows, spread over tasks even if one key has most of the rows.

Rows are sorted by key and order into ranges of bounded size, whatever the keys are. A running result has to be a fold
whose parts can be combined: the rows of a key in a range become a summary, summaries of neighbouring ranges are combined in
order, and each range starts with what the ranges before it say of its first key. Only the last key of a range can go on in
the next one, so a range sends one summary, and as many as there are ranges come to the driver.

The sorted rows are written to the folder that all machines share, so a lost executor costs its ranges only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Rows = dict[str, list]  #: columns of some rows of one key, in order


class Scan(Protocol):
    """A running result. `columns` is the schema of what it adds."""

    columns: str

    def summary(self, rows: Rows):
        """What has to be known of rows that come before others of their key: a simple value or tuple."""

    def combine(self, before, behind):
        """The summary of two neighbouring parts."""

    def apply(self, rows: Rows, before) -> Rows:
        """The added columns; before: the summary of all rows of the key before these, or None."""


def _runs(keys: list[tuple]) -> list[tuple[int, int]]:
    """Where each key's rows start and end."""
    starts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1])] if keys else []
    return list(zip(starts, [*starts[1:], len(keys)], strict=True))


def scanned(df: DataFrame, by: list[str], order: list[str], scan: Scan, rows_per_task: int = 1 << 20) -> DataFrame:
    """df with the columns of a running result over each key's rows in this order; equal places take any order, but a fixed one."""
    from ..sinks.recording import scratch_folder

    spark, names = df.sparkSession, df.columns
    tasks = max(1, math.ceil(df.count() / rows_per_task), int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = [*by, *order, "_tie"]
    dealt = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).drop("_tie")

    def number(batches) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.record_batch([*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(range(at, at + b.num_rows), pa.int64())], names=[*b.schema.names, "_part", "_at"])
            at += b.num_rows

    def schema(*more: str) -> str:
        return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *more])

    folder = scratch_folder(spark)
    kind = schema("_part int", "_at long")
    dealt.mapInArrow(number, kind).write.parquet(folder)
    placed = spark.read.schema(kind).parquet(folder)

    def held(table: pa.Table) -> tuple[Rows, list[tuple]]:
        rows = table.sort_by("_at").select(names).to_pydict()
        return rows, list(zip(*(rows[c] for c in by), strict=True))

    def ends(table: pa.Table) -> pa.Table:
        import pickle

        rows, found = held(table)
        a, b = _runs(found)[-1]
        last = pickle.dumps((found[0], found[-1], a == 0, scan.summary({c: v[a:b] for c, v in rows.items()})))
        return pa.table({"part": pa.array([table.column("_part")[0].as_py()], pa.int32()), "last": pa.array([last], pa.binary())})

    import pickle

    before, carried, key = {}, None, None
    for row in sorted(placed.groupBy("_part").applyInArrow(ends, "part int, last binary").collect()):  # a row for each range
        first, last, whole, own = pickle.loads(row.last)
        goes_on = carried is not None and first == key
        if goes_on:
            before[row.part] = carried
        carried = scan.combine(carried, own) if goes_on and whole else own
        key = last

    def apply(table: pa.Table) -> pa.Table:
        rows, found = held(table)
        start, added = before.get(table.column("_part")[0].as_py()), []
        for a, b in _runs(found):
            added.append(scan.apply({c: v[a:b] for c, v in rows.items()}, start if a == 0 else None))
        new = {c: [v for part in added for v in part[c]] for c in added[0]}
        kept = table.sort_by("_at").select(names)
        for c, v in new.items():
            kept = kept.append_column(c, pa.array(v))
        return kept

    return placed.groupBy("_part").applyInArrow(apply, schema(scan.columns))


def _add(parts: list[float], x: float) -> None:
    """Adds x to a sum that is held exactly, as floats that share no bits; what isn't finite stays so."""
    whole = x + sum(parts)
    if not math.isfinite(whole):
        parts[:] = [whole]
        return
    at = 0
    for y in parts:
        if abs(x) < abs(y):
            x, y = y, x
        both = x + y
        rest = y - (both - x)
        if rest:
            parts[at] = rest
            at += 1
        x = both
    parts[at:] = [x]


class Numbered:
    """The number of each row from 0, and running sums of columns: {new: old}; nulls add nothing.

    Each sum is the exact one, rounded once: it is the same wherever ranges end, and rows that add 0 leave it as it is.
    """

    def __init__(self, name: str = "n", sums: dict[str, str] | None = None):
        self.name, self.sums = name, sums or {}
        self.columns = ", ".join([f"{name} long", *(f"{c} double" for c in self.sums)])

    def summary(self, rows: Rows):
        return self.combine((0, *[()] * len(self.sums)), (len(next(iter(rows.values()))), *([v or 0.0 for v in rows[c]] for c in self.sums.values())))

    def combine(self, before, behind):
        sums = [list(parts) for parts in before[1:]]
        for parts, more in zip(sums, behind[1:], strict=True):
            for x in more:
                _add(parts, x)
        return before[0] + behind[0], *map(tuple, sums)

    def apply(self, rows: Rows, before) -> Rows:
        n, *start = before or (0, *[()] * len(self.sums))
        out = {self.name: list(range(n, n + len(next(iter(rows.values())))))}
        for first, (new, old) in zip(start, self.sums.items(), strict=True):
            parts, out[new] = list(first), []
            for v in rows[old]:
                _add(parts, v or 0.0)
                out[new].append(math.fsum(parts))
        return out


class EmaRate:
    """The rate of growth of a counter, averaged exponentially; rows without growth leave it as it is.

    A summary is the first and last time and value, and the map of the average over the rows between: a e + b once it has
    started, s if it starts in there, None if it doesn't.
    """

    columns = "ema double"

    def __init__(self, time: str, value: str, alpha: float):
        self.time, self.value, self.alpha, self.keep = time, value, alpha, 1 - alpha

    def _step(self, t0: float, v0: float, t1: float, v1: float):
        rate = (v1 - v0) / max(t1 - t0, 1e-12)
        return (self.keep, self.alpha * rate, rate) if v1 > v0 else (1.0, 0.0, None)

    @staticmethod
    def _then(first, second):
        (a, b, s), (c, d, t) = first, second
        return a * c, c * b + d, t if s is None else c * s + d

    def summary(self, rows: Rows):
        t, v, out = rows[self.time], rows[self.value], (1.0, 0.0, None)
        for k in range(1, len(t)):
            out = self._then(out, self._step(t[k - 1], v[k - 1], t[k], v[k]))
        return t[0], v[0], t[-1], v[-1], out

    def combine(self, before, behind):
        t0, v0, t1, v1, first = before
        t2, v2, t3, v3, second = behind
        return t0, v0, t3, v3, self._then(self._then(first, self._step(t1, v1, t2, v2)), second)

    def apply(self, rows: Rows, before) -> Rows:
        last, ema, out = None, None, []
        if before is not None:
            _, _, *last, (_, _, ema) = before
        for t, v in zip(rows[self.time], rows[self.value], strict=True):
            if last is not None:
                a, b, s = self._step(*last, t, v)
                ema = s if ema is None else a * ema + b
            last = (t, v)
            out.append(ema)
        return {"ema": out}
