"""What the corpus operators share: inputs, shared scratch tables, shipping of code.

Rules that every operator here follows
--------------------------------------
* Only the id and the text column are read; other columns, whatever their names, are left alone.
* A null text counts as the empty text.
* A null id is one more id; it comes back as null.
* Several rows with one id are documents of their own, each with its own row in the result. Operators that tell documents
  apart by their ids get numbers for such a table that keep the order of the ids, see every_row().
* An empty table gives an empty result with the same columns.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import inspect
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NULL_ID = -(2**63)
_SHIPPED: set[str] = set()
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(os.path.dirname(here))
    package = os.path.basename(os.path.dirname(here))
    target = os.path.join(tempfile.mkdtemp(), f"{package}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for top in (os.path.join(root, package, "__init__.py"), *(os.path.join(here, n) for n in sorted(os.listdir(here)))):
            if top.endswith(".py"):
                z.write(top, os.path.relpath(top, root))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def each_row(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and text of each row as columns `id` and `text`, without nulls."""
    return docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """each_row() for work in Python: executors get this package."""
    ship(docs.sparkSession)
    return each_row(docs, id_col, text_col)


def id_back(col: str = "id", name: str = "doc_id"):
    return F.nullif(F.col(col), F.lit(NULL_ID)).alias(name)


#: Bytes of a piece of a batch, if it has several rows.
SLICE_BYTES = 4 << 20


def give_back() -> None:
    """Hands memory that is free back to the system: a worker that waits for its next task keeps none of it."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def slices(batches, most: int = 512):
    """The batches in pieces of a few rows and bytes, which bounds what a Python worker holds at once."""
    for b in batches:
        left = [b.slice(k, most) for k in range(0, b.num_rows, most)][::-1]
        while left:
            piece = left.pop()
            if piece.num_rows > 1 and piece.nbytes > SLICE_BYTES:
                half = piece.num_rows // 2
                left += [piece.slice(half), piece.slice(0, half)]
            else:
                yield piece
    give_back()


#: Rows and bytes that the JVM hands to a Python worker at once while a table is written.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Documents are long rows: fewer of them at once keep the buffers of both sides small."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    before = {name: spark.conf.get(name) for name in limits}
    for name, most in limits.items():
        size = int(before[name]) if before[name].isdigit() else 0  # not a number of its own: unlimited, or with a unit
        spark.conf.set(name, str(min(size, most) if size > 0 else most))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


class Scratch:
    """Tables written to the folder that all machines share, which cut lineage and survive lost executors.

    The folder is spark.checkpoint.dir; where that is unset, a local master gets a folder of its own and a cluster an error.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir has to be set to a folder that all machines share")
            base = "file://" + tempfile.mkdtemp(prefix="stackweave-")
        self.base = f"{base.rstrip('/')}/stackweave-{uuid.uuid4().hex}"
        self.n = 0
        self.held: dict[str, None] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        """Writes df and reads it back."""
        self.n += 1
        path = f"{self.base}/{self.n}"
        schema = df.schema
        with small_batches(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch = path
        self.held[path] = None
        return out

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        self.held.pop(path, None)
        with contextlib.suppress(Exception):  # what is left goes with the application's folder
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def drop(self, *frames: DataFrame) -> None:
        """Removes tables that nothing reads any more."""
        for df in frames:
            self._delete(df._scratch)

    def end(self, *frames: DataFrame) -> None:
        """Removes all tables but those of `frames`, which a lazy result still reads."""
        left = {df._scratch for df in frames}
        for path in [p for p in self.held if p not in left]:
            self._delete(path)


#: Bytes of rows up to which a table is sent to all tasks; a larger one is joined by shuffling.
SENT_BYTES = 64 << 20


def sent(df: DataFrame, row_bytes: int | Column = 64) -> DataFrame:
    """Marks a table as one to send to all tasks if its rows, of so many bytes each, don't come to more than SENT_BYTES."""
    size = df.agg(F.sum(F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes)).head()[0] or 0
    return F.broadcast(df) if size <= SENT_BYTES else df


def numbered(rows: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """Adds place, the number of a row within its `key` in this order, from 0, and size, the rows of the key.

    Rows are sorted by ranges, so a frequent key or a frequent value is spread; each task counts its own rows, and the
    tasks' counts, a row for each task and key, say where each begins. Rows that are equal in `order` take any order.
    """
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())
    by = ["key", *order, "_tie"]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
    at = dealt.columns.index("key")

    def count(batches) -> Iterator[pa.RecordBatch]:
        part, key, n = TaskContext.get().partitionId(), None, 0
        for b in batches:
            number = []
            for k in b.column(at).to_pylist():
                key, n = k, (n + 1 if k == key else 0)
                number.append(n)
            yield pa.record_batch([*b.columns, pa.array([part] * len(number), pa.int32()), pa.array(number, pa.int64())], names=[*b.schema.names, "part", "number"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    placed = scratch.keep(dealt.mapInArrow(count, f"{kinds}, part int, number long"))
    counts = placed.groupBy("key", "part").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = scratch.keep(counts.select("key", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_before"), F.sum("rows").over(Window.partitionBy("key")).alias("size")))
    found = placed.join(sent(counts, 96), ["key", "part"])
    return found.withColumn("place", F.col("number") + F.col("_before")).drop("part", "number", "_before")


def every_row(*ids: str):
    """Lets an operator that needs distinct ids work on each row of a table with repeated ones.

    The operator has the parameters docs, id_col and text_col. Rows of such a table are numbered by id, then by their text;
    it gets the numbers as ids, so the smallest number is a row of the smallest id, and the columns `ids` of its result are
    put back. Null ids are the smallest. Without repeated ids it gets `docs` as they are.
    """

    def wrap(f):
        signature = inspect.signature(f)

        @functools.wraps(f)
        def call(*args, **kwargs) -> DataFrame:
            given = signature.bind(*args, **kwargs)
            given.apply_defaults()
            docs, id_col, text_col = (given.arguments[k] for k in ("docs", "id_col", "text_col"))
            texts = rows(docs, id_col, text_col)
            if texts.groupBy("id").count().where("count > 1").isEmpty():
                return f(*given.args, **given.kwargs)
            scratch = Scratch(docs.sparkSession)
            keyed = texts.select(F.lit("").alias("key"), "id", "text", F.xxhash64("text").alias("h"))
            placed = scratch.keep(numbered(keyed, ["id", "h"], scratch).select("place", "id", "text"))
            given.arguments["docs"] = placed.select(F.col("place").alias(id_col), F.col("text").alias(text_col))
            out = f(*given.args, **given.kwargs)
            columns = out.columns
            for c in ids:
                names = sent(placed.select(F.col("place").alias(c), id_back("id", "_name")), 16)
                out = out.join(names, c).drop(c).withColumnRenamed("_name", c)
            return out.select(*columns)

        return call

    return wrap
