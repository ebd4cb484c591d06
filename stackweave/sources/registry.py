"""Readers by file name. Of the patterns that match, the longest one counts."""

from __future__ import annotations

from collections.abc import Callable
from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.storagelevel import StorageLevel

from ..plans.pipe import FramePipe
from . import encoded, rls, zarr

READERS: dict[str, Callable[..., FramePipe]] = {}
CACHES = ("no_caching", "cache_raw", "cache_compressed", "cache_raw_reuse", "cache_compressed_reuse")
_held: dict[str, FramePipe] = {}


def register(pattern: str, reader: Callable[..., FramePipe]) -> None:
    """reader(spark, path, **options) gives a FramePipe. A pattern that is there already is replaced."""
    READERS[pattern] = reader


register("*.rls", rls.load)
register("*.frames.parquet", encoded.load)
register("*.zarr", zarr.load)


def reader_of(path: str) -> Callable[..., FramePipe]:
    found = [p for p in READERS if fnmatch(path.rsplit("/", 1)[-1], p)]
    if not found:
        raise ValueError(f"no reader for {path}")
    return READERS[max(found, key=len)]


def load(spark: SparkSession, path: str, cache: str = "no_caching", **options) -> FramePipe:
    """The stack at a path. Caches are Spark's: raw keeps rows, compressed keeps them serialised; reuse holds the last one."""
    if cache not in CACHES:
        raise ValueError(f"cache is one of {', '.join(CACHES)}")
    if cache.endswith("_reuse") and path in _held:
        return _held[path]
    pipe = reader_of(path)(spark, path, **options)
    if cache != "no_caching":
        level = StorageLevel.MEMORY_AND_DISK_DESER if "raw" in cache else StorageLevel.MEMORY_AND_DISK
        pipe = FramePipe(pipe.frame.persist(level), pipe.source_shape, pipe.ops)
    if cache.endswith("_reuse"):
        release()
        _held[path] = pipe
    return pipe


def release() -> None:
    """Forgets the held stack."""
    for pipe in _held.values():
        pipe.frame.unpersist()
    _held.clear()


def image_folder(spark: SparkSession, path: str, extension: str = ".tiff") -> DataFrame:
    """Files of a folder in the order of the number in their names: n, stamp, path, content."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from ..functions import recording_file

    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{extension}").load(path).select("path", "content", recording_file(F.col("path")).alias("f"))
    # numbers are names of files in one folder: a short list, numbered without their contents
    order = files.select("path", F.row_number().over(Window.orderBy("f.number", "path")).cast("long").alias("n"))
    return files.join(order, "path").select((F.col("n") - 1).alias("n"), "f.stamp", "path", "content")
