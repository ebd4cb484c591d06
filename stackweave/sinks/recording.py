"""Writer of raw recordings, see sources.rls, and manifests of copied files."""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.pipe import FramePipe
from ..sources.rls import HEADER
from ..sources.stacks import to_arrays


def save_recording(pipe: FramePipe, path: str, ticks: DataFrame | None = None, sample_rate: int = 0, overwrite: bool = False) -> None:
    """Writes a recording to a path that all machines share; values are cut off to whole bytes 0..255.

    The place of a frame follows from its number, so each task writes its frames by itself, and a task that runs again
    writes the same bytes. ticks (n, ticks) are the frames' clock ticks, their numbers otherwise.
    """
    s = pipe.shape
    if s.c != 1:
        raise ValueError("a recording has one channel")
    with open(path, "wb" if overwrite else "xb") as f:
        f.write(struct.pack("<5Q", s.x, s.y, s.n, sample_rate, 1))
        f.truncate(HEADER + s.n * (8 + s.x * s.y))
    frames = to_arrays(pipe)
    frames = frames.join(ticks.select("n", "ticks"), "n") if ticks is not None else frames.withColumn("ticks", F.col("n"))
    size = 8 + s.x * s.y

    def write(rows):
        with open(path, "r+b") as f:
            for r in rows:
                f.seek(HEADER + r.n * size)
                f.write(struct.pack("<Q", r.ticks) + bytes(min(255, max(0, int(v))) for v in r.px))

    frames.foreachPartition(write)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder for tables between jobs in the one that all machines share; a local one only where the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to be set to a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="stackweave-")
    return f"{base.rstrip('/')}/stackweave-{uuid.uuid4().hex}"


def copy_files(spark: SparkSession, source: str, target: str, overwrite: bool = False) -> DataFrame:
    """Copies a folder's files, each in a task of its own, and returns the manifest of both folders, see manifest().

    A file is written under a name of its own and renamed when it is whole and has the digest of what was read. The target is
    a folder that all machines have at the same path.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content", F.sha2("content", 512).alias("digest"))
    folder = target.removeprefix("file://")
    os.makedirs(folder, exist_ok=True)

    def put(rows):
        for r in rows:
            path = f"{folder}/{r.name}"
            if os.path.exists(path) and not overwrite:
                with open(path, "rb") as f:
                    if hashlib.sha512(f.read()).hexdigest() != r.digest:
                        raise FileExistsError(path)
                continue
            own = f"{path}.{uuid.uuid4().hex}.part"
            with open(own, "wb") as f:
                f.write(r.content)
            with open(own, "rb") as f:
                if hashlib.sha512(f.read()).hexdigest() != r.digest:
                    raise OSError(f"{own} is not what was written")
            os.replace(own, path)

    files.foreachPartition(put)
    return manifest(spark, source, target)


def manifest(spark: SparkSession, source: str, target: str) -> DataFrame:
    """name, both digests and whether they are equal for each file of two folders."""

    def hashed(path: str, name: str) -> DataFrame:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 512).alias(name))

    both = hashed(source, "source_hash").join(hashed(target, "target_hash"), "name", "full_outer")
    return both.withColumn("equal", F.coalesce(F.col("source_hash") == F.col("target_hash"), F.lit(False)))
