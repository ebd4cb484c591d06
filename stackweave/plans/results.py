"""Results kept by the arguments they came from."""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def kept(folder: str) -> Callable:
    """Keeps the DataFrame that f(spark, ...) gives as Parquet under a digest of its arguments; force=True makes it anew."""

    def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(f)
        def call(spark: SparkSession, *args, force: bool = False, **kwargs) -> DataFrame:
            key = hashlib.sha256(json.dumps([f.__name__, args, sorted(kwargs.items())], default=str).encode()).hexdigest()[:32]
            path = f"{folder.rstrip('/')}/{key}"
            if not force:
                try:
                    return spark.read.parquet(path)
                except AnalysisException:
                    pass
            f(spark, *args, **kwargs).write.mode("overwrite").parquet(path)
            return spark.read.parquet(path)

        return call

    return wrap
