"""Importance resampling of a corpus towards a target.

Texts are bags of words and word pairs, hashed into a fixed number of buckets. Two multinomial models are estimated,
one of the target documents and one of the whole corpus; a document's weight is the logarithm of their ratio over its
features. Adding independent Gumbel noise to the weights and taking the k largest samples k documents without
replacement in proportion to the weights. The noise is a function of the document's id and a seed.

Counts are summed in each task, and only the bucket sums, of fixed number, are collected. The k-th largest key is found
by counting keys in ranges that get narrower, without sorting the corpus.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, id_back, rows, slices
from .ngram_join import mix, word_hashes

_U = np.uint64
#: Ids of target documents up to which they are sent to all tasks instead of shuffling the texts to them.
SENT_ROWS = 1_000_000


def buckets(text: str, size: int) -> np.ndarray:
    """The bucket of each word and of each two neighbouring words."""
    w = word_hashes(text)
    pairs = mix(w[:-1] * _U(0x9FB21C651E98DF25) + w[1:]) if len(w) > 1 else w[:0]
    return (np.concatenate([w, pairs]) >> _U(20)) % _U(size)


def _sums(size: int):
    def run(batches):
        total = np.zeros((2, size), np.int64)
        for b in slices(batches):
            texts, target = b.column(0).to_pylist(), b.column(1).to_pylist()
            for which in (0, 1):
                own = [buckets(t, size) for t, is_target in zip(texts, target, strict=True) if is_target == bool(which)]
                if own:
                    total[which] += np.bincount(np.concatenate(own).astype(np.int64), minlength=size)
        used = np.flatnonzero(total.any(0))
        yield pa.record_batch([pa.array(used), pa.array(total[1, used]), pa.array(total[:, used].sum(0))], names=["bucket", "target", "raw"])

    return run


def fit(texts: DataFrame, size: int) -> np.ndarray:
    """The logarithm of the ratio of both models for each bucket, from `text` and the boolean `target`."""
    sums = texts.select("text", "target").mapInArrow(_sums(size), "bucket long, target long, raw long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).toArrow()
    counts = np.ones((2, size))  # each bucket once more than seen
    at = sums.column("bucket").to_numpy()
    counts[0, at] += sums.column("target").to_numpy()
    counts[1, at] += sums.column("raw").to_numpy()
    return np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())


def weighted(texts: DataFrame, ratio: np.ndarray) -> DataFrame:
    """Adds `weight`, the sum over a text's features, and `n_features`."""
    shared = texts.sparkSession.sparkContext.broadcast(ratio)

    @F.pandas_udf("weight double, n_features long")
    def weigh(col: pd.Series) -> pd.DataFrame:
        own = [buckets(t, len(shared.value)) for t in col]
        return pd.DataFrame({"weight": [float(shared.value[o].sum()) for o in own], "n_features": [len(o) for o in own]})

    return texts.withColumn("w", weigh("text")).select("*", "w.*").drop("w")


def gumbel(key: Column, seed: int) -> Column:
    """Standard Gumbel noise that follows from a key and a seed."""
    unit = (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(unit))


def kth_largest(df: DataFrame, col: str, k: int, ranges: int = 4096) -> float:
    """The k-th largest value of a column of doubles, by counts in ranges that get narrower."""
    low, high, n = df.agg(F.min(col), F.max(col), F.count(col)).head()
    if k >= n:
        return low if n else float("inf")
    while low < high:
        width = (high - low) / ranges
        if not low < low + width < high:
            break
        at = F.least(F.floor((F.col(col) - F.lit(low)) / F.lit(width)), F.lit(ranges - 1))
        counts = {r.at: (r.n, r.lo, r.hi) for r in df.where(F.col(col).between(low, high)).groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).collect()}
        for r in sorted(counts, reverse=True):
            n, lo, hi = counts[r]
            if k <= n:
                low, high = lo, hi
                break
            k -= n
    for r in df.where(F.col(col).between(low, high)).groupBy(col).count().orderBy(F.desc(col)).toLocalIterator():  # as many as there are doubles between
        k -= r["count"]
        if k <= 0:
            return r[col]
    return low


def resample(docs: DataFrame, target: DataFrame, part: float = 0.85, size: int = 1 << 14, seed: int = 1, temperature: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, weight, n_features, key, kept for each document; `target` (doc_id) names the target documents.

    key is weight / temperature plus Gumbel noise, and the part of the documents with the largest keys is kept; ties at
    the last place are kept, too. A null or empty text has weight 0. An empty target makes all weights that of the
    smoothing alone.
    """
    scratch = Scratch(docs.sparkSession)
    texts = rows(docs, id_col, text_col)
    named = target.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct().withColumn("target", F.lit(True))
    named = scratch.keep(named)
    marked = texts.join(F.broadcast(named) if named.count() <= SENT_ROWS else named, "id", "left").withColumn("target", F.coalesce("target", F.lit(False)))
    ratio = fit(marked, size)
    out = weighted(texts, ratio).select("id", "weight", "n_features", (F.col("weight") / temperature + gumbel(F.col("id"), seed)).alias("key"))
    out = scratch.keep(out)
    least = kth_largest(out, "key", int(np.ceil(part * out.count())))
    return out.withColumn("kept", F.col("key") >= F.lit(least))


def labelled_share(labels: DataFrame) -> float:
    """The part of the labelled documents that are good and not toxic; 1 where nothing is labelled."""
    good, every = labels.where("quality is not null and toxic is not null").agg(F.sum(F.expr("if(quality = 1 and toxic = 0, 1, 0)")), F.count(F.lit(1))).head()
    return good / every if every else 1.0


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, weight, n_features, key, kept; the target are the documents labelled as good and not toxic.

    As large a part stays as the target has of the labelled documents.
    """
    good = labels.where("quality = 1 and toxic = 0").select("doc_id")
    return resample(docs, good, labelled_share(labels)).select(id_back("id", "doc_id"), "weight", "n_features", "key", "kept")
