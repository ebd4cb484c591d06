"""Language identification by bit-sliced Bloom filters over character n-grams.

One filter row has a bit for each language; an n-gram sets its languages' bits in `hashes` rows, and the AND of those
rows gives all languages that contain it. A text's bits are counted for each language, the expected number of false
positives is taken away, and the language with the largest count is the answer.

An n-gram belongs to a language if it is there at least `share` times as frequent as in the language that uses it
most, so that quotations and loan words do not count. Counts are summed in each task before they are shuffled. The
filter has a fixed number of rows and is the only thing that is collected and sent to all tasks.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_back, rows, ship, slices

LENGTH = 4
#: A language is a bit of a long; further languages have further filters.
BITS = 63
#: n-grams that a training task holds before it sums them.
HELD = 2_000_000


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngrams(text: str) -> np.ndarray:
    """The n-grams of a text in lower case, in which each run of other characters than letters is one space."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, np.uint64)
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    clean = np.where(letter, points & 0xFFFF, 32)[keep].astype(np.uint64)
    if len(clean) < LENGTH:
        clean = np.concatenate([clean, np.full(LENGTH - len(clean), 32, np.uint64)])
    n = len(clean) - LENGTH + 1
    out = clean[:n].copy()
    for k in range(1, LENGTH):
        out |= clean[k : k + n] << np.uint64(16 * k)
    return out


def places(keys: np.ndarray, size: int, hashes: int) -> list[np.ndarray]:
    """The filter rows of each key."""
    x = keys * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    step = (x >> np.uint64(40)) | np.uint64(1)
    return [((x + np.uint64(k) * step) % np.uint64(size)).astype(np.int64) for k in range(hashes)]


def _count(batches):
    held: dict[str, list[np.ndarray]] = {}
    n = 0

    def sums():
        for lang, parts in held.items():
            keys, counts = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.record_batch([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], names=["lang", "key", "n"])

    for b in slices(batches):
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            keys = ngrams(text)
            held.setdefault(lang, []).append(keys)
            n += len(keys)
            if n > HELD:
                yield from sums()
                held, n = {}, 0
    yield from sums()


def _filter_rows(size: int, hashes: int):
    def run(batches):
        for b in slices(batches):
            at = places(b.column(0).to_numpy().view(np.uint64), size, hashes)
            yield pa.record_batch([pa.array(np.concatenate(at)), pa.concat_arrays([b.column(1)] * hashes)], names=["place", "mask"])

    return run


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", share: float = 0.5, least: int = 2, size: int = 1 << 21, hashes: int = 3) -> dict:
    """The languages and the filters, one for BITS languages each. Rows without a language or a text teach nothing."""
    ship(labelled.sparkSession)
    known = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    counts = known.mapInArrow(_count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).persist()
    try:
        totals = counts.groupBy("lang").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "lang").collect()
        langs = [r.lang for r in totals]
        tables = [np.zeros(size, np.int64) for _ in range(max(1, -(-len(langs) // BITS)))]
        if langs:
            spark = labelled.sparkSession
            bits = F.broadcast(spark.createDataFrame([(r.lang, k // BITS, 1 << k % BITS, float(r.total)) for k, r in enumerate(totals)], "lang string, part int, bit long, total double"))
            rate = counts.join(bits, "lang").withColumn("rate", F.col("n") / F.col("total"))
            most = rate.withColumn("most", F.max("rate").over(Window.partitionBy("key")))
            own = most.where((F.col("n") >= least) & (F.col("rate") >= share * F.col("most")))
            for part, table in enumerate(tables):
                masks = own.where(F.col("part") == part).groupBy("key").agg(F.bit_or("bit").alias("mask"))
                cells = masks.mapInArrow(_filter_rows(size, hashes), "place long, mask long").groupBy("place").agg(F.bit_or("mask").alias("mask")).toArrow()
                table[cells.column("place").to_numpy()] = cells.column("mask").to_numpy()
    finally:
        counts.unpersist()
    kind = np.uint8 if len(langs) <= 8 else np.int64
    false = [float(((tables[k // BITS] >> k % BITS) & 1).mean() ** hashes) for k in range(len(langs))]
    return {"langs": langs, "rows": tables[0].astype(kind), "further": [t.astype(kind) for t in tables[1:]], "hashes": hashes, "false": false}


def identify(model: dict, text: str) -> tuple[str, float, int]:
    """The language, the part of the text's n-grams that are its own, from 0 to 1, and how many n-grams there are."""
    keys = ngrams(text)
    if not len(keys) or not model["langs"]:
        return "und", 0.0, len(keys)
    at, masks = places(keys, len(model["rows"]), model["hashes"]), []
    for table in (model["rows"], *model.get("further", ())):
        mask = table[at[0]]
        for a in at[1:]:
            mask = mask & table[a]
        masks.append(mask)
    false = np.array(model["false"])
    counts = np.array([np.count_nonzero(masks[k // BITS] & masks[0].dtype.type(1 << k % BITS)) for k in range(len(false))])
    corrected = (counts - len(keys) * false) / np.maximum(1 - false, 1e-9)
    best = int(np.argmax(corrected))
    return model["langs"][best], float(min(1, max(0, corrected[best] / len(keys)))), len(keys)


def annotate(docs: DataFrame, model: dict, name: str, text_col: str = "text") -> DataFrame:
    """Adds a struct of lang_pred, score and n_grams; `und`, 0 and 0 for a text without letters, a null one included."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, n_grams long")
    def found(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([identify(shared.value, t or "") for t in texts], columns=["lang_pred", "score", "n_grams"])

    return docs.withColumn(name, found(F.col(text_col).cast("string")))


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, n_grams of each document, see annotate()."""
    return annotate(rows(docs, id_col, text_col), model, "found").select("id", "found.*")


def held_out(doc_id):
    """A third of the ids teach nothing: those whose crc32 as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the text and lang of the documents that are not held out."""
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    found = predict(docs, model)
    return found.select(id_back("id", "doc_id"), "lang_pred", "score").withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "lang_pred", "score")
