"""Periodic runs of words within a document.

A run is a stretch of words with smallest period q (words q apart are identical) and a length of at least
max(12, 2 q) that no neighbouring word extends with period q.

Recursive frequency splitting: a word inside a run of period q occurs at least floor(max(12, 2 q) / q) times there, its
next occurrence is at most q words away, and the run fits into the segment. So a word that occurs too rarely within its
segment, or only too far from its next occurrence, belongs to no run: it splits the segment, whose parts are shorter and
make further words too rare. Parts of under 12 words go. All segments of all documents of a batch are split at
once, until nothing changes.

Lag scan: what survives is looked through lag by lag. A run of period q holds at least max(7 - q, q - 5) places in a
row whose six words are equal to those q places on, so it is enough to look at every (q - 5)-th place, about
m (6 + ln m) comparisons for m words. Hits are extended word by word to the whole stretch, smaller lags first; a
stretch inside a run whose period divides the lag is that run again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import each_row, id_back, ship, slices

LEAST, GRAM = 12, 6
#: Pairs of places that a lag scan holds at once.
PAIRS = 1 << 20


def least_period(count: np.ndarray) -> np.ndarray:
    """The smallest period of a run whose every word may occur only so often."""
    out = np.full(len(count), LEAST // 2 - 1)
    for q in range(LEAST // 2 - 1, 0, -1):
        out[count >= LEAST // q] = q
    return out


def surviving(words: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[tuple[int, int]]:
    """The segments of `words` that can hold runs, from segments that don't overlap (one for each document)."""
    done: list[tuple[int, int]] = []
    while True:
        size = stop - start
        start, size = start[size >= LEAST], size[size >= LEAST]
        if not len(start):
            return sorted(done)
        segment = np.repeat(np.arange(len(start)), size)
        place = np.arange(len(segment)) + np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        order = np.lexsort((words[place], segment))  # stable: places rise within a segment's word
        w, s, p = words[place][order], segment[order], place[order]
        new = np.r_[True, (w[1:] != w[:-1]) | (s[1:] != s[:-1])]
        group = np.cumsum(new) - 1
        count = np.bincount(group)[group]
        gap = np.where(new[1:], len(words), p[1:] - p[:-1])
        near = np.minimum(np.r_[len(words), gap], np.r_[gap, len(words)])
        fits = np.empty(len(order), bool)
        fits[order] = (count > 1) & (2 * np.maximum(near, least_period(count)) <= size[s])
        edge = np.diff(np.r_[0, fits.astype(np.int8), 0])
        seam = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])  # segments next to each other stay apart
        begin = np.union1d(np.flatnonzero(edge == 1), seam[fits[seam]])
        end = np.union1d(np.flatnonzero(edge == -1), seam[1:][fits[seam[1:] - 1]])
        whole = (end - begin) == size[segment[begin]]
        done += zip(place[begin[whole]].tolist(), (place[end[whole] - 1] + 1).tolist(), strict=True)
        start, stop = place[begin[~whole]], place[end[~whole] - 1] + 1


def _equal_ahead(a: np.ndarray, b: np.ndarray) -> int:
    """How many first values two arrays have in common."""
    at, step, n = 0, 32, min(len(a), len(b))
    while at < n:
        differs = np.flatnonzero(a[at : min(at + step, n)] != b[at : min(at + step, n)])
        if len(differs):
            return at + int(differs[0])
        at, step = at + step, step * 2
    return n


def scan(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of one segment, by start and period."""
    n, found = len(words), []
    if n < LEAST:
        return found
    gram = np.zeros(n - GRAM + 1, np.uint64)
    for k in range(GRAM):  # equal words give equal values; hits are compared word by word
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + words[k : n - GRAM + 1 + k].astype(np.uint64) + np.uint64(1)
    lags = np.arange(1, min(n // 2, n - GRAM) + 1)
    step = np.maximum(1, lags - GRAM + 1)
    upto = np.cumsum(-(-np.maximum(len(gram) - lags, 0) // step))
    first = 0
    while first < len(lags):
        base = upto[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(upto, base + PAIRS, "right")))
        amount = np.diff(np.r_[base, upto[first:last]])
        lag = np.repeat(lags[first:last], amount)
        at = (np.arange(len(lag)) - np.repeat(upto[first:last] - amount - base, amount)) * np.repeat(step[first:last], amount)
        hit = gram[at] == gram[at + lag]
        lag, at = lag[hit], at[hit]
        for s, length, p in found:
            rest = (lag % p != 0) | (at < s) | (at + lag >= s + length)
            lag, at = lag[rest], at[rest]
        done, k = (0, 0), 0
        while k < len(lag):
            q, i = int(lag[k]), int(at[k])
            k += 1
            if done[0] == q and i < done[1]:
                continue
            hi = i + _equal_ahead(words[i : n - q], words[i + q :])
            lo = i - _equal_ahead(words[:i][::-1], words[q : i + q][::-1])
            done = (q, hi)
            length = hi - lo + q
            if length < max(LEAST, 2 * q) or any(q % p == 0 and s <= lo and hi + q <= s + m for s, m, p in found):
                continue
            found.append((lo, length, q))
            rest = (lag[k:] % q != 0) | (at[k:] < lo) | (at[k:] + lag[k:] >= hi + q)
            lag, at, k = lag[k:][rest], at[k:][rest], 0
        first = last
    return sorted((s, m, p) for s, m, p in found)


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each document from its words."""
    number: dict[bytes, int] = {}
    words = np.array([number.setdefault(w, len(number)) for t in texts for w in t], np.int64)
    stop = np.cumsum([len(t) for t in texts])
    start = stop - np.array([len(t) for t in texts], np.int64)
    out: list[list] = [[] for _ in texts]
    for a, b in surviving(words, start, stop):
        doc = int(np.searchsorted(stop, a, "right"))
        at = a - int(start[doc])
        out[doc] += [(s + at, m, p) for s, m, p in scan(words[a:b])]
    return [sorted(r, key=lambda r: (r[0], r[2])) for r in out]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by a space, of each run only the first period (words that another run drops go, too)."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for s, m, p in runs:
        keep[s + p : s + m] = False
    return b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, runs (an array of start, length, period, by start and period) and collapsed, the text with single periods.

    Words are what ASCII white space (\\x20, \\x09 to \\x0D) separates. There is one row for each row of `docs`, repeated ids
    and rows included; a null or empty text has no words, no runs and an empty collapsed text; a null id is
    common.NULL_ID. Other columns are not read. A document is one row, as it is before.
    """
    ship(docs.sparkSession)
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def find(batches) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [t.encode().split() for t in b.column(1).to_pylist()]  # bytes: ASCII white space only
            runs = runs_of(texts)
            at = np.cumsum([0, *map(len, runs)])
            flat = np.array([r for rs in runs for r in rs], np.int64).reshape(-1, 3)
            structs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(run))
            text = [collapse(t, r).decode() for t, r in zip(texts, runs, strict=True)]
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), structs), pa.array(text, pa.string())], names=["id", "runs", "collapsed"])

    return each_row(docs, id_col, text_col).mapInArrow(find, "id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text, of a tenth of the documents with the end replaced by repetitions, chosen by the id's checksum.

    With h the crc32 of the decimal id and g = floor(h / 10): if h ends in 0, each word i from a = g mod n on becomes word
    a + (i - a) mod p, where p = 1 + floor((n - a) / (3 + g mod 8)). A null id chooses nothing.
    """
    whole = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    held = F.array(F.struct(words.alias("w"), F.floor(h / 10).alias("g")))  # so that words are split once, and only where they are wanted

    def changed(s: Column) -> Column:
        n = F.size(s.w)
        a = (s.g % F.greatest(n, F.lit(1))).cast("int")
        p = (1 + F.floor((n - a) / (3 + s.g % 8))).cast("int")
        return F.array_join(F.transform(s.w, lambda word, i: F.when(i < a, word).otherwise(F.get(s.w, (a + (i - a) % p).cast("int")))), " ")

    return whole.select("doc_id", F.when(h % 10 == 0, F.get(F.transform(held, changed), F.lit(0))).otherwise(F.col("text")).alias("text"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_runs, the longest run's start, length, period and exponent_milli, runs_sha256 and collapsed_sha256 of each row.

    The longest run is the one with the smallest start, then period, of those with the greatest length; null without runs.
    """
    found = periodic_runs(docs, id_col, text_col)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length, (-r.start).alias("s"), (-r.period).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string"))), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    out = found.select("id", "runs", best.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return out.select(
        id_back("id", "doc_id"), F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.p")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.p")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


#: Equal words up to half a document apart, made to stretches lag by lag.
ORACLE_SQL = r"""
WITH RECURSIVE codes AS MATERIALIZED (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce([b::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(b))
), d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w0,
         xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
                         lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) AS h
  FROM documents, codes
), planted AS (
  SELECT doc_id, w0, len(w0) AS n, h, h // 10 AS g, (h // 10) % greatest(len(w0), 1) AS a FROM d
), docs AS MATERIALIZED (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w0[i + 1] ELSE w0[1 + a + (i - a) % (1 + (n - a) // (3 + g % 8))] END)
                    ELSE w0 END AS w
  FROM planted
), words AS MATERIALIZED (
  SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS word FROM docs
), islands AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i AS i, x.i - row_number() OVER (PARTITION BY x.doc_id, y.i - x.i ORDER BY x.i) AS island
  FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND y.i - x.i <= x.n // 2
), stretches AS MATERIALIZED (
  SELECT doc_id, q, min(i) AS s, count(*) + q AS m FROM islands GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(12, 2 * q)
), runs AS MATERIALIZED (
  SELECT * FROM stretches x WHERE NOT EXISTS (SELECT 1 FROM stretches y WHERE y.doc_id = x.doc_id AND y.q < x.q AND x.q % y.q = 0 AND y.s <= x.s AND x.s + x.m <= y.s + y.m)
), dropped AS (
  SELECT DISTINCT doc_id, unnest(range(s + q, s + m)) AS i FROM runs
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || m || ',' || q || chr(10), '' ORDER BY s, q) AS lines, list({'s': s, 'm': m, 'q': q} ORDER BY m DESC, s, q)[1] AS best
  FROM runs GROUP BY doc_id
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.m AS length, best.q AS period, 1000 * best.m // best.q AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM docs LEFT JOIN found USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
