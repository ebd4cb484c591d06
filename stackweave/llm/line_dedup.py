"""Line deduplication by pairwise alignment.

Documents that overlap are found through units that they share: lines, and two and three neighbouring lines. Each unit
leads its documents to the first document that has it, so a unit adds one pair for each of its documents and never all
pairs of them. A unit of many words leads at any frequency. A shorter one leads if it is rare: it does not stand in many
different surroundings, measured against how often it occurs and how large the corpus is. The lines of a document with
thousands of copies are rare in that sense, a short notice at the foot of many different pages is not.

Each pair is aligned with patience diff: lines that occur once in both documents are matched in their longest common
order, then the parts between them in the same way. Runs of matched lines are common blocks, and they are deleted from
the later document, the one with the larger id, if they hold enough words. All alignments read the original texts; the
first document that has a line keeps it, so one copy is left of all that is deleted.
"""

from __future__ import annotations

import bisect
import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, every_row, id_back, rows, slices

#: Rows up to which the deleted ranges are sent to all tasks instead of shuffling the texts to them.
SENT_ROWS = 500_000
#: Lines of a unit.
NEIGHBOURS = (1, 2, 3)


def line_hash(line: str) -> int:
    """Of a line without white space at its ends; 0 for a blank one."""
    line = line.strip()
    return int.from_bytes(hashlib.blake2b(line.encode(), digest_size=8).digest(), "little", signed=True) or 1 if line else 0


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched places of two sequences, in order."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, p, q = todo.pop()
        while i < j and p < q and a[i] == b[p]:
            out.append((i, p))
            i, p = i + 1, p + 1
        while i < j and p < q and a[j - 1] == b[q - 1]:
            j, q = j - 1, q - 1
            out.append((j, q))
        if i >= j or p >= q:
            continue
        once_a, once_b = Counter(a[i:j]), Counter(b[p:q])
        place = {x: k for k, x in enumerate(b[p:q], p) if once_b[x] == 1}
        pairs = [(k, place[x]) for k, x in enumerate(a[i:j], i) if once_a[x] == 1 and x in place]
        if not pairs:
            continue
        ends, tails, back = [], [], [-1] * len(pairs)  # the longest rising run of places in b
        for k, (_, y) in enumerate(pairs):
            at = bisect.bisect_left(ends, y)
            back[k] = tails[at - 1] if at else -1
            ends[at : at + 1], tails[at : at + 1] = [y], [k]
        k, chain = tails[-1], []
        while k >= 0:
            chain.append(pairs[k])
            k = back[k]
        i0, p0 = i, p
        for x, y in [*reversed(chain), (j, q)]:
            todo.append((i0, x, p0, y))
            if x < j:
                out.append((x, y))
            i0, p0 = x + 1, y + 1
    return sorted(out)


def blocks(matches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """start, end of the runs of places of the first sequence that are matched in step."""
    out = []
    for k, (x, y) in enumerate(matches):
        if k and matches[k - 1] == (x - 1, y - 1):
            out[-1] = (out[-1][0], x + 1)
        else:
            out.append((x, x + 1))
    return out


def _lines(batches):
    for b in slices(batches):
        hashes = [[line_hash(x) for x in t.split("\n")] for t in b.column(1).to_pylist()]
        words = [[len(x.split()) for x in t.split("\n")] for t in b.column(1).to_pylist()]
        yield pa.record_batch([b.column(0), pa.array(hashes, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.int32()))], names=["id", "hashes", "words"])


def _surroundings(long_words: int):
    """One row for each document and unit of it: whether it is long, and the first place's surroundings."""

    def run(batches):
        for b in slices(batches):
            ids, lines, around, long = [], [], [], []
            for doc, hashes, words in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                seen, full = set(), [k for k, h in enumerate(hashes) if h]  # blank lines are no part of a unit
                for size in NEIGHBOURS:
                    for j in range(len(full) - size + 1):
                        own = full[j : j + size]
                        first, last = own[0], own[-1]
                        unit = hashes[first] if size == 1 else hash(tuple(hashes[k] for k in own))
                        if unit not in seen:
                            seen.add(unit)
                            ids.append(doc)
                            lines.append(unit)
                            long.append(sum(words[k] for k in own) >= long_words)
                            around.append(hash((hashes[first - 1] if first else 2, hashes[last + 1] if last + 1 < len(hashes) else 3)))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(lines, pa.int64()), pa.array(around, pa.int64()), pa.array(long, pa.bool_())], names=["id", "line", "around", "long"])

    return run


def _align(least_words: int):
    def run(batches):
        for b in slices(batches):
            later, starts, ends = [], [], []
            for doc, own, words, first in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                total = np.concatenate([[0], np.cumsum(words)])
                for s, e in blocks(patience(own, first)):
                    if total[e] - total[s] >= least_words:
                        later.append(doc)
                        starts.append(s)
                        ends.append(e)
            yield pa.record_batch([pa.array(later, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["id", "s", "e"])

    return run


def _delete(batches):
    for b in slices(batches):
        texts, lines, gone = [], [], []
        for text, ranges in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            parts = text.split("\n")
            drop = np.zeros(len(parts), bool)
            for r in ranges or ():
                drop[r["s"] : r["e"]] = True
            lines.append(len(parts))
            gone.append(int(drop.sum()))
            texts.append("\n".join(p for p, d in zip(parts, drop, strict=True) if not d) if gone[-1] else text)
        yield pa.record_batch([b.column(0), pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(gone, pa.int64())], names=["id", "text", "n_lines", "n_removed"])


@every_row("id")
def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", surroundings: int = 8, least_words: int = 5, long_words: int = 20, share: float = 0.016) -> DataFrame:
    """id, text, n_lines, n_removed of each document, its repeated blocks deleted.

    Lines end at \\n and are compared without white space at their ends. A unit of `long_words` words or more always
    leads. A shorter one is rare when twice the number of its surroundings, the lines before and behind it, is not over
    the number of its documents plus 2 * `surroundings`, or plus that `share` of all documents if it is more. A block is deleted when it has at least `least_words` words. A null text counts as empty: one blank line. A null id
    comes before all others.
    """
    scratch = Scratch(docs.sparkSession)
    texts = rows(docs, id_col, text_col)
    lines = scratch.keep(texts.mapInArrow(_lines, "id long, hashes array<long>, words array<int>"))
    places = lines.mapInArrow(_surroundings(long_words), "id long, line long, around long, long boolean")
    more = max(2 * surroundings, share * lines.count())
    by_line = places.groupBy("line", "around").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"), F.max("long").alias("long"))
    by_line = by_line.groupBy("line").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.min("id").alias("first"), F.max("long").alias("long"))
    rare = scratch.keep(by_line.where(f"n > 1 and (long or 2 * k <= n + {more})").select("line", "first"))
    pairs = scratch.keep(places.join(rare, "line").where("id <> first").select("id", "first").distinct())
    firsts = lines.select(F.col("id").alias("first"), F.col("hashes").alias("other"))
    aligned = pairs.join(firsts, "first").join(lines, "id").select("id", "hashes", "words", "other")
    found = scratch.keep(aligned.mapInArrow(_align(least_words), "id long, s int, e int"))
    gone = scratch.keep(found.distinct().groupBy("id").agg(F.collect_list(F.struct("s", "e")).alias("ranges")))  # a document's own ranges
    small = found.count() <= SENT_ROWS
    return texts.join(F.broadcast(gone) if small else gone, "id", "left").select("id", "text", "ranges").mapInArrow(_delete, "id long, text string, n_lines long, n_removed long")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 of each document; the digest is of the text that is left."""
    return without_repeats(docs).select(id_back("id", "doc_id"), "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
