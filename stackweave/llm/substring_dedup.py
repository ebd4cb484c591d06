"""Removal of passages that repeat: MinHash banding of paragraphs, and equal runs of words widened to their ends.

A line is cut into paragraphs of a dozen words or more. A cut is made behind a sentence whose hash says so, or at last
behind the first sentence after four dozen words; longer stretches are cut between two words whose hash is the
smallest around, so that a passage is cut alike wherever it stands. A line of several paragraphs counts as one more, so
that a few changed words do not hide a long passage. A paragraph's id is a hash of its words. Paragraphs get a MinHash
signature of their five-word shingles, cut into as many bands as a recall of `recall` at the asked similarity needs.
Those that collide in a band are verified by their exact Jaccard similarity as in ngram_join, links form components,
and of each component the first place in the corpus stays.

Paragraphs whose words are all equal, wherever their lines and sentences end, are found by seeds: of each
`least_words` // 2 neighbouring runs of words the one with the smallest hash, whose length is such that every equal
passage of `least_words` words holds one. Each place of a seed is widened word by word as far as the seed's first
place in the corpus agrees. Places between which only a few words differ are joined, and what then has `least_words`
repeated words or more is removed.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, every_row, id_back, rows, sent, slices
from .ngram_join import _U, _WHITE, _byte_values, _powers, _signs, bloom, bucket_bits, buckets_of, holds, mix, packed, repeated, resolve

#: Words of a paragraph before a cut, and words after which the next sentence end is a cut.
SHORT, LONG = 12, 48
#: A pair of words has the smallest hash of this many on each side of it where a stretch without another cut is cut.
AROUND = 24
SHINGLE = 5
LINE = np.int64(0x5DEECE66D1234567)
SEED = _U(0x2545F4914F6CDD1D)
#: Bits for the place of a word in its text.
PLACE = _U((1 << 28) - 1)
#: Repeats with up to a third of the least number of words between them are one, changed in between.
BRIDGE = 3


def bands(percent: int, recall: float, width: int = 3) -> int:
    """How many bands of `width` hashes find a pair of the least similarity with the given probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - (percent / 100) ** width))


@functools.lru_cache(maxsize=4)
def multipliers(n: int) -> np.ndarray:
    """Odd numbers that each order the shingles in another way."""
    return np.array([(2 * k * 0x5851F42D4C957F2D + 0x9E3779B97F4A7C15 | 1) & 0xFFFFFFFFFFFFFFFF for k in range(n)], _U)


def least_of(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


_WORD = (~_WHITE).astype(np.int8)


def word_starts(raw: bytes) -> tuple[np.ndarray, int]:
    """Where each word of a text starts, and its end; the number of words."""
    word = np.concatenate([[False], ~_WHITE[np.frombuffer(raw, np.uint8)]])
    start = np.flatnonzero(word[1:] & ~word[:-1])
    return np.append(start, len(raw)), len(start)


POWERS = 1 << 19


class Paragraphs:
    """The paragraphs of texts, all texts together: first and last word, ids and shingles.

    Words are numbered through all texts; `edges` has where each text's words begin, and `doc` the text of each word.
    """

    def __init__(self, *texts: str | bytes):
        parts = [t.encode() if isinstance(t, str) else t for t in texts]
        self.raw = b"\n".join(parts)
        low = np.frombuffer(self.raw.lower(), np.uint8)  # bytes.lower() knows A-Z only
        word = np.zeros(len(low) + 2, np.int8)
        np.take(_WORD, low, out=word[1:-1])
        edge = np.flatnonzero(word[1:] != word[:-1])
        self.start, self.end = start, end = edge[::2], edge[1::2]
        self.n_words = len(start)
        self.edges = np.concatenate([[0], np.searchsorted(start, np.cumsum([len(t) + 1 for t in parts]))])
        self.doc = np.repeat(np.arange(len(parts)), np.diff(self.edges))
        if not self.n_words:
            self.first = self.last = self.ids = np.zeros(0, np.int64)
            self.hashes, self.pieces = np.zeros(0, _U), 0
            return
        up, down = _powers(max(POWERS, 1 << len(low).bit_length()))
        sums = np.zeros(len(low) + 1, _U)
        np.cumsum(_byte_values()[low] * up[: len(low)], out=sums[1:])
        self.hashes = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(_U))
        lines = np.searchsorted(np.flatnonzero(low == 10), start)
        # before which words a text, a line or a sentence ends
        breaks = np.ones(self.n_words, bool)
        breaks[1:] = lines[1:] != lines[:-1]
        last = low[end[:-1] - 1]
        stops = (last == 33) | (last == 46) | (last == 63)
        places = np.flatnonzero(breaks[1:] | stops) + 1
        chosen = (self.hashes[places - 1] >> _U(60)) & _U(1) > 0
        cuts, before = [0], 0
        for k, line, hit in zip(places.tolist(), breaks[places].tolist(), chosen.tolist(), strict=True):
            if line or k - before >= LONG or hit and k - before >= SHORT:
                cuts.append(k)
                before = k
        first = self._shorter(np.array([*cuts, self.n_words]))
        edges = np.append(first, self.n_words)
        self.pieces = len(first)
        # a line of several paragraphs is one more, after all others
        head = np.flatnonzero(breaks[first])
        tail = np.append(head[1:], self.pieces)
        several = tail - head > 1
        self.first, self.last = np.concatenate([first, first[head[several]]]), np.concatenate([edges[1:], edges[tail[several]]])
        total = np.zeros(self.n_words + 1, _U)
        np.cumsum(self.hashes * up[: self.n_words], out=total[1:])
        self.ids = mix((total[self.last] - total[self.first]) * down[self.first] + (self.last - self.first).astype(_U)).view(np.int64)
        self.ids[self.pieces :] ^= LINE  # lines are compared with lines only: one is like its own paragraphs
        self.total = total

    def own(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts of words, and the words' places in them."""
        doc = self.doc[at]
        return doc, at - self.edges[doc]

    def _apart(self, values: np.ndarray, gap: int, fill: int) -> tuple[np.ndarray, np.ndarray]:
        """Values of words with a gap before, between and behind the texts, and where the words are."""
        at = np.arange(self.n_words) + gap * (self.doc + 1)
        wide = np.full(self.n_words + gap * (len(self.edges)), fill, values.dtype)
        wide[at] = values
        return wide, at

    def text(self, k: int) -> str:
        """The text of a paragraph."""
        return self.raw[self.start[self.first[k]] : self.end[self.last[k] - 1]].decode()

    def _shorter(self, edges: np.ndarray) -> np.ndarray:
        """More cuts in stretches of more than LONG words, between pairs of words that have the smallest hash around them."""
        if (edges[1:] - edges[:-1]).max() <= LONG:
            return edges[:-1]
        pairs = np.full(self.n_words, _U(0xFFFFFFFFFFFFFFFF))  # a text's last word has none
        inside = self.doc[1:] == self.doc[:-1]
        pairs[:-1][inside] = mix(self.hashes[:-1] * _U(0x9FB21C651E98DF25) + self.hashes[1:])[inside]
        wide, at = self._apart(pairs, AROUND, 0xFFFFFFFFFFFFFFFF)
        near = least_of(wide, AROUND)
        more = np.flatnonzero((pairs < near[at - AROUND]) & (pairs <= near[at + 1])) + 1
        at = np.searchsorted(edges, more, "right") - 1
        more = more[(edges[at + 1] - edges[at] > LONG) & (more - edges[at] >= SHORT) & (edges[at + 1] - more >= SHORT)]
        return np.sort(np.concatenate([edges[:-1], more]))

    def _runs(self, size: int) -> np.ndarray:
        """A hash of each `size` neighbouring words."""
        n = self.n_words - size + 1
        return mix((self.total[size:] - self.total[:n]) * _powers(max(POWERS, 1 << self.n_words.bit_length()))[1][:n] + _U(size))

    def seeds(self, least_words: int) -> tuple[np.ndarray, np.ndarray]:
        """The first words of the seeds and their hashes: every run of `least_words` words holds one of them."""
        around, length = seed_sizes(least_words)
        # a run that reaches into the next text is in none of the windows that are asked
        windows = np.flatnonzero(np.arange(self.n_words) + least_words <= self.edges[1:][self.doc])
        if not len(windows):
            return np.zeros(0, np.int64), np.zeros(0, _U)
        runs = self._runs(length)
        packed = (runs & ~PLACE) | np.arange(len(runs), dtype=_U)  # of equal ones the first
        at = (least_of(packed, around)[windows] & PLACE).astype(np.int64)
        at = at[np.flatnonzero(np.diff(at, prepend=-1))]
        return at, runs[at] ^ SEED

    def beside(self, at: np.ndarray, length: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """16 bits of each of the `reach` words before and behind runs of words, from the run outwards; 0 where the text has ended."""
        words, place = self._apart(np.maximum((self.hashes >> _U(40)).astype(np.uint16), 1), reach, 0)
        away, place = np.arange(reach)[None, :], place[at][:, None]
        return words[place - 1 - away], words[place + length + away]

    def signatures(self, hashes: int, words: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
        """The paragraphs of so many words or more, and their MinHash values."""
        which = np.flatnonzero(self.last - self.first >= max(words, SHINGLE))
        if not len(which):
            return which, np.zeros((0, hashes), _U)
        h = np.full(self.n_words - SHINGLE + 1, SHINGLE, _U)
        for k in range(SHINGLE):
            h = (h + self.hashes[k : k + len(h)]) * _U(0x9FB21C651E98DF25)
        spans = np.stack([self.first[which], self.last[which] - SHINGLE + 1], 1).ravel()
        h = np.append(h, _U(0))  # reduceat takes no place behind the end
        x = (h ^ (h >> _U(31)))[None, :] * multipliers(hashes)[:, None]
        x >>= _U(16)
        x[:, -1] = _U(1 << 48)
        return which, np.minimum.reduceat(x, spans, 1)[:, ::2].T

    def keys(self, n_bands: int, width: int, words: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
        """The paragraphs of so many words or more, and a key for each band."""
        which, values = self.signatures(n_bands * width, words)
        values = values.reshape(len(which), n_bands, width)
        x = np.arange(1, n_bands + 1, dtype=_U)[None, :]
        for k in range(width):
            x = mix(x * _U(0x9FB21C651E98DF25) + values[:, :, k])
        x[which >= self.pieces] ^= LINE.view(_U)
        return which, x


def seed_sizes(least_words: int) -> tuple[int, int]:
    """Of how many neighbouring runs one is a seed, and how many words a run has."""
    around = max(1, least_words // 2)
    return around, least_words - around + 1


def _together(batches):
    """The ids (as they are in the batches) and the paragraphs of a few texts at once."""
    for b in slices(batches, 64):
        ids, held, size = b.column(0).to_numpy(), [], 0
        for k, text in enumerate(b.column(1).to_pylist()):
            raw = text.encode()
            if held and size + len(raw) >= POWERS:
                yield ids[k - len(held) : k], Paragraphs(*held)
                held, size = [], 0
            held.append(raw)
            size += len(raw) + 1
        if held:
            yield ids[len(ids) - len(held) :], Paragraphs(*held)


def _fresh(p: Paragraphs, which: np.ndarray, seen: set[int]) -> np.ndarray:
    """The paragraphs that the task has not met yet."""
    keep = np.zeros(len(which), bool)
    for k, x in enumerate(p.ids[which].tolist()):
        if x not in seen:
            if len(seen) > 1_000_000:
                seen.clear()
            seen.add(x)
            keep[k] = True
    return keep


def _counted(n_bands: int, width: int, least_words: int, across: bool, bits: int):
    """Band keys with the paragraphs that have them, and seeds with their documents (their places, if repeats in one document count)."""

    def chunks(batches):
        seen: set[int] = set()
        for ids, p in _together(batches):
            which, keys = p.keys(n_bands, width, least_words // 2)
            fresh = _fresh(p, which, seen)
            yield keys[fresh].ravel(), np.repeat(p.ids[which[fresh]].view(_U), n_bands)
            at, seeds = p.seeds(least_words)
            doc, place = p.own(at)
            docs = ids.view(_U)[doc]
            yield seeds, mix(docs ^ _U(0x5851F42D4C957F2D)) if across else mix(mix(docs) ^ place.astype(_U))

    return lambda batches: packed(chunks(batches), bits)


_ROWS = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("seed", pa.bool_()), ("s", pa.int32()), ("e", pa.int32()), ("left", pa.binary()), ("right", pa.binary()), ("text", pa.string()), ("keys", pa.list_(pa.int64()))])
ROWS = "id long, key long, seed boolean, s int, e int, left binary, right binary, text string, keys array<long>"


def _repeats(n_bands: int, width: int, least_words: int, shared):
    """The places of seeds that may repeat, with the words beside them, and of paragraphs that may collide; of these the
    first one in the task has its text and those of its keys."""
    around, length = seed_sizes(least_words)

    def run(batches):
        table, seen = shared.value, set()
        for ids, p in _together(batches):
            at, own = p.seeds(least_words)
            which, keys = p.keys(n_bands, width, least_words // 2)
            hits = holds(table, np.concatenate([own, keys.ravel()]))
            hit, found = hits[: len(at)], hits[len(at) :].reshape(keys.shape)
            at, own = at[hit], own[hit]
            doc, s = p.own(at)
            left, right = (_binary(x) for x in p.beside(at, length, around))
            yield _batch(len(at), id=ids[doc], key=own.view(np.int64), seed=np.ones(len(at), bool), s=s, e=s + length, left=left, right=right)
            some = np.flatnonzero(found.any(1))
            which, keys, found = which[some], keys[some].view(np.int64), found[some]
            fresh = _fresh(p, which, seen).tolist()
            doc, s = p.own(p.first[which])
            texts = [p.text(k) if new else None for k, new in zip(which.tolist(), fresh, strict=True)]
            kept = [keys[k, found[k]] if new else None for k, new in enumerate(fresh)]
            yield _batch(len(which), id=ids[doc], key=p.ids[which], seed=np.zeros(len(which), bool), s=s, e=s + p.last[which] - p.first[which], text=texts, keys=kept)

    return run


def _binary(x: np.ndarray) -> pa.Array:
    """Each row of an array as bytes."""
    size = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, len(x) * size + 1, size, dtype=np.int32)), pa.py_buffer(x.tobytes())])


def _batch(n: int, **columns) -> pa.RecordBatch:
    """A batch of _ROWS; what isn't given is null."""
    return pa.record_batch([columns[f.name] if isinstance(columns.get(f.name), pa.Array) else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _ROWS], schema=_ROWS)


def _rows_of(x: pa.Array) -> np.ndarray:
    """The numbers of 16 bits in all rows of an array of bytes without nulls."""
    ends = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1]
    return np.frombuffer(x.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.uint16)


def _widened(batches):
    """Ranges s to e of later places, widened as far as the words beside them are those beside the first place."""

    def agree(a: pa.Array, b: pa.Array) -> np.ndarray:
        a, b = (_rows_of(x).reshape(len(x), -1) for x in (a, b))
        return np.minimum.accumulate((a == b) & (a != 0), 1).sum(1)

    for b in slices(batches, 4096):
        if b.num_rows:
            ids, s, e = (b.column(k).to_numpy() for k in range(3))
            s, e = s - agree(b.column(3), b.column(5)), e + agree(b.column(4), b.column(6))
            yield pa.record_batch([pa.array(ids), pa.array(s.astype(np.int64)), pa.array(e.astype(np.int64))], names=["id", "s", "e"])


def _spans(batches):
    """Ranges of words of one document as few as they can be."""
    for b in slices(batches):
        ids, starts, ends = [], [], []
        for doc, s, e in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            order = np.argsort(s, kind="stable")
            s, e = np.array(s, np.int64)[order], np.maximum.accumulate(np.array(e, np.int64)[order])
            new = np.flatnonzero(np.append(True, s[1:] > e[:-1]))
            ids.append(doc)
            starts.append(s[new].tolist())
            ends.append(e[np.append(new[1:], len(s)) - 1].tolist())
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))], names=["id", "starts", "ends"])


def _remove(least_words: int):
    def run(batches):
        for b in slices(batches):
            texts, total, gone, cut = [], [], [], []
            for text, starts, ends in zip(*(b.column(k).to_pylist() for k in range(1, 4)), strict=True):
                raw = text.encode()
                if not starts:
                    for column, value in zip((texts, total, gone, cut), (text, len(raw.split()), 0, 0), strict=True):
                        column.append(value)
                    continue
                first, n = word_starts(raw)
                s, e = np.array(starts), np.array(ends)
                new = np.flatnonzero(np.append(True, s[1:] - e[:-1] > least_words // BRIDGE))
                long = np.add.reduceat(e - s, new) >= least_words
                s, e = s[new], e[np.append(new[1:], len(e)) - 1]
                parts, end = [], 0
                for x, y in zip(s[long].tolist(), e[long].tolist(), strict=True):
                    parts.append(raw[end : first[x]])
                    end = first[y]  # a range ends where the next word starts
                texts.append((b"".join(parts) + raw[end:]).decode())
                total.append(n)
                gone.append(int((e - s)[long].sum()))
                cut.append(int(long.sum()))
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(cut, pa.int64())], names=["id", "text", "n_words", "n_removed", "n_passages"])

    return run


@every_row("id")
def without_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, recall: float = 0.98, width: int = 2, least_words: int = 20, across: bool = False) -> DataFrame:
    """id, text, n_words, n_removed, n_passages of each document, repeated passages removed.

    Words are runs of other characters than [\\x20\\x09-\\x0D] and compared with A-Z in lower case. Of a component of
    paragraphs, or of the places of a seed, the one with the smallest id, then the first in the text, stays. Repeats
    within one document count unless `across` is set; then all places in the first document stay. A passage of
    `least_words` words or more that stands word for word at an earlier place is always found; its ends are those up to
    which the first place of its seeds agrees. Paragraphs of under half of `least_words` words lead nowhere as changed
    ones. A null text counts as empty and keeps no words.
    """
    spark = docs.sparkSession
    scratch, n_bands = Scratch(spark), bands(percent, recall, width)
    texts = rows(docs, id_col, text_col)
    bits = bucket_bits((texts.agg(F.sum(F.length("text"))).head()[0] or 0) // 20)  # a key for about twenty characters
    again = texts.mapInArrow(_counted(n_bands, width, least_words, across, bits), "bucket int, keys binary")
    again = scratch.keep(repeated(again, True))
    shared = spark.sparkContext.broadcast(bloom(again, bits))
    found = scratch.keep(texts.mapInArrow(_repeats(n_bands, width, least_words, shared), ROWS))
    fresh = found.where("text is not null").groupBy(F.col("key").alias("id")).agg(F.min("text").alias("text"), F.first("keys").alias("keys"))
    distinct = scratch.keep(fresh)  # equal words have equal keys
    scratch.drop(again)
    sketches = scratch.keep(distinct.select("id", "text").mapInArrow(_signs(SHINGLE), "id long, n long, sign binary, sketch binary").drop("sign"))
    linked = resolve(distinct.select("id", "text"), sketches, buckets_of(distinct.select("id", F.explode("keys").alias("key")), scratch), scratch, SHINGLE, percent)
    linked = scratch.keep(linked.select(F.col("id").alias("key"), "component"))
    scratch.end(linked, found)
    apart = "id <> first.id" if across else "struct(id, s) <> struct(first.id, first.s)"
    seeds = found.where("seed")
    first = seeds.groupBy("key").agg(F.min(F.struct("id", "s", "left", "right")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = scratch.keep(first.select("key", "first"))
    later = seeds.join(first, "key").where(apart)
    # words of the place that stays are not part of a later one that overlaps it
    start = f"if(id = first.id and s < first.s + {least_words}, first.s + {least_words}, s)"
    spans = later.select("id", "s", "e", "left", "right", F.col("first.left").alias("l"), F.col("first.right").alias("r"), F.expr(start).alias("start"))
    near = spans.where("start = s").drop("start").mapInArrow(_widened, "id long, s long, e long")
    near = near.unionByName(spans.where("start <> s").select("id", F.col("start").cast("long").alias("s"), F.col("e").cast("long").alias("e")).where("s < e"))
    placed = found.where("not seed").join(sent(linked), "key").select("id", F.col("component").alias("class"), "s", "e")
    kept = scratch.keep(placed.groupBy("class").agg(F.min(F.struct("id", "s")).alias("first")))
    changed = placed.join(kept, "class").where(apart).select("id", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"))
    spans = near.unionByName(changed).groupBy("id").agg(F.collect_list("s").alias("s"), F.collect_list("e").alias("e"))  # a document's own
    spans = scratch.keep(spans.mapInArrow(_spans, "id long, starts array<long>, ends array<long>"))
    scratch.end(spans)
    gone = sent(spans, F.size("starts") * 16 + 64)
    return texts.join(gone, "id", "left").select("id", "text", "starts", "ends").mapInArrow(_remove(least_words), "id long, text string, n_words long, n_removed long, n_passages long")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, n_passages, kept_sha256 of each document; the digest is of the text that is left.

    What goes are passages of 20 words or more that stand at an earlier place, in the same document or another one.
    """
    out = without_passages(docs)
    return out.select(id_back("id", "doc_id"), "n_words", "n_removed", "n_passages", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
