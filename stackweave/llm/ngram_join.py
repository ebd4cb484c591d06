"""Similarity join of word n-gram sets by parity sketches.

A set of shingles is hashed into a sketch of bits, each shingle flipping one bit. Two sketches differ in at most as
many bits as their sets differ in shingles, so their Hamming distance bounds the symmetric difference from below.
Sets whose Jaccard similarity reaches percent/100 differ in at most D shingles, where D follows from their sizes. The
sketch of a size band is cut into D + 1 + E parts: more than E parts of a linked pair are equal (pigeonhole), and if
no more than E parts of a set are empty, those can be left out and an equal part still finds the pair.

Equal sets are one class from the start, so copies cost nothing. Within a bucket of equal parts no pairs are spelled
out: each set is verified against the bucket's smallest id, in a large bucket what is left against a few others of
it, and only buckets that hold several components then go on:

* in a small bucket, sets of different components are paired;
* in large ones, each set is written as its difference from a centre, the smallest id of all large buckets that sets
  join with its own; so it is written once, in however many of them it is. For a pair of which one is not linked with
  the centre the differences overlap, by an amount that follows from the sizes, so a prefix join over the differences,
  what the centre lacks first, finds it; pairs whose sketches are too far apart do not leave that join.

Every pair that is found is compared by sketches of the whole sets first, and verified exactly if those allow it. No candidate is dropped and no bucket is capped.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, every_row, id_back, rows, sent, slices
from .components import components

#: Bits of a sketch part, as a power of two.
PART_BITS = 20
#: Members up to which all pairs of different components of a bucket are verified.
SMALL = 32
#: Further centres of a large bucket, all looked at together.
ROUNDS = 4
#: Longs of the sketches by which pairs of large buckets are judged in their join.
FOLDED = 16
#: Rows that are verified against one copy of their partner.
RUN = 128

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


@functools.lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))


@functools.lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    base = 0xD6E8FEB86659FD93
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([[_U(1)], np.multiply.accumulate(np.full(size, b, _U))]) for b in (base, pow(base, -1, 1 << 64)))


_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word [^\\x20\\x09-\\x0D]+ with A-Z in lower case."""
    raw = np.frombuffer(text.encode().lower(), np.uint8)  # bytes.lower() knows A-Z only
    word = np.concatenate([[False], ~_WHITE[raw], [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = _powers(1 << max(16, len(raw).bit_length()))
    sums = np.concatenate([[_U(0)], np.cumsum(_byte_values()[raw] * up[: len(raw)])])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(_U))


def shingles(text: str, n: int = 3) -> np.ndarray:
    """The distinct hashes of n neighbouring words; of fewer words, all of them as one."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = min(n, len(w))
    h = np.full(len(w) - n + 1, n, _U)
    for k in range(n):
        h = (h + w[k : k + len(h)]) * _U(0x9FB21C651E98DF25)
    return np.unique(mix(h))


def largest_difference(total: int, percent: int) -> int:
    """The largest symmetric difference of two linked sets with so many elements together."""
    return total * (100 - percent) // (100 + percent)


@functools.lru_cache(maxsize=8)
def bands(percent: int) -> list[int]:
    """The smallest sizes of the size bands. Linked sets are in one band or in neighbouring ones."""
    out = [next(s for s in range(1, 10_000) if largest_difference(2 * s + 1, percent) > 0)]
    while out[-1] < 1 << 40:
        out.append(int(out[-1] * (100 / percent) ** 1.35) + 1)
    return out


@functools.lru_cache(maxsize=1024)
def parts_of(low: int, high: int, percent: int) -> tuple[int, int]:
    """Parts of the sketches by which sets of two bands (of one, if they are the same) meet, and how many tokens each set needs.

    A part and its value are a token. Of D shingles that differ each changes one part at most, so linked sets share all
    but D tokens, and the first D + 1 in any order that is the same for both hold a shared one. There are more parts
    than that, so that hardly any set needs the tokens of its empty parts; what is left over spares it frequent ones.
    """
    sizes = bands(percent)
    last = sizes[low + 1] - 1
    most = largest_difference(last + min(sizes[high + 1] - 1, last * 100 // percent), percent)
    least = max(sizes[low], -(-sizes[high] * percent // 100))
    empty = 1
    for _ in range(200):
        mean = (most + 1 + empty) * math.exp(-least / (most + 1 + empty))
        if empty >= mean + 3 * math.sqrt(mean):
            break
        empty += 1
    return most + 1 + empty, most + 1


def tokens(u: np.ndarray, percent: int) -> list[tuple[np.ndarray, int, int]]:
    """The tokens of a sorted set for each pair of bands in which it may have partners: keys, how many are of parts
    that aren't empty (these come first), and how many a set needs. Those of empty parts are there if they are needed."""
    sizes, n, out = bands(percent), len(u), []
    own = int(np.searchsorted(sizes, n, "right")) - 1
    if own < 0:
        return out
    pairs = [(own, own)]
    if 100 * n >= percent * sizes[own + 1]:
        pairs.append((own, own + 1))
    if own and percent * n <= 100 * (sizes[own] - 1):
        pairs.append((own - 1, own))
    bits = mix((u & _U((1 << PART_BITS) - 1)) + _U(1))
    for low, high in pairs:
        parts, need = parts_of(low, high, percent)
        part = ((u >> _U(32)) * _U(parts)) >> _U(32)  # u is sorted, and so is part
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        used = part[first]
        # the hash of a part is the sum modulo 2 of the hashes of its set bits
        value, filled = np.bitwise_xor.reduceat(bits, first), len(used)
        if filled < need:
            rest = np.setdiff1d(np.arange(parts, dtype=_U), used)
            used, value = np.concatenate([used, rest]), np.concatenate([value, np.zeros(len(rest), _U)])
        out.append((mix(value ^ mix(used + _U(((high + low) << 40) + 1))), filled, need))
    return out


def sketch_keys(sets: list[np.ndarray], percent: int, frequent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The first tokens of sorted sets, as many as each needs, and the places of their sets in the list.

    Frequent ones (by a Bloom filter) and those of empty parts come last.
    """
    found = [(k, *t) for k, u in enumerate(sets) for t in tokens(u, percent)]
    if not found:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    keys = np.concatenate([t[1] for t in found])
    order = keys >> _U(2)
    if frequent is not None:
        order[holds(frequent, keys)] |= _U(1 << 62)
    at, chosen = 0, []
    for _, own, filled, need in found:
        order[at + filled : at + len(own)] |= _U(1 << 63)
        # tokens that differ in the two bits left out only are all taken, so that every set decides alike
        chosen.append(order[at : at + len(own)] <= np.partition(order[at : at + len(own)], need - 1)[need - 1])
        at += len(own)
    chosen = np.concatenate(chosen)
    return keys[chosen], np.repeat([t[0] for t in found], [len(t[1]) for t in found])[chosen]


def bit_sketch(u: np.ndarray) -> np.ndarray:
    """A sketch of the whole set for a first look at pairs: as many bits as the set's size or more, packed.

    A sketch of half as many bits is the sum of both halves modulo 2, so sketches of sets of any sizes can be compared.
    """
    bits = 1 << max(8, (len(u) - 1).bit_length())
    return np.packbits((np.bincount(((u >> _U(7)) & _U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8))


def distance(a: np.ndarray, b: np.ndarray) -> int:
    """The Hamming distance of two sketches, at most the symmetric difference of their sets."""
    while len(a) != len(b):
        a, b = (a, b) if len(a) > len(b) else (b, a)
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _signs(n: int):
    def run(batches):
        for b in slices(batches):
            sets = [shingles(t, n) for t in b.column(1).to_pylist()]
            signs = [hashlib.blake2b(u.tobytes(), digest_size=16).digest() for u in sets]
            sketches = pa.array([bit_sketch(u).tobytes() for u in sets], pa.binary())
            yield pa.record_batch([b.column(0), pa.array([len(u) for u in sets], pa.int64()), pa.array(signs, pa.binary()), sketches], names=["id", "n", "sign", "sketch"])

    return run


def folded(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each key, of 1 << bits, and 32 further bits of it."""
    x = mix(keys + _U(77))
    return (x >> _U(64 - bits)).astype(np.int32) if bits else np.zeros(len(x), np.int32), x.astype(np.uint32)


#: Keys that a task gathers before it hands them on.
GATHERED = 1 << 19


def packed(chunks, bits: int):
    """Rows (bucket, keys) of the arrays of keys, or pairs of arrays of keys and their owners: all keys of a bucket as one
    run of numbers, of 32 bits for the key and 32 more for its owner."""

    def flush(held):
        bucket, low = folded(np.concatenate([h[0] for h in held]), bits)
        if held[0][1] is not None:
            low = low.astype(_U) | (mix(np.concatenate([h[1] for h in held])) << _U(32))
        order = np.argsort(bucket, kind="stable")
        bucket, low = bucket[order], low[order]
        at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
        offsets = pa.array(np.append(at, len(low)) * low.itemsize, pa.int32())
        keys = pa.Array.from_buffers(pa.binary(), len(at), [None, offsets.buffers()[1], pa.py_buffer(low.tobytes())])
        return pa.record_batch([pa.array(bucket[at]), keys], names=["bucket", "keys"])

    held, size = [], 0
    for keys in chunks:
        held.append(keys if isinstance(keys, tuple) else (keys, None))
        size += len(held[-1][0])
        if size > GATHERED:
            yield flush(held)
            held, size = [], 0
    if size:
        yield flush(held)


def _counted(n: int, percent: int, bits: int):
    """The tokens of each set, once for copies within the task."""

    def chunks(batches):
        seen: set[bytes] = set()
        for b in slices(batches):
            for text in b.column(1).to_pylist():
                u = shingles(text, n)
                sign = hashlib.blake2b(u.tobytes(), digest_size=16).digest()
                if sign in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen = set()
                seen.add(sign)
                yield from (t[0] for t in tokens(u, percent))

    return lambda batches: packed(chunks(batches), bits)


def _repeated(owned: bool):
    """The keys of each bucket that occur again (with another owner), and how often, up to FREQUENT + 1. The rows of a
    bucket follow each other."""

    def trimmed(held):
        """Of each key FREQUENT + 1 occurrences at most, which is all that matters, so a key of many rows takes no more room."""
        keys = np.concatenate(held)
        keys = np.unique(keys) if owned else np.sort(keys)
        if owned:
            keys = keys[np.argsort(keys.astype(np.uint32), kind="stable")]
        low = keys.astype(np.uint32)
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        return keys[np.arange(len(low)) - np.repeat(first, np.diff(np.append(first, len(low)))) <= FREQUENT]

    def counts(now, held):
        low, c = np.unique(trimmed(held).astype(np.uint32), return_counts=True)
        return [np.full((c > 1).sum(), now, np.int32), low[c > 1].view(np.int32), c[c > 1].astype(np.int32)]

    def batch(found):
        return pa.record_batch([pa.array(np.concatenate([f[k] for f in found])) for k in range(3)], names=["bucket", "low", "c"])

    def run(batches):
        now, held, found, size, new = None, [], [], 0, 0
        for b in slices(batches):
            for bucket, keys in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if bucket != now:
                    if held:
                        found.append(counts(now, held))
                        size += len(found[-1][0])
                        if size > 100_000:
                            yield batch(found)
                            found, size = [], 0
                    now, held, new = bucket, [], 0
                held.append(np.frombuffer(keys, _U if owned else np.uint32))
                new += len(held[-1])
                if new > GATHERED:
                    held, new = [trimmed(held)], 0
        if held:
            found.append(counts(now, held))
        if found:
            yield batch(found)

    return run


def bucket_bits(keys: int) -> int:
    """Buckets for so many keys: about 100,000 in each, so that 32 bits tell them apart at any size."""
    return min(30, max(8, (keys >> 17).bit_length()))


def repeated(packs: DataFrame, owned: bool = False) -> DataFrame:
    """bucket, low, c of the keys in packed rows (bucket, keys) that occur more than once, or that have several owners."""
    return packs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_repeated(owned), "bucket int, low int, c int")


#: The most bits of a Bloom filter, 32 MB. Beyond ten for a key it lets more through.
BLOOM_BITS = 1 << 28


#: The fewest bits of a block of a Bloom filter, as a power of two.
BLOCK_BITS = 10


def _places(bucket: np.ndarray, low: np.ndarray, size: int, bits: int) -> list[np.ndarray]:
    """Three places of each key, all in its bucket's block: tasks that hold different buckets fill different words."""
    block = max(BLOCK_BITS, size.bit_length() - 1 - bits)
    start = (bucket.astype(_U) >> _U(max(0, bits + block + 1 - size.bit_length()))) << _U(block)
    x = mix((bucket.astype(_U) << _U(32)) | low.astype(_U))
    y = mix(x)
    return [start + (((v & _U(0xFFFFFFFF)) << _U(block)) >> _U(32)) for v in (x, x >> _U(32), y >> _U(32))]


def _words(size: int, bits: int):
    def run(batches):
        for b in batches:
            at = np.concatenate(_places(b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint32), size, bits))
            word, inverse = np.unique(at >> _U(6), return_inverse=True)
            cells = np.zeros(len(word), _U)
            np.bitwise_or.at(cells, inverse, _U(1) << (at & _U(63)))
            yield pa.record_batch([pa.array(word.astype(np.int32)), pa.array(cells.view(np.int64))], names=["word", "bits"])

    return run


def bloom(keys: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of keys (bucket, low), with the bits of a bucket as its first number."""
    size = 1 << min(BLOOM_BITS.bit_length() - 1, max(16, (10 * keys.count()).bit_length()))
    cells = keys.select("bucket", "low").mapInArrow(_words(size, bits), "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 + (size >> 6), np.int64)
    table[0] = bits
    table[1 + cells.column("word").to_numpy()] = cells.column("bits").to_numpy()
    return table.view(_U)


def holds(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys the Bloom filter may hold."""
    left = np.arange(len(keys))
    bucket, low = folded(keys, int(table[0]))
    for at in _places(bucket, low, (len(table) - 1) << 6, int(table[0])):
        at = at[left]
        left = left[((table[1 + (at >> _U(6)).astype(np.int64)] >> (at & _U(63))) & _U(1)).astype(bool)]
    found = np.zeros(len(keys), bool)
    found[left] = True
    return found


def _passing(n: int, percent: int, shared):
    def run(batches):
        again, frequent = shared.value
        for b in slices(batches, 64):
            keys, place = sketch_keys([shingles(t, n) for t in b.column(1).to_pylist()], percent, frequent)
            hit = holds(again, keys)
            yield pa.record_batch([pa.array(b.column(0).to_numpy()[place[hit]]), pa.array(keys[hit].view(np.int64))], names=["id", "key"])

    return run


#: A token of more sets than this is a frequent one; sets leave such tokens out first.
FREQUENT = 8


def _prefix(own: np.ndarray, centre: np.ndarray, linked: bool, percent: int) -> list:
    """The size of a set's difference from its centre, how many of its first elements count, and these elements.

    All that the centre lacks is there, as it is put into another order later, see _meeting().

    What the centre lacks comes first, the rarer part. Let x and y be the differences' sizes of two linked sets A and B
    of which not both are linked with the centre C, d the size of their own difference and o what their differences
    share: o = (x + y - d) / 2. With c = (100 - percent) / (100 + percent), d <= c (|A| + |B|), and y > c (|B| + |C|) if B
    is not linked with C. So o > (x + c (|C| - |A|)) / 2 for a linked A, o >= x - |A| (100 - percent) / (2 percent) if x <= y,
    and o >= y - |B| (100 - percent) / percent. Two sets that share o elements share one of the first x - o + 1 of A
    and y - o + 1 of B. If the first shared element is one that the centre has, the sets share none that it lacks, and
    then d is at least the sum of the numbers of those and the difference of the numbers of the others. A linked set needs the first bound only, against partners that aren't; others the second one
    for the set of the smaller x and the third one for its partner. `short` elements hold for the first two.
    """
    more, less = np.setdiff1d(own, centre, assume_unique=True), np.setdiff1d(centre, own, assume_unique=True)
    x, a, c = len(more) + len(less), len(own), len(centre)
    if linked:
        least = (x * (100 + percent) + (100 - percent) * (c - a)) // (2 * (100 + percent)) + 1
    else:
        least = x - a * (100 - percent) // (2 * percent)
    short = x - max(1, least) + 1
    long = short if linked else x - max(1, x - a * (100 - percent) // percent) + 1
    bits = np.packbits((np.bincount(((own >> _U(7)) & _U(64 * FOLDED - 1)).astype(np.int64), minlength=64 * FOLDED) & 1).astype(np.uint8))
    return [x, len(more), short, long, np.concatenate([more, less[: max(0, long - len(more))]]).view(np.int64).tolist(), bits.view(np.int64).tolist()]


def _compare(n: int, percent: int, differences: bool):
    names = ["a", "b", "na", "nb", "linked", *["x", "more", "short", "long", "prefix", "bits"] * differences]

    def run(batches):
        now, other = None, None
        for b in slices(batches):
            out = [[] for _ in names]
            for doc, anchor, salt, kind, text in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                own = shingles(text, n)
                if not kind:
                    now, other = (anchor, salt), own
                    continue
                assert now == (anchor, salt)
                both = np.concatenate([own, other])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                linked = 100 * common >= percent * (len(both) - common) and common > 0
                row = [doc, anchor, len(own), len(other), linked]
                if differences:
                    row += _prefix(own, other, linked, percent)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds, strict=False)], names=names)

    return run


def _beside(held: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of `held` (id, ...) that the pairs (a, b) need: partitions sorted by b, salt and kind, b's own row first.

    A row goes to its partners' task once for RUN of them, so a partner of many is dealt to many tasks.
    """
    runs = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / RUN).cast("int").alias("runs"))
    runs = scratch.keep(runs)
    pieces = pairs.join(runs, "b").select(F.col("a").alias("id"), "b", F.pmod(F.xxhash64("a"), "runs").cast("int").alias("salt"), F.lit(1).alias("kind"))
    anchors = runs.select(F.col("b").alias("id"), "b", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("salt"), F.lit(0).alias("kind"))
    asked = scratch.keep(pieces.unionByName(anchors))
    found = held.join(sent(asked), "id").select("id", "b", "salt", "kind", *(c for c in held.columns if c != "id"))
    return found.repartition("b", "salt").sortWithinPartitions("b", "salt", "kind")


def compare(texts: DataFrame, pairs: DataFrame, scratch: Scratch, n: int, percent: int, differences: bool = False) -> DataFrame:
    """Verifies each pair (a, b): a, b, na, nb, linked and, if asked for, what _prefix() says of their difference."""
    kind = "a long, b long, na long, nb long, linked boolean" + ", x long, more long, short long, long long, prefix array<long>, bits array<long>" * differences
    return _beside(texts, pairs, scratch).mapInArrow(_compare(n, percent, differences), kind)


def _near(percent: int):
    def run(batches):
        now, other = None, None
        for b in slices(batches):
            out = [[], []]
            for doc, anchor, salt, kind, size, sketch in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                own = (size, np.frombuffer(sketch, np.uint8))
                if not kind:
                    now, other = (anchor, salt), own
                    continue
                assert now == (anchor, salt)
                if distance(own[1], other[1]) <= largest_difference(size + other[0], percent):
                    out[0].append(doc)
                    out[1].append(anchor)
            yield pa.record_batch([pa.array(c, pa.int64()) for c in out], names=["a", "b"])

    return run


def linked(texts: DataFrame, sketches: DataFrame | None, pairs: DataFrame, scratch: Scratch, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link. Sketches (id, n, sketch), where there are any, spare texts that are too far apart."""
    if sketches is not None:
        pairs = scratch.keep(_beside(sketches, pairs, scratch).mapInArrow(_near(percent), "a long, b long"))
    return scratch.keep(compare(texts, pairs, scratch, n, percent).where("linked").select("a", "b"))


def _across(open_rows: DataFrame) -> DataFrame:
    """Pairs of different components within small buckets, each one as often as it is in them."""
    a, b = (open_rows.select("key", F.col("id").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    return a.join(b, "key").where("a < b and ca <> cb").select("a", "b")


def _elements(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys of the elements of a batch's differences (b, prefix) with their centres, their rows and their places."""
    prefix = b.column(b.schema.get_field_index("prefix"))
    sizes = np.diff(prefix.offsets.to_numpy())
    row = np.repeat(np.arange(len(sizes)), sizes)
    centre = b.column(b.schema.get_field_index("b")).to_numpy().view(_U)
    return mix(prefix.flatten().to_numpy().view(_U) ^ mix(centre)[row]), row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _meeting(shared):
    """Puts what a centre lacks into the order that all sets around it share, the elements of one set alone first and
    frequent ones last, and cuts the list off. `meet` are the places of elements that another set may have as well."""

    def run(batches):
        several, frequent = shared.value
        for b in slices(batches):
            at = b.schema.get_field_index
            keys, row, place = _elements(b)
            hit = holds(several, keys)
            late = hit.astype(np.int8)
            late[hit] += holds(frequent, keys[hit])
            more, long = (b.column(at(c)).to_numpy() for c in ("more", "long"))
            late[place >= more[row]] = 3  # what the centre has stays behind
            behind = np.where(late == 3, place.astype(_U), keys)
            order = np.lexsort((behind, late, row))
            keep = place < long[row]
            order = order[keep]
            values, hit, row, place = b.column(at("prefix")).flatten().to_numpy()[order], hit[order], row[keep], place[keep]
            ends = lambda rows_: pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows_, minlength=b.num_rows))]), pa.int32())
            prefix = pa.ListArray.from_arrays(ends(row), pa.array(values))
            meet = pa.ListArray.from_arrays(ends(row[hit]), pa.array(place[hit], pa.int32()))
            columns = [prefix if n == "prefix" else c for n, c in zip(b.schema.names, b.columns, strict=True)]
            yield pa.record_batch([*columns, meet], names=[*b.schema.names, "meet"])

    return run


def _useful(shared):
    """Leaves of `prefix` and `meet` the elements that a Bloom filter holds: meet are their places, prefix is what stands there."""

    def run(batches):
        for b in slices(batches):
            keys, row, place = _elements(b)
            hit = holds(shared.value, keys)
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[hit], minlength=b.num_rows))]), pa.int32())
            values = b.column(b.schema.get_field_index("prefix")).flatten().to_numpy()[hit]
            left = {"prefix": pa.ListArray.from_arrays(ends, pa.array(values)), "meet": pa.ListArray.from_arrays(ends, pa.array(place[hit], pa.int32()))}
            yield pa.record_batch([left.get(n, c) for n, c in zip(b.schema.names, b.columns, strict=True)], names=b.schema.names)

    return run


def _meets(found: DataFrame) -> DataFrame:
    """b, e of the elements at which sets of different components meet, one of them among its first `short` elements and
    the other one not linked with the centre."""
    at = found.select("b", "component", "linked", "short", "prefix", F.explode("meet").alias("r")).withColumn("e", F.get("prefix", F.col("r")))
    asks, asked = (F.when(c, F.col("component")) for c in (F.col("r") < F.col("short"), ~F.col("linked")))
    sides = at.groupBy("b", "e").agg(F.min(asks).alias("lo"), F.max(asks).alias("hi"), F.min(asked).alias("lo_"), F.max(asked).alias("hi_"))
    return sides.where("lo is not null and lo_ is not null and least(lo, lo_) <> greatest(hi, hi_)").select("b", "e")


def _folded_elements(bits: int):
    """The bucket and the further bits of elements (b, e)."""

    def run(batches):
        for b in batches:
            bucket, low = folded(mix(b.column(1).to_numpy().view(_U) ^ mix(b.column(0).to_numpy().view(_U))), bits)
            yield pa.record_batch([pa.array(bucket), pa.array(low.view(np.int32))], names=["bucket", "low"])

    return run


def _around(texts: DataFrame, large: DataFrame, scratch: Scratch, n: int, percent: int) -> DataFrame:
    """Pairs of different components within large buckets, some of them twice, from the differences to centres that all buckets of a set share.

    Near copies of one text meet in many buckets. Around the centre of each of them a set would be written, and a pair
    found, once for each bucket, and buckets grow into large ones as the copies do. A pair of which both link with the
    centre isn't looked for, so each set's link with it is among the pairs, as no bucket need hold these two.
    """
    around = scratch.keep(components(large.select(F.col("id").alias("a"), F.col("centre").alias("b")), scratch).withColumnRenamed("component", "b"))
    members = large.select("id", "component").distinct().join(around, "id").where("id <> b").withColumnRenamed("id", "a")
    members = scratch.keep(members)
    found = compare(texts, members.select("a", "b"), scratch, n, percent, True)
    found = scratch.keep(found.join(members, ["a", "b"]))
    centred = found.where("linked").select(F.col("b").alias("a"), F.col("a").alias("b"))
    # most elements are those of one component alone: they are counted first, and only the others are dealt out
    bits, spark = bucket_bits(found.agg(F.sum(F.size("prefix"))).head()[0] or 0), texts.sparkSession

    def owned(batches):
        for b in slices(batches):
            keys, row, _ = _elements(b)
            yield keys, b.column(b.schema.get_field_index("component")).to_numpy().view(_U)[row]

    again = scratch.keep(repeated(found.select("b", "component", "prefix").mapInArrow(lambda batches: packed(owned(batches), bits), "bucket int, keys binary"), True))
    shared = spark.sparkContext.broadcast((bloom(again, bits), bloom(again.where(F.col("c") > FREQUENT), bits)))
    kinds = "a long, b long, na long, component long, linked boolean, x long, more long, short long, long long, bits array<long>, prefix array<long>, meet array<int>"
    found = found.select("a", "b", "na", "component", "linked", "x", "more", "short", "long", "bits", "prefix").mapInArrow(_meeting(shared), kinds)
    found = scratch.keep(found.where("size(meet) > 0"))
    shared.destroy()
    # an element is dealt out if two sets still have it, with those before it at which sets meet, not with the whole prefix
    meets = scratch.keep(_meets(found).mapInArrow(_folded_elements(bits), "bucket int, low int"))
    shared = spark.sparkContext.broadcast(bloom(meets, bits))
    found = scratch.keep(found.mapInArrow(_useful(shared), kinds).where("size(meet) > 0"))
    shared.destroy()
    each = found.select("*", F.posexplode("meet").alias("k", "r")).withColumn("e", F.get("prefix", F.col("k"))).withColumn("before", F.slice("prefix", F.lit(1), F.col("k")))
    first = each.where("r < short").select("b", "e", *(F.col(c).alias(f"{c}_") for c in ("a", "na", "component", "linked", "x", "more", "bits", "before")))
    each = each.where("not linked").select("b", "e", "r", "a", "na", "component", "x", "more", "bits", "before")
    least = F.abs(F.col("x") - F.col("x_"))
    held = F.col("more") + F.col("more_") + F.abs(F.col("x") - F.col("more") - F.col("x_") + F.col("more_"))
    least = F.when(F.col("r") < F.col("more"), least).otherwise(F.greatest(least, held))
    apart = sum((F.bit_count(F.get("bits", F.lit(k)).bitwiseXOR(F.get("bits_", F.lit(k)))) for k in range(FOLDED)), F.lit(0))
    near = F.greatest(least, apart) * (100 + percent) <= (F.col("na") + F.col("na_")) * (100 - percent)
    once = ~F.arrays_overlap("before_", "before")  # a pair meets at the first element that it shares
    pairs = first.join(each, ["b", "e"]).where((F.col("linked_") | (F.col("x") >= F.col("x_"))) & (F.col("component") != F.col("component_")) & near & once)
    return pairs.select(F.least("a", "a_").alias("a"), F.greatest("a", "a_").alias("b")).union(centred)


def buckets_of(keys: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds to (id, key) the bucket's number of members and its centre, the smallest id, where there are several."""
    several = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("centre")).where("members > 1")
    return scratch.keep(keys.join(scratch.keep(several), "key"))


def _further(buckets: DataFrame, star: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of what doesn't link with a large bucket's centre and further centres b, which spare pairs later on.

    They are the first sets in each of ROUNDS orders, so that those of a large group of near copies come up whatever
    their ids, and all are looked at together. What they leave open comes up again at the end.
    """
    rest = buckets.where(F.col("members") > SMALL).where("id <> centre").select("key", "id", "centre")
    done = sent(links.select(F.col("a").alias("id"), F.col("b").alias("centre")))
    left = scratch.keep(rest.join(done, ["id", "centre"], "left_anti").select("key", "id"))
    names = [f"c{k}" for k in range(ROUNDS)]
    orders = [F.min(F.struct(F.xxhash64("id", F.lit(k)), "id")).alias(c) for k, c in enumerate(names)]
    centres = left.groupBy("key").agg(*orders, F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    # for each order one comparison for each set, however many buckets hold it
    chosen = left.join(scratch.keep(centres), "key").groupBy(F.col("id").alias("a")).agg(*(F.min(c).alias(c) for c in names))
    chosen = chosen.select("a", F.explode(F.array_distinct(F.array(*(f"{c}.id" for c in names)))).alias("b")).where("a <> b")
    return scratch.keep(chosen.join(sent(star), ["a", "b"], "left_anti"))


def resolve(texts: DataFrame, sketches: DataFrame | None, buckets: DataFrame, scratch: Scratch, n: int, percent: int) -> DataFrame:
    """id, component of the sets that link with another one of the same bucket (key, id, members, centre)."""
    star = scratch.keep(buckets.where("id <> centre").select(F.col("id").alias("a"), F.col("centre").alias("b")).distinct())
    links = linked(texts, sketches, star, scratch, n, percent)
    if ROUNDS:
        more = _further(buckets, star, links, scratch)
        if not more.isEmpty():
            star, links = star.union(more), links.union(linked(texts, sketches, more, scratch, n, percent))
    first = scratch.keep(components(links, scratch))
    # a pair that is alone in its bucket has been verified
    placed = buckets.where("members > 2").join(sent(first), "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = scratch.keep(placed)
    several = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    still = scratch.keep(placed.join(several, "key"))
    pairs = _across(still.where(F.col("members") <= SMALL)).union(_around(texts, still.where(F.col("members") > SMALL), scratch, n, percent)).distinct()
    looked_at = sent(star.union(star.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    pairs = scratch.keep(pairs.join(looked_at, ["a", "b"], "left_anti"))
    more = linked(texts, sketches, pairs, scratch, n, percent)
    return components(links.union(more), scratch)


@every_row("doc_id", "class_id", "component_id")
def linked_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id of each document.

    Words are runs of other characters than [\\x20\\x09-\\x0D] with A-Z in lower case; a document's set are its
    distinct n-word shingles, or all its words as one if there are fewer. Two documents link when 100 * intersection
    >= percent * union. class_id is the smallest id with the same set and component_id the smallest id that links
    reach. A null, empty or blank text has no shingles and links with nothing. A null id counts as the smallest.
    """
    if not 50 < percent < 100:
        raise ValueError("percent has to be over 50 and below 100")
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    texts = rows(docs, id_col, text_col)
    # copies: one class for each set
    signs = scratch.keep(texts.mapInArrow(_signs(n), "id long, n long, sign binary, sketch binary"))
    some = signs.where("n > 0")
    classes = scratch.keep(some.groupBy("n", "sign").agg(F.min("id").alias("class")))
    member = scratch.keep(some.drop("sketch").join(classes, ["n", "sign"]).select("id", "n", "class"))
    # buckets: tokens are counted first, and only those that occur again are dealt out with their ids
    bits = bucket_bits(signs.agg(F.sum("n")).head()[0] or 0)
    again = scratch.keep(repeated(texts.mapInArrow(_counted(n, percent, bits), "bucket int, keys binary")))
    shared = spark.sparkContext.broadcast((bloom(again, bits), bloom(again.where(F.col("c") > FREQUENT), bits)))
    scratch.drop(again)
    keys = texts.mapInArrow(_passing(n, percent, shared), "id long, key long")
    # copies are few or many, but never more than the sets: their ids may be few enough to send
    copies = scratch.keep(member.where("id <> class").select("id"))
    keys = scratch.keep(keys.join(sent(copies), "id", "left_anti"))
    shared.destroy()
    buckets = buckets_of(keys, scratch)
    found = scratch.keep(resolve(texts, signs.select("id", "n", "sketch"), buckets, scratch, n, percent).withColumnRenamed("id", "class"))
    scratch.end(signs, member, found)
    whole = member.join(found, "class", "left").select("id", "n", "class", F.coalesce("component", "class").alias("component"))
    none = signs.where("n = 0").select("id", "n", F.col("id").alias("class"), F.col("id").alias("component"))
    return whole.unionByName(none).select(id_back("id", "doc_id"), F.col("n").alias("n_shingles"), id_back("class", "class_id"), id_back("component", "component_id"))
