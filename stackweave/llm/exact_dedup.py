"""Exact deduplication by deterministic block naming.

A text is cut into blocks of a fixed number of bytes. Equal blocks get one integer name: the blocks are dealt to
buckets, sorted within each bucket, and numbered in that order. Names of neighbours are then paired and the pairs
named in the same way, level by level, until one name is left of each document. Two documents with as many blocks
have the same last name if and only if their texts are equal: no digest decides.

Hashes of blocks are counted first. A block whose hash no other block has is equal to none, so its hash is its name and
it stays where it is; only blocks whose hash occurs again are dealt out. Which these are is a function of the hash (a
Bloom filter), so equal blocks are named in the same way, and a filter that lets more through changes no result.

A block that is found again in the same task is replaced by a reference to its first place, so that a block with a
third of all rows reaches its bucket once for each task. Names go back to their places over those references, whose
keys are as evenly spread as the documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, every_row, id_back, rows, slices
from .ngram_join import bloom, bucket_bits, holds, packed, repeated

WHITE = b" \t\n\x0b\x0c\r"
#: Bytes of distinct blocks that a task remembers at once.
REMEMBERED = 16 << 20
PLACES = "id long, n_points long, sha string, n_blocks int, pos int, rep_id long, rep_pos int, block binary, name long"
_ARROW = pa.schema([("id", pa.int64()), ("n_points", pa.int64()), ("sha", pa.string()), ("n_blocks", pa.int32()), ("pos", pa.int32()), ("rep_id", pa.int64()), ("rep_pos", pa.int32()), ("block", pa.binary()), ("name", pa.int64())])


def blocks_of(norm: bytes, block_bytes: int) -> list[bytes]:
    return [norm[i : i + block_bytes] for i in range(0, len(norm), block_bytes)] or [b""]


def hashes(blocks: list[bytes]) -> np.ndarray:
    """A hash of 62 bits of each block."""
    return np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=8).digest() for x in blocks), np.uint64) >> np.uint64(2)


def _counted(block_bytes: int, bits: int):
    """The hash of each block, once for equal blocks that the task still remembers."""

    def chunks(batches):
        seen: set[bytes] = set()
        held = 0
        for batch in slices(batches):
            for text in batch.column(1).to_pylist():
                new = []
                for block in blocks_of(text.encode().translate(None, WHITE), block_bytes):
                    if block in seen:
                        continue
                    if held > REMEMBERED:
                        seen, held = set(), 0
                    seen.add(block)
                    held += len(block) + 100
                    new.append(block)
                yield hashes(new)

    return lambda batches: packed(chunks(batches), bits)


def _cut(block_bytes: int, shared):
    def run(batches):
        again = shared.value
        first: dict[bytes, tuple[int, int]] = {}
        held = 0
        for batch in slices(batches):
            out: list[list] = [[] for _ in _ARROW]
            size = 0
            texts = batch.column(1).to_pylist()
            norms = [text.encode().translate(None, WHITE) for text in texts]
            cut = [blocks_of(norm, block_bytes) for norm in norms]
            found = hashes([block for blocks in cut for block in blocks])
            numbers = zip(found.tolist(), holds(again, found).tolist(), strict=True)
            for doc, text, norm, blocks in zip(batch.column(0).to_pylist(), texts, norms, cut, strict=True):
                for pos, block in enumerate(blocks):
                    number, several = next(numbers)
                    rep, sent, name = (None, None), None, -2 - number  # names of other blocks aren't negative, and -1 is no block
                    if several:
                        rep, name = first.get(block), None
                        if rep is None:
                            if held > REMEMBERED:
                                first, held = {}, 0
                            first[block] = rep = (doc, pos)
                            held += len(block) + 100
                            size += len(block)
                            sent = block
                    sha = hashlib.sha256(norm).hexdigest() if not pos else None
                    for column, value in zip(out, (doc, len(text), sha, len(blocks), pos, *rep, sent, name), strict=True):
                        column.append(value)
                if size > 8 << 20:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, _ARROW, strict=True)], schema=_ARROW)
                    out, size = [[] for _ in _ARROW], 0
            if out[0]:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, _ARROW, strict=True)], schema=_ARROW)

    return run


def sorted_names(df: DataFrame, by: list[str], buckets: int) -> DataFrame:
    """Adds `name`: equal values of `by` get one integer, different values different ones."""
    bucket = F.pmod(F.xxhash64(*by), F.lit(buckets))
    rank = F.dense_rank().over(Window.partitionBy("bucket").orderBy(*by))
    return df.withColumn("bucket", bucket).withColumn("name", F.col("bucket") * F.lit(1 << 32) + rank).drop("bucket")


def identities(docs: DataFrame, scratch: Scratch, block_bytes: int = 2048, buckets: int = 1 << 16) -> DataFrame:
    """id, n_points, sha, n_blocks, name: (n_blocks, name) is the same for equal normalised texts only."""
    most = docs.agg(F.sum(F.octet_length("text") / block_bytes + 1).cast("long")).head()[0] or 0
    bits = bucket_bits(most)
    again = scratch.keep(repeated(docs.mapInArrow(_counted(block_bytes, bits), "bucket int, keys binary")))
    shared = docs.sparkSession.sparkContext.broadcast(bloom(again, bits))
    scratch.drop(again)
    places = scratch.keep(docs.mapInArrow(_cut(block_bytes, shared), PLACES))
    shared.destroy()
    named = sorted_names(places.where("block is not null").select("rep_id", "rep_pos", "block"), ["block"], buckets).drop("block")
    alone = places.where("name is not null").select("id", "n_points", "sha", "n_blocks", "pos", "name")
    several = places.where("name is null").drop("block", "name").join(named, ["rep_id", "rep_pos"])
    level = scratch.keep(alone.unionByName(several.select("id", "n_points", "sha", "n_blocks", "pos", "name")))
    scratch.drop(places)
    heads = level.where("pos = 0").select("id", "n_points", "sha", "n_blocks")
    done = level.where("n_blocks = 1").select("id", "name")
    left = level.where("n_blocks > 1").select("id", F.col("n_blocks").alias("n"), "pos", "name")
    longest = left.agg(F.max("n")).head()[0] or 1
    while longest > 1:
        half = F.floor(F.col("pos") / 2).cast("int")
        pairs = left.groupBy("id", F.ceil(F.col("n") / 2).cast("int").alias("n"), half.alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
        )
        # a name is needed twice, for its pairs and for its documents: each level is written
        pairs = scratch.keep(pairs)
        names = sorted_names(pairs.select("a", "b").distinct(), ["a", "b"], buckets)
        left = scratch.keep(pairs.join(names, ["a", "b"]).select("id", "n", "pos", "name"))
        scratch.drop(pairs)
        done = done.unionByName(left.where("n = 1").select("id", "name"))
        left = left.where("n > 1")
        longest = (longest + 1) // 2
    return heads.join(done, "id")


@every_row("doc_id", "keep_id")
def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 2048, buckets: int = 1 << 16, scratch: Scratch | None = None) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256, n_blocks.

    Texts are equal when they are identical without the characters of [\\x20\\x09-\\x0D]. Of equal texts the row with
    the most code points in the original text stays, then the smallest id. A null text counts as empty; empty texts
    are equal to each other.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    named = scratch.keep(identities(rows(docs, id_col, text_col), scratch, block_bytes, buckets))
    best = named.groupBy("n_blocks", "name").agg(F.max(F.struct("n_points", F.bitwise_not("id").alias("r"))).alias("best"), F.count(F.lit(1)).alias("group_size"))
    # written, so that the join deals out both sides anew and a large group can be split
    best = scratch.keep(best.select("n_blocks", "name", F.bitwise_not(F.col("best.r")).alias("keep"), "group_size"))
    scratch.end(named, best)
    return named.join(best, ["n_blocks", "name"]).select(
        id_back("id", "doc_id"), id_back("keep", "keep_id"), "group_size", (F.col("id") == F.col("keep")).alias("kept"), F.col("sha").alias("text_sha256"), F.col("n_blocks").cast("long").alias("n_blocks")
    )
