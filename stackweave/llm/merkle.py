"""A Merkle manifest of a table: a root over all rows, and for each row the witness that leads from it to the root.

Trees have arity 8. Leaves of a key are appended in order; while several nodes are left, every 8 consecutive ones
(the last run may be shorter, even one) become their hash. The keys' roots, in order of the keys, are hashed alike.

Incremental witnesses: a `Frontier` takes nodes one by one. Each level has one open run, and each node of it carries
the leaves below it, whose witnesses reach up to that node. When a run is complete its nodes are siblings: the witnesses
of every node's leaves are extended by the other nodes, and the run's hash is appended to the level above.

Distribution: a key's leaves are cut into aligned blocks of 8**4, which are whole subtrees. A task appends one block, and the
blocks' roots are the leaves of the next round, appended in blocks again, up to one root for each key. Witnesses come
back down the same way: those of a round's blocks are what the round below ends its own with. So no task holds more than
8**4 nodes and their witnesses, and a key with a third of all rows is as many tasks as it has blocks. Texts are hashed where
they are read; only digests are shuffled.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, numbered, ship

ARITY, LEVELS = 8, 4
BLOCK = ARITY**LEVELS


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Frontier:
    """The open runs of a tree that grows at its end, and the witnesses of its leaves so far.

    A witness is a list of (before, after) from the leaf upwards: the siblings to the left and right, joined.
    """

    def __init__(self):
        self.open: list[list[tuple[str, int, int]]] = [[]]  # for each level: hash, first leaf, leaf behind the last
        self.witness: list[list[tuple[str, str]]] = []

    def append(self, leaf: str) -> None:
        at = len(self.witness)
        self.witness.append([])
        self._add(0, (leaf, at, at + 1))

    def _add(self, level: int, node: tuple[str, int, int]) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append(node)
        if len(self.open[level]) == ARITY:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        hashes = [h for h, _, _ in run]
        for k, (_, a, b) in enumerate(run):
            siblings = ("".join(hashes[:k]), "".join(hashes[k + 1 :]))
            for leaf in range(a, b):
                self.witness[leaf].append(siblings)
        self._add(level + 1, (digest("".join(hashes)), run[0][1], run[-1][2]))

    def close(self, levels: int) -> str:
        """Completes the open runs of so many levels, from below, and returns the only node above them."""
        for level in range(levels):
            if self.open[level]:
                self._complete(level)
        [(root, _, _)] = self.open[levels]
        return root


def packed(witness: list[tuple[str, str]]) -> str:
    return ";".join(f"{a},{b}" for a, b in witness)


def unpacked(witness: str) -> list[tuple[str, str]]:
    return [tuple(level.split(",")) for level in witness.split(";")] if witness else []


def fold(leaf: str, witness: list[tuple[str, str]]) -> str:
    """The root that a leaf and its witness lead to."""
    for before, after in witness:
        leaf = digest(before + leaf + after)
    return leaf


def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaves(docs: DataFrame, key_col: str = "lang", id_col: str = "doc_id", fields: tuple[str, ...] = FIELDS, tampered: dict[str, Column] | None = None) -> DataFrame:
    """id, key, leaf, other: the hash of each row's fields, and that of the row with `tampered` columns in their place.

    A field is `-` if it is null, else its count of UTF-8 bytes, a colon and its value. key is the empty string for null
    and = with the value otherwise, so that nulls come first and all other keys in the order of their bytes.
    """
    def row(changed: dict[str, Column]) -> Column:
        return F.sha2(F.concat(*(_field(changed.get(f, F.col(f"`{f}`"))) for f in fields)).cast("binary"), 256)

    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{key_col}`").cast("string")), F.lit(""))
    leaf = row({})
    return docs.select(F.col(f"`{id_col}`").alias("id"), key.alias("key"), leaf.alias("leaf"), (row(tampered) if tampered else leaf).alias("other"))


def _levels(size: int) -> int:
    """The levels of a block of a key with so many leaves: up to the only node, or of a whole block."""
    return LEVELS if size > BLOCK else next(h for h in range(LEVELS + 1) if ARITY**h >= size)


def _block(table: pa.Table) -> tuple[pa.Table, Frontier, str, int]:
    table = table.sort_by("place")
    size, own = table.column("size")[0].as_py(), Frontier()
    for leaf in table.column("leaf").to_pylist():
        own.append(leaf)
    return table, own, own.close(_levels(size)), size


def _tops(table: pa.Table) -> pa.Table:
    table, _, root, size = _block(table)
    place = table.column("place")[0].as_py() // BLOCK
    return pa.table({"key": [table.column("key")[0].as_py()], "place": pa.array([place], pa.int64()), "size": pa.array([-(-size // BLOCK)], pa.int64()), "leaf": [root]})


_TOP = "key string, place long, size long, leaf string"


def _block_of() -> Column:
    return F.floor(F.col("place") / BLOCK).alias("block")


def rounds(items: DataFrame, scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """The items of each round, and key and leaf of the keys' roots. items: key, place, size, leaf."""
    below, roots = [items], None
    while True:
        tops = scratch.keep(below[-1].select("key", "place", "size", "leaf").groupBy("key", _block_of()).applyInArrow(_tops, _TOP))
        done = tops.where("size = 1").select("key", "leaf")
        roots = done if roots is None else roots.unionByName(done)
        more = tops.where("size > 1")
        if more.isEmpty():
            return below, roots
        below.append(more)


def _extended(own: pa.Table, above: pa.Table) -> Iterator[tuple[dict, list[tuple[str, str]], str]]:
    """The rows of a block with their whole witnesses, and what their block carries down."""
    table, frontier, _, _ = _block(own)
    up = above.to_pylist()[0]
    rest = unpacked(up["path"])
    for row, witness in zip(table.to_pylist(), frontier.witness, strict=True):
        yield row, witness + rest, up["root"]


def _passed(own: pa.Table, above: pa.Table) -> pa.Table:
    rows = [(r["key"], r["place"], packed(w), root) for r, w, root in _extended(own, above)] if len(own) else []
    return pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 4, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["key", "place", "path", "root"])


def descend(below: list[DataFrame], tops: DataFrame, scratch: Scratch) -> DataFrame:
    """key, place, path, root of the blocks of the first round, from tops: key, path and root of each key's root."""
    above = None
    for items in below[:0:-1]:
        ended = tops.join(items.select("key").where(F.col("size") <= BLOCK).distinct(), "key", "left_semi").select("key", F.lit(0).cast("long").alias("place"), "path", "root")
        above = ended if above is None else above.unionByName(ended)
        above = scratch.keep(_meet(items.select("key", "place", "size", "leaf"), above, _passed, "key string, place long, path string, root string"))
    single = below[0].where(F.col("size") <= BLOCK).select("key").distinct()
    ended = tops.join(single, "key", "left_semi").select("key", F.lit(0).cast("long").alias("place"), "path", "root")
    return ended if above is None else above.unionByName(ended)


def _meet(items: DataFrame, above: DataFrame, f, schema: str) -> DataFrame:
    return items.groupBy("key", _block_of()).cogroup(above.groupBy("key", F.col("place").alias("block"))).applyInArrow(f, schema)


_PROVEN = pa.schema([("id", pa.int64()), *((n, pa.string()) for n in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())])


def _proven(top: str):
    def proven(own: pa.Table, above: pa.Table) -> pa.Table:
        out = []
        for row, witness, subroot in _extended(own, above) if len(own) else ():
            proof = hashlib.sha256("".join(itertools.chain.from_iterable(witness)).encode()).hexdigest()
            root = fold(row["other"], witness)
            out.append((row["id"], row["leaf"], subroot, top, proof, root, root == top))
        return pa.table([pa.array(c, f.type) for c, f in zip(list(zip(*out, strict=True)) or [()] * len(_PROVEN), _PROVEN, strict=True)], schema=_PROVEN)

    return proven


def manifest(rows: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root, verified for each row of `rows` (id, key, leaf, other), see leaves().

    Leaves of a key ascend by id (null first), then by their hash; equal rows are leaves of their own. proof_sha256 is the
    hash of all siblings from the leaf to the root, folded_root what `other` and these siblings lead to. An empty table
    gives no rows.
    """
    spark = rows.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark)
    kept = scratch.keep(rows)
    items = scratch.keep(numbered(kept, ["id", "leaf"], scratch))
    below, roots = rounds(items, scratch)
    roots = scratch.keep(roots)
    keys = scratch.keep(numbered(roots.select(F.lit("").alias("key"), F.col("key").alias("name"), "leaf"), ["name"], scratch))
    over, root = rounds(keys, scratch)
    root = root.head()
    if root is None:
        return spark.createDataFrame([], "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    start = spark.createDataFrame([("", "", "")], "key string, path string, root string")
    witness = _meet(keys.select("key", "place", "size", "leaf"), descend(over, start, scratch), _passed, "key string, place long, path string, root string")
    tops = scratch.keep(keys.select("name", "place", F.col("leaf").alias("root")).join(witness.select("place", "path"), "place").select(F.col("name").alias("key"), "path", "root"))
    return _meet(items, scratch.keep(descend(below, tops, scratch)), _proven(root["leaf"]), "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def report(docs: DataFrame) -> DataFrame:
    """The manifest of documents by language; of a third of them, by the id's checksum, the text is tampered with: A-Z in lower case."""
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return manifest(leaves(docs, tampered={"text": F.when(chosen, lower).otherwise(F.col("text"))})).withColumnRenamed("id", "doc_id")


#: Levels by recursion; the siblings of a node share its place div 8.
ORACLE_SQL = r"""
WITH RECURSIVE codes AS MATERIALIZED (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce([b::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(b))
), d AS MATERIALIZED (
  SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
                            lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) % 3 = 0 AS chosen
  FROM documents, codes
), f AS (
  SELECT doc_id, lang, text, chosen, concat(
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
    coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head
  FROM d
), leaf AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || lang, '') AS key, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS h,
         sha256(head || coalesce(strlen(text) || ':' || CASE WHEN chosen THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS other
  FROM f
), placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM leaf
), nodes(key, level, i, h, n) AS (
  SELECT key, 0, i, h, count(*) OVER (PARTITION BY key) FROM placed
  UNION ALL
  SELECT key, level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM nodes WHERE n > 1 GROUP BY key, level, i // 8, n
), sub AS MATERIALIZED (
  SELECT key, h, level, row_number() OVER (ORDER BY key) - 1 AS i FROM nodes WHERE n = 1
), over_(level, i, h, n) AS (
  SELECT 0, i, h, count(*) OVER () FROM sub
  UNION ALL
  SELECT level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM over_ WHERE n > 1 GROUP BY level, i // 8, n
), steps AS MATERIALIZED (
  SELECT p.doc_id, p.key, x.level, list(x.h ORDER BY x.i) AS run, (p.i >> (3 * x.level)) % 8 AS k
  FROM placed p JOIN nodes x ON x.key = p.key AND x.n > 1 AND x.i // 8 = p.i >> (3 * x.level + 3)
  GROUP BY p.doc_id, p.key, p.i, x.level
  UNION ALL
  SELECT p.doc_id, p.key, s.level + x.level, list(x.h ORDER BY x.i), (s.i >> (3 * x.level)) % 8
  FROM placed p JOIN sub s USING (key) JOIN over_ x ON x.n > 1 AND x.i // 8 = s.i >> (3 * x.level + 3)
  GROUP BY p.doc_id, p.key, p.i, s.level, s.i, x.level
), proofs AS (
  SELECT doc_id, sha256(string_agg(array_to_string(list_concat(run[:k], run[k + 2:]), ''), '' ORDER BY level)) AS proof FROM steps GROUP BY doc_id
), folded(doc_id, level, h) AS (
  SELECT doc_id, 0, other FROM placed
  UNION ALL
  SELECT f.doc_id, f.level + 1, sha256(array_to_string(list_concat(run[:k], [h], run[k + 2:]), '')) FROM folded f JOIN steps s ON s.doc_id = f.doc_id AND s.level = f.level
), ends AS (
  SELECT doc_id, arg_max(h, level) AS folded FROM folded GROUP BY doc_id
)
SELECT p.doc_id, p.h AS leaf, s.h AS subroot, r.h AS root, coalesce(proof, sha256('')) AS proof_sha256, folded AS folded_root, folded = r.h AS verified
FROM placed p JOIN sub s USING (key) JOIN ends USING (doc_id) LEFT JOIN proofs USING (doc_id), (SELECT h FROM over_ WHERE n = 1) r
"""
