"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

A seed is a fixed mask over neighbouring words: the offsets it holds are hashed, the others ignored, so that a
substituted word on an ignored offset does not hide a copy. The masked hashes of each place in each document are
joined with those of the benchmark. Around each hit the document and the item are laid over each other, and the words
that agree are counted in the best stretch of `stretch` words of the item; `agree_percent` of them have to be equal.

Items whose words are all equal are one class: the benchmark's copies cost one line of the last join each, nothing else. No
document's words are dealt out before its hits are known: a hit is the document's hash, a class and a diagonal, each
diagonal once, and only documents with hits are read again and laid over their items.

The benchmark's hashes are sent to all tasks if they are at most `block_rows`. Of a larger benchmark, whatever its size,
only bits are sent, FILTER_BITS at most; the places of documents that pass them meet the hashes in a shuffled join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, each_row, id_back, sent

#: The offsets that each mask holds, of a span of twelve words.
MASKS = ((0, 1, 2, 3, 4, 5, 6, 7), (0, 1, 3, 4, 6, 7, 9, 10), (0, 2, 3, 5, 7, 8, 10, 11))
SPAN = 12
#: Bits of the filter of a benchmark too large to be sent, of which a row has LINE_BITS; more hashes than these bits serve let more through.
FILTER_BITS = 1 << 28
LINE_BITS = 1 << 16


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("h", F.transform(words(F.col("text")), lambda w: F.xxhash64(w))).drop("text")


def _key(mask: int, offsets: tuple[int, ...], at: Column, h: Column) -> Column:
    inside = at + (max(offsets) + 1) <= F.size(h)
    return F.when(inside, F.xxhash64(F.lit(mask), *(F.get(h, at + o) for o in offsets)))


def _seeds(df: DataFrame, masks: list[tuple[int, ...]], *more: str) -> DataFrame:
    """One row for each place and mask: the columns `more`, pos, mask, key."""
    at = df.select("*", F.posexplode_outer("h").alias("pos", "_"))  # outer: else Spark asks for size(h) > 0 first, and hashes all words twice
    keys = F.array(*(_key(m, o, F.col("pos"), F.col("h")) for m, o in enumerate(masks)))
    return at.select(*more, "pos", F.posexplode(keys).alias("mask", "key")).where("key is not null")


def _may_meet(found: DataFrame, seeds: DataFrame, count: int) -> DataFrame:
    """The rows of `found` but for most of those whose key none of the `count` seeds has.

    Two bits in one line of a Bloom filter stand for a key.
    """
    lines = min(FILTER_BITS, 1 << (32 * count).bit_length()) // LINE_BITS or 1
    line, n_words = F.pmod("key", F.lit(lines)).cast("int").alias("line"), LINE_BITS // 64
    places = [F.shiftrightunsigned("key", k).bitwiseAND(LINE_BITS - 1).cast("int") for k in (32, 48)]

    def word(place: Column) -> Column:
        return F.shiftright(place, 6).alias("word")

    def bit(place: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63)).alias("bits")

    own = seeds.select(line, F.explode(F.array(*places)).alias("place")).select("line", word(F.col("place")), bit(F.col("place")))
    none = seeds.sparkSession.range(lines * n_words).selectExpr(f"int(id div {n_words}) AS line", f"int(id % {n_words}) AS word", "0L AS bits")
    each = own.unionAll(none).groupBy("line", "word").agg(F.bit_or("bits").alias("bits"))
    table = each.groupBy("line").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).getField("bits").alias("bits"))
    held = [F.get("bits", word(p)).bitwiseAND(bit(p)) != 0 for p in places]
    return found.withColumn("line", line).join(F.broadcast(table), "line").where(held[0] & held[1]).select(*found.columns)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", stretch: int = 20, agree_percent: int = 80, block_rows: int = 500_000, scratch: Scratch | None = None
) -> DataFrame:
    """doc_id, item_id, n_agree, n_words of each pair of a document and a benchmark item that it contains.

    n_agree is the largest number of equal words in a stretch of n_words = min(stretch, words of the item) words of
    the item on one diagonal; a pair counts when 100 * n_agree >= agree_percent * n_words. An item with fewer words
    than a mask spans has to be found as a whole first. Texts without words, null ones included, contain nothing and
    are contained in nothing. An id on several rows stands for all their texts, in either table.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    # rows are never merged but with equal ones: each row of a document counts for its id, and each text of an item for its item
    hashed = _hashed(each_row(benchmark, item_col, item_text_col)).withColumn("item", F.xxhash64("h"))
    hashed = scratch.keep(hashed.where("size(h) > 0").select("item", F.col("id").alias("item_id"), "h"))
    named = hashed.select("item", "item_id").distinct()
    items = scratch.keep(hashed.select("item", "h").distinct())
    short = sorted(r[0] for r in items.where(F.size("h") < SPAN).select(F.size("h")).distinct().collect())  # fewer than SPAN
    masks = [*MASKS, *(tuple(range(n)) for n in short)]
    whole = F.element_at(F.array(F.lit(0), *(F.lit(len(m) if k >= len(MASKS) else 0) for k, m in enumerate(masks))), F.col("mask") + 2)
    seeds = _seeds(items.withColumn("n", F.size("h")), masks, "item", "n").where((whole == 0) & (F.col("n") >= SPAN) | (whole == F.col("n")))
    seeds = scratch.keep(seeds.withColumnRenamed("pos", "ipos"))
    count = seeds.count()

    texts = each_row(docs, id_col, text_col).withColumn("doc", F.xxhash64("id", "text"))
    found = _seeds(_hashed(texts), masks, "doc")
    hits = found.join(F.broadcast(seeds), ["mask", "key"]) if count <= block_rows else _may_meet(found, seeds, count).join(seeds, ["mask", "key"])
    hits = scratch.keep(hits.select("doc", "item", "n", (F.col("pos") - F.col("ipos")).alias("diagonal")).distinct())

    # rows that share a hash are both laid over the items of either, so nothing rests on its being different
    texts = _hashed(texts.join(sent(hits.select("doc").distinct(), 16), "doc", "left_semi"))
    beside = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.get("h", F.col("diagonal") + k))
    laid = texts.join(hits, "doc").select("id", "item", "n", F.least(F.lit(stretch), F.col("n")).alias("n_words"), beside.alias("beside"))
    laid = laid.join(sent(items.withColumnRenamed("h", "it"), F.size("it") * 8 + 64), "item")
    equal = F.zip_with("beside", "it", lambda a, b: F.when(a == b, 1).otherwise(0))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.col("n") - F.col("n_words") + 1), lambda s: F.aggregate(F.slice("equal", s, F.col("n_words")), F.lit(0), lambda a, x: a + x)))
    pairs = laid.select("id", "item", "n", "n_words", equal.alias("equal")).select("id", "item", "n_words", best.alias("n_agree"))
    pairs = pairs.where(F.col("n_agree") * 100 >= F.col("n_words") * agree_percent).groupBy("id", "item").agg(F.max("n_agree").alias("n_agree"), F.max("n_words").alias("n_words"))
    pairs = pairs.join(sent(named, 32), "item").groupBy("id", F.col("item_id").alias("item")).agg(F.max("n_agree").cast("long").alias("n_agree"), F.max("n_words").cast("long").alias("n_words"))
    return pairs.select(id_back("id", "doc_id"), id_back("item", "item_id"), "n_agree", "n_words")


ORACLE_SQL = """
WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS h FROM documents),
i AS (SELECT item_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS h FROM benchmark),
m(mask, o) AS (VALUES (0, [0, 1, 2, 3, 4, 5, 6, 7]), (1, [0, 1, 3, 4, 6, 7, 9, 10]), (2, [0, 2, 3, 5, 7, 8, 10, 11])),
ip AS (SELECT id, h, unnest(range(len(h))) AS pos FROM i WHERE len(h) >= 12),
ik AS (SELECT id, pos, mask, list_transform(o, lambda x: h[pos + x + 1]) AS k FROM ip, m WHERE pos + o[8] < len(h)
       UNION ALL SELECT id, 0, 100 + len(h), h FROM i WHERE len(h) BETWEEN 1 AND 11),
dp AS (SELECT id, h, unnest(range(len(h))) AS pos FROM d),
dk AS (SELECT id, pos, mask, list_transform(o, lambda x: h[pos + x + 1]) AS k FROM dp, m WHERE pos + o[8] < len(h)
       UNION ALL SELECT id, pos, 100 + n, h[pos + 1:pos + n] FROM dp, (SELECT DISTINCT len(h) AS n FROM i WHERE len(h) BETWEEN 1 AND 11) WHERE pos + n <= len(h)),
g AS (SELECT DISTINCT dk.id AS doc, ik.id AS item, dk.pos - ik.pos AS diagonal FROM dk JOIN ik USING (mask, k)),
e AS (SELECT doc, item, len(i.h) AS n, least(20, len(i.h)) AS w,
             list_transform(range(len(i.h)), lambda k: CASE WHEN diagonal + k >= 0 AND d.h[diagonal + k + 1] = i.h[k + 1] THEN 1 ELSE 0 END) AS eq
      FROM g JOIN d ON d.id = doc JOIN i ON i.id = item),
b AS (SELECT doc, item, w, list_max(list_transform(range(1, n - w + 2), lambda s: list_sum(eq[s:s + w - 1]))) AS best FROM e)
SELECT doc AS doc_id, item AS item_id, CAST(max(best) AS BIGINT) AS n_agree, CAST(max(w) AS BIGINT) AS n_words
FROM b WHERE best * 100 >= w * 80 GROUP BY doc, item
"""
