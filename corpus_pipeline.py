"""A corpus pipeline: language ID, exact deduplication, near-duplicate removal, decontamination and tokenizing.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept and returns a DataFrame; run()
writes each stage as Parquet to the folder that all machines share and reads it back for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackweave.llm import bpe, decontaminate, exact_dedup, language_id, ngram_join
from stackweave.llm.common import NULL_ID, Scratch, sent, table


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The documents whose doc_id isn't in `dropped` (doc_id). Their columns may have any names."""
    key = F.coalesce(F.col("doc_id"), F.lit(NULL_ID))
    dropped = sent(dropped)
    return docs.join(dropped, key == dropped["dropped"], "left_anti")


def _ids(found: DataFrame, scratch: Scratch, goes: str = "true") -> DataFrame:
    """The ids of dropped documents as a table of its own, so that all that led to it can go.

    Of several rows with one id none is dropped unless `goes` holds for all of them.
    """
    ids = found.select(F.coalesce(F.col("doc_id"), F.lit(NULL_ID)).alias("dropped"), F.expr(goes).alias("goes"))
    return scratch.keep(ids.groupBy("dropped").agg(F.min("goes").alias("goes")).where("goes").select("dropped"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents without letters, and longer ones of which hardly anything is like a learned language.

    Where no document has a language nothing is learned, and only those without letters go.
    """
    model, name = language_id.fit(docs), "found"
    while name in docs.columns:
        name += "_"
    kept = F.col(f"{name}.n_grams") > 0
    if model["langs"]:
        kept &= (F.col(f"{name}.n_grams") < 20) | (F.col(f"{name}.score") >= 0.2)
    return language_id.annotate(docs, model, name).where(kept).drop(name)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for white space, the longest stays, then the smallest doc_id."""
    scratch, own = Scratch(spark), Scratch(spark)
    dropped = _ids(exact_dedup.exact_duplicates(docs, scratch=own), scratch, "not kept")
    own.end()
    return _without(docs, dropped)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that share 80 % of their five-word shingles, the smallest doc_id stays."""
    scratch, own = Scratch(spark), Scratch(spark)
    dropped = _ids(ngram_join.linked_components(docs, n=5, percent=80, scratch=own), scratch, "not doc_id <=> component_id")
    own.end()
    return _without(docs, dropped)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that hold a passage of the benchmark."""
    scratch, own = Scratch(spark), Scratch(spark)
    dropped = _ids(decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"), scratch=own), scratch)
    own.end()
    return _without(docs, dropped)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document that is left."""
    return bpe.digests(docs, bpe.default_path())


STAGES = [("language ID", language), ("exact dedup", exact), ("n-gram Jaccard join", near), ("benchmark decontamination", clean), ("BPE", tokens)]

#: SQL has neither the language model nor the tokenizer: tests/llm/test_pipeline.py holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        scratch.end(docs)  # its input has been read
    return docs
