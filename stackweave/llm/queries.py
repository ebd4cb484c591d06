"""The queries of this subpackage over the given tables, and their SQL where there is one."""

from __future__ import annotations

from . import bpe, byte_bpe, chat, decontaminate, importance, language_id, line_dedup, merkle, ngram_join, periodic_runs, pii, substring_dedup
from .common import table
from .exact_dedup import exact_duplicates

QUERIES = {}
ORACLE = {}


def query(name):
    def add(f):
        QUERIES[name] = f
        return f

    return add


@query("op2_exact_dedup")
def op2_exact_dedup(spark, sf_dir):
    return exact_duplicates(table(spark, sf_dir, "documents")).drop("n_blocks")


ORACLE["op2_exact_dedup"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
                  regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS kept,
       sha256(norm) AS text_sha256
FROM d
"""


@query("op6_bpe")
def op6_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), bpe.default_path())


@query("op7_decontamination")
def op7_decontamination(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE["op7_decontamination"] = decontaminate.ORACLE_SQL


@query("op3_language_id")
def op3_language_id(spark, sf_dir):
    return language_id.languages(table(spark, sf_dir, "documents"))


@query("op5_ngram_jaccard_join")
def op5_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.linked_components(table(spark, sf_dir, "documents"))


ORACLE["op5_ngram_jaccard_join"] = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w
), n AS MATERIALIZED (
  SELECT w.doc_id, count(shingle) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id
), pairs AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT a, b, shared = x.n AND shared = y.n AS same FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM n
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
)
SELECT n.doc_id, any_value(n.n) AS n_shingles, least(n.doc_id, (SELECT min(b) FROM links WHERE a = n.doc_id AND same)) AS class_id, min(other) AS component_id
FROM n JOIN reach USING (doc_id) GROUP BY n.doc_id
"""


@query("op4_pii")
def op4_pii(spark, sf_dir):
    return pii.report(table(spark, sf_dir, "documents"))


@query("op1_line_dedup")
def op1_line_dedup(spark, sf_dir):
    return line_dedup.report(table(spark, sf_dir, "documents"))


@query("op9_quality")
def op9_quality(spark, sf_dir):
    return importance.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_substring_dedup")
def op10_substring_dedup(spark, sf_dir):
    return substring_dedup.report(table(spark, sf_dir, "documents"))


@query("op8_chat_format")
def op8_chat_format(spark, sf_dir):
    return chat.report(table(spark, sf_dir, "conversations"))


@query("op13_byte_bpe")
def op13_byte_bpe(spark, sf_dir):
    return byte_bpe.digests(table(spark, sf_dir, "documents"), byte_bpe.default_path())


@query("op12_periodic_runs")
def op12_periodic_runs(spark, sf_dir):
    return periodic_runs.report(periodic_runs.planted(table(spark, sf_dir, "documents")))


ORACLE["op12_periodic_runs"] = periodic_runs.ORACLE_SQL


@query("op11_merkle_manifest")
def op11_merkle_manifest(spark, sf_dir):
    return merkle.report(table(spark, sf_dir, "documents"))


ORACLE["op11_merkle_manifest"] = merkle.ORACLE_SQL
