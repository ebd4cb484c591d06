import hashlib
import re

import numpy as np

import corpus_pipeline
from stackweave.llm import bpe

from .test_bpe import exact as tokens
from .test_decontaminate import brute as leaks
from .test_ngram_join import brute as components

SF = "/root/testdata/sf0.001"


def test_stages_and_whole_run(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(9001, "12 34 !!", "en", "s", 8), (9002, None, "en", "s", 0), (9003, "", None, None, 0), (9004, "A.", "en", "s", 2)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema)).unionByName(docs.where("doc_id < 3").selectExpr("doc_id + 8000 AS doc_id", "concat(text, ' ') AS text", "lang", "source", "n_chars"))
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    for name in ("documents", "benchmark"):
        (docs if name == "documents" else spark.read.parquet(f"{SF}/benchmark.parquet")).write.parquet(f"{tmp_path}/{name}.parquet")
    kept = {r.doc_id: r.text for r in docs.collect()}
    now, columns = docs, docs.columns
    for (name, stage), expect in zip(corpus_pipeline.STAGES, (language, exact, near, lambda k: clean(k, items)), strict=False):
        now = stage(spark, now, str(tmp_path))
        assert now.columns == columns
        got = {r.doc_id: r.text for r in now.collect()}
        kept = expect(kept)
        assert got == kept, (name, set(got) ^ set(kept))
    want = set()
    for d, text in kept.items():
        ids = tokens(text)
        want.add((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert {tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == want
    assert len(want) < docs.count()


def language(kept):
    return {d: t for d, t in kept.items() if t and any(c.isalpha() for c in t)}


def exact(kept):
    best = {}
    for d, t in kept.items():
        key = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[key] = min(best.get(key, (0, 1 << 60)), (-len(t), d))
    return {d: kept[d] for _, d in best.values()}


def near(kept):
    found = components(list(kept.items()), 5, 80)
    return {d: t for d, t in kept.items() if found[d][1] == d}


def clean(kept, items):
    bad = {d for d, _ in leaks([(d, t) for d, t in kept.items() if any(" ".join(i.lower().split()[:2]) in " ".join(t.lower().split()) for i in items.values())], list(items.items()))}
    return {d: t for d, t in kept.items() if d not in bad}


def test_repeated_ids_and_no_language(spark, tmp_path):
    """No row has a language, so only texts without letters go; of an id with several rows none goes unless all do."""
    text = " ".join(f"word{k} and" for k in range(40))
    rows = [(1, text), (1, "another text of its own " * 3), (2, text + " "), (2, text), (3, "1234"), (3, "12"), (4, "5678"), (4, "letters"), (5, "one more text"), (None, "no id at all")]
    docs = spark.createDataFrame([(d, t, None, "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a passage that nobody has in any text of these at all, of more than twenty words, so that nothing is found anywhere here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((str(r.doc_id), r.n_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    want = [(d, t) for d, t in rows if t not in ("1234", "12", "5678") and d != 2]  # both rows of 2 equal one of 1
    assert got == sorted((str(d), len(tokens(t))) for d, t in want)


def test_decontamination_leaves_one_table_of_ids(spark, tmp_path):
    """All that led to the dropped ids is gone before the documents that stay are written."""
    import glob

    passage = " ".join(f"w{j}" for j in range(30))
    spark.createDataFrame([(k, passage) for k in range(40)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, f"a {passage} b"), (2, "nothing of it"), (None, passage)], "doc_id long, text string")
    tables = lambda: set(glob.glob(spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/stackweave-*/*"))
    before = tables()
    left = corpus_pipeline.clean(spark, docs, str(tmp_path))
    assert len(tables() - before) == 1
    assert [r.doc_id for r in left.collect()] == [2]
