"""Several rows with one id: each is a document of its own, and none is lost."""

import collections

import numpy as np
import pytest

from stackweave.llm import bpe, exact_dedup, importance, language_id, line_dedup, ngram_join, pii, substring_dedup

T = " ".join(f"word{k}" for k in range(60))
ROWS = [(1, T), (1, "zz " + " ".join(f"other{k}" for k in range(40))), (2, T), (3, "x"), (None, "mail a@b.cd"), (None, None), (3, "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "en") for r in ROWS], "doc_id long, text string, lang string").repartition(2)


def ids(found, column="doc_id"):
    return collections.Counter(r[column] for r in found)


WANT = collections.Counter(d for d, _ in ROWS)


def test_exact_copies_are_found_under_repeated_ids(docs):
    got = exact_dedup.exact_duplicates(docs).collect()
    assert ids(got) == WANT
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got if r.doc_id in (1, 2, 3)) == [(1, 1, 1, True), (1, 1, 2, True), (2, 1, 2, False), (3, 3, 2, False), (3, 3, 2, True)]


def test_links_of_repeated_ids(docs):
    got = ngram_join.linked_components(docs).collect()
    assert ids(got) == WANT
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id in (1, 2, 3)) == [(1, 39, 1), (1, 58, 1), (2, 58, 1), (3, 1, 3), (3, 1, 3)]


def test_lines_and_passages_of_repeated_ids(docs):
    lines = line_dedup.report(docs).collect()
    assert ids(lines) == WANT and sorted(r.n_removed for r in lines if r.doc_id in (1, 2)) == [0, 0, 1]
    passages = substring_dedup.report(docs).collect()
    assert ids(passages) == WANT and sorted(r.n_removed for r in passages if r.doc_id in (1, 2)) == [0, 0, 60]


def test_rows_that_need_no_ids(docs, spark):
    got = bpe.digests(docs, bpe.default_path(), piece_points=50).collect()
    own = bpe.codec(bpe.default_path())
    assert sorted(map(str, ((r.doc_id, r.n_tokens) for r in got))) == sorted(map(str, ((d, len(own.encode(t or ""))) for d, t in ROWS)))
    assert ids(pii.report(docs).collect()) == WANT
    assert sum(r.n_email for r in pii.report(docs).collect()) == 1
    assert ids(language_id.languages(docs).collect()) == WANT
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert ids(importance.report(docs, labels).collect()) == WANT


def test_registered_passages_in_mid_line(spark):
    """The registered parameters: nearly equal passages (Jaccard of five words >= 0.8) inside a line, random words around them."""
    rng = np.random.default_rng(4)

    def words(n):
        return [f"w{k}" for k in rng.integers(0, 50000, n)]

    def shingles(p):
        return {tuple(p[k : k + 5]) for k in range(len(p) - 4)}

    rows, want = [], {}
    for n, changes in ((60, 0), (60, 1), (100, 2), (200, 4)):
        for k in range(15):
            passage = words(n)
            other = list(passage)
            for at in rng.choice(n, changes, replace=False):
                other[at] = f"new{rng.integers(1 << 30)}"
            a, b = shingles(passage), shingles(other)
            if len(a & b) < 0.8 * len(a | b):
                continue
            first = len(rows)
            rows.append((first, " ".join(words(30) + passage + words(30))))
            rows.append((first + 1, " ".join(words(25) + other + words(35))))
            want[first + 1] = n
    got = {r.doc_id: r for r in substring_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = [got[d].n_removed >= n / 2 for d, n in want.items()]
    assert len(found) > 40 and np.mean(found) >= 0.9
    assert all(r.n_removed == 0 for d, r in got.items() if d not in want)


def test_repeats_within_one_text_go(spark):
    part = " ".join(f"part{k}" for k in range(25))
    [row] = substring_dedup.report(spark.createDataFrame([(1, f"{part} between these two {part} end")], "doc_id long, text string")).collect()
    assert row.n_removed == 25
