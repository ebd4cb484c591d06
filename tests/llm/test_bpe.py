import functools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stackweave.llm import bpe

PATH = bpe.default_path()
PARTS = ["a", "the", "ing", "'s", "'re", "''", "!", "?!", " ", "  ", "\n", "\t", "1", "23", "é", "ß", "语", "😀", "<|endoftext|>", "<|endof", "text|>", " ", " ", "x" * 40, "ab" * 30, "9" * 50, "!" * 50, " " * 40]


@functools.cache
def library():
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(PATH)
    out.no_truncation()
    out.no_padding()
    return out


def exact(text):
    return library().encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=60).map("".join), st.integers(1, 40))
def test_tree_equals_the_library(text, most):
    own = bpe.codec(PATH)
    _, ids = bpe.tree(own, [(t, own.encode(t)) for t in bpe.halves(text, most)])
    assert ids.tolist() == exact(text)
    assert own.decode(ids) == library().decode(ids.tolist(), skip_special_tokens=False)


@pytest.mark.parametrize("letters", ["abcdefghij", "theandingeronatre", "0123456789", "!?.,'", "éèêçü"])
def test_long_unsplit_text(letters):
    r, own = random.Random(1), bpe.codec(PATH)
    text = "".join(r.choice(letters) for _ in range(20000))
    _, ids = bpe.tree(own, [(t, own.encode(t)) for t in bpe.halves(text, 700)])
    assert ids.tolist() == exact(text)


def test_every_code_point_is_split_alike():
    own = bpe.codec(PATH)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 5000):
        text = "".join(f"a{c}{c}1 {c} b!{c}" for c in points[k : k + 5000])
        if own.encode(text).tolist() != exact(text):
            bad = [c for c in points[k : k + 5000] if own.encode(f"a{c}{c}1 {c} b!{c}").tolist() != exact(f"a{c}{c}1 {c} b!{c}")]
            assert not bad, [hex(ord(c)) for c in bad]


def test_query_shapes(spark):
    rows = [(1, "hello world", "x"), (2, None, "y"), (3, "", "z"), (None, "q " * 30, "z"), (4, "abc" * 4000, "z"), (1, "hello", "dup")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs, PATH, piece_points=500).collect())
    import hashlib

    import numpy as np

    want = []
    for doc, text, _ in rows:  # several rows with one id are documents of their own
        ids = exact(text or "")
        want.append((str(doc), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.digests(docs.limit(0), PATH).count() == 0


def test_decode_of_encode(spark):
    docs = spark.createDataFrame([(1, "a b é", "x"), (2, None, "y"), (3, "abc " * 900, "z")], "doc_id long, text string, ids string")
    coded = bpe.encode(docs, PATH, piece_points=500)
    assert {r.id: r.text for r in bpe.decode(coded, PATH).collect()} == {r.id: r.text for r in coded.collect()} == {1: "a b é", 2: "", 3: "abc " * 900}
