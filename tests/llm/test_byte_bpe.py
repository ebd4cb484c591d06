import base64
import functools
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stackweave.llm import byte_bpe

PATH = byte_bpe.default_path()
PARTS = ["a", "the", "ing", "'s", "'re", "'l", "'ll", "'v", "''", "'", "!", "?!", " ", "  ", "\n", "\r\n", "\t", "\x1c", "\x85", " ", "　", "1", "23", "é", "ß", "语", "😀", "<|endoftext|>", "x" * 60, "ab" * 30, "9" * 50, "!" * 50, " " * 40]


@functools.cache
def library():
    import tiktoken

    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def own(texts):
    codec = byte_bpe.codec(PATH)
    ids, starts, cut = codec.encode(pa.array(texts, pa.string()))
    return [(ids[a:b], starts[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=30).map("".join), max_size=6))
def test_equals_the_library(texts):
    for text, (ids, starts) in zip(texts, own(texts), strict=True):
        assert ids.tolist() == library().encode_ordinary(text)
        assert byte_bpe.codec(PATH).decode(ids) == text.encode()
        assert starts.tolist() == np.cumsum([0, *(len(library().decode_single_token_bytes(i)) for i in ids)])[:-1].tolist()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=30).map("".join), st.integers(0, 40), st.integers(0, 90))
def test_ranges_are_decoded_from_the_kept_starts(text, a, b):
    [(ids, starts)] = own([text])
    assert byte_bpe.codec(PATH).decode_range(ids, starts, a, b) == text.encode()[a:b]


def test_every_code_point_is_split_alike():
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 50000):
        texts = ["".join(f"a{c}{c}1 {c} b!{c}'s{c}'ll  {c}" for c in points[j : j + 500]) for j in range(k, min(k + 50000, len(points)), 500)]
        want = library().encode_ordinary_batch(texts)
        assert [i.tolist() for i, _ in own(texts)] == want


@pytest.mark.parametrize("letters", ["abcdefghij", "theandingeronatre", "0123456789", "!?.,'", "éèêçü", " \n\t", "' srevmltd"])
def test_long_unsplit_text(letters):
    r = random.Random(1)
    text = "".join(r.choice(letters) for _ in range(30000))
    assert own([text, text[:100]])[0][0].tolist() == library().encode_ordinary(text)


@pytest.mark.parametrize("width", [1, 2, 3, 256])
def test_scan_equals_one_step_after_another(width):
    states, _, _ = byte_bpe._functions()
    functions = np.random.default_rng(1).integers(0, len(states), 1000).astype(np.uint8)
    if width == 1:
        functions = functions[:1]
    want, state = [], 0
    for f in functions:
        want.append(state)
        state = int(states[f, state])
    assert byte_bpe.scan(functions, max(width, 2)).tolist() == want


def test_cache_that_starts_anew():
    codec = byte_bpe.Codec(PATH, byte_bpe.code_point_classes())
    codec.MOST_WORDS = 3
    text = "one two three four one two fourfold three"
    assert codec.encode(pa.array([text]))[0].tolist() == library().encode_ordinary(text) and len(codec.known) <= 3


def test_rows(spark):
    rows = [(1, "hello world", "x"), (2, None, "y"), (3, "", "z"), (None, "q " * 30, "z"), (4, "abc" * 40000, "z"), (1, "hello", "dup"), (1, "hello", "dup")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(2)
    got = sorted(map(tuple, byte_bpe.digests(docs, PATH).collect()), key=str)
    want = []
    for doc, text, _ in rows:
        ids = library().encode_ordinary(text or "")
        want.append((doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert byte_bpe.digests(docs.limit(0), PATH).count() == 0
    coded = byte_bpe.encode(docs.where("doc_id is not null"), PATH)
    assert {bytes(r.decoded) for r in byte_bpe.decode(coded, PATH, 2, 7).collect()} == {b"llo w", b"", b"cabca", b"llo"}


def test_words_that_come_up_again_are_merged_once(monkeypatch):
    """A full cache goes on as the older half: a word in steady use isn't merged anew when other words fill it."""
    codec, merged, merge = byte_bpe.Codec(PATH, byte_bpe.code_point_classes()), [], byte_bpe.merge
    codec.MOST_WORDS = 4
    monkeypatch.setattr(byte_bpe, "merge", lambda word, *rest: merged.append(word) or merge(word, *rest))
    text = "".join(f" steadyword other{k}x" for k in range(40))
    assert codec.encode(pa.array([text]))[0].tolist() == library().encode_ordinary(text)
    assert merged.count(b" steadyword") == 1
