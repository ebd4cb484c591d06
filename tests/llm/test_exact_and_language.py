import random
import re
import types

import numpy as np
import pyarrow as pa

from stackweave.llm import common, exact_dedup, language_id


def test_exact_duplicates(spark):
    r = random.Random(1)
    base = ["".join(r.choice("ab c\n") for _ in range(r.randrange(0, 60))) for _ in range(40)]
    docs = [(k, r.choice(base) + r.choice(["", " ", "\t\x0b"]), "x") for k in range(200)]
    docs += [(300, None, "x"), (301, "", "x"), (None, "\x0c ", "x"), (302, "é" * 50, "y"), (303, "é" * 50 + " ", "y"), (303, "a", "y"), (304, "\x1c", "z")]
    got = exact_dedup.exact_duplicates(spark.createDataFrame(docs, "doc_id long, text string, name string"), block_bytes=8, buckets=4)
    got = sorted(((x.doc_id, x.keep_id, x.group_size, x.kept) for x in got.collect()), key=str)
    groups = {}
    for k, (d, t, _) in enumerate(docs):  # several rows with one id are documents of their own
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), -1 if d is None else d, k, d))
    want = sorted(((d, min(g)[3], len(g), k == min(g)[2]) for g in groups.values() for _, _, k, d in g), key=str)
    assert got == want
    assert exact_dedup.exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_blocks_of_their_own_are_not_dealt_out(spark):
    class Seen(common.Scratch):
        dealt = 0

        def keep(self, df):
            out = super().keep(df)
            if "block" in out.columns:
                self.dealt += out.where("block is not null").count()
            return out

    r = random.Random(3)
    texts = ["".join(r.choice("abc") for _ in range(r.randrange(20, 60))) for _ in range(300)]
    docs = [(k, t) for k, t in enumerate([*texts, texts[7] + " ", texts[9][:16] + texts[8][16:]])]
    scratch = Seen(spark)
    got = exact_dedup.exact_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), block_bytes=16, scratch=scratch).collect()
    assert sorted((x.doc_id, x.keep_id) for x in got if x.group_size > 1) == [(7, 300), (300, 300)] and len(got) == len(docs)
    assert 0 < scratch.dealt < 40  # of about 900 blocks


def test_blocks_are_named_alike_whatever_the_filter_lets_through():
    texts = ["aaaabbbb", "aaaacccc", "dddd", "eeee", "aaaabbbb", "dd dd", ""]
    docs = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["id", "text"])
    names = []
    for bits in (0, -1):  # a filter that holds nothing, and one that holds all hashes
        table = np.full(1 + (1 << 10), bits, np.int64).view(np.uint64)
        table[0] = 8
        places = [x for b in exact_dedup._cut(4, types.SimpleNamespace(value=table))([docs]) for x in b.to_pylist()]
        found = [(x["name"], x["rep_id"], x["rep_pos"]) for x in places]
        assert len(found) == 10 and all((name is None) == (rep is not None) == bool(bits) for name, rep, _ in found)
        names.append([found.index(x) for x in found])
    assert names[0] == names[1] == [0, 1, 0, 3, 4, 5, 0, 1, 4, 9]


def test_languages(spark):
    r = random.Random(2)
    parts = {"xx": ["the", "ing", "and", "er"], "yy": ["oui", "eau", "ment", "le"], "zz": ["sch", "ung", "ein", "über"]}
    docs = [(k, " ".join("".join(r.choice(parts[lang]) for _ in range(3)) for _ in range(r.randrange(1, 60))), lang) for k in range(600) for lang in [r.choice([*parts])]]
    docs += [(1000, None, "xx"), (1001, "", None), (1002, "12 !?", "xx"), (1003, "a", "xx"), (1004, "the " * 50000, None), (None, "eau eau", "yy")]
    got = {x.doc_id: x for x in language_id.languages(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(docs)
    held = [got[d].lang_pred == lang for d, _, lang in docs if d is not None and d < 1000 and got[d].held_out]
    assert len(held) > 100 and sum(held) / len(held) > 0.99
    assert all(got[d].lang_pred == "und" and got[d].score == 0 for d in (1000, 1001, 1002))
    assert got[1003].lang_pred in parts and got[1004].lang_pred == "xx" and all(0 <= x.score <= 1 for x in got.values())
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language_id.languages(empty).count() == 0


def test_filter_has_no_false_negatives():
    keys = language_id.ngrams("the quick brown fox jumps over the lazy dog")
    import numpy as np

    table = np.zeros(1 << 12, np.uint8)
    for at in language_id.places(keys, len(table), 3):
        table[at] = 1
    model = {"langs": ["en"], "rows": table, "hashes": 3, "false": [0.0]}
    assert language_id.identify(model, "THE quick, brown fox jumps over the lazy dog!") == ("en", 1.0, len(keys))


def test_more_languages_than_bits(spark):
    alphabet = [chr(0x4E00 + k) for k in range(700)]
    docs = [(f"l{k:02d}", "".join(alphabet[10 * k + (7 * j + j // 10) % 10] for j in range(200))) for k in range(70)]
    frame = spark.createDataFrame([(lang, text) for lang, text in docs for _ in range(2)], "lang string, text string")
    model = language_id.fit(frame)
    assert len(model["langs"]) == 70 and len(model["further"]) == 1
    assert [language_id.identify(model, text)[0] for _, text in docs] == [lang for lang, _ in docs]
