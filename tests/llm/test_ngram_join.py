import types
import random
import re

import numpy as np
import pytest

from stackweave.llm import ngram_join as nj


def brute(docs, n, percent):
    sets = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k = min(n, len(w))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def near_copies(seed, groups=6, copies=14, size=(3, 150)):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(3000)] + ["Ärzte", "été"]
    docs = []
    for _ in range(groups):
        base = [r.choice(vocab) for _ in range(r.randrange(*size))]
        for _ in range(copies):
            own = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 4, 6])):
                own[r.randrange(len(own))] = r.choice(vocab)
            if r.random() < 0.3:
                own = own[: -r.randrange(1, 4)] or own
            if r.random() < 0.3:
                base = own  # a chain of copies of copies
            docs.append(" \n".join(own) if r.random() < 0.5 else "\t".join(own).upper())
    r.shuffle(docs)
    return [*enumerate(docs), (1000, None), (1001, ""), (1002, " \n "), (1003, "one"), (1004, "ONE"), (1005, "w1 " * 500)]


@pytest.mark.parametrize(("seed", "n", "percent", "small"), [(1, 3, 90, 32), (2, 3, 90, 2), (3, 5, 80, 2)])
def test_against_all_pairs(spark, monkeypatch, seed, n, percent, small):
    monkeypatch.setattr(nj, "SMALL", small)
    monkeypatch.setattr(nj, "RUN", 3)
    docs = near_copies(seed)
    got = nj.linked_components(spark.createDataFrame(docs, "doc_id long, text string"), n=n, percent=percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(docs, n, percent)


def test_every_linked_pair_shares_a_key():
    r = random.Random(5)
    for _ in range(400):
        n, percent = r.randrange(5, 400), r.choice([80, 90])
        a = {r.getrandbits(64) for _ in range(n)}
        b, most = set(a), n
        while True:
            c = set(b)
            c.remove(r.choice(sorted(c))) if r.random() < 0.5 and len(c) > 1 else c.add(r.getrandbits(64))
            if 100 * len(a & c) < percent * len(a | c):
                break
            b = c
        import numpy as np

        ka, kb = (set(nj.sketch_keys([np.array(sorted(s), np.uint64)], percent)[0].tolist()) for s in (a, b))
        assert a == b or ka & kb, (n, most, percent)


def test_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert nj.linked_components(none).count() == 0
    odd = spark.createDataFrame([(None, "a b c d", "k"), (5, "a b c d", "k"), (5, "a b", "k")], "doc_id long, text string, key string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in nj.linked_components(odd).collect()), key=str)
    assert got == [(5, 1, 5), (5, 2, None), (None, 2, None)]  # each row is a document of its own


def test_filter_words_follow_the_buckets():
    """Tasks hold different buckets, so words that several tasks fill would grow with their number."""
    rng = np.random.default_rng(6)
    for bits, size in ((8, 1 << 22), (12, 1 << 16), (20, 1 << 28), (0, 1 << 16)):
        bucket, low = nj.folded(rng.integers(0, 1 << 63, 40000, dtype=np.uint64), bits)
        at = np.concatenate(nj._places(bucket, low, size, bits))
        assert at.max() < size and len(np.unique(at >> np.uint64(12))) > 0.5 * min(size >> 12, 40000)
        word = {b: set((at[np.tile(bucket >> max(0, bits - 2), 3) == b] >> np.uint64(6)).tolist()) for b in range(1 << min(bits, 2))}
        assert len(set.union(*word.values())) == sum(map(len, word.values()))


def test_filter_holds_its_keys_and_few_others(spark):
    rng = np.random.default_rng(7)
    keys = rng.integers(0, 1 << 63, 60000, dtype=np.uint64)
    bucket, low = nj.folded(keys[:30000], 10)
    table = nj.bloom(spark.createDataFrame(list(zip(bucket.tolist(), low.view(np.int32).tolist(), strict=True)), "bucket int, low int"), 10)
    found = nj.holds(table, keys)
    assert found[:30000].all() and found[30000:].mean() < 0.03


def test_elements_that_meet_are_left_and_nothing_else(spark):
    kinds = "a long, b long, na long, component long, linked boolean, x long, more long, short long, long long, bits array<long>, prefix array<long>, meet array<int>"
    found = [  # elements 7 and 9 have an asking set and another one that isn't linked; 8 is one component's, 5 is asked for by none, 6 by linked ones only
        (1, 0, 9, 1, True, 3, 0, 3, 4, [0], [7, 8, 6, 5], [0, 1, 2, 3]),
        (2, 0, 9, 2, False, 3, 0, 2, 4, [0], [7, 9, 5, 4], [0, 1, 2]),
        (3, 0, 9, 2, False, 3, 0, 1, 4, [0], [3, 9, 2, 1], [1]),
        (4, 0, 9, 1, False, 3, 0, 1, 2, [0], [8, 9], [0, 1]),
        (5, 0, 9, 3, True, 3, 0, 1, 2, [0], [6, 2], [0]),
    ]
    frame = spark.createDataFrame(found, kinds)
    meets = nj._meets(frame)
    assert sorted(x.e for x in meets.collect()) == [7, 9]
    shared = types.SimpleNamespace(value=nj.bloom(meets.mapInArrow(nj._folded_elements(8), "bucket int, low int"), 8))
    batch = frame.coalesce(1).toArrow().combine_chunks().to_batches()[0]
    left = [(x["a"], x["prefix"], x["meet"]) for b in nj._useful(shared)([batch]) for x in b.to_pylist()]
    assert left == [(1, [7], [0]), (2, [7, 9], [0, 1]), (3, [9], [1]), (4, [9], [1]), (5, [], [])]


def test_sets_of_several_large_buckets_are_written_once(spark, monkeypatch):
    """Near copies of one text meet in many buckets, with other centres: each of them is set against one centre only."""
    r = random.Random(8)
    base = [f"w{k}" for k in range(220)]
    docs = []
    for d in range(90):
        own = list(base)
        for k in r.sample(range(len(own)), r.choice([1, 4, 5, 6])):
            own[k] = f"own{r.randrange(400)}"
        docs.append((d, " ".join(own)))
    around, compare, seen = nj._around, nj.compare, {}

    def looked(texts, large, *rest):
        seen["buckets"] = [tuple(x) for x in large.select("id", "centre").where("id <> centre").distinct().collect()]
        return around(texts, large, *rest)

    def compared(texts, pairs, scratch, n, percent, differences=False):
        if differences:
            seen["sets"] = [x.a for x in pairs.collect()]
        return compare(texts, pairs, scratch, n, percent, differences)

    for name, value in (("SMALL", 2), ("ROUNDS", 1), ("_around", looked), ("compare", compared)):
        monkeypatch.setattr(nj, name, value)
    got = nj.linked_components(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got.collect()} == brute(docs, 3, 90)
    assert len(seen["buckets"]) > 1.5 * len({d for d, _ in seen["buckets"]})
    assert len(seen["sets"]) == len(set(seen["sets"])) > 0


def test_links_of_sets_that_share_no_bucket_with_their_centre(spark, monkeypatch):
    """5 and 6 link with each other and with 0, the centre of both buckets by way of 3, but share no bucket with it."""
    monkeypatch.setattr(nj, "SMALL", 2)
    monkeypatch.setattr(nj, "ROUNDS", 0)
    text = {d: " ".join(f"t{d}w{k}" for k in range(60)) for d in (0, 1, 2, 3)}
    text |= {5: text[0] + " x", 6: text[0] + " y"}
    scratch = nj.Scratch(spark)
    texts = nj.rows(spark.createDataFrame(list(text.items()), "doc_id long, text string"))
    keys = spark.createDataFrame([(d, k) for k, ids in ((1, (0, 1, 3)), (2, (2, 3, 5, 6))) for d in ids], "id long, key long")
    got = {x.id: x.component for x in nj.resolve(texts, None, nj.buckets_of(keys, scratch), scratch, 3, 90).collect()}
    assert 5 in got and got[5] == got[6]


def test_further_centres_are_looked_at_together(spark, monkeypatch):
    """Four groups of near copies share a bucket: one further comparison finds the links, not one for each centre."""
    monkeypatch.setattr(nj, "SMALL", 2)
    linked, asked = nj.linked, []

    def counted(texts, sketches, pairs, *rest):
        asked.append(pairs.count())
        return linked(texts, sketches, pairs, *rest)

    monkeypatch.setattr(nj, "linked", counted)
    docs = [(d, " ".join([*(f"t{d % 4}w{k}" for k in range(60)), f"x{d}"])) for d in range(16)]
    scratch = nj.Scratch(spark)
    texts = nj.rows(spark.createDataFrame(docs, "doc_id long, text string"))
    keys = spark.createDataFrame([(d, 1) for d, _ in docs], "id long, key long")
    got = {x.id: x.component for x in nj.resolve(texts, None, nj.buckets_of(keys, scratch), scratch, 3, 90).collect()}
    assert got == {d: d % 4 for d, _ in docs}
    assert len(asked) <= 3 and max(asked) <= 15 * nj.ROUNDS
