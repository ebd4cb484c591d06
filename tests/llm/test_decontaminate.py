import itertools
import random

from stackweave.llm import decontaminate as dc


def brute(docs, items, stretch=20, percent=80):
    """All diagonals of all pairs, without seeds."""
    import re

    def w(t):
        return re.findall(r"[^\W_]+", (t or "").lower())

    out = {}
    for d, t in docs:
        for i, u in items:
            a, b = w(t), w(u)
            if not a or not b:
                continue
            n = min(stretch, len(b))
            for diagonal in range(-len(b) + 1, len(a)):
                eq = [0 <= diagonal + k < len(a) and a[diagonal + k] == b[k] for k in range(len(b))]
                best = max(sum(eq[s : s + n]) for s in range(len(b) - n + 1))
                if best * 100 >= n * percent:
                    out[d, i] = max(out.get((d, i), 0), best)
    return out


def test_against_all_diagonals(spark):
    r = random.Random(3)
    vocab = [f"w{k}" for k in range(60)] + ["été", "Ärzte"]
    items = [(k, " ".join(r.choice(vocab) for _ in range(r.choice([3, 9, 12, 25, 50])))) for k in range(12)] + [(90, None), (91, "...")]
    docs = []
    for d in range(60):
        words = [r.choice(vocab) for _ in range(r.randrange(0, 80))]
        k, passage = items[r.randrange(12)]
        passage = passage.upper().split()
        if len(passage) > 11:
            for s in range(4, len(passage), 9):  # a substitution in nine words
                passage[s] = "changed"
        words[len(words) // 2 : len(words) // 2] = passage if d % 3 else []
        docs.append((d, ", ".join(words)))
    docs += [(100, None), (101, ""), (102, "w1 " * 300)]
    got = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.n_agree for r in got.collect()}
    want = brute(docs, items)
    short = {k for k, t in items if t and len(t.split()) < dc.SPAN}
    want = {k: v for k, v in want.items() if k[1] not in short or v == len(dict(items)[k[1]].split())}  # found as a whole
    assert got == want and len(got) > 20
    blocks = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_rows=50)
    assert {(r.doc_id, r.item_id): r.n_agree for r in blocks.collect()} == want


def test_masks_stand_substitutions():
    for n, least in ((1, 1.0), (2, 1.0), (3, 0.93)):
        ways = list(itertools.combinations(range(20), n))
        found = sum(any(not ({p + o for o in m} & set(w)) for m in dc.MASKS for p in range(20 - max(m))) for w in ways)
        assert found >= least * len(ways), (n, found / len(ways))


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c", 2)], "doc_id long, text string, h int")
    items = spark.createDataFrame([(7, "a b c"), (None, "b c")], "item_id long, text string")
    assert dc.contaminated(none, items).count() == 0
    assert dc.contaminated(some, items.limit(0)).count() == 0
    assert {(r.doc_id, r.item_id) for r in dc.contaminated(some, items).collect()} == {(1, 7), (1, None)}


def test_repeated_ids_lose_no_text(spark):
    first, second = (" ".join(f"{x}{k}" for k in range(30)) for x in "ab")
    docs = spark.createDataFrame([(1, "z " + first), (2, second + " z"), (3, "nothing here"), (3, first)], "doc_id long, text string")
    items = spark.createDataFrame([(7, first), (7, second), (None, "one two")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(docs, items).collect()}
    assert got == {(1, 7), (2, 7), (3, 7)}


def test_a_large_benchmark_is_not_sent(spark, monkeypatch):
    first = [(k, " ".join(f"w{k * 7 + j * j}" for j in range(30))) for k in range(8)]
    items, docs = [(k + 100 * copy, t) for copy in range(5) for k, t in first], [(k, f"before {t} behind") for k, t in first[:5]]
    sent, send = [], dc.F.broadcast
    monkeypatch.setattr(dc.F, "broadcast", lambda df: (sent.append(df), send(df))[1])
    df = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string")
    got = {(r.doc_id, r.item_id, r.n_agree) for r in dc.contaminated(df(docs, "doc_id"), df(items, "item_id"), block_rows=50).collect()}
    assert got == {(k, k + 100 * copy, 20) for k, _ in docs for copy in range(5)}
    assert sent and not any({"mask", "key"} <= set(f.columns) for f in sent)  # neither at once nor one block after the other
    assert max(f.count() for f in sent) <= len(items)


def test_copies_of_items_add_no_hits(spark):
    first = [(k, " ".join(f"w{k * 7 + j * j}" for j in range(30))) for k in range(3)]
    docs, written = spark.createDataFrame([(k, f"before {t}") for k, t in first], "doc_id long, text string"), []

    class Seen(dc.Scratch):
        def keep(self, df):
            out = super().keep(df)
            written.append((tuple(out.columns), out.count()))
            return out

    for copies in (1, 6):
        items = spark.createDataFrame([(k + 100 * c, t.upper() if c % 2 else t) for c in range(copies) for k, t in first], "item_id long, text string")
        assert dc.contaminated(docs, items, scratch=Seen(spark)).count() == 3 * copies
    hits = [n for columns, n in written if "diagonal" in columns]
    assert len(hits) == 2 and hits[0] == hits[1] == 3


def test_filter_loses_no_key(spark):
    keys = spark.range(20_000).selectExpr("xxhash64(id) AS key", "id")
    held = keys.where("id % 4 = 0")
    left = [r.id for r in dc._may_meet(keys, held, 5000).collect()]
    assert len(left) == len(set(left)) and set(left) >= set(range(0, 20_000, 4)) and len(left) < 5000 + 300
