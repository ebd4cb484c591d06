import difflib
import random

import numpy as np

from stackweave.llm import importance, line_dedup, substring_dedup


def test_patience_against_rules():
    r = random.Random(1)
    for _ in range(300):
        a = [r.randrange(12) for _ in range(r.randrange(0, 25))]
        b = list(a)
        for _ in range(r.randrange(0, 5)):
            b.insert(r.randrange(len(b) + 1), r.randrange(30)) if r.random() < 0.5 else b and b.pop(r.randrange(len(b)))
        got = line_dedup.patience(a, b)
        assert all(a[x] == b[y] for x, y in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))
        if len(set(a)) == len(a) and len(set(b)) == len(b) and a == [x for x in b if x in set(a)]:
            assert len(got) == len(a)
    a, b = [f"l{k}" for k in range(40)], [f"l{k}" for k in range(40) if k % 7]
    same = sum(m.size for m in difflib.SequenceMatcher(None, a, b, False).get_matching_blocks())
    assert len(line_dedup.patience(a, b)) == same


def test_lines_leave_one_copy(spark):
    r = random.Random(2)
    line = lambda k: f"this is the line number {k} of them all"
    base = [line(k) for k in range(30)]
    docs = [(0, "\n".join(base)), (1, "\n".join(["own first line of the second one", *base[5:15], "own last line of the second one"])), (2, "\n".join(base)), (3, None), (4, ""), (5, "\n\n\n"), (6, "short\n" + line(3))]
    docs += [(100 + k, f"page {k} has its very own heading here\nthe same footer line stands on all pages\nand page {k} ends with this") for k in range(60)]
    docs += [(200 + k, "\n".join(line(1000 + j) for j in range(8))) for k in range(300)]  # a large group of copies
    docs += [(None, "a b c d e f\n" * 3), (7, "x" * 100_000)]
    r.shuffle(docs)
    got = {x.id: x for x in line_dedup.without_repeats(spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, id string")).collect()}
    assert len(got) == len(docs)
    assert got[0].n_removed == 0 and got[0].text == "\n".join(base)
    assert got[1].text == "own first line of the second one\nown last line of the second one" and got[1].n_removed == 10
    assert got[2].n_removed == 30 and got[2].text == ""
    assert got[6].text == "short"
    assert all(got[100 + k].n_removed == 0 for k in range(60))  # a footer is no rare line
    assert got[200].n_removed == 0 and all(got[200 + k].n_removed == 8 for k in range(1, 300))
    assert got[3].n_lines == 1 and got[5].n_lines == 4
    assert line_dedup.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def sentences(r, n):
    out, left = [], n
    while left > 0:
        k = min(left, r.randrange(3, 9))
        out.append(" ".join(f"w{r.randrange(4000)}" for _ in range(k)) + ".")
        left -= k
    return " ".join(out)


def test_passages(spark):
    r = random.Random(3)
    shared = [sentences(r, 70) for _ in range(4)]
    docs = [(k, "\n".join([sentences(r, r.randrange(20, 90)), *([shared[k % 4] + (" " + sentences(r, 40) if k % 2 else "")] if k < 80 else []), sentences(r, 50)])) for k in range(120)]
    near = shared[0].split(" ")
    near[33] = "changed"
    docs += [(500, "some words first.\n" + " ".join(near)), (501, None), (502, ""), (503, sentences(r, 30)), (None, "one two three"), (504, "x y " * 30000)]
    got = {x.id: x for x in substring_dedup.without_passages(spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, place string")).collect()}
    assert len(got) == len(docs)
    for k in range(80):
        # the first four keep their passage; the others lose most of it and nothing else
        assert got[k].n_removed == 0 if k < 4 else 35 <= got[k].n_removed <= 72, (k, got[k].n_removed, got[k].n_words)
    assert all(got[k].n_removed == 0 and got[k].text == dict(docs)[k] for k in range(80, 120))
    assert got[500].n_removed == 70 and got[500].text.startswith("some words first.")
    assert got[501].text == "" and got[502].n_words == 0 and got[503].n_removed == 0
    assert got[504].n_words == 60000
    assert substring_dedup.without_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_paragraphs_of_a_passage_do_not_depend_on_their_place():
    r = random.Random(4)
    passage = sentences(r, 90)
    a = substring_dedup.Paragraphs(passage).ids
    b = substring_dedup.Paragraphs("Some other line.\n" + passage.upper().replace(" ", "  ") + " and more words.").ids
    assert len(set(a.tolist()) & set(b.tolist())) >= len(a) - 2
    p = substring_dedup.Paragraphs(passage)
    which, keys = p.keys(6, 3)
    assert keys.shape == (len(which), 6)
    assert 1 - (1 - 0.8**3) ** substring_dedup.bands(80, 0.98) >= 0.98


def test_minhash_estimates_jaccard():
    r = random.Random(5)
    words = [f"w{k}" for k in range(45)]
    other = list(words)
    other[20] = "x"
    a, b = (substring_dedup.Paragraphs(" ".join(w)) for w in (words, other))
    sa, sb = a.signatures(400)[1], b.signatures(400)[1]
    assert len(sa) == len(sb) == 1, (len(sa), len(sb))
    assert abs((sa == sb).mean() - 36 / 46) < 0.08


def test_importance(spark):
    r = random.Random(6)
    good, bad = [f"g{k}" for k in range(50)], [f"b{k}" for k in range(50)]
    docs = [(k, " ".join(r.choice(good if k % 4 else bad) for _ in range(60)), "z") for k in range(400)] + [(900, None, "z"), (901, "", "z"), (None, "g1 g2", "z")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, weight string")
    target = spark.createDataFrame([(k,) for k in range(100) if k % 4] + [(None,), (5,)], "doc_id long")
    got = {x.id: x for x in importance.resample(frame, target, part=0.75).collect()}
    assert len(got) == len(docs) and got[900].weight == 0 and got[901].n_features == 0
    assert sum(x.kept for x in got.values()) == int(np.ceil(0.75 * len(docs)))
    assert all(got[k].kept == (k % 4 > 0) for k in range(400))
    again = {x.id: x.key for x in importance.resample(frame.repartition(7), target, part=0.75).collect()}
    assert all(abs(again[k] - got[k].key) < 1e-6 for k in got)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, target).count() == 0 and importance.resample(frame, target.limit(0)).count() == len(docs)


def test_gumbel_and_kth_largest(spark):
    df = spark.range(20000).select(importance.gumbel(__import__("pyspark.sql.functions").sql.functions.col("id"), 3).alias("x"))
    mean, var = df.selectExpr("avg(x)", "var_samp(x)").head()
    assert abs(mean - 0.5772) < 0.05 and abs(var - np.pi**2 / 6) < 0.1
    values = sorted((x.x for x in df.collect()), reverse=True)
    for k in (1, 2, 777, 19999, 20000, 30000):
        assert importance.kth_largest(df, "x", k, 16) == values[min(k, 20000) - 1]
    ties = spark.createDataFrame([(1.0,)] * 5 + [(2.0,)] * 3, "x double")
    assert [importance.kth_largest(ties, "x", k) for k in (1, 3, 4, 8)] == [2, 2, 1, 1]


def test_equal_passages_inside_lines(spark):
    r = random.Random(8)
    words = lambda n: " ".join(f"w{r.randrange(4000)}" for _ in range(n))
    plain, marked = [words(n) for n in (20, 55, 80, 120)], [sentences(r, n) for n in (20, 55, 80, 120)]
    shared = plain + marked
    docs = [(100 * j + k, f"{sentences(r, 30)} {words(15)} {p} {words(25)} {sentences(r, 30)}") for j, p in enumerate(shared) for k in range(20)]
    r.shuffle(docs)
    got = {x.id: x for x in substring_dedup.without_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for doc, text in docs:
        p = shared[doc // 100]
        if doc % 100 == 0:
            assert got[doc].text == text
        else:  # a paragraph that is nearly the same may take a few words beside it along
            left = set(got[doc].text.split())
            assert len(p.split()) <= got[doc].n_removed <= len(p.split()) + 12, (doc, got[doc].n_removed)
            assert sum(w in left for w in p.split()) <= 8, doc


def test_changed_passages_without_sentences(spark):
    r = random.Random(9)
    words = lambda n: [f"w{r.randrange(4000)}" for _ in range(n)]
    passage = words(160)
    docs = []
    for k in range(20):
        own = list(passage)
        own[60 + k] = f"changed{k}"
        docs.append((k, " ".join(words(40) + own + words(40))))
    got = [x.n_removed for x in substring_dedup.without_passages(spark.createDataFrame(docs, "doc_id long, text string")).orderBy("id").collect()]
    assert got[0] == 0 and min(got[1:]) >= 158, got


def test_repeats_in_one_text_leave_the_first(spark):
    words = [f"w{k}" for k in range(22)]
    docs = [(1, " ".join(words * 2)), (2, "x y " * 100)]
    got = {x.id: x for x in substring_dedup.without_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1].text.split() == words and got[2].n_removed == 180


def test_frequent_lines_and_blocks_of_short_ones(spark):
    r = random.Random(10)
    passage = " ".join(f"w{r.randrange(4000)}" for _ in range(50))
    docs = [(k, f"document {k} starts with words of its own\n{passage}\ndocument {k} ends with words of its own") for k in range(100)]
    # three short lines that the last two share; each of them, and no two of them, stands in an earlier document
    docs += [(200 + k, f"page {k} of it\n{x}\nend {k} of it") for k, x in enumerate(("red green", "blue white", "black brown"))]
    docs += [(k, f"start {k} here\nred green\nblue white\nblack brown\nstop {k} here") for k in (300, 301)]
    # a line of six words in 20 of 2,000 documents is as rare as one in 10 of 1,000
    docs += [(1000 + k, f"sole line {k} there" + ("\nsix words that are here often" + f"\nanother {k} there" if k < 40 and k % 2 == 0 else "")) for k in range(1900)]
    got = {x.id: x for x in line_dedup.without_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[0].n_removed == 0 and all(got[k].n_removed == 1 and passage not in got[k].text for k in range(1, 100))
    assert got[300].n_removed == 0 and got[301].text == "start 301 here\nstop 301 here"
    assert got[1000].n_removed == 0 and all(got[1000 + k].n_removed == 1 for k in range(2, 40, 2))


def test_importance_keeps_the_labelled_share(spark):
    docs = spark.createDataFrame([(k, f"{'bad' if k % 2 else 'good'} words {k % 10}") for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 2 == 0), 0) for k in range(100)], "doc_id long, quality int, toxic int")
    assert importance.report(docs, labels).where("kept").count() == 100
    assert importance.report(docs, labels.limit(0)).where("kept").count() == 200


def test_texts_together_are_cut_as_alone():
    r = random.Random(11)
    texts = [sentences(r, 90), "", "one\ntwo", " ".join(f"w{r.randrange(40)}" for _ in range(400)), "x y " * 40, "\n", sentences(r, 30) + "\n" + sentences(r, 200), " ".join(f"v{k}" for k in range(20))]
    both = substring_dedup.Paragraphs(*texts)
    which, keys = both.keys(4, 2, 10)
    at, seeds = both.seeds(20)
    near = both.beside(at, *(substring_dedup.seed_sizes(20)[::-1]))
    doc, place = both.own(at)
    owner, first = both.own(both.first[which])
    for k, text in enumerate(texts):
        p = substring_dedup.Paragraphs(text)
        own, own_keys = p.keys(4, 2, 10)
        own_at, own_seeds = p.seeds(20)
        assert place[doc == k].tolist() == own_at.tolist() and seeds[doc == k].tolist() == own_seeds.tolist()
        if len(own_at):
            assert all((a[doc == k] == b).all() for a, b in zip(near, p.beside(own_at, *(substring_dedup.seed_sizes(20)[::-1])), strict=True))
        assert first[owner == k].tolist() == p.first[own].tolist() and (keys[owner == k] == own_keys).all()
        assert [both.text(j) for j in which[owner == k]] == [p.text(j) for j in own]
