import hashlib
import random

import pytest

from stackweave.llm import periodic_runs


def brute(words):
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            m = j - i + q
            if j > i and m >= max(12, 2 * q) and not any(words[i : i + m - p] == words[i + p : i + m] for p in range(1, q)):
                out.append((i, m, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(r):
    words = [b"%d" % r.randrange(r.choice([1, 2, 3, 5, 20])) for _ in range(r.randint(0, 70))]
    for _ in range(r.randint(0, 3)):
        s, p = r.randrange(len(words) + 1), r.randint(1, 9)
        words[s:s] = ((words[s : s + p] or [b"x"]) * 40)[: r.randint(1, 60)]
    return words


@pytest.mark.parametrize("seed", range(8))
def test_equals_brute_force(seed):
    r = random.Random(seed)
    texts = [some_words(r) for _ in range(150)]
    for k in range(0, len(texts), 5):  # several documents at once: no run crosses them
        assert periodic_runs.runs_of(texts[k : k + 5]) == [brute(t) for t in texts[k : k + 5]]


def test_small_blocks_of_the_lag_scan(monkeypatch):
    monkeypatch.setattr(periodic_runs, "PAIRS", 7)
    r = random.Random(5)
    for _ in range(60):
        words = some_words(r)
        assert periodic_runs.runs_of([words]) == [brute(words)]


def test_rare_words_split_until_nothing_changes():
    # u once: splits; then v and w are alone in their parts, and so on
    text = b"a b a b a b a b a b a b u v a b a b w v c d e f c d".split()
    assert periodic_runs.runs_of([text]) == [[(0, 12, 2)]]


def test_long_texts_are_linear_in_their_repeats():
    words = b"one two three four five six seven eight nine ten".split() * 20000
    assert periodic_runs.runs_of([words]) == [[(0, 200000, 10)]]
    assert periodic_runs.runs_of([[b"x"] * 300000]) == [[(0, 300000, 1)]]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_rows(spark):
    rows = [(1, "a " * 12, "x"), (2, None, "y"), (3, "", "y"), (None, "a b\t" * 7 + "c", "y"), (4, "a b c d e f g", "y"), (1, "a " * 12, "x"), (5, "a b c a b c\x1ca b c", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted(map(tuple, periodic_runs.report(docs).collect()), key=str)
    nothing = [0, None, None, None, None, digest("")]
    want = [
        (1, 1, 0, 12, 1, 12000, digest("0,12,1\n"), digest("a")), (1, 1, 0, 12, 1, 12000, digest("0,12,1\n"), digest("a")), (2, *nothing, digest("")), (3, *nothing, digest("")),
        (None, 1, 0, 14, 2, 7000, digest("0,14,2\n"), digest("a b c")), (4, *nothing, digest("a b c d e f g")), (5, *nothing, digest("a b c a b c\x1ca b c")),
    ]
    assert got == sorted(want, key=str)
    assert periodic_runs.report(docs.limit(0)).count() == 0


def test_planting(spark):
    import zlib

    texts = [" ".join(f"w{k}" for k in range(n)) for n in (0, 1, 5, 40)]
    docs = spark.createDataFrame([(i, texts[i % 4]) for i in range(200)] + [(None, texts[3])], "doc_id long, text string")
    got = {r.doc_id: r.text for r in periodic_runs.planted(docs).collect()}
    changed = 0
    for i in range(200):
        words, h = texts[i % 4].split(), zlib.crc32(str(i).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
            changed += 1
        assert got[i].split() == words
    assert changed > 5 and got[None] == texts[3]
