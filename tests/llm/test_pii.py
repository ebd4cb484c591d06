import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from stackweave.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    """The contract's patterns as they stand."""
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "phone" and not 10 <= len(digits) <= 15 or kind == "card" and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            out.append((*m.span(), kind))
    return sorted(out, key=lambda s: (s[0], [*PATTERNS].index(s[2])))


PIECES = ["a", "b.c", "@", "@@", ".", "-", "+", "+1 (386) 555-8773", "4155030142265802", "41550301422658", "1.2.3.4", "255.0.0.256", "1.2.3.4.5.6.7.8", "0001.2.3.4", "x@y.z", "a@b", "é", " ", "  ", "12", "(", ")", "\n", "%", "_", "😀", "٣"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join))
def test_base_spans(text):
    assert pii.base_spans(text) == plain(text)


def test_long_runs_are_linear():
    for run in ("1" * 300_000, "a" * 300_000, "1." * 150_000, "+1 " * 100_000, "a@" * 100_000, "- " * 100_000):
        pii.candidates(run, pii.base_spans(run))


def test_reliabilities_find_the_good_labelers():
    import numpy as np

    r = np.random.default_rng(1)
    truth = r.random(4000) < 0.4
    rates = [0.95, 0.9, 0.85, 0.8, 0.55]
    counts = {}
    for t in truth:
        k = 0
        for rate in rates:
            k = k * 3 + (2 if r.random() < 0.2 else int(t == (r.random() < rate)))
        counts[k] = counts.get(k, 0) + 1
    p, theta, share = pii.reliabilities(counts)
    good = [theta[1, j, 1] / (theta[1, j, 0] + theta[1, j, 1]) for j in range(5)]
    assert good[0] > good[4] and abs(share[1] - 0.4) < 0.05 and abs(good[0] - 0.95) < 0.05
    assert p[0b0] < 0.01


def test_report(spark):
    secret = 'token = "f4a5fe37efccd68d1e891c0c519f516cd56f8755" and '
    texts = ["no data here", None, "", "mail x.y@ex.com or +1 (386) 555-8773, ip 10.0.0.1 card 4155030142265802", *(secret.replace("f4", f"{k:02x}") + "words" for k in range(40)), "see section 20240101-20240102 of é 123-45-6789", "x" * 200_000]
    docs = spark.createDataFrame([(k, t, "b") for k, t in enumerate(texts)] + [(None, "a@b.cc", "b")], "doc_id long, text string, base string")
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    assert len(got) == len(texts) + 1
    for k, t in [*enumerate(texts), (None, "a@b.cc")]:
        base = plain(t or "")
        text = ",".join(f"{kind}:{s}:{e}" for s, e, kind in base)
        assert got[k].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [got[k][f"n_{kind}"] for kind in PATTERNS] == [sum(s[2] == kind for s in base) for kind in PATTERNS]
        assert set(text.split(",")) <= set(got[k].spans.split(",")) or not text
        starts = [int(s.split(":")[1]) for s in got[k].spans.split(",") if s]
        assert starts == sorted(starts)
    assert all("secret:9:49" in got[k].spans for k in range(4, 44))
    assert pii.report(docs.limit(0)).count() == 0


def labelled(seed, n=1500):
    """Texts with spans that are personal data, and others that look like them: (text, kind, got, whether it is)."""
    import random

    r = random.Random(seed)
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    words = lambda: " ".join(r.choice("the of and to in is that for it as was with on by at from".split()) for _ in range(r.randint(4, 9)))
    word = lambda k: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))

    def card_like(valid):
        while True:
            d = digits(16)
            if pii.luhn(d) == valid and d[0] != "0":
                return d

    made = []
    for _ in range(n):
        kind, true = r.choice(["secret", "number", "handle", "person"]), r.random() < 0.5
        if kind == "secret":
            got = hexes(40) if true else r.choice([f"path/{word(5)}/{word(4)}{digits(2)}/{word(3)}", f"a-{word(4)}-{word(3)}-{word(5)}-{digits(1)}"])
            text = f'{r.choice(["token", "api_key", "secret"])} = "{got}"' if true else f"see {got} and"
        elif kind == "number":
            got = f"{digits(3)}-{digits(2)}-{digits(4)}" if true else r.choice([f"20{digits(2)}-{r.randint(10, 12)}-{r.randint(10, 28)}", card_like(False)])
            text = f"{r.choice(['ssn', 'account', 'passport'])} {got}" if true else f"{r.choice(['version', 'section', 'issue'])} {got}"
        elif kind == "handle":
            got, true = f"@{word(7)}", True
            text = f"by user {got}"
        else:
            got = r.choice(sorted(pii.NAMES)) if true else r.choice(["License", "Monday", "January", "Figure"])
            text = f"{r.choice(['Mr', 'Dr', 'Frau'])} {got} said" if true else f"on {got} of"
        made.append((f"{words()} {text} {words()}", kind, got, true))
    return made


def test_precision_and_recall_of_added_spans(spark):
    made = labelled(1)
    docs = spark.createDataFrame([(k, t) for k, (t, *_) in enumerate(made)], "doc_id long, text string")
    added = {r.id: {(s.split(":")[0], made[r.id][0][int(s.split(":")[1]) : int(s.split(":")[2])]) for s in r.added} for r in pii.find(docs).collect()}
    for kind in pii.ADDED:
        own = [(k, got, true) for k, (_, k2, got, true) in enumerate(made) if k2 == kind]
        hits = sum((kind, got) in added[k] for k, got, true in own if true)
        false = sum((kind, got) in added[k] for k, got, true in own if not true)
        assert hits >= 0.9 * sum(true for *_, true in own), kind
        assert hits >= 0.9 * (hits + false), kind


def test_votes_that_agree_keep_their_side():
    for vote, side in ((1, True), (0, False)):
        for others in ([], [(2, 500)]):
            pattern = int("".join(str(vote) if k in (0, 4) else "2" for k in range(5)), 3)
            counts = {pattern: 157, **{int("22222", 3): n for _, n in others}}
            assert (pii.reliabilities(counts)[0][pattern] > 0.5) == side
