"""Personal data by weak supervision.

Four base kinds (email, ip, card, phone) are found by pattern and check, and always stay. Beyond them candidate spans
are taken from each text: keys and tokens, numbers of eight digits or more, handles and names. Labelers vote on each
candidate, yes, no or not at all: shape patterns, a gazetteer of names and one of words that only look like names, the
words before the span, the characters around it, and its mix of characters. Expectation-maximisation estimates how
reliable each labeler is, for spans that are personal data and for others, from the counts of vote patterns of one kind of
span. A labeler that does not vote says nothing, and none is taken to be worse than chance, so spans on which all votes
agree keep the side that they agree on. The probabilities that follow are the labels of the final classifier, a naive Bayes
model of the features of spans of that kind, which decides. Vote patterns and features are bounded in number; only their sums are collected.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, id_back, rows, slices

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "number", "handle", "person")
KINDS = (*BASE, *ADDED)

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain, each found from its @, so that long runs without one cost nothing."""
    out, end = [], 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < m.start():
            out.append((start, m.end()))
            end = m.end()
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """start, end, kind of the base kinds, by start and then kind."""
    out = []
    if "@" in text:
        out += [(s, e, "email") for s, e in emails(text)]
    if _DIGIT.search(text):
        out += [(*m.span(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
        out += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


#: Gazetteers and context words: given names, capitalised words that are no names, words before personal data, and
#: words before other numbers.
NAMES = frozenset("James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Daniel Nancy Matthew Lisa Anthony Betty Mark Margaret Paul Sandra Steven Ashley Andrew Emily Kenneth Donna George Carol Kevin Amanda Brian Melissa Edward Deborah Laura Anna Maria Peter Hans Klaus Jürgen Wolfgang Stefan Andreas Petra Sabine Monika Ursula Jean Pierre Michel Philippe Nathalie Isabelle Sylvie Jose José Antonio Manuel Francisco Carmen Ana Isabel Juan Carlos Luis Pedro".split())
NOT_NAMES = frozenset("License Public Apache General Creative Commons Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December Version Chapter Figure Table".split())
TITLES = frozenset("mr mrs ms dr prof sir herr frau señor señora monsieur madame mme sr sra".split())
_PERSONAL = NAMES | frozenset(t.capitalize() for t in TITLES)
PRIVATE = frozenset("password passwd pwd token secret key apikey api_key access_key auth bearer ssn passport iban account card phone tel telephone mobile call fax email mail contact name user username login id born".split())
PUBLIC = frozenset("version page pages isbn issn doi rfc section chapter figure table year line lines issue volume build revision commit sha".split())

_TOKEN = re.compile(r"[A-Za-z0-9_+/=-]{12,}")
_NUMBER = re.compile(r"[0-9](?:[ ./-]?[0-9]){7,}")
_HANDLE = re.compile(r"(?<![\w.@])@[A-Za-z]\w{2,}")
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+")
_WORD = re.compile(r"[\w-]+")
_SEPARATORS = re.compile(r"[ ./-]")

LABELERS = ("shape", "names", "before", "around", "mix")
FEATURES = 4096


def _before(text: str, start: int) -> list[str]:
    """Up to three words before a place, the nearest first."""
    return [w.lower() for w in _WORD.findall(text[max(0, start - 48) : start])[-3:]][::-1]


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans that may be personal data and overlap no base span or earlier candidate."""
    found = []
    if _DIGIT.search(text):
        found += [(*m.span(), "secret") for m in _TOKEN.finditer(text) if _DIGIT.search(m[0]) and any(c.isalpha() for c in m[0])]
        found += [(*m.span(), "number") for m in _NUMBER.finditer(text)]
    if "@" in text:
        found += [(*m.span(), "handle") for m in _HANDLE.finditer(text)]
    if not _PERSONAL.isdisjoint(_CAPITAL.findall(text)):
        for m in _CAPITAL.finditer(text):
            if m[0] in NAMES or (prior := _before(text, m.start())[:1]) and prior[0] in TITLES:
                found.append((*m.span(), "person"))
    out, end, taken = [], 0, [(s, e) for s, e, _ in base]
    k = 0
    for s, e, kind in sorted(found, key=lambda c: (c[0], -c[1])):
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        if s >= end and not any(a < e and s < b for a, b in taken[k : k + 4]):
            out.append((s, e, kind))
            end = e
    return out


def votes(text: str, span: tuple[int, int, str]) -> list[int]:
    """1 (yes), 0 (no) or 2 (no vote) of each labeler."""
    s, e, kind = span
    got, prior = text[s:e], _before(text, s)
    digits = sum(c.isdigit() for c in got)
    plain = _SEPARATORS.sub("", got)
    shape = 2
    if kind == "secret":
        shape = 1 if re.fullmatch(r"(?:[0-9a-f]{16,}|[0-9A-F]{16,})", got) else 0 if "/" in got or got.count("-") > 2 else 2
    elif kind == "number":
        shape = 0 if re.fullmatch(r"(?:19|20)[0-9]{2}[./-][0-9]{2}[./-][0-9]{2}", got) else 1 if re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", got) else 2
        if 13 <= len(plain) <= 19 and plain.isdigit():
            shape = int(luhn(plain))  # as long as a card's number: one, or none
    elif kind == "handle":
        shape = 1
    names = (1 if got in NAMES else 0 if got in NOT_NAMES else 2) if kind == "person" else 2
    before = 1 if any(w in PRIVATE or w in TITLES for w in prior) else 0 if any(w in PUBLIC for w in prior) else 2
    left, right = text[s - 1 : s], text[e : e + 1]
    around = 1 if left in "=:\"'" and left or right in "\"'" and right else 0 if left.isalnum() or right.isalnum() or left in "/#" and left else 2
    mix = 2
    if kind in ("secret", "number"):
        distinct = len(set(plain)) / min(len(plain), 16 if kind == "secret" else 10)
        mix = 0 if distinct < 0.3 else 1 if kind == "secret" and distinct > 0.5 and digits >= len(plain) / 4 else 2
    return [shape, names, before, around, mix]


def _hashed(kind: str, *parts) -> int:
    """A feature's place among those of its kind of span."""
    size = FEATURES // len(ADDED)
    return ADDED.index(kind) * size + int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=4).digest(), "little") % size


def features(text: str, span: tuple[int, int, str]) -> list[int]:
    """Hashed features of a span and what stands around it."""
    s, e, kind = span
    got, prior = text[s:e], _before(text, s)
    shape = re.sub(r"(.)\1+", r"\1", "".join("9" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c for c in got))[:12]
    digits = _SEPARATORS.sub("", got)
    sum_fits = luhn(digits) if digits.isdigit() and digits.isascii() else None
    return [_hashed(kind, n, v) for n, v in (("length", len(got).bit_length()), ("shape", shape), ("word", prior[0] if prior and prior[0] in PRIVATE | PUBLIC | TITLES else "-"), ("left", text[s - 1 : s]), ("right", text[e : e + 1]), ("name", got in NAMES), ("sum", sum_fits))]


_FOUND = pa.schema(
    [("id", pa.int64()), ("base", pa.list_(pa.string())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("kinds", pa.list_(pa.int32())), ("patterns", pa.list_(pa.int32())), ("features", pa.list_(pa.list_(pa.int32())))]
)


def _extract(batches):
    for b in slices(batches):
        out = [[] for _ in _FOUND]
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            base = base_spans(text)
            more = candidates(text, base)
            row = (
                doc, [f"{k}:{s}:{e}" for s, e, k in base], [c[0] for c in more], [c[1] for c in more], [KINDS.index(c[2]) for c in more],
                [functools.reduce(lambda a, v: a * 3 + v, votes(text, c), 0) for c in more], [features(text, c) for c in more],
            )
            for column, value in zip(out, row, strict=True):
                column.append(value)
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, _FOUND, strict=True)], schema=_FOUND)


#: What is taken for granted of a labeler that votes: so many right and wrong votes on either class.
_RIGHT, _WRONG = 4.0, 1.0


def reliabilities(counts: dict[int, int], rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns: the probability of each pattern, and by class, labeler and vote.

    It starts from the majority of the votes, which also decides what the two classes mean. Labelers that do not vote are
    left out of a span's likelihood. Returns the probability that a span with the pattern is personal data, theta[class,
    labeler, vote], where the third vote is not to vote, alike in both classes, and the classes' shares.
    """
    patterns = np.array([*itertools.product(range(3), repeat=len(LABELERS))])
    n = np.array([counts.get(k, 0) for k in range(len(patterns))], float)
    cast = np.stack([patterns == v for v in (0, 1)])  # vote, pattern, labeler
    yes, no = (patterns == 1).sum(1), (patterns == 0).sum(1)
    p = (yes + 0.5) / (yes + no + 1)
    right, share = np.full((2, len(LABELERS)), _RIGHT / (_RIGHT + _WRONG)), np.full(2, 0.5)
    for _ in range(rounds if n.sum() else 0):
        weight = np.stack([n * (1 - p), n * p])
        share = (weight.sum(1) + 1) / (n.sum() + 2)
        for c in (0, 1):
            own, other = weight[c] @ cast[c], weight[c] @ cast[1 - c]
            right[c] = (own + _RIGHT) / (own + other + _RIGHT + _WRONG)
        below = np.maximum(1 - right.sum(0), 0) / 2  # more often yes for what isn't: then it says nothing
        right += below
        like = [(cast[c] * np.log(right[c]) + cast[1 - c] * np.log1p(-np.minimum(right[c], 1 - 1e-9))).sum(1) for c in (0, 1)]
        log = np.log(share)[:, None] + np.stack(like)
        p = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
    quiet = (n @ (patterns == 2) + 1) / (n.sum() + 3)
    theta = np.empty((2, len(LABELERS), 3))
    for c in (0, 1):
        theta[c, :, c], theta[c, :, 1 - c], theta[c, :, 2] = right[c] * (1 - quiet), (1 - right[c]) * (1 - quiet), quiet
    return p, theta, share


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """id, base, added of each document: arrays of kind:start:end in code points, the end exclusive.

    A null or empty text has no spans. Documents are read once; candidates, votes and features are written between.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    kept = scratch.keep(rows(docs, id_col, text_col).mapInArrow(_extract, "id long, base array<string>, starts array<int>, ends array<int>, kinds array<int>, patterns array<int>, features array<array<int>>"))
    each = kept.where("size(patterns) > 0").select(F.explode(F.arrays_zip("kinds", "patterns", "features")).alias("c")).select("c.*")
    counts: dict[int, dict[int, int]] = {}
    for r in each.groupBy("kinds", "patterns").agg(F.count(F.lit(1)).alias("n")).collect():  # kinds times 3 ** labelers at most
        counts.setdefault(r.kinds, {})[r.patterns] = r.n
    size, p, share = 3 ** len(LABELERS), np.full((len(KINDS), 3 ** len(LABELERS)), 0.5), np.full((len(KINDS), 2), 0.5)
    for kind, own in counts.items():
        p[kind], _, share[kind] = reliabilities(own)
    label = F.element_at(F.array(*(F.lit(float(x)) for x in p.ravel())), F.col("kinds") * size + F.col("patterns") + 1)
    sums = each.select(label.alias("p"), F.explode("features").alias("f")).groupBy("f").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()  # FEATURES at most
    table = np.zeros((2, FEATURES))
    for r in sums:
        table[:, r.f] = r.no, r.yes
    ratio, per = np.zeros(FEATURES), FEATURES // len(ADDED)
    for kind, own in counts.items():
        part = slice((kind - len(BASE)) * per, (kind - len(BASE) + 1) * per)
        total = [sum((1 - p[kind][k]) * n for k, n in own.items()), sum(p[kind][k] * n for k, n in own.items())]
        ratio[part] = np.log((table[1, part] + 0.5) / (total[1] + 1)) - np.log((table[0, part] + 0.5) / (total[0] + 1))
    model = spark.sparkContext.broadcast((ratio, np.log(share[:, 1]) - np.log(share[:, 0]), float(np.log(threshold / (1 - threshold)))))

    @F.pandas_udf("array<string>")
    def decide(starts: pd.Series, ends: pd.Series, kinds: pd.Series, marks: pd.Series) -> pd.Series:
        weights, prior, least = model.value
        return pd.Series([[f"{KINDS[k]}:{s}:{e}" for s, e, k, f in zip(*c, strict=True) if prior[k] + sum(weights[x] for x in f) > least] for c in zip(starts, ends, kinds, marks, strict=True)], dtype=object)

    some = kept.where("size(starts) > 0").select("id", "base", decide("starts", "ends", "kinds", "features").alias("added"))
    none = kept.where("size(starts) = 0").select("id", "base", F.array().cast("array<string>").alias("added"))
    return some.unionByName(none)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of each document."""
    found = find(docs)
    order = F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(n)) for n, k in enumerate(KINDS)))

    def keyed(s):
        parts = F.split(s, ":")
        return F.struct(F.get(parts, 1).cast("int").alias("start"), F.element_at(order, F.get(parts, 0)).alias("kind"), s.alias("s"))

    spans = F.transform(F.array_sort(F.transform(F.concat("base", "added"), keyed)), lambda x: x.s)

    def count(kind):
        return F.size(F.filter("base", lambda s: s.startswith(f"{kind}:"))).cast("long").alias(f"n_{kind}")

    n = [count(kind) for kind in BASE]
    return found.select(id_back("id", "doc_id"), *n, F.sha2(F.array_join("base", ",").cast("binary"), 256).alias("base_sha256"), F.array_join(spans, ",").alias("spans"), F.size("added").cast("long").alias("n_added"))
