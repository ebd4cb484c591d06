import hashlib
import random
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest

from stackweave.llm import merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(leaves):
    """The root and each leaf's witness, level by level."""
    nodes, proofs = [(x, [k]) for k, x in enumerate(leaves)], [[] for _ in leaves]
    while len(nodes) > 1:
        above = []
        for k in range(0, len(nodes), 8):
            run = nodes[k : k + 8]
            for j, (_, below) in enumerate(run):
                for leaf in below:
                    proofs[leaf].append(("".join(x for x, _ in run[:j]), "".join(x for x, _ in run[j + 1 :])))
            above.append((h("".join(x for x, _ in run)), sum((b for _, b in run), [])))
        nodes = above
    return nodes[0][0], proofs


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    by = defaultdict(list)
    for r in rows:
        d, s, lang, n, t = r
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in t) if t is not None and d is not None and zlib.crc32(str(d).encode()) % 3 == 0 else t
        by[lang].append(((d is not None, d or 0), h("".join(map(field, r))), h("".join(map(field, (d, s, lang, n, lower)))), d))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    below = {}
    for lang in langs:
        by[lang].sort()
        below[lang] = tree([x[1] for x in by[lang]])
    if not langs:
        return []
    root, over = tree([below[x][0] for x in langs])
    out = []
    for lang, up in zip(langs, over, strict=True):
        subroot, proofs = below[lang]
        for (_, leaf, other, d), proof in zip(by[lang], proofs, strict=True):
            whole = proof + up
            for a, b in whole:
                other = h(a + other + b)
            out.append((d, leaf, subroot, root, h("".join(a + b for a, b in whole)), other, other == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 511, 512, 513, 700])
def test_appended_leaves_give_the_tree_and_its_witnesses(n):
    leaves = [h(str(k)) for k in range(n)]
    own = merkle.Frontier()
    for leaf in leaves:
        own.append(leaf)
    root = own.close(merkle._levels(n))
    assert (root, own.witness) == tree(leaves)
    assert all(merkle.fold(x, merkle.unpacked(merkle.packed(w))) == root for x, w in zip(leaves, own.witness, strict=True))


def test_a_completed_run_extends_the_witnesses_of_all_its_leaves():
    own = merkle.Frontier()
    for k in range(64):
        own.append(h(str(k)))
        done = (k + 1) // 8 * 8
        assert all(len(w) >= 1 for w in own.witness[:done]) and all(w == [] for w in own.witness[done:])
    assert all(len(w) == 2 for w in own.witness)


KIND = "doc_id long, source string, lang string, n_chars long, text string, leaf string, key string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], KIND).repartition(3)


def got(docs):
    return sorted(map(tuple, merkle.report(docs).collect()), key=str)


@pytest.mark.parametrize("n", [1, 8, 9, 64, 65, 520])
def test_rounds_of_small_blocks(monkeypatch, n):
    monkeypatch.setattr(merkle, "LEVELS", 1)  # blocks of 8: up to four rounds
    monkeypatch.setattr(merkle, "BLOCK", 8)
    leaves, place = [h(str(k)) for k in range(n)], range(n)
    level, rounds = pa.table({"key": [""] * n, "place": pa.array(place, pa.int64()), "size": pa.array([n] * n, pa.int64()), "leaf": leaves}), []
    while not rounds or len(level) > 1:
        rounds.append(level)
        level = pa.concat_tables([merkle._tops(level.slice(k, 8)) for k in range(0, len(level), 8)])
    assert level.column("leaf")[0].as_py() == tree(leaves)[0]
    above = [""]
    for level in rounds[::-1]:
        blocks = zip(range(0, len(level), 8), above, strict=True)
        above = [merkle.packed(w) for k, path in blocks for _, w, _ in merkle._extended(level.slice(k, 8), pa.table({"path": [path], "root": [""]}))]
    assert [merkle.unpacked(p) for p in above] == tree(leaves)[1]


def test_equals_brute_force(spark):
    r = random.Random(2)
    rows = [(k, r.choice(["web", None]), r.choices(["en", "fr", "de", None, "é"], [60, 20, 1, 5, 2])[0], r.choice([None, 3]), r.choice([None, "", "Abc É", "plain " * 50])) for k in range(120)]
    rows += [rows[3]] * 20 + [(5, "a", "en", 1, "other"), (None, None, None, None, None), (None, "x", "en", 2, "ABC"), (7, "web", "en", 1, "Long " * 200000)]
    want = brute(rows)
    assert got(frame(spark, rows)) == want
    assert {w[-1] for w in want} == {True, False}


def test_two_rounds_and_a_single_leaf(spark):
    rows = [(k, "s", "en", k, f"T{k}") for k in range(5000)] + [(9999, "s", "fr", 1, "one")]
    assert got(frame(spark, rows)) == brute(rows)
    one = [(1, None, None, None, "A")]
    [only] = got(frame(spark, one))
    assert only[1] == only[2] == only[3] and only[4] == h("") and [only] == brute(one)


def test_no_rows(spark):
    assert got(frame(spark, [])) == []
