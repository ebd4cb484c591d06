"""Components against a brute-force version, and how many tables they write."""

import random

import pytest

from stackweave.llm.common import Scratch
from stackweave.llm.components import components


def brute(links):
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for node in sorted(near):
        open_ = [node] * (node not in out)
        while open_:
            if (x := open_.pop()) not in out:
                out[x] = node
                open_ += near[x]
    return out


def shuffled(n, seed=5):
    return random.Random(seed).sample(range(-(10**12), 10**12), n)


def cases():
    draw, ids = random.Random(3), shuffled(400)
    yield "sparse", [(draw.choice(ids), draw.choice(ids)) for _ in range(230)]
    yield "one path", list(zip(ids, ids[1:], strict=False))
    yield "rising path", [(k, k + 1) for k in range(300)]
    yield "hubs on a path", [(ids[k], ids[k % 7]) for k in range(7, 400)] + list(zip(ids[:7], ids[1:7], strict=False))
    yield "copies and own links", [(ids[0], ids[1])] * 50 + [(ids[2], ids[2]), (ids[1], ids[3]), (ids[3], ids[1])]
    yield "none", []


@pytest.mark.parametrize("name, links", list(cases()), ids=lambda x: x if isinstance(x, str) else "")
@pytest.mark.parametrize("most", [None, 3, 40])
def test_components(spark, name, links, most):
    table = spark.createDataFrame(links, "a long, b long").repartition(5)
    got = components(table, Scratch(spark), *[most] * (most is not None)).collect()
    assert len(got) == len({r.id for r in got})
    assert {r.id: r.component for r in got} == brute(links)


def test_few_tables(spark):
    """Each round costs every partition a task, so a few links in many partitions cost what the rounds do."""
    links, scratch = dict(cases())["hubs on a path"], Scratch(spark)
    assert components(spark.createDataFrame(links, "a long, b long").repartition(5), scratch).count() == 400
    assert scratch.n <= 4
