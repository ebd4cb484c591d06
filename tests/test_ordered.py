import math
import random

import numpy as np
import pytest

from stackweave.operators import window
from stackweave.plans.ordered import EmaRate, Numbered, scanned


def rows(seed, n=600):
    r = random.Random(seed)
    keys = r.choices(["hot", "a", "b", None, "c"], [8, 1, 1, 1, 0.05], k=n)
    at, out, total = {}, [], {}
    for k in keys:
        at[k] = at.get(k, 0) + 1
        total[k] = total.get(k, 0.0) + r.choice([0, 0, 1.5, 3, -1])
        out.append((k, at[k], total[k]))
    r.shuffle(out)
    return out


def brute(data, alpha=0.2):
    want = {}
    for key in {k for k, _, _ in data}:
        last, ema = None, None
        for t, v in sorted((t, v) for k, t, v in data if k == key):
            if last and v > last[1]:
                rate = (v - last[1]) / (t - last[0])
                ema = rate if ema is None else alpha * rate + (1 - alpha) * ema
            last = (t, v)
            want[key, t] = ema
    return want


@pytest.mark.parametrize("seed", [1, 2])
def test_one_key_over_many_ranges(spark, seed):
    data = rows(seed)
    df = spark.createDataFrame(data, "k string, t long, v double").repartition(3)
    got = {(r.k, r.t): r.ema for r in scanned(df, ["k"], ["t"], EmaRate("t", "v", 0.2), rows_per_task=25).collect()}
    want = brute(data)
    assert set(got) == set(want) and all((got[x] is None) == (y is None) and (y is None or abs(got[x] - y) < 1e-9) for x, y in want.items())
    assert window.ema_rate(df.limit(0), ["k"], "t", "v").count() == 0


def test_numbers_and_running_sums(spark):
    data = rows(3)
    df = spark.createDataFrame(data, "k string, t long, v double")
    got = {(r.k, r.t): (r.n, r.s) for r in scanned(df, ["k"], ["t"], Numbered("n", {"s": "v"}), rows_per_task=40).collect()}
    for key in {k for k, _, _ in data}:
        own = sorted((t, v) for k, t, v in data if k == key)
        for n, ((t, _), s) in enumerate(zip(own, np.cumsum([v for _, v in own]), strict=True)):
            assert got[key, t][0] == n and abs(got[key, t][1] - s) < 1e-9


def test_running_sums_rest_on_no_range(spark):
    r, data = random.Random(6), []
    for key in "ab":
        data += [(key, t, r.choice([0.0, 0.0, None, 0.1, 0.7, 123.37, 3e9])) for t in range(300)]
    df, want = spark.createDataFrame(data, "k string, t long, v double"), {}
    for key in "ab":
        own = [v or 0.0 for k, _, v in data if k == key]
        want |= {(key, t): math.fsum(own[: t + 1]) for t in range(300)}
    for rows_per_task in (7, 64, 10_000):
        e = scanned(df, ["k"], ["t"], Numbered("n", {"s": "v"}), rows_per_task=rows_per_task)
        assert {(x.k, x.t): x.s for x in e.collect()} == want  # bit by bit, so no row without growth looks like growth


def test_sums_that_are_not_finite():
    scan, inf = Numbered("n", {"s": "v"}), float("inf")
    parts = [scan.summary({"v": v}) for v in ([1.0, None], [inf, 2.0], [0.0, -inf])]
    before = scan.combine(parts[0], parts[1])
    assert scan.apply({"v": [inf, 2.0]}, parts[0])["s"] == [inf, inf]
    assert scan.apply({"v": [5.0]}, before) == {"n": [4], "s": [inf]}
    assert math.isnan(scan.apply({"v": [5.0]}, scan.combine(before, parts[2]))["s"][0])


def test_summaries_combine_in_any_grouping():
    r, scan = random.Random(4), EmaRate("t", "v", 0.3)
    for _ in range(50):
        n = r.randint(3, 12)
        t, v = list(range(n)), [float(r.randint(0, 5)) for _ in range(n)]
        i, j = sorted(r.sample(range(1, n), 2))
        part = lambda a, b: scan.summary({"t": t[a:b], "v": v[a:b]})  # noqa: B023, E731
        left = scan.combine(scan.combine(part(0, i), part(i, j)), part(j, n))
        right = scan.combine(part(0, i), scan.combine(part(i, j), part(j, n)))
        whole = part(0, n)
        for x in (left, right):
            assert x[:4] == whole[:4] and all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for a, b in zip(x[4], whole[4], strict=True))


def test_elapsed_of_each_key(spark):
    data = [("a", 1, 500), ("a", 0, 100), (None, 3, 70), (None, 5, 90)]
    got = window.elapsed(spark.createDataFrame(data, "k string, n long, ticks long"), ["k"]).collect()
    assert sorted((str(r.k), r.n, r.elapsed_ns) for r in got) == [("None", 3, 0), ("None", 5, 20_000_000), ("a", 0, 0), ("a", 1, 400_000_000)]
