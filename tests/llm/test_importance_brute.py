"""The whole resampling against plain Python, and its figures on labels that it was not given."""

import math
import random

import pytest

from stackweave.llm import importance


def features(text):
    words = text.split()
    single = [int(importance.buckets(w, 1 << 14)[0]) for w in words]
    return single + [int(importance.buckets(f"{a} {b}", 1 << 14)[2]) for a, b in zip(words, words[1:], strict=False)]


def test_weights_and_choice_equal_plain_python(spark):
    r = random.Random(1)
    docs = [(k, " ".join(f"{'g' if k % 3 else 'b'}{r.randrange(40)}" for _ in range(r.randrange(1, 30)))) for k in range(200)] + [(200, ""), (201, None)]
    target = {k for k, _ in docs if k % 3 and k < 150}
    got = {x.id: x for x in importance.resample(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, id string"), spark.createDataFrame([(k,) for k in target], "doc_id long"), part=0.5).collect()}
    counts = [dict.fromkeys(range(1 << 14), 1), dict.fromkeys(range(1 << 14), 1)]
    for k, text in docs:
        for f in features(text or ""):
            counts[1][f] += 1
            counts[0][f] += k in target
    total = [sum(c.values()) for c in counts]
    for k, text in docs:
        own = features(text or "")
        want = sum(math.log(counts[0][f] / total[0]) - math.log(counts[1][f] / total[1]) for f in own)
        assert got[k].n_features == len(own) and abs(got[k].weight - want) < 1e-6
        assert abs(got[k].key - got[k].weight) < 40  # the noise of 202 rows
    keys = sorted((x.key for x in got.values()), reverse=True)
    assert all(x.kept == (x.key >= keys[100]) for x in got.values())


def test_held_out_labels(spark):
    """Half of the labels choose; of the others nearly all good documents stay, and nearly all of low quality go."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = importance.report(spark.read.parquet(f"{sf}/documents.parquet"), labels.where("doc_id % 2 = 0"))
    both = found.join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    good = both[(both.quality == 1) & (both.toxic == 0)]
    poor = both[(both.quality == 0) & (both.toxic == 0)]
    assert len(good) > 50 and good.kept.mean() > 0.85
    assert len(poor) > 10 and poor.kept.mean() < 0.5


@pytest.mark.parametrize("k", [1, 5, 100, 101, 500])
def test_kth_largest(spark, k):
    r = random.Random(k)
    values = [r.choice([r.gauss(0, 1), 1.5, -2.0, r.gauss(0, 1e-9)]) for _ in range(100)]
    want = sorted(values, reverse=True)[k - 1] if k < 100 else min(values)
    assert importance.kth_largest(spark.createDataFrame([(v,) for v in values], "v double"), "v", k, ranges=8) == want
