import numpy as np
import pytest
from pyspark.sql import functions as F

from stackweave.operators import order, scalar
from stackweave.plans.counting import FrameCounter
from stackweave.plans.shuffled import Permutation, random_batches, with_batches
from stackweave.sources import stacks


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [0.0, -0.0, 0.0, 5.0], list(np.random.default_rng(1).normal(size=1001) * 1e-3), [7.0] * 500 + [float(k) for k in range(100)], [-1e300, 1e300, 5e-324, -5e-324, 0.0]])
def test_quantiles_of_a_stack(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double").repartition(3)
    levels = [0.0, 0.02, 0.25, 0.5, 0.9, 1.0]
    [row] = order.stack_quantiles(df, levels).collect()
    with np.errstate(over="ignore"):
        want = np.quantile(values, levels)
    assert np.allclose(row.q, want, rtol=1e-12, atol=0, equal_nan=True) or np.isinf(want).any()


def test_no_task_gets_the_values(spark):
    df = spark.range(100000).select((F.col("id") * 0.5).alias("v"))
    assert "percentile" not in order.stack_quantiles(df, [0.5])._jdf.queryExecution().toString()
    assert order.stack_quantiles(df.limit(0), [0.5]).collect()[0].q == [None]
    with pytest.raises(ValueError):
        order.stack_quantiles(df, [1.5])


def test_order_of_doubles():
    v = np.sort(np.r_[np.random.default_rng(2).normal(size=100), -1e300, 1e300, 0.0, 5e-324, -5e-324])
    assert (np.diff(order.ordered(v)) > 0).all() and order.ordered(np.array([0.0]))[0] == order.ordered(np.array([-0.0]))[0]


def frames(spark, n=37):
    a = np.random.default_rng(3).random((n, 1, 3, 4))
    return a, stacks.from_arrays(spark.createDataFrame([(i, f.ravel().tolist()) for i, f in enumerate(a)], "n long, px array<double>"), "n", "px", 3, 4, n)


def test_counts_without_a_second_job(spark):
    _, pipe = frames(spark)
    counter = FrameCounter()
    counted = pipe | counter.op | scalar.threshold(0.5)
    counted[3:10].write.format("noop").mode("overwrite").save()
    counter.reset()
    counted[3:10].write.format("noop").mode("overwrite").save()
    counted.all().write.format("noop").mode("overwrite").save()
    assert counter.counts == [7, 37] and counter.count == 44
    counter.reset()
    assert counter.count == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 64, 65, 1000])
def test_permutation(n):
    for seed in range(3):
        p = Permutation(n, seed)
        order_ = p.at(np.arange(n))
        assert sorted(order_.tolist()) == list(range(n)) and p.place(order_).tolist() == list(range(n))
    if n > 100:
        assert Permutation(n, 1).at(np.arange(n)).tolist() != Permutation(n, 2).at(np.arange(n)).tolist()
        assert abs(np.corrcoef(np.arange(n), Permutation(n, 1).at(np.arange(n)))[0, 1]) < 0.15
        with pytest.raises(IndexError):
            Permutation(n).at([n])


def test_random_batches(spark):
    a, pipe = frames(spark)
    seen = []
    for numbers, values in random_batches(pipe, 10, seed=5):
        assert np.allclose(values, a[numbers])
        seen += numbers.tolist()
    assert sorted(seen) == list(range(37)) and seen != sorted(seen)
    assert seen == [n for numbers, _ in random_batches(pipe, 10, seed=5) for n in numbers.tolist()]
    rows = with_batches(spark.range(37).select(F.col("id").alias("n")), 37, 10, 5).collect()
    assert [r.n for r in sorted(rows, key=lambda r: (r.batch, r.place))] == seen
    assert [n.tolist() for n, _ in random_batches(pipe, 20, shuffle=False)] == [list(range(20)), list(range(20, 37))]
