import numpy as np
import pytest

from stackweave.operators import packed
from stackweave.plans import blocks
from stackweave.plans.blocks import Layout
from stackweave.plans.trace import Bound, trace


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(2)
    a, b = r.random((21, 1, 9, 12)), r.random((17, 1, 10, 11))
    made = [blocks.from_arrays(spark.createDataFrame([(i, f.ravel().tolist()) for i, f in enumerate(x)], "n long, px array<double>").cache(), "n", "px", *x.shape[2:], layout=Layout(4, 3, 5)) for x in (a, b)]
    return a[:, 0], b[:, 0], *made


def windowed(x, k):
    return sum(x[j : len(x) - k + 1 + j] for j in range(k)) / k


def test_a_window_ahead(data):
    a, _, pa, _ = data

    def f(R, a):
        w = a[R.n.start : R.n.stop + 4]
        return sum(w[j : w.shape[0] - 4 + j] for j in range(5)) / 5

    pipe = trace(f, a=pa)
    assert (pipe.shape.n, pipe.shape.y, pipe.shape.x) == (17, 9, 12)
    assert np.allclose(pipe.to_numpy()[:, 0], windowed(a, 5))
    assert np.allclose(pipe.to_numpy((slice(3, 6), 0, slice(2, 4), slice(5, 9))), windowed(a, 5)[3:6, 2:4, 5:9])
    assert pipe.plan.need({"n": (3, 6), "c": (0, 1), "y": (2, 4), "x": (5, 9)})[0] == {"n": (3, 10), "c": (0, 1), "y": (2, 4), "x": (5, 9)}


def test_shared_bounds_of_two_stacks(data):
    a, b, pa, pb = data

    def f(R, a, b):
        before = a[R.n.start - 2 : R.n.stop - 2, ...]
        side = b[R.n, R.y.start + 1 : R.y.stop + 1, R.x.start : R.x.stop]
        return before - side * 2

    pipe = trace(f, Layout(5, 4, 4), a=pa, b=pb)
    # frames 2 to 16 of b meet 0 to 14 of a; rows up to 8 of b's 10 and a's 9; columns up to b's 11
    want = a[0:15, 0:9, 0:11] - 2 * b[2:17, 1:10, 0:11]
    assert pipe.shape.n == 15 and np.allclose(pipe.to_numpy()[:, 0], want)
    assert np.allclose(pipe.to_numpy((slice(2, 9), 0, slice(1, 3))), want[2:9, 1:3])


def test_strides_and_divisions(data):
    a, _, pa, _ = data

    def pairs(R, a):
        w = a[R.n.start * 2 : R.n.stop * 2]
        return (w[0::2] + w[1::2]) / 2

    got = trace(pairs, a=pa)
    assert got.shape.n == 10 and np.allclose(got.to_numpy()[:, 0], (a[0:20:2] + a[1:20:2]) / 2)

    def twice(R, a):
        w = a[R.n.start // 2 : (R.n.stop + 1) // 2]
        return np.repeat(w, 2, 0)[R.n.start % 2 if isinstance(R.n.start, int) else 0 :][: int(R.n.stop) - int(R.n.start)] if isinstance(R.n.start, int) else np.repeat(w, 2, 0)[:3]

    got = trace(twice, a=pa)
    assert got.shape.n == 42 and np.allclose(got.to_numpy()[:, 0], np.repeat(a, 2, 0))


def test_traced_functions_behind_and_before_operators(data):
    a, b, pa, pb = data
    mean = pa | packed.moving_mean(3)
    pipe = trace(lambda R, a, m: a[R.n.start + 1 : R.n.stop + 1] - m[R.n], a=pa, m=mean) | packed.moving_mean(2)
    want = windowed(a[1:20] - windowed(a, 3), 2)
    assert len(pipe.tables) == 1 and np.allclose(pipe.to_numpy()[:, 0], want)
    assert np.allclose(pipe.to_numpy((slice(7, 8),))[:, 0], want[7:8])
    both = trace(lambda R, p, q: p[R.n] + q[R.n], p=pipe, q=pb)
    assert np.allclose(both.to_numpy()[:, 0], want[:17, :9, :11] + b[: len(want[:17]), :9, :11])


@pytest.mark.parametrize(
    ("f", "error"),
    [
        (lambda R, a: a[R.n.start :], ValueError), (lambda R, a: a[3], TypeError), (lambda R, a: a[R.n.start : R.n.stop : 2], ValueError), (lambda R, a: a[..., ...], IndexError),
        (lambda R, a: a[R.n, R.y, R.x, R.x], IndexError), (lambda R, a: a[R.y.start : R.y.start + 3], ValueError), (lambda R, a: np.zeros((3, 4, 5)), ValueError), (lambda R, a: a[R.n.start : R.n.stop + 1], ValueError),
        (lambda R, a: a[10 - R.n.stop : 10 - R.n.start], ValueError),
    ],
)
def test_refused(data, f, error):
    with pytest.raises(error):
        trace(f, a=data[2])


def test_bounds():
    n = Bound("n", 1, 0)
    assert ((n * 3 + 5) // 2).at(4, 9) == 8 and ((n + 1) // 2 + 3).at(4, 9) == 5 and (2 + n - 1).at(4, 9) == 5
    with pytest.raises(ValueError):
        _ = (n // 2) * 2
