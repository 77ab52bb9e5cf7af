import math
import random

import numpy as np
import pytest

from lodestone.llm import whitening


def made(n, dim=64, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim)) * np.linspace(0.2, 2, dim)
    base[:, 1] = base[:, 0] + base[:, 1] / 2
    return [(k, v, 1.0, 2, 3) for k, v in enumerate(base.tolist())]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened double, n int, component int")


def plain(rows):
    """By id: deviation, and the whitened vector by another eigen-solver, its sign free."""
    kept = [(r[0], r[1]) for r in rows]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept])
    n, s = len(x), x.sum(axis=0)
    y = (n * x - s) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    top = min(32, x.shape[1])
    return {i: (sum(int(a) ** 2 for a in n * p - s), y[k] @ u[:, :top] / np.sqrt(e[:top])) for k, ((i, _), p) in enumerate(zip(kept, x, strict=True))}, e / e.sum()


def test_equals_another_solver(spark):
    rows = made(300)
    bad = [(1000 + k, v, None, None, None) for k, v in enumerate([None, [], [None] * 64, [float("nan")] + [1.0] * 63, [float("-inf")] * 64, [1.0] * 63])]
    got = whitening.whiten(frame(spark, rows + bad).repartition(7)).collect()
    want, share = plain(rows)
    assert len(got) == 300 * 32 and {r.n for r in got} == {300} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    signs = {}
    for r in got:
        deviation, white = want[r.vec_id]
        assert r.deviation == deviation and abs(r.explained / share[r.component - 1] - 1) < 1e-9
        sign = signs.setdefault(r.component, math.copysign(1, r.whitened * white[r.component - 1]))
        assert abs(r.whitened - sign * white[r.component - 1]) < 1e-8


def test_repeats_nulls_and_no_variance(spark):
    rows = [(7, [0.5, 1.0, 2.0], None, None, None)] * 3 + [(None, [1.5, 1.0, 4.0], None, None, None)]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == 12 and sorted({r.component for r in got}) == [1, 2, 3]
    first = [r for r in got if r.component == 1]
    assert abs(sum(r.whitened**2 for r in first) / 4 - 1) < 1e-9 and {r.whitened for r in got if r.component > 1} == {0.0}
    one = whitening.whiten(frame(spark, rows[:1])).collect()
    assert {(r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(0, 0.0, 0.0, 0.0)}
    assert whitening.whiten(frame(spark, [])).count() == 0 and whitening.whiten(frame(spark, [(1, None, None, None, None)])).count() == 0


def test_moments_merge_as_one():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 5)) * 1000 + 1e6
    whole, parts = whitening.Moments.none(5), []
    whole.add(x)
    for chunk in np.split(x, [1, 20, 20]):
        parts.append(whitening.Moments.none(5))
        parts[-1].add(chunk)
    both = whitening.Moments.none(5)
    for p in parts:
        both.merge(p)
    assert both.n == whole.n == 50
    assert np.allclose(both.covariance(), np.cov(x.T, bias=True)) and np.allclose(whole.covariance(), both.covariance())


@pytest.mark.parametrize("n", [1, 2, 3, 9, 64])
def test_symmetric_qr(n):
    random.seed(n)
    rng = np.random.default_rng(n)
    a = rng.normal(size=(n, n))
    for m in (a + a.T, np.zeros((n, n)), np.eye(n), np.outer(a[0], a[0])):
        d, q = whitening.symmetric_qr(m)
        assert np.allclose(q @ np.diag(d) @ q.T, m, atol=1e-12 * max(1, np.abs(m).max() * n)) and np.allclose(q.T @ q, np.eye(n), atol=1e-12) and (np.diff(d) <= 0).all()
