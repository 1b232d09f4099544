"""Density curves and fitted distributions against plain numpy."""

import math

import numpy as np
import pytest

from tallyhelix.operators import qc


def plain_bandwidth(x):
    """The rule written out: binned values, cosine sums one by one, and a scan for the least fixed point."""
    margin = max(0.5 * (x.max() - x.min()), 6)
    lo, span = x.min() - margin, x.max() - x.min() + 2 * margin
    at = (x - lo) / span * 1023
    w = np.zeros(1024)
    for v in at:
        w[int(v)] += 1 - (v - int(v))
        w[int(v) + 1] += v - int(v)
    n, k = np.arange(1024), np.arange(1, 1024)
    a = np.array([2 * (w / len(x) * np.cos(np.pi * j * (2 * n + 1) / 2048)).sum() for j in k])
    count = len(np.unique(x))

    def f(s, t):
        return 0.5 * np.pi ** (2 * s) * (k ** (2.0 * s) * a * a * np.exp(-(k**2) * np.pi**2 * t)).sum()

    def best(t):
        v = f(7, t)
        for s in (6, 5, 4, 3, 2):
            odd = np.prod([2 * i - 1 for i in range(1, s + 1)]) / np.sqrt(2 * np.pi)
            v = f(s, (2 * (1 + 0.5 ** (s + 0.5)) / 3 * odd / (count * v)) ** (2 / (3 + 2 * s)))
        return (2 * count * np.sqrt(np.pi) * v) ** -0.4

    t = 1e-9
    while best(t) > t:
        t *= 1.001
    return math.sqrt(t) * span


def mixture(rng, n):
    return np.abs(np.concatenate([rng.exponential(3, n // 2), rng.normal(60, 12, n // 2)]))


def test_density_is_the_sum_of_kernels(spark):
    rng = np.random.default_rng(10)
    x = {0: mixture(rng, 3000), 1: np.abs(rng.normal(50, 15, 800))}
    cells = spark.createDataFrame([(s, float(v)) for s in x for v in x[s]] + [(2, 5.0)] * 30, "s int, fpm double")
    got = {}
    for r in qc.density(cells, 64).collect():
        got.setdefault(r.s, []).append((r.i, r.x, r.y))
    assert set(got) == {0, 1}  # values without a spread have no curve
    for s, v in x.items():
        h, top = plain_bandwidth(v), np.quantile(v, 0.96)
        near = v[v <= top + 3 * h]
        for i, at, y in sorted(got[s]):
            want = (np.exp(-0.5 * ((at - near) / h) ** 2) + np.exp(-0.5 * ((at + near) / h) ** 2)).sum() / (len(near) * h * np.sqrt(2 * np.pi))
            assert at == pytest.approx(i * top / 63) and y == pytest.approx(want, rel=0.02, abs=2e-5)


def test_bandwidths_of_normal_values_are_near_the_best_known():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 10, 5000)
    w = np.histogram(x, 1024, (-80, 80))[0].astype(float)
    assert qc.bandwidth(w, 5000) * 160 == pytest.approx(1.06 * 10 * 5000**-0.2, rel=0.15)
    assert np.allclose(qc.cosines(w[:7]), [2 * (w[:7] * np.cos(np.pi * k * (2 * np.arange(7) + 1) / 14)).sum() for k in range(7)])


@pytest.mark.parametrize("name", ["normal", "exponential", "halfnormal", "lognormal", "gamma", "weibull", "beta", "student", "generalised normal", "logistic", "gumbel"])
def test_the_right_family_comes_first(spark, name):
    rng = np.random.default_rng(11)
    n = 40_000
    x = {
        "normal": lambda: rng.normal(100, 8, n),
        "exponential": lambda: rng.exponential(30, n),
        "halfnormal": lambda: np.abs(rng.normal(0, 20, n)),
        "lognormal": lambda: rng.lognormal(3, 0.7, n),
        "gamma": lambda: rng.gamma(3, 10, n),
        "weibull": lambda: 50 * rng.weibull(4, n),
        "beta": lambda: 80 * rng.beta(0.6, 0.7, n),
        "student": lambda: 100 + 5 * rng.standard_t(3, n),
        "generalised normal": lambda: 100 + 20 * np.sign(rng.random(n) - 0.5) * rng.gamma(1 / 6, 1, n) ** (1 / 6),
        "logistic": lambda: rng.logistic(100, 6, n),
        "gumbel": lambda: rng.gumbel(100, 9, n),
    }[name]()
    rows = [r["name"] for r in qc.fitted_distributions(spark.createDataFrame([(float(v),) for v in x], "fpm double")).collect()]
    # one with more parameters may come closer, as it can take the same shape or nearly
    size = {f: len(kinds) for f, (kinds, *_) in qc.FAMILIES.items()}
    assert not [f for f in rows[: rows.index(name)] if size[f] <= size[name]], rows[:4]


def test_fits_of_nothing_and_of_one_value(spark):
    for rows in ([], [(4.0,)] * 5, [(None,)]):
        assert qc.fitted_distributions(spark.createDataFrame(rows, "fpm double")).collect() == []
    some = qc.fitted_distributions(spark.createDataFrame([(0.0,), (0.0,), (3.0,), (9.0,)], "fpm double")).collect()
    assert {"normal", "laplace"} <= {r["name"] for r in some}


def test_the_simplex_finds_a_minimum():
    at, v = qc.simplex(lambda p: (p[0] - 3) ** 2 + 10 * (p[1] + p[0] - 1) ** 2 if p[0] < 50 else math.inf, [0.0, 0.0])
    assert at == pytest.approx([3, -2], abs=1e-3) and v < 1e-6
