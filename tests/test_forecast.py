"""Decomposition and ARMA models on planted series."""

import numpy as np
import pytest

from quarry.operators import forecast as FC


def _frame(spark, series):
    return spark.createDataFrame([(k, i + 1, float(v)) for k, xs in series.items() for i, v in enumerate(xs)], "k string, t int, x double")


def _arma(rng, n, phi=0.0, theta=0.0, burn=100):
    e = rng.standard_normal(n + burn)
    z = np.zeros(n + burn)
    for i in range(1, n + burn):
        z[i] = phi * z[i - 1] + e[i] + theta * e[i - 1]
    return z[burn:]


def test_moving_average_terms_of_many_series_in_one_fit(spark):
    rng = np.random.default_rng(12)
    df = _frame(spark, {"arma": 50 + _arma(rng, 1500, 0.6, 0.4), "ima": np.cumsum(_arma(rng, 1500, 0, -0.6)),
                        "white": 3 + rng.standard_normal(600), "ar": _arma(rng, 1500, 0.7), "flat": np.full(40, 2.0), "short": [1.0, 2.0, 1.5]})
    got = {r.k: r for r in FC.arma_fit(df, ["k"], "t", "x", 1, 1).collect()}
    assert (got["arma"].d, got["arma"].p, got["arma"].q) == (0, 1, 1)
    assert abs(got["arma"].phi[0] - 0.6) < 0.08 and abs(got["arma"].theta[0] - 0.4) < 0.08 and abs(got["arma"].mu - 50) < 0.5
    # the smallest AICc may add a needless term to a long series; what it fits stays close
    assert got["ima"].d == 1 and got["ima"].q == 1 and got["ar"].p == 1 and all(abs(got[k].sigma2 - 1) < 0.15 for k in ("ima", "ar", "white"))
    pure = FC.arma_fit(df.where("k = 'ima'"), ["k"], "t", "x", 0, 1).first()
    assert (pure.d, pure.p, pure.q) == (1, 0, 1) and abs(pure.theta[0] + 0.6) < 0.08 and pure.phi == []
    assert got["flat"].d is None and got["short"].d is None


def test_unstable_orders_are_not_eligible():
    assert FC._outside([0.5]) and FC._outside([]) and FC._outside([0.0]) and FC._outside([0.5, 0.3])
    assert not FC._outside([1.0]) and not FC._outside([0.6, 0.5]) and not FC._outside([-1.2])


def test_forecasts_and_psi_errors(spark):
    xs = [float(v) for v in (3, 5, 4, 6, 8, 7, 9, 12)]
    df = _frame(spark, {"a": xs, "b": xs, "none": xs})
    fits = spark.createDataFrame([("a", 0, 1, 1, 5.0, [0.5], [0.3], 4.0), ("b", 1, 0, 1, 1.0, [], [-0.4], 4.0),
                                  ("none", None, None, None, None, None, None, None)],
                                 "k string, d int, p int, q int, mu double, phi array<double>, theta array<double>, sigma2 double")
    got = {(r.k, r.t): r for r in FC.arma_forecast(df, fits, ["k"], "t", "x", 3).collect()}
    e, z = [], [v - 5 for v in xs]
    for i, v in enumerate(z):
        e.append(v - (0.5 * z[i - 1] + 0.3 * e[i - 1] if i else 0.0))
    assert all(got["a", i + 1].value == pytest.approx(x - e[i]) and got["a", i + 1].part == "fitted" for i, x in enumerate(xs))
    one = 0.5 * z[-1] + 0.3 * e[-1]
    assert [got["a", 8 + s].value for s in (1, 2, 3)] == pytest.approx([5 + one, 5 + 0.5 * one, 5 + 0.25 * one])
    half = [got["a", 8 + s].hi - got["a", 8 + s].value for s in (0, 1, 2, 3)]
    assert half == pytest.approx([FC.BAND * 2 * np.sqrt(v) for v in (1, 1, 1 + 0.8 ** 2, 1 + 0.8 ** 2 + 0.4 ** 2)])
    # differences: psi 1, -0.4, 0, ... sums up to 1, 0.6, 0.6
    half = [got["b", 8 + s].value - got["b", 8 + s].lo for s in (1, 2, 3)]
    assert half == pytest.approx([FC.BAND * 2 * np.sqrt(v) for v in (1, 1.36, 1.72)])
    steps = np.diff([12.0] + [got["b", 8 + s].value for s in (1, 2, 3)])
    assert steps[1:] == pytest.approx([1.0, 1.0]) and got["b", 1].value is None
    assert got["none", 9].value is None and got["none", 9].lo is None


def test_chain_on_planted_series(spark):
    """A seasonal trend with autocorrelated noise: the global part finds the trend, the bands hold the months."""
    rng = np.random.default_rng(5)
    t = np.arange(1, 121)
    trend = 200 + 30 * np.sin(0.5 * t) + 0.5 * t
    df = _frame(spark, {k: trend + 2 * _arma(rng, 120, 0.5) for k in ("a", "b", "c")})
    rows = FC.forecast_both(df, ["k"], "t", "x", 6, max_p=1, max_q=1).collect()
    assert len(rows) == 3 * 2 * 120
    dec = [r for r in rows if r.method == "decomposition"]
    assert all(r.lo < r.value + r.local < r.hi and r.actual is not None for r in dec)
    assert np.mean([r.lo <= r.actual <= r.hi for r in dec if r.part == "fitted"]) >= 0.85
    # straight-line ends and cubic terms run off beyond the data, so the future is only near
    assert np.mean([abs(r.value - r.actual) for r in dec if r.part == "future"]) < 25
    mid = [abs(r.value - trend[r.t - 1]) for r in dec if 3 < r.t <= 110]
    assert np.mean(mid) < 6
    parts = FC.decompose(df, ["k"], "t", "x").collect()
    assert all((r.smooth is None) == (r.part == "test") and r.local == pytest.approx(r.x - r.fit) for r in parts)
    tests = FC.residual_tests(df, ["k"], "t", "x", 6, max_p=1, max_q=1).collect()
    assert len(tests) == 6 and all(r.kpss_ok for r in tests)


def test_holdout_is_not_read_by_the_fit(spark):
    t = np.arange(1, 61)
    base = 10 + np.sin(0.5 * t)
    odd = base.copy()
    odd[-6:] = 1e6
    got = {}
    for name, xs in (("base", base), ("odd", odd)):
        got[name] = {r.t: r.fit for r in FC.decompose(_frame(spark, {"a": xs}), ["k"], "t", "x").collect()}
    assert got["base"] == got["odd"]
