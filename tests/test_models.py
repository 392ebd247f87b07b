"""Models and series on planted-signal data."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import models as M
from quarry.operators import series as TS


@pytest.fixture(scope="module")
def linear(spark):
    rng = np.random.default_rng(0)
    n = 2000
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    x3 = x1 * 0.98 + rng.normal(scale=0.05, size=n)  # collinear with x1
    y = 3 + 2 * x1 - 1 * x2 + rng.normal(scale=0.1, size=n)
    rows = [tuple(map(float, r)) for r in zip(y, x1, x2, x3, rng.normal(size=n))]
    return spark.createDataFrame(rows, "y double, x1 double, x2 double, x3 double, noise double")


def test_ols_recovers_coefficients_and_matches_spark_ml(linear):
    tab = {r.term: r for r in M.ols(linear, "y", ["x1", "x2"]).collect()}
    assert tab["(Intercept)"].estimate == pytest.approx(3, abs=0.02)
    assert tab["x1"].estimate == pytest.approx(2, abs=0.02)
    assert tab["x2"].p_value < 1e-10 and tab["x1"].r2 > 0.99
    ml = M.ols_spark_ml(linear, "y", ["x1", "x2"])
    assert list(ml.coefficients) == pytest.approx([tab["x1"].estimate, tab["x2"].estimate], rel=1e-6)
    se = ml.summary.coefficientStandardErrors
    assert se[0] == pytest.approx(tab["x1"].std_error, rel=1e-4)
    # centered Gram: intercept and its standard error mapped back to the original scale
    assert ml.intercept == pytest.approx(tab["(Intercept)"].estimate, rel=1e-6)
    assert se[-1] == pytest.approx(tab["(Intercept)"].std_error, rel=1e-4)


def test_ols_large_offsets_stay_exact(spark):
    """Large offsets: the centered Gram keeps full precision (an uncentered normal
    equation, e.g. Spark ML's with standardization off, drifts in the 6th digit here)."""
    rng = np.random.default_rng(9)
    n = 3000
    x = 1e6 + rng.normal(size=n) * 10
    y = 5e5 + 3 * (x - 1e6) + rng.normal(size=n)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, x)], "y double, x double")
    tab = {r.term: r for r in M.ols(df, "y", ["x"]).collect()}
    xc, yc = x - x.mean(), y - y.mean()
    slope = (xc @ yc) / (xc @ xc)
    assert tab["x"].estimate == pytest.approx(slope, rel=1e-12)
    assert tab["(Intercept)"].estimate == pytest.approx(y.mean() - slope * x.mean(), rel=1e-9)


def test_vif_flags_collinear_pair(linear):
    v = {r.term: r.vif for r in M.vif(linear, ["x1", "x2", "x3"]).collect()}
    assert v["x1"] > 50 and v["x3"] > 50 and 1 <= v["x2"] < 1.1


def test_step_aic_and_backward_drop_noise(linear):
    path = M.step_aic(linear, "y", ["x1", "x2", "noise"]).orderBy("step").collect()
    assert "noise" not in path[-1].terms.split(",")
    be = M.backward_eliminate(linear, "y", ["x1", "x2", "x3", "noise"]).orderBy("step").collect()
    final = set(be[-1].terms.split(","))
    assert "noise" not in final and "x2" in final and not {"x1", "x3"} <= final


def test_logit_sign(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=3000)
    y = (rng.random(3000) < 1 / (1 + np.exp(-(0.5 + 2 * x)))).astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, x)], "y int, x double")
    tab = {r.term: r for r in M.logit(df, "y", ["x"]).collect()}
    assert tab["x"].estimate == pytest.approx(2, abs=0.3) and tab["x"].p_value < 1e-6


def test_t_pvalue_known_values():
    from quarry.operators.gram import t_pvalue
    assert t_pvalue(2.228, 10) == pytest.approx(0.05, abs=1e-3)
    assert t_pvalue(0.0, 5) == pytest.approx(1.0)


def _series(spark, values, key="s"):
    return spark.createDataFrame([(key, i + 1, float(v)) for i, v in enumerate(values)], "k string, t int, x double")


def test_ar1_recovered(spark):
    rng = np.random.default_rng(2)
    x = [0.0]
    for _ in range(399):
        x.append(0.6 * x[-1] + rng.normal())
    df = _series(spark, x)
    fit = TS.ar_fit(df, ["k"], "t", "x", max_p=3, max_d=1).first()
    assert fit.d == 0 and fit.p >= 1 and fit.beta[1] == pytest.approx(0.6, abs=0.1)
    pac = {r.lag: r.pacf for r in TS.pacf(TS.acf(df, ["k"], "t", "x", 5), ["k"], 5).collect()}
    assert pac[1] == pytest.approx(0.6, abs=0.1) and abs(pac[2]) < 0.15
    fc = TS.ar_forecast(df, TS.ar_fit(df, ["k"], "t", "x", 3, 1), ["k"], "t", "x", 6).orderBy("t").collect()
    assert [r.t for r in fc] == list(range(401, 407))


def test_seasonal_fit_on_planted_series(spark):
    t = np.arange(1, 61)
    ts = 2 * (t - 1) / 59 - 1
    x = 100 + 10 * np.sin(0.5 * t) + 5 * ts ** 3
    df = _series(spark, x)
    fitted, coef = TS.seasonal_fit(df, ["k"], "t", "x")
    err = fitted.agg(F.max(F.abs(F.col("x") - F.col("fit")))).first()[0]
    assert err < 1e-6


def test_unit_root_statistics(spark):
    walk = np.cumsum(np.random.default_rng(4).normal(size=200))
    noise = np.random.default_rng(0).normal(size=200)
    df = _series(spark, walk, "walk").unionByName(_series(spark, noise, "noise"))
    k = {r.k: r for r in TS.kpss(df, ["k"], "t", "x").collect()}
    assert not k["walk"].stationary_5pct and k["noise"].stationary_5pct

    def kpss_np(x):  # independent statement of the statistic
        n, e = len(x), x - x.mean()
        s, lags = np.cumsum(e), int(np.floor(4 * (n / 100) ** 0.25))
        lr = (e @ e + 2 * sum((1 - j / (lags + 1)) * (e[j:] @ e[:-j]) for j in range(1, lags + 1))) / n
        return s @ s / (n * n * lr)
    assert k["walk"].kpss == pytest.approx(kpss_np(walk)) and k["noise"].kpss == pytest.approx(kpss_np(noise))
    a = {r.k: r for r in TS.adf(df, ["k"], "t", "x").collect()}
    assert a["noise"].stationary_5pct and not a["walk"].stationary_5pct
    assert all(math.isfinite(r.adf) for r in a.values())


def test_mape_and_pick(spark):
    df = spark.createDataFrame([("s", 100.0, 90.0, 99.0), ("s", 200.0, 220.0, 201.0)],
                               "k string, y double, f1 double, f2 double")
    m1 = TS.mape(df, ["k"], "y", "f1").withColumn("method", F.lit("one"))
    m2 = TS.mape(df, ["k"], "y", "f2").withColumn("method", F.lit("two"))
    assert m1.first().mape == pytest.approx(10.0)
    assert TS.pick_model(m1.unionByName(m2), ["k"]).first().method == "two"


def test_binomial_selection_paths(spark):
    rng = np.random.default_rng(6)
    n = 1500
    x1, x2, z = rng.normal(size=n), rng.normal(size=n), rng.normal(size=n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(1.5 * x1 - 1.0 * x2)))).astype(int)
    df = spark.createDataFrame([(int(a), float(b), float(c), float(d)) for a, b, c, d in zip(y, x1, x2, z)],
                               "y int, x1 double, x2 double, z double")
    path = M.step_aic(df, "y", ["x1", "x2", "z"], family="binomial").orderBy("step").collect()
    final = set(path[-1].terms.split(","))
    assert {"x1", "x2"} <= final and path[-1].aic <= path[0].aic
    be = M.backward_eliminate(df, "y", ["x1", "x2", "z"], family="binomial").orderBy("step").collect()
    assert set(be[-1].terms.split(",")) == {"x1", "x2"}


def test_ar_intercept_mapped_back(spark):
    rng = np.random.default_rng(12)
    x = [50.0]
    for _ in range(499):
        x.append(50 + 0.6 * (x[-1] - 50) + rng.normal())
    df = _series(spark, x)
    fit = TS.ar_fit(df, ["k"], "t", "x", max_p=2, max_d=1).first()
    b = fit.beta
    assert fit.d == 0 and b[0] / (1 - sum(b[1:fit.p + 1])) == pytest.approx(50, abs=1.0)
    fc = TS.ar_forecast(df, TS.ar_fit(df, ["k"], "t", "x", 2, 1), ["k"], "t", "x", 1).first()
    expect = b[0] + sum(b[j] * x[-j] for j in range(1, fit.p + 1))
    assert fc.forecast == pytest.approx(expect, rel=1e-9)


def test_wide_gram_matches_the_aggregate(spark):
    from quarry.operators import gram as G
    rng = np.random.default_rng(3)
    m = rng.normal(size=(400, 14)) + 1000
    cols = [f"v{i}" for i in range(14)]
    df = spark.createDataFrame([(*map(float, r),) for r in m] + [(None,) * 14], ", ".join(f"{c} double" for c in cols))
    center = G.column_means(df, cols)
    wide = G.gram_matrix(df, cols[:13], cols[13], center)
    flat = G.unpack(G.gram(df, cols[:13], cols[13], center=center).first().asDict(), 14)
    assert wide[3] == flat[3] == 400
    for a, b in zip(wide[:3], flat[:3]):
        assert np.allclose(a, b, rtol=1e-9, atol=1e-6)


def test_grid_over_width_and_cost_on_rings(spark):
    from quarry.operators import svm as S
    rng = np.random.default_rng(5)
    rows = []
    for i in range(240):
        r, a = (1.0 if i % 2 else 3.0) + rng.normal() * 0.1, rng.uniform(0, 6.28)
        rows.append((i, i % 2, [float(r * np.cos(a)), float(r * np.sin(a))]))
    df = spark.createDataFrame(rows, "id int, y int, v array<double>")
    got = {r.sigma: r for r in S.grid_cv(df, "y", "v", "id", [1.0, 1000.0], [1.0], dim=64, folds=2).collect()}
    assert got[1.0].accuracy > 0.95 and got[1.0].kappa > 0.9  # rings need the kernel
    assert got[1000.0].accuracy < 0.8  # far too wide: nearly constant features
