"""Many-series forecasting on the monthly order series
(region x segment, gap-free month spine)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators import forecast as FC
from quarry.operators import series as TS
from quarry.plans.registry import query
from quarry.plans.standins import MONTHLY_FILLED_SQL, monthly_filled
from quarry.session import ensure_checkpoint_dir
from quarry.sources.tables import Tables

KEY = ["market", "segment"]
H = 6
MAX_LAG = 12


def _series(spark, sf_dir):
    """The monthly series, materialised once: every statistic below reads it
    several times (per difference order, per lag), and it is a small aggregate."""
    ensure_checkpoint_dir(spark)
    return monthly_filled(Tables(spark, sf_dir)).select(*KEY, "t", "sales").checkpoint(eager=True)


def _with_holdout(spark, sf_dir):
    return TS.holdout(_series(spark, sf_dir), KEY, "t", H)


@query("ts_holdout", section="2.13", sql=f"""
WITH {MONTHLY_FILLED_SQL}
SELECT market, segment, t, CASE WHEN t <= MAX(t) OVER (PARTITION BY market, segment) - {H} THEN 'train' ELSE 'test' END AS part
FROM monthly_filled""")
def ts_holdout(spark, sf_dir):
    return _with_holdout(spark, sf_dir).select(*KEY, "t", "part")


_LAGS_SQL = ", ".join(f"LAG(d, {k}) OVER w AS l{k}" for k in range(1, MAX_LAG + 1))
_SUMS_SQL = ", ".join(f"SUM(d * l{k}) AS a{k}" for k in range(1, MAX_LAG + 1))
_ACF_COLS = ", ".join(f"a{k}" for k in range(1, MAX_LAG + 1))


@query("ts_acf", section="2.13", sql=f"""
WITH {MONTHLY_FILLED_SQL},
d AS (SELECT market, segment, t, sales - AVG(sales) OVER (PARTITION BY market, segment) AS d FROM monthly_filled),
l AS (SELECT *, {_LAGS_SQL} FROM d WINDOW w AS (PARTITION BY market, segment ORDER BY t)),
s AS (SELECT market, segment, SUM(d * d) AS s0, {_SUMS_SQL} FROM l GROUP BY 1, 2)
SELECT market, segment, CAST(replace(k, 'a', '') AS INTEGER) AS lag, ROUND(a / s0, 6) AS acf
FROM s UNPIVOT (a FOR k IN ({_ACF_COLS}))""")
def ts_acf(spark, sf_dir):
    a = TS.acf(_series(spark, sf_dir), KEY, "t", "sales", MAX_LAG)
    return a.withColumn("acf", F.round("acf", 6))


@query("ts_pacf", section="2.13")
def ts_pacf(spark, sf_dir):
    return TS.pacf(TS.acf(_series(spark, sf_dir), KEY, "t", "sales", MAX_LAG), KEY, MAX_LAG)


_SQL_LAGS = 12  # the SQL unrolls the lag sums; trunc(4 (n/100)^(1/4)) needs no more below 8100 months
_KP_PROD = ", ".join(f"e * LAG(e, {s}) OVER w AS p{s}" for s in range(1, _SQL_LAGS + 1))
_KP_SUMS = ", ".join(f"SUM(p{s}) AS g{s}" for s in range(1, _SQL_LAGS + 1))
_KP_LR = " + ".join(f"2 * (CASE WHEN {s} <= lags THEN 1 - {s} / (lags + 1) ELSE 0 END) * COALESCE(g{s}, 0)"
                    for s in range(1, _SQL_LAGS + 1))


@query("ts_kpss", section="2.13", sql=f"""
WITH {MONTHLY_FILLED_SQL},
e AS (SELECT market, segment, t, sales - AVG(sales) OVER (PARTITION BY market, segment) AS e,
             COUNT(*) OVER (PARTITION BY market, segment) AS n FROM monthly_filled),
c AS (SELECT *, SUM(e) OVER (PARTITION BY market, segment ORDER BY t ROWS UNBOUNDED PRECEDING) AS S, {_KP_PROD}
      FROM e WINDOW w AS (PARTITION BY market, segment ORDER BY t)),
a AS (SELECT market, segment, ANY_VALUE(n) AS n, CAST(floor(4 * power(ANY_VALUE(n) / 100.0, 0.25)) AS INTEGER) AS lags,
             SUM(S * S) AS ss, SUM(e * e) AS e0, {_KP_SUMS} FROM c GROUP BY 1, 2),
k AS (SELECT market, segment, n, lags, ss / (n * n * ((e0 + {_KP_LR}) / n)) AS kpss FROM a)
SELECT market, segment, CAST(n AS BIGINT) AS n, lags, ROUND(kpss, 6) AS kpss, kpss < {TS.KPSS_LEVEL_5PCT} AS stationary_5pct
FROM k""")
def ts_kpss(spark, sf_dir):
    k = TS.kpss(_series(spark, sf_dir), KEY, "t", "sales")
    return k.select(*KEY, "n", "lags", F.round("kpss", 6).alias("kpss"), "stationary_5pct")


@query("ts_mape", section="2.13", sql=f"""
WITH {MONTHLY_FILLED_SQL},
f AS (SELECT market, segment, t, sales,
             AVG(sales) OVER (PARTITION BY market, segment ORDER BY t ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS yhat,
             t > MAX(t) OVER (PARTITION BY market, segment) - {H} AS is_test FROM monthly_filled)
SELECT market, segment, ROUND(AVG(abs(100.0 * (sales - yhat) / NULLIF(sales, 0))), 4) AS mape
FROM f WHERE is_test GROUP BY 1, 2""")
def ts_mape(spark, sf_dir):
    s = _with_holdout(spark, sf_dir)
    w = Window.partitionBy(*KEY).orderBy("t").rowsBetween(-3, -1)
    s = s.withColumn("yhat", F.avg("sales").over(w)).where(F.col("part") == "test")
    return TS.mape(s, KEY, "sales", "yhat").withColumn("mape", F.round("mape", 4))


WIDTH = 2  # the smoother averages 2 * WIDTH + 1 months


def _fit_sql() -> str:
    """The seasonal regression in SQL, by successive orthogonalisation instead of normal equations.

    Each step takes the training-month projection on one column off all later columns and off the
    smoothed series, and adds it to the fit; every month is carried along.
    """
    on = "PARTITION BY market, segment"
    ts = f"(2.0 * (t - MIN(t) OVER g) / greatest(MAX(t) FILTER (tr) OVER g - MIN(t) OVER g, 1) - 1)"
    powers = {"t1": "u", "t2": "u * u", "t3": "u * u * u"}
    design = {"s": "sin(0.5 * t)", "c": "cos(0.5 * t)", **powers,
              **{f"{a}_{p}": f"{f}(0.5 * t) * {e}" for a, f in (("s", "sin"), ("c", "cos")) for p, e in powers.items()}}
    keep, k, n = "market, segment, t, tr, sales", WIDTH, len(design)
    ctes = [MONTHLY_FILLED_SQL,
            f"h AS (SELECT market, segment, t, sales, t <= MAX(t) OVER ({on}) - {H} AS tr FROM monthly_filled)",
            f"""a AS (SELECT *, CASE WHEN tr AND COUNT(CASE WHEN tr THEN 1 END) OVER w = {2 * k + 1} THEN AVG(sales) OVER w END AS ma,
                 MAX(t) FILTER (tr) OVER ({on}) AS n FROM h WINDOW w AS ({on} ORDER BY t ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING))""",
            f"""e AS (SELECT *, MAX(ma) FILTER (t = n - {k}) OVER g AS rb, MAX(ma) FILTER (t = n - {k + 1}) OVER g AS rp,
                 MAX(ma) FILTER (t = {k + 1}) OVER g AS lb, MAX(ma) FILTER (t = {k + 2}) OVER g AS ln FROM a WINDOW g AS ({on}))""",
            f"""m AS (SELECT {keep}, CASE WHEN NOT tr THEN NULL WHEN ma IS NOT NULL THEN ma
                 WHEN t > n - {k} THEN rb + (t - (n - {k})) * (rb - rp) ELSE lb - ({k + 1} - t) * (ln - lb) END AS smooth,
                 {ts} AS u FROM e WINDOW g AS ({on}))""",
            f"d AS (SELECT {keep}, smooth, {', '.join(f'{e} AS x{i}' for i, e in enumerate(design.values()))} FROM m)",
            f"""q0 AS (SELECT {keep}, {', '.join(f'x{i} - AVG(x{i}) FILTER (tr) OVER g AS x{i}' for i in range(n))},
                 smooth - AVG(smooth) OVER g AS y, AVG(smooth) OVER g AS fit FROM d WINDOW g AS ({on}))"""]
    for j in range(n):
        part = lambda c: f"COALESCE(SUM({c} * x{j}) FILTER (tr) OVER g / NULLIF(SUM(x{j} * x{j}) FILTER (tr) OVER g, 0), 0) * x{j}"
        later = "".join(f"x{i} - {part(f'x{i}')} AS x{i}, " for i in range(j + 1, n))
        ctes.append(f"q{j + 1} AS (SELECT {keep}, {later}y - {part('y')} AS y, fit + {part('y')} AS fit FROM q{j} WINDOW g AS ({on}))")
    return ",\n".join(ctes) + f",\nglobal AS (SELECT {keep}, fit FROM q{n})"


_FIT_SQL = _fit_sql()


def _parts(spark, sf_dir):
    return FC.decompose(_series(spark, sf_dir), KEY, "t", "sales", H, WIDTH)


@query("ts_seasonal_fit", section="2.13", sql=f"""
WITH {_FIT_SQL}
SELECT market, segment, t, CASE WHEN tr THEN 'train' ELSE 'test' END AS part, ROUND(sales, 2) AS sales, ROUND(fit, 2) AS fit FROM global""")
def ts_seasonal_fit(spark, sf_dir):
    return _parts(spark, sf_dir).select(*KEY, "t", "part", F.round("sales", 2).alias("sales"), F.round("fit", 2).alias("fit"))


@query("ts_residual", section="2.13", sql=f"""
WITH {_FIT_SQL}
SELECT market, segment, t, ROUND(sales - fit, 2) AS resid FROM global WHERE tr""")
def ts_residual(spark, sf_dir):
    return _parts(spark, sf_dir).where(F.col("part") == "train").select(*KEY, "t", F.round("local", 2).alias("resid"))


@query("ts_mape_regression", section="2.13", sql=f"""
WITH {_FIT_SQL}
SELECT market, segment, ROUND(AVG(abs(100.0 * (sales - fit) / NULLIF(sales, 0))), 4) AS mape FROM global WHERE NOT tr GROUP BY 1, 2""")
def ts_mape_regression(spark, sf_dir):
    test = _parts(spark, sf_dir).where(F.col("part") == "test")
    return TS.mape(test, KEY, "sales", "fit").withColumn("mape", F.round("mape", 4))


@query("ts_arma_fit", section="2.13")
def ts_arma_fit(spark, sf_dir):
    train = _with_holdout(spark, sf_dir).where(F.col("part") == "train")
    return FC.arma_fit(train, KEY, "t", "sales")


@query("ts_residual_tests", section="2.13")
def ts_residual_tests(spark, sf_dir):
    return FC.residual_tests(_series(spark, sf_dir), KEY, "t", "sales", H, WIDTH)


def _ar(held):
    train = held.where(F.col("part") == "train")
    fits = TS.ar_fit(train, KEY, "t", "sales", max_p=3, max_d=1)
    return train, fits


@query("ts_ar_fit", section="2.13")
def ts_ar_fit(spark, sf_dir):
    _, fits = _ar(_with_holdout(spark, sf_dir))
    return fits


def _ar_test(held):
    train, fits = _ar(held)
    fc = TS.ar_forecast(train, fits, KEY, "t", "sales", H)
    return fc.join(held.where(F.col("part") == "test").select(*KEY, "t", "sales"), [*KEY, "t"], "left")


@query("ts_forecast", section="2.13")
def ts_forecast(spark, sf_dir):
    """Fitted and held-out months of the decomposition and of the ARMA model, with 95 % bands."""
    return FC.forecast_both(_series(spark, sf_dir), KEY, "t", "sales", H, WIDTH)


@query("ts_forecast_ar", section="2.13")
def ts_forecast_ar(spark, sf_dir):
    return _ar_test(_with_holdout(spark, sf_dir)).select(*KEY, "t", "forecast", "sales")


@query("ts_adf", section="2.13")
def ts_adf(spark, sf_dir):
    return TS.adf(_series(spark, sf_dir), KEY, "t", "sales")


@query("ts_model_pick", section="2.13")
def ts_model_pick(spark, sf_dir):
    series = _series(spark, sf_dir)  # built once for all methods
    future = FC.forecast_both(series, KEY, "t", "sales", H, WIDTH).where(F.col("part") == "future")
    both = TS.mape(future, [*KEY, "method"], "actual", "value")
    ar = TS.mape(_ar_test(TS.holdout(series, KEY, "t", H)), KEY, "sales", "forecast").withColumn("method", F.lit("ar"))
    return TS.pick_model(both.unionByName(ar), KEY)
