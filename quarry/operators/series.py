"""Many monthly series at once.

A series is keyed rows ``(key..., t, x)``: one row per key and month,
already aggregated, so one series is bounded by the calendar no matter
how large the raw data is.  Statistics expressible in SQL (holdout, ACF,
KPSS, MAPE) are window/aggregate expressions.  Fits use the Gram
primitive per key, and the small per-series solves and recursions run in
``applyInPandas`` over those bounded groups.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators import gram as G

# Published 5 % critical values.
KPSS_LEVEL_5PCT = 0.463          # KPSS level-stationarity test
ADF_TREND_5PCT = -3.45           # Dickey-Fuller with constant and trend, n about 50-100


def _w(key: Sequence[str], t: str):
    return Window.partitionBy(*key).orderBy(t)


def _schema_of(df: DataFrame, cols: Sequence[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in cols)


def holdout(df: DataFrame, key: Sequence[str], t: str, h: int = 6, name: str = "part") -> DataFrame:
    """Last ``h`` points of each series are ``test``, the rest ``train``."""
    last = F.max(t).over(Window.partitionBy(*key))
    return df.withColumn(name, F.when(F.col(t) <= last - h, "train").otherwise("test"))


# --------------------------------------------------------------------------- seasonal regression

SEASONAL_TERMS = ["s", "c", "t1", "t2", "t3", "s_t1", "s_t2", "s_t3", "c_t1", "c_t2", "c_t3"]


def seasonal_design(df: DataFrame, key: Sequence[str], t: str, scale_from: str | None = None) -> DataFrame:
    """sin(0.5 t), cos(0.5 t), a cubic in t scaled to [-1, 1] per series, and their products.

    ``t`` runs from 1 in each series.  The scale uses the training span
    (rows where ``scale_from`` is not NULL), so future rows extrapolate.
    """
    g = Window.partitionBy(*key)
    base = F.col(t) if scale_from is None else F.when(F.col(scale_from).isNotNull(), F.col(t))
    lo, hi = F.min(base).over(g), F.max(base).over(g)
    ts = (F.lit(2.0) * (F.col(t) - lo) / F.greatest(hi - lo, F.lit(1)) - 1)
    # one projection per dependency level (long withColumn chains re-analyse the plan each time)
    out = df.withColumns({"s": F.sin(0.5 * F.col(t)), "c": F.cos(0.5 * F.col(t)), "_ts": ts})
    out = out.withColumns({"t1": F.col("_ts"), "t2": F.col("_ts") ** 2, "t3": F.col("_ts") ** 3}).drop("_ts")
    return out.withColumns({f"{a}_{p}": F.col(a) * F.col(p) for a in ("s", "c") for p in ("t1", "t2", "t3")})


def _dot(cols: Sequence[str], beta: Column) -> Column:
    """Intercept + sum(beta[i+1] * col_i) for an array column ``beta``."""
    expr = F.get(beta, 0)
    for i, c in enumerate(cols):
        expr = expr + F.get(beta, i + 1) * F.col(c)
    return expr


def gram_solve_by(gram_df: DataFrame, keys: Sequence[str], p: int, extra: dict | None = None) -> DataFrame:
    """Least squares per group from a Gram table: (keys..., beta array, rss, n, se array)."""
    keys = list(keys)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        xtx, xty, yty, n = G.unpack(row, p)
        beta, rss, se, k, dof = G.ols_solve(xtx, xty, yty, n)
        out = {k_: [row[k_]] for k_ in keys}
        out |= {"beta": [beta.tolist()], "se": [se.tolist()], "rss": [rss], "n": [n], "rank": [k]}
        return pd.DataFrame(out)

    schema = f"{_schema_of(gram_df, keys)}, beta array<double>, se array<double>, rss double, n long, rank int"
    return gram_df.groupBy(*keys).applyInPandas(solve, schema)


def seasonal_fit(df: DataFrame, key: Sequence[str], t: str, x: str, train: Column | None = None,
                 name: str = "fit") -> tuple[DataFrame, DataFrame]:
    """Fit the seasonal regression per series on the training rows.

    Returns (rows with the fitted/forecast value ``name``, coefficients per series).
    """
    key = list(key)
    flagged = df.withColumn("_train", F.when(train, F.lit(1)) if train is not None else F.lit(1))
    d = seasonal_design(flagged, key, t, scale_from="_train")
    # center each series on its training means (one bounded series per window), so the
    # Gram sums stay well conditioned whatever the level of the series; rows in the order
    # of t, so no sum depends on how Spark joined and dealt them
    cols = SEASONAL_TERMS + [x]
    g = Window.partitionBy(*key).orderBy(t).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = d.withColumns({f"_m_{c}": F.avg(F.when(F.col("_train") == 1, F.col(c))).over(g) for c in cols})
    d = d.withColumns({f"_c_{c}": F.col(c) - F.col(f"_m_{c}") for c in cols})
    centered = [f"_c_{c}" for c in SEASONAL_TERMS]
    gdf = G.gram(d.where(F.col("_train") == 1), centered, f"_c_{x}", by=key)
    coef = gram_solve_by(gdf, key, len(SEASONAL_TERMS) + 1)
    out = d.join(coef.select(*key, "beta"), key) \
        .withColumn(name, F.col(f"_m_{x}") + _dot(centered, F.col("beta")))
    return out.drop("beta", "_train", *SEASONAL_TERMS, *[f"_m_{c}" for c in cols],
                    *[f"_c_{c}" for c in cols]), coef


def residual(df: DataFrame, x: str, fit: str, name: str = "resid") -> DataFrame:
    return df.withColumn(name, F.col(x) - F.col(fit))


# --------------------------------------------------------------------------- autocorrelation

def acf(df: DataFrame, key: Sequence[str], t: str, x: str, max_lag: int) -> DataFrame:
    """Sample autocorrelation per series and lag (overall mean, divisor n): (key..., lag, acf).

    A constant series has NULL autocorrelations.
    """
    key = list(key)
    g = Window.partitionBy(*key)
    d = df.withColumn("_d", F.col(x) - F.avg(x).over(g))
    w = _w(key, t)
    d = d.withColumns({f"_l{k}": F.lag("_d", k).over(w) for k in range(1, max_lag + 1)})
    sums = d.groupBy(*key).agg(F.sum(F.col("_d") * F.col("_d")).alias("_s0"),
                               *[F.sum(F.col("_d") * F.col(f"_l{k}")).alias(f"a{k}") for k in range(1, max_lag + 1)])
    long = sums.select(*key, "_s0", *[F.try_divide(F.col(f"a{k}"), F.col("_s0")).alias(str(k)) for k in range(1, max_lag + 1)]) \
        .unpivot([*key, "_s0"], [str(k) for k in range(1, max_lag + 1)], "lag", "acf")
    return long.select(*key, F.col("lag").cast("int").alias("lag"), "acf")


def pacf(acf_df: DataFrame, key: Sequence[str], max_lag: int) -> DataFrame:
    """Partial autocorrelation by the Durbin-Levinson recursion over each series' ACF."""
    key = list(key)

    def dl(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lag")
        r = np.concatenate([[1.0], pdf["acf"].to_numpy(dtype=float)])
        m = min(max_lag, len(r) - 1)
        phi = np.zeros((m + 1, m + 1))
        out = []
        for k in range(1, m + 1):
            if k == 1:
                phi[1, 1] = r[1]
            else:
                num = r[k] - np.dot(phi[k - 1, 1:k], r[1:k][::-1])
                den = 1.0 - np.dot(phi[k - 1, 1:k], r[1:k])
                phi[k, k] = num / den if den != 0 else np.nan
                phi[k, 1:k] = phi[k - 1, 1:k] - phi[k, k] * phi[k - 1, 1:k][::-1]
            out.append(phi[k, k])
        res = pd.DataFrame({"lag": np.arange(1, m + 1, dtype="int32"), "pacf": out})
        for k_ in key:
            res.insert(0, k_, pdf[k_].iloc[0])
        return res

    schema = f"{_schema_of(acf_df, key)}, lag int, pacf double"
    return acf_df.groupBy(*key).applyInPandas(dl, schema)


# --------------------------------------------------------------------------- unit-root statistics

def kpss(df: DataFrame, key: Sequence[str], t: str, x: str) -> DataFrame:
    """KPSS level-stationarity statistic per series with a Bartlett long-run variance.

    Lag truncation l = trunc(4 (n/100)^(1/4)), each series to its own l.  A constant series has a
    NULL statistic.  Returns (key..., n, lags, kpss, stationary_5pct).
    """
    key = list(key)
    g = Window.partitionBy(*key)
    w = _w(key, t)
    d = df.withColumns({"_e": F.col(x) - F.avg(x).over(g), "_n": F.count(F.lit(1)).over(g)})
    d = d.withColumns({
        "_S": F.sum("_e").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "_lags": F.floor(F.lit(4.0) * F.pow(F.col("_n") / 100.0, 0.25)).cast("int")})
    agg = d.groupBy(*key).agg(F.first("_n").alias("n"), F.first("_lags").alias("lags"),
                              F.sum(F.col("_S") * F.col("_S")).alias("_ss"),
                              F.sum(F.col("_e") * F.col("_e")).alias("_e0"),
                              F.transform(F.array_sort(F.collect_list(F.struct(t, "_e"))), lambda r: r["_e"]).alias("_es"))

    def lagged(s):  # sum of e_t e_{t-s} over one series, whose months are one array
        m = F.size("_es") - s
        return F.aggregate(F.zip_with(F.slice("_es", 1, m), F.slice("_es", s + 1, m), lambda a, b: a * b),
                           F.lit(0.0), lambda a, v: a + v)

    lr = F.when(F.col("lags") < 1, F.col("_e0")).otherwise(F.aggregate(
        F.sequence(F.lit(1), F.greatest("lags", F.lit(1))), F.col("_e0"),
        lambda a, s: a + 2 * (1 - s / (F.col("lags") + 1)) * lagged(s)))
    lr = lr / F.col("n")
    stat = F.try_divide(F.col("_ss"), F.col("n") * F.col("n") * lr)
    return agg.select(*key, "n", "lags", stat.alias("kpss")) \
        .withColumn("stationary_5pct", F.col("kpss") < KPSS_LEVEL_5PCT)


def differenced(df: DataFrame, key: Sequence[str], t: str, x: str, d: int, name: str) -> DataFrame:
    w = _w(key, t)
    out = df.withColumn(name, F.col(x))
    for _ in range(d):
        out = out.withColumn(name, F.col(name) - F.lag(name, 1).over(w))
    return out


def adf(df: DataFrame, key: Sequence[str], t: str, x: str) -> DataFrame:
    """Augmented Dickey-Fuller t-ratio (constant + trend), lag k = trunc((n-1)^(1/3)).

    Regression of Δy_t on 1, t, y_{t-1}, Δy_{t-1..t-k} per series, one Gram
    aggregate; lags beyond a series' own k are zero.  The largest k of all series sets the number
    of lag columns (one small job while the plan is built).  Returns (key..., n, lags, adf, stationary_5pct).
    """
    key = list(key)
    g = Window.partitionBy(*key)
    w = _w(key, t)
    lag_order = lambda n: F.floor(F.pow(n - 1.0, 1.0 / 3.0) + 1e-9).cast("int")
    max_k = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.max(lag_order(F.col("n")))).first()[0] or 0
    d = df.withColumns({"_n": F.count(F.lit(1)).over(g), "_i": F.row_number().over(w),
                        "_y1": F.lag(x, 1).over(w)})
    d = d.withColumns({"_k": lag_order(F.col("_n")),
                       "_dy": F.col(x) - F.col("_y1")})
    d = d.withColumns({f"_dl{j}": F.when(F.lit(j) <= F.col("_k"), F.lag("_dy", j).over(w)).otherwise(0.0)
                       for j in range(1, max_k + 1)})
    d = d.where(F.col("_i") > F.col("_k") + 1).withColumn("_tt", F.col("_i").cast("double"))
    terms = ["_tt", "_y1"] + [f"_dl{j}" for j in range(1, max_k + 1)]
    # per-series centering (the t-ratio of y_{t-1} is unchanged; the sums stay small)
    d = d.withColumns({c: F.col(c) - F.avg(c).over(g) for c in terms + ["_dy"]})
    gdf = G.gram(d, terms, "_dy", by=key)
    fits = gram_solve_by(gdf, key, len(terms) + 1)
    ks = d.groupBy(*key).agg(F.first("_k").alias("lags"))
    stat = F.try_divide(F.get("beta", 2), F.get("se", 2))
    return fits.join(ks, key).select(*key, "n", "lags", stat.alias("adf")) \
        .withColumn("stationary_5pct", F.col("adf") < ADF_TREND_5PCT)


# --------------------------------------------------------------------------- AR models

def ar_fit(df: DataFrame, key: Sequence[str], t: str, x: str, max_p: int = 3, max_d: int = 1) -> DataFrame:
    """AR(p) on the d-times differenced series; d from KPSS, p by AICc (re-aim of automatic ARIMA).

    d: the smallest d <= max_d whose differenced series passes the KPSS
    level test at 5 %.  p: all p <= max_p on a common sample in one Gram
    aggregate keyed by (series, p).  Returns (key..., d, p, beta, sigma2, aicc).
    """
    key = list(key)
    stats = []
    for d in range(max_d + 1):
        dd = differenced(df, key, t, x, d, "_y").where(F.col("_y").isNotNull())
        stats.append(kpss(dd, key, t, "_y").select(*key, F.lit(d).alias("d"), "stationary_5pct"))
    st = stats[0]
    for s in stats[1:]:
        st = st.unionByName(s)
    chosen = st.groupBy(*key).agg(F.coalesce(F.min(F.when(F.col("stationary_5pct"), F.col("d"))),
                                             F.lit(max_d)).alias("d"))
    parts = []
    for d in range(max_d + 1):
        parts.append(differenced(df, key, t, x, d, "_y").withColumn("d", F.lit(d)))
    allx = parts[0]
    for p_ in parts[1:]:
        allx = allx.unionByName(p_)
    sel = allx.join(chosen, [*key, "d"])
    w = Window.partitionBy(*key).orderBy(t)
    sel = sel.withColumns({f"_l{j}": F.lag("_y", j).over(w) for j in range(1, max_p + 1)})
    complete = F.col("_y").isNotNull()
    for j in range(1, max_p + 1):
        complete = complete & F.col(f"_l{j}").isNotNull()
    sel = sel.where(complete).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(max_p))))
    sel = sel.withColumns({f"_z{j}": F.when(F.col("p") >= j, F.col(f"_l{j}")).otherwise(0.0)
                           for j in range(1, max_p + 1)})
    terms = [f"_z{j}" for j in range(1, max_p + 1)]
    gkeys = [*key, "d", "p"]
    # center within each (series, d, p) fit; the intercept is mapped back below
    gw = Window.partitionBy(*gkeys)
    sel = sel.withColumns({f"_m{c}": F.avg(c).over(gw) for c in terms + ["_y"]})
    sel = sel.withColumns({c: F.col(c) - F.col(f"_m{c}") for c in terms + ["_y"]})
    means = sel.groupBy(*gkeys).agg(*[F.first(f"_m{c}").alias(f"_m{c}") for c in terms + ["_y"]])
    gdf = G.gram(sel, terms, "_y", by=gkeys)
    fits = gram_solve_by(gdf, gkeys, max_p + 1).join(means, gkeys)
    b0 = F.get("beta", 0) + F.col("_m_y")
    for j in range(1, max_p + 1):
        b0 = b0 - F.get("beta", j) * F.col(f"_m_z{j}")
    fits = fits.withColumn("beta", F.concat(F.array(b0), F.slice("beta", 2, max_p)))
    k = F.col("p") + 2  # intercept, p coefficients, variance
    n = F.col("n")
    # too few points, or a perfect fit: NULL, the candidate is not eligible
    spare = F.when(n - k - 1 > 0, n - k - 1)
    aicc = n * F.log(F.col("rss") / n) + 2 * k + 2 * k * (k + 1) / spare
    fits = fits.withColumn("aicc", aicc).withColumn("sigma2", F.col("rss") / n)
    best = fits.groupBy(*key).agg(F.min_by(F.struct("d", "p", "beta", "sigma2", "aicc"), "aicc").alias("m"))
    return best.select(*key, "m.d", "m.p", "m.beta", "m.sigma2", "m.aicc")


def ar_forecast(df: DataFrame, fits: DataFrame, key: Sequence[str], t: str, x: str, h: int = 6,
                name: str = "forecast") -> DataFrame:
    """``h``-step forecasts per series from an AR fit on differences, integrated back.

    Each series (bounded by its months) and its fit meet in one
    ``applyInPandas`` call: the recursion is a short loop over ``h`` steps.
    """
    key = list(key)
    packed = df.select(*key, F.col(t).alias("_t"), F.col(x).cast("double").alias("_x")) \
        .join(fits.select(*key, "d", "p", "beta"), key)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_t")
        y = pdf["_x"].to_numpy(dtype=float)
        if pd.isna(pdf["d"].iloc[0]):  # no eligible fit: the months come back without a forecast
            out = pd.DataFrame({t: np.arange(int(pdf["_t"].iloc[-1]) + 1, int(pdf["_t"].iloc[-1]) + h + 1, dtype="int32"),
                                name: np.full(h, np.nan)})
            for k_ in key:
                out.insert(0, k_, pdf[k_].iloc[0])
            return out
        d, p, beta = int(pdf["d"].iloc[0]), int(pdf["p"].iloc[0]), np.asarray(pdf["beta"].iloc[0], float)
        levels = [y]
        for _ in range(d):
            levels.append(np.diff(levels[-1]))
        z = list(levels[-1])
        fc = []
        for _ in range(h):
            v = beta[0] + sum(beta[j] * z[-j] for j in range(1, p + 1) if len(z) >= j)
            z.append(v)
            fc.append(v)
        fc = np.asarray(fc)
        for lvl in range(d, 0, -1):  # undo each difference from the last observed level
            fc = levels[lvl - 1][-1] + np.cumsum(fc)
        last_t = int(pdf["_t"].iloc[-1])
        out = pd.DataFrame({t: np.arange(last_t + 1, last_t + h + 1, dtype="int32"), name: fc})
        for k_ in key:
            out.insert(0, k_, pdf[k_].iloc[0])
        return out

    schema = f"{_schema_of(df, key)}, {t} int, {name} double"
    return packed.groupBy(*key).applyInPandas(run, schema)


def mape(df: DataFrame, key: Sequence[str], y: str, yhat: str, name: str = "mape") -> DataFrame:
    """Mean absolute percent error per series (rows with y = 0 are left out)."""
    err = F.abs(F.lit(100.0) * (F.col(y) - F.col(yhat)) / F.nullif(F.col(y), F.lit(0)))
    return df.groupBy(*key).agg(F.avg(err).alias(name))


def pick_model(mapes: DataFrame, key: Sequence[str], method: str = "method", score: str = "mape") -> DataFrame:
    """Per series, the method with the smallest error (ties: first by name)."""
    return mapes.groupBy(*key).agg(
        F.min_by(F.struct(F.col(method), F.col(score)), F.struct(F.col(score), F.col(method))).alias("m")) \
        .select(*key, F.col(f"m.{method}").alias(method), F.col(f"m.{score}").alias(score))
