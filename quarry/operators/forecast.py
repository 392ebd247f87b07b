"""Decomposition and ARMA forecasts of many monthly series at once.

Global part: the seasonal regression fitted to the smoothed training months.  Local part: what is left
of the raw months, modelled as an ARMA series, which gives the error bands.  ARMA models (moving-average
terms included) are fitted in two regressions for all series and all orders together: a long
autoregression gives the innovations, then every order (p, q) is one group of a Gram table over lagged
values and lagged innovations.  A series is bounded by its months; only the short recursions over one
series or one fit run in pandas.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators import gram as G
from quarry.operators import series as TS
from quarry.operators import windows as W
from quarry.session import ensure_checkpoint_dir

BAND = 1.959964  # fixed value: 97.5 % point of the normal distribution


def _keep(df: DataFrame) -> DataFrame:
    """A table of whole series (one row a month), written once because several fits read it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def decompose(df: DataFrame, key: Sequence[str], t: str, x: str, h: int = 6, width: int = 2) -> DataFrame:
    """Adds ``part`` (train, test: the last ``h``), ``smooth``, ``fit`` (global part) and ``local`` = x - fit.

    The moving average over ``2 * width + 1`` training months has its ends filled by straight lines; the
    seasonal regression is fitted to it and scored on every month.  ``t`` runs from 1 in each series.
    """
    held = TS.holdout(df.select(*key, t, x), key, t, h)
    train = W.moving_avg(held.where(F.col("part") == "train"), key, t, x, width, "_ma")
    smooth = W.extend_ends(train, key, t, "_ma", width, "smooth").select(*key, t, "smooth")
    both = held.join(smooth, [*key, t], "left")
    fitted, _ = TS.seasonal_fit(both, key, t, "smooth", train=F.col("part") == "train")
    return TS.residual(fitted, x, "fit", "local").select(*key, t, "part", x, "smooth", "fit", "local")


# --------------------------------------------------------------------------- ARMA by two regressions

def _stationary(df: DataFrame, key: list[str], t: str, x: str, max_d: int) -> DataFrame:
    """(key, t, ``d``, ``_z``, ``_mu``, ``_i``, ``_n``): differenced until KPSS passes, about its mean, numbered from 1."""
    levels = [TS.differenced(df.select(*key, t, F.col(x).cast("double").alias(x)), key, t, x, d, "_y")
              .where(F.col("_y").isNotNull()).withColumn("d", F.lit(d)) for d in range(max_d + 1)]
    rows = reduce(DataFrame.unionByName, levels)
    tests = TS.kpss(rows, [*key, "d"], t, "_y")
    chosen = tests.groupBy(*key).agg(F.coalesce(F.min(F.when(F.col("stationary_5pct"), F.col("d"))), F.lit(max_d)).alias("d"))
    g = Window.partitionBy(*key)
    out = rows.join(chosen, [*key, "d"]).withColumns({
        "_mu": F.avg("_y").over(g), "_n": F.count(F.lit(1)).over(g), "_i": F.row_number().over(g.orderBy(t))})
    return out.select(*key, t, "d", (F.col("_y") - F.col("_mu")).alias("_z"), "_mu", "_n", "_i")


def _lags(df: DataFrame, key: list[str], t: str, col: str, most: int, prefix: str) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(t)
    return df.withColumns({f"{prefix}{j}": F.lag(col, j).over(w) for j in range(1, most + 1)})


def _outside(coefs: np.ndarray) -> bool:
    """Whether 1 - c1 B - c2 B^2 - ... has all its roots outside the unit circle."""
    c = np.trim_zeros(np.asarray(coefs, float), "b")
    return not len(c) or bool(np.abs(np.roots(np.concatenate([-c[::-1], [1.0]]))).min() > 1.0 + 1e-6)


def arma_fit(df: DataFrame, key: Sequence[str], t: str, x: str, max_p: int = 2, max_q: int = 2, max_d: int = 1) -> DataFrame:
    """Best ARIMA(p, d, q) of each series: (key..., d, p, q, mu, phi, theta, sigma2, aicc, n).

    ``d`` is the smallest order whose differences pass KPSS at 5 %; (p, q) has the smallest AICc of all
    orders whose autoregression is stable and whose moving average is invertible, on one common sample.
    Signs: z_t = phi_1 z_(t-1) + ... + e_t + theta_1 e_(t-1) + ... about the mean ``mu``.  A series without
    an eligible order (constant, too short) has NULLs.  The longest series sets the number of lag columns
    (one small job while the plan is built).
    """
    key = list(key)
    z = _keep(_stationary(df, key, t, x, max_d))
    long_order = F.greatest(F.lit(max_p + max_q), F.floor(2 * F.pow(F.col("_n").cast("double"), 1 / 3)).cast("int"))
    long_order = F.least(long_order, F.floor(F.col("_n") / 4).cast("int"))
    z = z.withColumn("_m", long_order)
    top = z.agg(F.max("_m")).first()[0] or 0
    lagged = _lags(z, key, t, "_z", max(top, max_p), "_l")
    # first regression: innovations of a long autoregression, each series to its own order
    terms = [f"_f{j}" for j in range(1, top + 1)]
    first = lagged.withColumns({f: F.when(F.col("_m") >= j, F.col(f"_l{j}")).otherwise(0.0) for j, f in enumerate(terms, 1)})
    first = first.where(F.col("_i") > F.col("_m"))
    coef = TS.gram_solve_by(G.gram(first, terms, "_z", by=key), key, top + 1)
    told = first.join(coef.select(*key, "beta"), key).withColumn("_e", F.col("_z") - TS._dot(terms, F.col("beta")))
    # second regression: all orders at once over lagged values and lagged innovations
    rows = _lags(told, key, t, "_e", max_q, "_v").where(F.col("_i") > F.col("_m") + max(max_p, max_q))
    grid = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p in range(max_p + 1) for q in range(max_q + 1)])
    rows = rows.withColumn("_g", F.explode(grid)).withColumns({"p": F.col("_g.p"), "q": F.col("_g.q")})
    cells = {f"_a{j}": F.when(F.col("p") >= j, F.col(f"_l{j}")).otherwise(0.0) for j in range(1, max_p + 1)}
    cells |= {f"_b{j}": F.when(F.col("q") >= j, F.col(f"_v{j}")).otherwise(0.0) for j in range(1, max_q + 1)}
    by = [*key, "d", "_mu", "p", "q"]
    width = len(cells) + 1
    grams = G.gram(rows.withColumns(cells), list(cells), "_z", by=by)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        beta, rss, _, _, _ = G.ols_solve(*G.unpack(row, width))
        phi, theta = beta[1:1 + row["p"]], beta[1 + max_p:1 + max_p + row["q"]]
        out = {c: [row[c]] for c in by}
        return pd.DataFrame(out | {"phi": [phi.tolist()], "theta": [theta.tolist()], "rss": [rss], "n": [int(row["n"])],
                                   "ok": [_outside(phi) and _outside(-theta)]})

    fits = grams.groupBy(*by).applyInPandas(
        solve, f"{TS._schema_of(grams, by)}, phi array<double>, theta array<double>, rss double, n bigint, ok boolean")
    k = F.col("p") + F.col("q") + 2  # mean and variance too
    spare = F.when(F.col("n") - k - 1 > 0, F.col("n") - k - 1)
    usable = F.col("ok") & (F.col("rss") > 0)
    aicc = F.when(usable, F.col("n") * F.log(F.when(usable, F.col("rss") / F.col("n"))) + 2 * k + F.try_divide(2 * k * (k + 1), spare))
    fits = fits.withColumns({"aicc": aicc, "sigma2": F.try_divide("rss", "n")}).withColumnRenamed("_mu", "mu")
    one = F.struct("d", "p", "q", "mu", "phi", "theta", "sigma2", "aicc", "n")
    best = fits.where(F.col("aicc").isNotNull()).groupBy(*key).agg(F.min_by(one, F.struct("aicc", "p", "q")).alias("m"))
    return df.select(*key).distinct().join(best, key, "left").select(*key, "m.*")


def psi_errors(fits: DataFrame, key: Sequence[str], h: int) -> DataFrame:
    """Standard error of each forecast step: (key..., step, se), step 0 being a fitted month.

    psi_j = theta_j + sum phi_i psi_(j-i); undoing a difference sums the weights up.
    """
    key = list(key)

    def recursion(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        se = np.full(h + 1, np.nan)
        if not pd.isna(row["d"]):
            phi, theta = (np.asarray(row[c], float) for c in ("phi", "theta"))
            psi = np.zeros(h)
            for j in range(h):
                psi[j] = 1.0 if j == 0 else (theta[j - 1] if j <= len(theta) else 0.0)
                psi[j] += sum(phi[i] * psi[j - 1 - i] for i in range(min(len(phi), j)))
            for _ in range(int(row["d"])):
                psi = np.cumsum(psi)
            se = np.sqrt(row["sigma2"] * np.concatenate([[1.0], np.cumsum(psi ** 2)]))
        out = pd.DataFrame({"step": np.arange(h + 1, dtype="int32"), "se": se})
        for k in reversed(key):
            out.insert(0, k, row[k])
        return out

    return (fits.groupBy(*key).applyInPandas(recursion, f"{TS._schema_of(fits, key)}, step int, se double")
            .withColumn("se", F.nanvl("se", F.lit(None).cast("double"))))


def arma_forecast(df: DataFrame, fits: DataFrame, key: Sequence[str], t: str, x: str, h: int = 6) -> DataFrame:
    """One-step fits of every month and ``h`` future months: (key..., t, part, value, lo, hi).

    Bands are 95 %, from the psi weights.  Series without a fit have NULLs.  Months before the
    first difference have no fit.
    """
    key = list(key)
    packed = df.select(*key, F.col(t).cast("int").alias("_t"), F.col(x).cast("double").alias("_x")) \
        .join(fits.select(*key, "d", "mu", "phi", "theta"), key)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_t")
        x_, t_ = pdf["_x"].to_numpy(float), pdf["_t"].to_numpy()
        n, row = len(x_), pdf.iloc[0]
        value = np.full(n + h, np.nan)
        if not pd.isna(row["d"]):
            d, mu = int(row["d"]), float(row["mu"])
            phi, theta = (np.asarray(row[c], float) for c in ("phi", "theta"))
            levels = [x_]
            for _ in range(d):
                levels.append(np.diff(levels[-1]))
            z = np.concatenate([levels[-1] - mu, np.zeros(h)])
            e = np.zeros(len(z))
            for i in range(len(z)):
                step = sum(phi[j] * z[i - 1 - j] for j in range(min(len(phi), i)))
                step += sum(theta[j] * e[i - 1 - j] for j in range(min(len(theta), i)))
                if i < n - d:
                    e[i] = z[i] - step
                else:
                    z[i] = step
            value[d:n] = x_[d:] - e[:n - d]
            ahead = z[n - d:] + mu
            for level in reversed(levels[:-1]):
                ahead = level[-1] + np.cumsum(ahead)
            value[n:] = ahead
        out = pd.DataFrame({t: np.concatenate([t_, t_[-1] + np.arange(1, h + 1)]).astype("int32"),
                            "part": ["fitted"] * n + ["future"] * h, "value": value, "step": np.maximum(np.arange(n + h) - n + 1, 0).astype("int32")})
        for k in reversed(key):
            out.insert(0, k, row[k])
        return out

    told = packed.groupBy(*key).applyInPandas(run, f"{TS._schema_of(df, key)}, {t} int, part string, value double, step int")
    return _banded(told.withColumn("value", F.nanvl("value", F.lit(None).cast("double"))), fits, key, h).select(
        *key, t, "part", "value", "lo", "hi")


def _banded(rows: DataFrame, fits: DataFrame, key: list[str], h: int) -> DataFrame:
    out = rows.join(psi_errors(fits, key, h), [*key, "step"], "left")
    return out.withColumns({"lo": F.col("value") - BAND * F.col("se"), "hi": F.col("value") + BAND * F.col("se")})


def forecast_both(df: DataFrame, key: Sequence[str], t: str, x: str, h: int = 6, width: int = 2, **orders) -> DataFrame:
    """Fitted and held-out months of both methods: (key..., t, method, part, actual, value, local, lo, hi).

    ``decomposition``: ``value`` is the global part, ``local`` what the ARMA model of its local part adds, and
    the bands lie about their sum.  ``arma``: the ARMA model of the raw training months (``local`` is 0).  The
    last ``h`` months are the ``future`` rows.
    """
    key = list(key)
    parts = _keep(decompose(df, key, t, x, h, width))
    train = parts.where(F.col("part") == "train")
    glob = parts.select(*key, F.col(t).cast("int").alias(t), F.col(x).alias("actual"), F.col("fit").alias("value"))
    near = arma_forecast(train, _keep(arma_fit(train, key, t, "local", **orders)), key, t, "local", h)
    near = near.select(*key, t, "part", F.col("value").alias("local"), "lo", "hi")
    first = glob.join(near, [*key, t]).withColumns({"lo": F.col("value") + F.col("lo"), "hi": F.col("value") + F.col("hi")})
    far = arma_forecast(train, _keep(arma_fit(train, key, t, x, **orders)), key, t, x, h)
    second = far.join(glob.drop("value"), [*key, t], "left").withColumn("local", F.lit(0.0))
    columns = [*key, t, "method", "part", "actual", "value", "local", "lo", "hi"]
    return (first.withColumn("method", F.lit("decomposition")).select(*columns)
            .unionByName(second.withColumn("method", F.lit("arma")).select(*columns)))


def residual_tests(df: DataFrame, key: Sequence[str], t: str, x: str, h: int = 6, width: int = 2, **orders) -> DataFrame:
    """ADF and KPSS of what each method leaves unexplained in training: (key..., method, n, adf, kpss, adf_ok, kpss_ok).

    For the decomposition that is the local part less its own ARMA fit, as for white noise.
    """
    key = list(key)
    parts = _keep(decompose(df, key, t, x, h, width)).where(F.col("part") == "train")
    left = []
    for method, col in (("decomposition", "local"), ("arma", x)):
        fits = _keep(arma_fit(parts, key, t, col, **orders))
        told = arma_forecast(parts, fits, key, t, col, 0).select(*key, t, "value")
        left.append(parts.join(told, [*key, t]).where(F.col("value").isNotNull())
                    .select(*key, F.lit(method).alias("method"), F.col(t).alias(t), (F.col(col) - F.col("value")).alias("_r")))
    rest = _keep(left[0].unionByName(left[1]))
    by = [*key, "method"]
    adf = TS.adf(rest, by, t, "_r").select(*by, "adf", F.col("stationary_5pct").alias("adf_ok"))
    kpss = TS.kpss(rest, by, t, "_r").select(*by, "n", "kpss", F.col("stationary_5pct").alias("kpss_ok"))
    return kpss.join(adf, by, "left").select(*by, "n", "adf", "kpss", "adf_ok", "kpss_ok")
