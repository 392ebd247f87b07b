"""Sufficient statistics for least squares: XᵀX, Xᵀy, yᵀy, n (SURVEY ml_gram).

One ``groupBy().agg()`` pass computes every cross product, optionally per
group, so a regression over any number of rows moves only p² numbers per
group.  Solving happens on those few numbers: on the driver for one model,
or with ``applyInPandas`` over the one-row-per-group Gram table for many
models (many series, many candidate subsets).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INTERCEPT = "_1"


def _names(x: Sequence[str], intercept: bool) -> list[str]:
    return ([INTERCEPT] if intercept else []) + list(x)


def column_means(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Means of the complete cases (one small aggregate row)."""
    base = df
    for c in cols:
        base = base.where(F.col(c).isNotNull())
    row = base.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols]).first()
    return {c: float(row[c] or 0.0) for c in cols}


def gram(df: DataFrame, x: Sequence[str], y: str | None = None, by: Sequence[str] = (),
         intercept: bool = True, center: dict[str, float] | None = None) -> DataFrame:
    """Cross-product sums per group: columns ``n``, ``xx_i_j`` (i <= j), ``xy_i``, ``yy``.

    Rows with a NULL in any used column are left out (complete cases).
    ``center`` subtracts a constant per column first (e.g. its mean): the sums
    stay small at any row count, and with an intercept the slopes, residuals
    and RSS are unchanged (:func:`ols_table` maps the intercept back).
    """
    names = _names(x, intercept)
    used = list(x) + ([y] if y else [])
    base = df
    for c in used:
        base = base.where(F.col(c).isNotNull())
    if center:
        base = base.select(*by, *[(F.col(c) - F.lit(center[c])).alias(c) if c in center else F.col(c)
                                  for c in used])

    def prod(a: str, b: str):
        # the intercept column multiplies nothing: keeps decimal inputs exact
        if a == INTERCEPT and b == INTERCEPT:
            return F.lit(1)
        if a == INTERCEPT or b == INTERCEPT:
            return F.col(b if a == INTERCEPT else a)
        return F.col(a) * F.col(b)

    aggs = [F.count(F.lit(1)).alias("n")]
    for i, a in enumerate(names):
        for j in range(i, len(names)):
            aggs.append(F.sum(prod(a, names[j])).alias(f"xx_{i}_{j}"))
        if y:
            aggs.append(F.sum(prod(a, y)).alias(f"xy_{i}"))
    if y:
        aggs.append(F.sum(F.col(y) * F.col(y)).alias("yy"))
    return base.groupBy(*by).agg(*aggs)


WIDE = 12  # predictors from which one matrix product per Arrow batch beats p²/2 sum expressions


def gram_matrix(df: DataFrame, x: Sequence[str], y: str | None = None, center: dict[str, float] | None = None):
    """XᵀX, Xᵀy, yᵀy, n of the complete cases as numpy, with an intercept.

    Few predictors: the aggregate of :func:`gram`.  Many: each task multiplies
    its Arrow batches and emits one triangle of sums, added up per cell, so
    neither the plan nor the generated code grows with p².
    """
    p = len(x) + 1
    if len(x) < WIDE:
        return unpack(gram(df, x, y, center=center).first().asDict(), p, with_y=y is not None)
    used = list(x) + ([y] if y else [])
    base = df
    for c in used:
        base = base.where(F.col(c).isNotNull())
    base = base.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(used)])
    shift = np.array([float((center or {}).get(c, 0.0)) for c in used])
    rows, cols = np.triu_indices(len(used) + 1)

    def products(batches):
        total = np.zeros((len(shift) + 1, len(shift) + 1))
        for batch in batches:
            m = np.ones((batch.num_rows, len(shift) + 1))
            for i in range(len(shift)):
                m[:, i + 1] = batch.column(i).to_numpy(zero_copy_only=False) - shift[i]
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(cols, pa.int32()), pa.array(total[rows, cols])],
                                         names=["i", "j", "v"])

    full = np.zeros((len(used) + 1, len(used) + 1))
    for r in base.mapInArrow(products, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        full[r.i, r.j] = full[r.j, r.i] = r.v
    n = int(full[0, 0])
    if y is None:
        return full, None, None, n
    return full[:p, :p], full[:p, p], float(full[p, p]), n


def unpack(row, p: int, with_y: bool = True):
    """Gram row (mapping) -> (XtX, Xty, yty, n) as numpy."""
    xtx = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            xtx[i, j] = xtx[j, i] = float(row[f"xx_{i}_{j}"])
    if not with_y:
        return xtx, None, None, int(row["n"])
    xty = np.array([float(row[f"xy_{i}"]) for i in range(p)])
    return xtx, xty, float(row["yy"]), int(row["n"])


# --------------------------------------------------------------------------- small dense algebra

def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction for the regularised incomplete beta (modified Lentz)."""
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 1e-14:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    front = math.exp(lbeta + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1 - x) / b


def t_pvalue(t: float, df: float) -> float:
    """Two-sided p-value of a Student t statistic."""
    if not np.isfinite(t) or df <= 0:
        return float("nan")
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def normal_pvalue(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def ols_solve(xtx: np.ndarray, xty: np.ndarray, yty: float, n: int):
    """Least squares from the Gram matrix: beta, rss, standard errors (pseudo-inverse when rank-deficient)."""
    inv = np.linalg.pinv(xtx)
    beta = inv @ xty
    rss = float(yty - 2 * beta @ xty + beta @ xtx @ beta)
    k = int(np.linalg.matrix_rank(xtx))
    dof = n - k
    sigma2 = rss / dof if dof > 0 else float("nan")
    se = np.sqrt(np.maximum(np.diag(inv) * sigma2, 0.0))
    return beta, max(rss, 0.0), se, k, dof


def ols_table(xtx, xty, yty, n, names: Sequence[str], shift: tuple | None = None) -> pd.DataFrame:
    """Coefficient table from a Gram matrix.

    ``shift = (x_means, y_mean)`` when the Gram matrix was built on centered
    columns (intercept first): the intercept and its standard error are
    mapped back to the original scale through T = [1, -x_means; 0, I].
    """
    beta, rss, se, k, dof = ols_solve(xtx, xty, yty, n)
    if shift is not None and names and names[0] == INTERCEPT:
        mx, my = np.asarray(shift[0], float), float(shift[1])
        inv = np.linalg.pinv(xtx)
        sigma2 = rss / dof if dof > 0 else float("nan")
        tmat = np.eye(len(names))
        tmat[0, 1:] = -mx
        cov = tmat @ (inv * sigma2) @ tmat.T
        beta = tmat @ beta
        beta[0] += my
        se = np.sqrt(np.maximum(np.diag(cov), 0.0))
    t = np.where(se > 0, beta / np.where(se > 0, se, 1), np.nan)
    ybar = xty[0] / n if names and names[0] == INTERCEPT else 0.0
    tss = yty - n * ybar * ybar
    r2 = 1 - rss / tss if tss > 0 else float("nan")
    adj = 1 - (1 - r2) * (n - 1) / dof if dof > 0 else float("nan")
    return pd.DataFrame({"term": ["(Intercept)" if c == INTERCEPT else c for c in names],
                         "estimate": beta, "std_error": se, "t_value": t,
                         "p_value": [t_pvalue(v, dof) for v in t],
                         "r2": r2, "adj_r2": adj, "n": n})


def vif_from_gram(xtx: np.ndarray, n: int) -> np.ndarray:
    """VIF_j = diag(R⁻¹)_j where R is the correlation matrix of the predictors.

    ``xtx`` must include the intercept as its first row/column.
    """
    sums = xtx[0, 1:]
    cross = xtx[1:, 1:]
    cov = cross - np.outer(sums, sums) / n
    var = np.diag(cov)
    live = var > 1e-12 * np.maximum(np.diag(cross) / n, 1e-300)  # a constant column has no VIF
    out = np.full(len(var), np.nan)
    if live.any():
        sd = np.sqrt(var[live])
        out[live] = np.diag(np.linalg.pinv(cov[np.ix_(live, live)] / np.outer(sd, sd)))
    return out


def subset(xtx, xty, idx: Sequence[int]):
    ix = np.array(list(idx))
    return xtx[np.ix_(ix, ix)], (xty[ix] if xty is not None else None)
