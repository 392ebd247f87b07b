"""Regression and classification models.

Data passes run on executors: Spark ML fits, or one Gram aggregate
(:mod:`quarry.operators.gram`).  Model selection loops (stepwise AIC,
backward elimination) work on the p x p Gram matrix after that one pass;
binomial fits are reweighted least squares (:mod:`quarry.operators.irls`), all
candidates of a selection step in the same passes.
Results come back as small DataFrames (one row per term or per step).
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from quarry.operators import gram as G
from quarry.operators.irls import Batch, both_ways

_COEF_SCHEMA = ("term string, estimate double, std_error double, t_value double, p_value double, "
                "r2 double, adj_r2 double, n long")


def _complete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    out = df
    for c in cols:
        out = out.where(F.col(c).isNotNull())
    return out


def _assemble(df: DataFrame, x: Sequence[str], out: str = "features", invalid: str = "skip") -> DataFrame:
    """``skip`` drops rows with NULL parts (fits), ``keep`` makes them NaN (scoring)."""
    return VectorAssembler(inputCols=list(x), outputCol=out, handleInvalid=invalid).transform(df)


def _no_nan(c: str):
    return F.when(~F.isnan(c), F.col(c))


# --------------------------------------------------------------------------- linear

def ols(df: DataFrame, y: str, x: Sequence[str]) -> DataFrame:
    """Linear model: estimate, std error, t, p per term, plus R² and adjusted R²."""
    spark = df.sparkSession
    means = G.column_means(df, [*x, y])
    names = G._names(x, True)
    xtx, xty, yty, n = G.gram_matrix(df, x, y, center=means)
    shift = ([means[c] for c in x], means[y])
    return spark.createDataFrame(G.ols_table(xtx, xty, yty, n, names, shift), _COEF_SCHEMA)


def ols_spark_ml(df: DataFrame, y: str, x: Sequence[str]):
    """The same fit with Spark ML's normal-equation solver (returns the fitted model)."""
    data = _assemble(_complete(df, [y, *x]), x)
    return LinearRegression(featuresCol="features", labelCol=y, solver="normal",
                            standardization=False, regParam=0.0).fit(data)


def ols_by(df: DataFrame, y: str, x: Sequence[str], by: Sequence[str]) -> DataFrame:
    """One linear model per group: Gram per group, solved per group with applyInPandas."""
    names = G._names(x, True)
    p = len(names)
    keys = list(by)

    means = G.column_means(df, [*x, y])
    shift = ([means[c] for c in x], means[y])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        xtx, xty, yty, n = G.unpack(row, p)
        t = G.ols_table(xtx, xty, yty, n, names, shift)
        for k in keys:
            t.insert(0, k, row[k])
        return t

    gdf = G.gram(df, x, y, by=keys, center=means)
    key_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in gdf.schema.fields if f.name in keys)
    return gdf.groupBy(*keys).applyInPandas(solve, f"{key_schema}, {_COEF_SCHEMA}")


def vif(df: DataFrame, x: Sequence[str]) -> DataFrame:
    """Variance inflation factor per predictor, largest first (one Gram pass)."""
    spark = df.sparkSession
    xtx, _, _, n = G.gram_matrix(df, x, None, center=G.column_means(df, x))
    v = G.vif_from_gram(xtx, n)
    pdf = pd.DataFrame({"term": list(x), "vif": v}).sort_values("vif", ascending=False)
    return spark.createDataFrame(pdf, "term string, vif double")


def _aic_gaussian(rss: float, n: int, k: int) -> float:
    # n log(RSS/n) + 2k; nothing is better than a perfect fit
    return n * math.log(rss / n) + 2 * k if rss > 0 else -math.inf


def step_aic(df: DataFrame, y: str, x: Sequence[str], family: str = "gaussian") -> DataFrame:
    """Both-direction stepwise selection by AIC, starting from the full model.

    Gaussian: every candidate is scored from one Gram matrix; a fit without residual
    (RSS under 1e-12 of the total) has AIC -infinity and ends the path.  Binomial: all candidates
    of a step are fitted together (:mod:`quarry.operators.irls`).
    Runs until no candidate lowers the AIC (each step lowers it, so it ends).
    Returns the path: (step, action, term, aic, terms).
    """
    spark = df.sparkSession
    x = list(x)
    schema = "step int, action string, term string, aic double, terms string"
    if family != "gaussian":
        batch, path = Batch(df, y, x), []
        both_ways(batch, x, lambda step, act, t, fit: path.append((step, act, t, float(fit.aic), ",".join(fit.terms))))
        batch.close()
        return spark.createDataFrame(path, schema)
    names = G._names(x, True)
    xtx, xty, yty, n = G.gram_matrix(df, x, y, center=G.column_means(df, [*x, y]))

    def score(terms):
        idx = [0] + [names.index(t) for t in terms]
        a, b = G.subset(xtx, xty, idx)
        _, rss, _, k, _ = G.ols_solve(a, b, yty, n)
        return _aic_gaussian(rss if rss > 1e-12 * yty else 0.0, n, k)

    current = list(x)
    best = score(current)
    path = [(0, "start", None, best, ",".join(current))]
    for step in itertools.count(1):
        cands = [("-", t, [c for c in current if c != t]) for t in current]
        cands += [("+", t, current + [t]) for t in x if t not in current]
        scored = [(score(terms), act, t, terms) for act, t, terms in cands]
        if not scored:
            break
        aic, act, t, terms = min(scored, key=lambda s: s[0])
        if aic >= best - 1e-9:
            break
        best, current = aic, terms
        path.append((step, act, t, aic, ",".join(current)))
    return spark.createDataFrame(path, schema)


# --------------------------------------------------------------------------- binomial

_GLM_ITER = 200


def _glm(data: DataFrame, y: str, x: Sequence[str]):
    feats = _assemble(data, x) if x else data.withColumn("features", array_to_vector(F.array()))
    glr = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="features",
                                      labelCol=y, maxIter=_GLM_ITER)
    return glr.fit(feats)


def logit(df: DataFrame, y: str, x: Sequence[str]) -> DataFrame:
    """Binomial GLM: estimate, std error, z, p per term, the model AIC, and whether the fit converged."""
    batch = Batch(df, y, x)
    m = batch.fit([list(x)])[0]
    batch.close()
    rows = [(t, float(e), float(se), float(z), float(p), float(m.aic), m.passes, m.converged)
            for t, e, se, z, p in zip([*x, "(Intercept)"], m.beta, m.se, m.z, m.p_values)]
    return df.sparkSession.createDataFrame(rows, "term string, estimate double, std_error double, z_value double, "
                                                 "p_value double, aic double, iterations int, converged boolean")


def backward_eliminate(df: DataFrame, y: str, x: Sequence[str], family: str = "gaussian",
                       max_vif: float = 2.0, max_p: float = 0.05) -> DataFrame:
    """Drop one term at a time: the highest-VIF term above ``max_vif`` that is not
    significant, else the least significant term above ``max_p``; stop when none.

    Gaussian works entirely from one Gram matrix; binomial refits by reweighted least
    squares from the coefficients of the step before, and takes VIFs from the Gram matrix of
    the same rows (those complete in ``y`` and all of ``x``).
    Returns the path: (step, dropped, reason, vif, p_value, terms).
    """
    spark = df.sparkSession
    x = list(x)
    names = G._names(x, True)
    df = _complete(df, [y, *x])
    xtx, xty, yty, n = G.gram_matrix(df, x, y, center=G.column_means(df, [*x, y]))
    batch = fit = None
    if family != "gaussian":
        batch = Batch(df, y, x)
    current = list(x)
    path = [(0, None, "start", None, None, ",".join(current))]
    for step in itertools.count(1):
        if not current:
            break
        idx = [0] + [names.index(t) for t in current]
        a, b = G.subset(xtx, xty, idx)
        vifs = dict(zip(current, G.vif_from_gram(a, n))) if len(current) > 1 else {current[0]: 1.0}
        if family == "gaussian":
            tab = G.ols_table(a, b, yty, n, [G.INTERCEPT] + current)
            pv = dict(zip(current, tab["p_value"].iloc[1:]))
        else:
            fit = batch.fit([current], [batch.start_of(fit) if fit else None])[0]
            pv = dict(zip(current, fit.p_values))
        high = [t for t in current if vifs[t] > max_vif and pv[t] > max_p]
        if high:
            drop, reason = max(high, key=lambda t: vifs[t]), "vif"
        else:
            worst = max(current, key=lambda t: pv[t])
            if pv[worst] <= max_p:
                break
            drop, reason = worst, "p_value"
        current = [t for t in current if t != drop]
        path.append((step, drop, reason, float(vifs[drop]), float(pv[drop]), ",".join(current)))
    if batch is not None:
        batch.close()
    return spark.createDataFrame(path, "step int, dropped string, reason string, vif double, "
                                       "p_value double, terms string")


# --------------------------------------------------------------------------- scoring

def predict(model, df: DataFrame, x: Sequence[str], out: str = "prediction") -> DataFrame:
    """Every row comes back; a row with a NULL feature has a NULL prediction."""
    scored = model.transform(_assemble(df, x, invalid="keep"))
    return scored.withColumn("prediction", _no_nan("prediction")).withColumnRenamed("prediction", out).drop("features")


def r2_holdout(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """Hold-out R² as the squared correlation of truth and prediction."""
    return df.agg((F.corr(y, yhat) ** 2).alias("r2"), F.count(F.lit(1)).alias("n"))


def predict_prob(model, df: DataFrame, x: Sequence[str], out: str = "prob") -> DataFrame:
    """P(y = 1) for held-out rows (GLM: the mean response; classifiers: probability[1]); NULL where a feature is NULL."""
    scored = model.transform(_assemble(df, x, invalid="keep"))
    if "probability" in scored.columns:
        scored = scored.withColumn(out, vector_to_array("probability")[1])
    else:
        scored = scored.withColumnRenamed("prediction", out)
    scored = scored.withColumn(out, _no_nan(out))
    return scored.drop("features", "rawPrediction", "probability", "prediction")


# --------------------------------------------------------------------------- multi-class

def to_vector(df: DataFrame, array_col: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(array_col).cast(ArrayType(DoubleType()))))


def svm_multi(df: DataFrame, label: str, features: str = "features", reg: float = 0.01,
              max_iter: int = 50):
    """One-vs-rest linear SVM of Spark ML (one-vs-one is :func:`quarry.operators.svm.svm_pairs`)."""
    svc = LinearSVC(regParam=reg, maxIter=max_iter)
    return OneVsRest(classifier=svc, labelCol=label, featuresCol=features, parallelism=4).fit(df)


def rff(df: DataFrame, array_col: str, dim: int, sigma: float, seed: int = 7,
        out: str = "rff") -> DataFrame:
    """Random Fourier features for the RBF kernel exp(-|x-y|²/(2σ²)) (Rahimi & Recht 2007).

    z(x) = sqrt(2/D) cos(Wx + b), W ~ N(0, 1/σ²), b ~ U(0, 2π), fixed by
    ``seed``.  Computed per Arrow batch with one matrix product.
    """
    from pyspark.sql.functions import pandas_udf

    d = len(df.select(array_col).first()[0])
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, 1.0 / sigma, size=(d, dim))
    b = rng.uniform(0.0, 2 * np.pi, size=dim)
    scale = math.sqrt(2.0 / dim)

    @pandas_udf(ArrayType(DoubleType()))
    def project(col: pd.Series) -> pd.Series:
        x = np.stack(col.to_numpy()).astype(np.float64)
        z = scale * np.cos(x @ w + b)
        return pd.Series(list(z))

    return df.withColumn(out, project(F.col(array_col)))
