"""Batched binomial fits against Spark's GLM; passes, odd rows, perfect fits."""

import math

import numpy as np
import pytest

from quarry.operators import models as M
from quarry.operators.irls import Batch

X = [f"x{i}" for i in range(6)]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 6)) * [1, 5, 0.1, 1, 1, 1] + [0, 100, 0, 0, 0, 0]
    x[:, 5] = 0.9 * x[:, 0] + 0.3 * x[:, 5]
    eta = 0.8 * x[:, 0] - 0.2 * (x[:, 1] - 100) + 6 * x[:, 2] - 0.5
    y = (rng.random(3000) < 1 / (1 + np.exp(-eta))).astype(int)
    rows = [(*map(float, r), int(v)) for r, v in zip(x, y)]
    rows += [(None, 1.0, 1.0, 1.0, 1.0, 1.0, 1), (1.0, 100.0, 0.0, 0.0, 0.0, 1.0, None)] * 20
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in X) + ", y int")


def test_equals_spark_glm(data):
    models = [X, X[:2], ["x4"], []]
    batch = Batch(data, "y", X)
    for terms, fit in zip(models, batch.fit(models)):
        want = M._glm(M._complete(data, ["y", *X]), "y", terms)
        assert fit.converged and batch.n == 3000
        assert fit.beta == pytest.approx([*want.coefficients, want.intercept], rel=1e-6, abs=1e-8)
        assert fit.aic == pytest.approx(want.summary.aic, rel=1e-9)
        if terms:
            assert fit.se == pytest.approx(want.summary.coefficientStandardErrors, rel=1e-5)
            assert fit.p_values == pytest.approx(want.summary.pValues, rel=1e-4, abs=1e-9)
    # four models, one set of passes
    assert batch.passes <= 9
    batch.close()


def test_selection_passes_do_not_follow_candidates(data, monkeypatch):
    seen, close = [], Batch.close
    monkeypatch.setattr(Batch, "close", lambda self: (seen.append(self.passes), close(self)))
    path = M.step_aic(data, "y", X, family="binomial").orderBy("step").collect()
    assert set(path[-1].terms.split(",")) >= {"x0", "x1", "x2"} and [r.aic for r in path] == sorted((r.aic for r in path), reverse=True)
    want = {r.terms: M._glm(M._complete(data, ["y", *X]), "y", r.terms.split(",")).summary.aic for r in path}
    assert all(r.aic == pytest.approx(want[r.terms], rel=1e-9) for r in path)
    # up to six candidates a step, and a step takes a handful of passes
    assert seen[0] <= 9 + 7 * len(path)
    M.backward_eliminate(data, "y", X, family="binomial")
    assert seen[1] < seen[0] + 20


def test_backward_uses_one_set_of_rows(data):
    full = M._complete(data, ["y", *X])
    got, want = (M.backward_eliminate(d, "y", X, family="binomial").orderBy("step").collect() for d in (data, full))
    assert [tuple(r) for r in got] == [tuple(r) for r in want] and {"x0", "x1", "x2"} <= set(got[-1].terms.split(",")) | {"x5"}


def test_perfect_fit_and_separation(spark):
    rows = [(float(i), float(i % 7), 3.0 * i + 2.0, int(i > 25)) for i in range(50)]
    df = spark.createDataFrame(rows, "a double, b double, y double, z int")
    path = M.step_aic(df, "y", ["a", "b"]).collect()
    assert path[0].aic == -math.inf
    fit = M.logit(df, "z", ["a"]).collect()
    assert all(math.isfinite(r.estimate) for r in fit) and fit[0].aic < 4.1
    one = M.logit(df.withColumn("c", df.a * 0 + 4), "z", ["b", "c"]).collect()
    assert {r.term for r in one} == {"b", "c", "(Intercept)"} and all(math.isfinite(r.estimate) for r in one)
