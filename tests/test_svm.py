"""One-vs-one machines and the joint grid on planted classes."""

import numpy as np

from quarry.operators import svm as S


def _classes(spark, n=240, classes=3, seed=3):
    rng = np.random.default_rng(seed)
    centres = np.array([[0, 0, 4], [4, 0, 0], [0, 4, 0], [4, 4, 4]], float)[:classes]
    rows = [(i, float(i % classes) + 5, (centres[i % classes] + rng.standard_normal(3) * 0.5).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "id int, y double, v array<double>")


def test_three_planted_classes_and_null_rows(spark):
    df = _classes(spark)
    odd = spark.createDataFrame([(900, 5.0, None), (901, None, [0.0, 0.0, 4.0])], df.schema)
    model = S.svm_pairs(df.union(odd), "y", "v")
    got = model.predict(df.union(odd), "v").collect()
    assert len(got) == 242 and [r.prediction for r in got if r.id == 900] == [None] and [r.prediction for r in got if r.id == 901] == [5.0]
    assert np.mean([r.prediction == r.y for r in got if r.id < 900]) > 0.99


def test_weights_solve_the_problem_of_each_pair(spark):
    """At the optimum the gradient of each pair's own loss vanishes."""
    df = _classes(spark, 120)
    model = S.svm_pairs(df, "y", "v", cost=0.7)
    rows = df.collect()
    x, y = np.array([r.v for r in rows]), np.array([r.y - 5 for r in rows])
    z = np.column_stack([x, np.ones(len(x))])
    for j, (p, m) in enumerate(model.pairs):
        w = model.weights[:, j]
        side = (y == p).astype(float) - (y == m)
        hinge = np.where(side != 0, np.maximum(0, 1 - side * (z @ w)), 0)
        slope = np.append(w[:-1], 0) - 2 * 0.7 * z.T @ (side * hinge)
        assert np.abs(slope).max() < 0.02 * np.abs(w).max()


def test_passes_do_not_follow_the_number_of_pairs(spark):
    few, many = (S.svm_pairs(_classes(spark, 240, k), "y", "v") for k in (2, 4))
    assert len(many.pairs) == 6 * len(few.pairs) and many.passes <= 2 * few.passes + 10


def test_joint_grid_on_rings(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(300):
        r, a = (1.0 if i % 2 else 3.0) + 0.1 * rng.standard_normal(), rng.uniform(0, 2 * np.pi)
        rows.append((i, float(i % 2), [float(r * np.cos(a)), float(r * np.sin(a))]))
    df = spark.createDataFrame(rows, "id int, y double, v array<double>")
    got = {(r.sigma, r.cost): r for r in S.grid_cv(df, "y", "v", "id", [0.05, 1.0, 50.0], [0.1, 1.0, 10.0], dim=64).collect()}
    assert len(got) == 9 and got[1.0, 1.0].accuracy > 0.97 and got[1.0, 1.0].kappa > 0.94
    assert got[50.0, 0.1].accuracy < 0.8 and got[0.05, 1.0].accuracy < got[1.0, 1.0].accuracy


def test_one_class_and_empty(spark):
    df = _classes(spark, 12, 1)
    model = S.svm_pairs(df, "y", "v")
    assert model.pairs == [] and {r.prediction for r in model.predict(df, "v").collect()} == {5.0}
    assert S.grid_cv(df.limit(0), "y", "v", "id", [1.0], [1.0]).count() == 0
