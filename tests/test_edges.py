"""Edge data: NULLs, constant columns, one class only, long series, folders and paths."""

import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import aggregate as A
from quarry.operators import evaluate as E
from quarry.operators import features as FT
from quarry.operators import gram as G
from quarry.operators import models as M
from quarry.operators import series as TS


def _series(spark, xs, key="a"):
    return spark.createDataFrame([(key, i + 1, float(x)) for i, x in enumerate(xs)], "k string, t int, x double")


def test_kpss_long_series_uses_every_lag(spark):
    n = 12_000
    x = np.cumsum(np.random.default_rng(0).standard_normal(n))
    got = TS.kpss(_series(spark, x), ["k"], "t", "x").first()
    e = x - x.mean()
    lags = int(4 * (n / 100) ** 0.25)
    lr = (e @ e + 2 * sum((1 - s / (lags + 1)) * (e[s:] @ e[:-s]) for s in range(1, lags + 1))) / n
    want = (np.cumsum(e) ** 2).sum() / (n * n * lr)
    assert got.lags == lags == 13 and got.kpss == pytest.approx(want, rel=1e-9)


def test_adf_lag_order_follows_the_series(spark):
    x = np.cumsum(np.random.default_rng(1).standard_normal(3000))
    assert TS.adf(_series(spark, x), ["k"], "t", "x").first().lags == 14


def test_constant_series_is_null_and_spares_others(spark):
    noise = np.random.default_rng(2).standard_normal(60)
    df = _series(spark, [5.0] * 60, "flat").union(_series(spark, noise, "live"))
    kp = {r.k: r.kpss for r in TS.kpss(df, ["k"], "t", "x").collect()}
    assert kp["flat"] is None and kp["live"] is not None
    ac = {r.k: r.acf for r in TS.acf(df, ["k"], "t", "x", 3).where("lag = 1").collect()}
    assert ac["flat"] is None and ac["live"] is not None
    fits = TS.ar_fit(df, ["k"], "t", "x")
    fc = TS.ar_forecast(df, fits, ["k"], "t", "x", h=2).collect()
    assert {r.k for r in fc} == {"flat", "live"} and len(fc) == 4


def test_null_groups_and_labels_keep_their_rows(spark):
    df = spark.createDataFrame([(None, 1.0, 1), (None, 3.0, 2), ("a", 2.0, 3), ("a", 4.0, 4), ("a", 6.0, 5)], "g string, x double, id int")
    assert {r.g: r.n for r in A.box_stats(df, "x", ["g"]).collect()} == {None: 2, "a": 3}
    assert FT.stratified_split(df, "g", 0.5, "id").count() == 5


def test_scoring_returns_every_row(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(3 * a + b), int(a + b > 0)) for i, (a, b) in enumerate(rng.standard_normal((80, 2)))]
    df = spark.createDataFrame(rows, "id int, x double, y double, z int")
    holes = df.withColumn("x", F.when(F.col("id") % 4 == 0, None).otherwise(F.col("x")))
    for out, col in ((M.predict(M.ols_spark_ml(df, "y", ["x"]), holes, ["x"], "p"), "p"),
                     (M.predict_prob(M._glm(df, "z", ["x"]), holes, ["x"], "p"), "p")):
        got = out.select("id", col).collect()
        assert len(got) == 80 and all((r[col] is None) == (r.id % 4 == 0) for r in got)
    assert all(r.converged for r in M.logit(df, "z", ["x"]).collect())


def test_one_class_constant_column_and_null_scores(spark):
    one = spark.createDataFrame([(1, 0.3), (1, 0.6)], "y int, p double")
    assert E.auc(one, "y", "p").first().auc is None and E.ks(one, "y", "p").first().ks is None
    some = spark.createDataFrame([(1, 0.9), (1, 0.8), (1, None), (0, 0.1)], "y int, p double")
    low = E.cutoff_sweep(some, "y", "p").orderBy("cutoff").first()
    assert low.sensitivity == 1.0
    flat = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0)], "a double, b double")
    assert [r.b for r in FT.zscore(flat, ["b"]).collect()] == [None, None]
    x = np.column_stack([np.ones(20), np.arange(20.0), np.full(20, 7.0), np.arange(20.0) ** 2])
    v = G.vif_from_gram(x.T @ x, 20)
    assert np.isnan(v[1]) and v[0] > 1 and v[2] > 1


def test_dummies_refuse_too_many_levels(spark):
    df = spark.range(20).withColumn("c", F.col("id").cast("string"))
    with pytest.raises(ValueError, match="20 levels"):
        FT.dummies(df, ["c"], max_levels=10)


def test_entry_runs_by_path_from_another_folder(tmp_path):
    from paths import SF_SMALL
    code = f"""
import importlib.util, os, tempfile
spec = importlib.util.spec_from_file_location("entry", {repr(str(__import__('pathlib').Path(__file__).resolve().parents[1] / '__spark_entry__.py'))})
e = importlib.util.module_from_spec(spec); spec.loader.exec_module(e)
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("rows", e.queries()["ml_ols_by_group"](s, "{SF_SMALL}").count())
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=240,
                         env={k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"})
    assert "rows 12" in out.stdout, out.stderr[-800:]


def test_deciles_ties_nulls_and_small_tables(spark):
    from quarry.operators import windows as W
    rows = [(i, None if i % 7 == 0 else (2.0 if i % 3 else float(i % 5))) for i in range(97)]
    for n_rows in (97, 7, 1, 0):
        df = spark.createDataFrame(rows[:n_rows], "id int, s double")
        got = {r.id: r.b for r in W.deciles(df, "s", "id", 10, "b").collect()}
        order = sorted(rows[:n_rows], key=lambda r: (r[1] is None, -(r[1] or 0.0), r[0]))
        q, rem = divmod(n_rows, 10)
        sizes = [q + (b < rem) for b in range(10)]
        want = [b + 1 for b, size in enumerate(sizes) for _ in range(size)]
        assert got == {r[0]: b for r, b in zip(order, want)}


def test_splits_with_null_and_repeated_ids(spark):
    ids = [None] * 30 + [5] * 30 + list(range(100, 140))
    df = spark.createDataFrame([(i, "a" if j % 2 else None) for j, i in enumerate(ids)], "id int, g string")
    for out in (FT.random_split(df, 0.5, "id"), FT.stratified_split(df, "g", 0.5, "id")):
        rows = out.collect()
        assert len(rows) == 100
        sides = {}
        for r in rows:
            sides.setdefault((r.g, r.id), set()).add(r.split)
        assert all(len(s) == 1 for s in sides.values())
    train = FT.random_split(df, 0.5, "id").where("split = 'train'").count()
    assert train <= 50
    assert FT.random_split(df.limit(0), 0.5, "id").count() == 0
    assert FT.random_split(df, 0.0, "id").where("split = 'train'").count() == 0
    assert FT.random_split(df, 1.0, "id").where("split = 'test'").count() == 0


def test_hinges_mad_and_hot_value(spark):
    import numpy as np
    xs = [1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 100.0, 101.0]
    df = spark.createDataFrame([(v,) for v in xs], "x double")
    r = A.box_stats(df, "x", method="hinges").first()
    assert (r.q1, r.median, r.q3) == (4.0, 16.0, 64.0)
    d = A.describe_numeric(df, ["x"]).first()
    assert abs(d.mad - 1.4826 * np.median(np.abs(np.array(xs) - np.median(xs)))) < 1e-9
    assert abs(d.sd - np.std(xs, ddof=1)) < 1e-9
    hot = spark.createDataFrame([(3.0,)] * 900 + [(float(i),) for i in range(100)] + [(None,)] * 5, "x double")
    got = {round(r.pct, 2): r.value for r in A.percentile_table(hot, ["x"], 0.25).collect()}
    v = np.array([3.0] * 900 + list(range(100)))
    assert got == {p: float(np.quantile(v, p)) for p in (0, 0.25, 0.5, 0.75, 1.0)}
    one = A.describe_numeric(spark.createDataFrame([(2.0, None)], "x double, y double"), ["x", "y"]).collect()
    assert {r.column: (r.n, r.nulls, r.sd, r.mad) for r in one} == {"x": (1, 0, None, 0.0), "y": (0, 1, None, None)}
