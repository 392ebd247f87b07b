"""Operators on small hand-made frames, checked against plain Python / pandas."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.operators import aggregate as A
from quarry.operators import columns as C
from quarry.operators import evaluate as E
from quarry.operators import features as FT
from quarry.operators import quality as Q
from quarry.operators import reshape as R
from quarry.operators import windows as W
from quarry.sources import files as IO


def test_ntile_uneven_groups(spark):
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(27)], "id int, s double")
    got = W.deciles(df, "s", "id", 10).groupBy("bucket").count().orderBy("bucket").collect()
    assert [r["count"] for r in got] == [3] * 7 + [2] * 3


def test_global_row_number_matches_window(spark):
    random.seed(3)
    rows = [(i, random.randint(0, 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, v int").repartition(7)
    got = W.global_row_number(df, [F.desc("v"), F.asc("id")]).select("id", "rn").collect()
    exp = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert sorted((r.rn, r.id) for r in got) == [(i + 1, r[0]) for i, r in enumerate(exp)]


def test_deciles_match_sql_ntile(spark):
    random.seed(5)
    df = spark.createDataFrame([(i, random.random()) for i in range(103)], "id int, s double")
    mine = {r.id: r.bucket for r in W.deciles(df, "s", "id", 10).collect()}
    df.createOrReplaceTempView("dec_t")
    ref = {r.id: r.b for r in spark.sql("SELECT id, ntile(10) OVER (ORDER BY s DESC, id) AS b FROM dec_t").collect()}
    assert mine == ref


def test_top_n_ties(spark):
    df = spark.createDataFrame([("a", 5), ("a", 5), ("a", 4), ("a", 3), ("b", 1)], "g string, v int")
    keep = W.top_n_per_group(df, ["g"], [F.desc("v")], 2, ties="keep").count()
    cut = W.top_n_per_group(df, ["g"], [F.desc("v")], 2, ties="cut").count()
    assert keep == 4 and cut == 3


def test_argmax_first_tie(spark):
    df = spark.createDataFrame([(1, "x", 9.0), (2, "y", 9.0), (3, "z", None)], "id int, name string, v double")
    r = A.argmax(df, "v", ["name"], tie=["id"]).first()
    assert r.name == "x"


def test_dedup_idempotent(spark):
    df = spark.createDataFrame([(1, 3), (1, 5), (2, 1), (2, 1)], "k int, v int")
    once = Q.dedup(df, ["k"], [F.desc("v")])
    twice = Q.dedup(once, ["k"], [F.desc("v")])
    assert sorted(once.collect()) == sorted(twice.collect()) == [(1, 5), (2, 1)]


def test_rules_null_and_equal_times(spark):
    df = spark.createDataFrame([(1, 1, 2, 1), (2, 2, 2, 1), (3, 3, 2, None), (4, 1, 2, 7)],
                               "id int, start int, stop int, p int")
    rules = {"order": F.col("start") < F.col("stop"), "p": F.col("p").isin(1, 2, 3)}
    rep = Q.rule_report(df, rules).first()
    assert rep.violations == 3  # id 2 (equal times), 3 (bad order + NULL), 4 (bad code)
    assert sorted(r.id for r in Q.conform(df, rules).collect()) == [1]
    lax = Q.rule_report(df, {"p": F.col("p").isin(1, 2, 3)}, null_is_fail=False).first()
    assert lax.violations == 1
    # equal start and end breaks the "<" load rule but not a ">" violation rule
    assert df.where(F.col("start") > F.col("stop")).count() == 1


def test_null_profile_and_drop_all_null(spark):
    df = spark.createDataFrame([(1, None, "a"), (None, None, "b")], "a int, b int, c string")
    prof = {r.column: (r.nulls, r.pct) for r in Q.null_profile(df).collect()}
    assert prof == {"a": (1, 50.0), "b": (2, 100.0), "c": (0, 0.0)}
    assert C.drop_all_null(df).columns == ["a", "c"]


def test_key_report_and_overlap(spark):
    a = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int")
    r = Q.key_report(a, "k").first()
    assert (r.rows, r.distinct_keys, r.null_keys, r.is_key) == (4, 3, 1, False)
    b = spark.createDataFrame([(2,), (3,)], "k int")
    o = Q.key_overlap(a, b, "k").first()
    assert (o.only_a, o.only_b, o.both) == (1, 1, 1)


def test_melt_then_pivot_is_identity(spark):
    df = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "id int, x int, y int")
    long = R.melt_flags(df, ["id"], ["x", "y"], keep_zero=True)
    wide = R.spread_wide(long, ["id"], "name", ["x", "y"], F.first("value"))
    assert sorted(wide.collect()) == sorted(df.collect())


def test_row_stats(spark):
    df = spark.createDataFrame([(1, 2.0, None, 4.0), (2, None, None, None)], "id int, a double, b double, c double")
    m = {r.id: r.row_mean for r in R.row_mean(df, ["id"], ["a", "b", "c"]).collect()}
    n = {r.id: r.n_null for r in R.row_null_count(df, ["id"], ["a", "b", "c"]).collect()}
    assert m == {1: 3.0, 2: None} and n == {1: 1, 2: 3}


def test_splits_exact_and_disjoint(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(100)], "id int, y int")
    s = FT.stratified_split(df, "y", 0.7, "id", seed=9)
    per = {(r.y, r.split): r["count"] for r in s.groupBy("y", "split").count().collect()}
    for y, n in ((0, 34), (1, 33), (2, 33)):
        assert per[(y, "train")] == round(n * 0.7)
    assert s.select("id").distinct().count() == 100
    r = FT.random_split(df, 0.3, "id", seed=9)
    assert r.where("split = 'train'").count() == 30


def test_dummies_drop_first_level(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    out = FT.dummies(df, ["k"])
    assert out.columns == ["k_b", "k_c"]


def test_percentile_methods_agree(spark):
    random.seed(11)
    vals = [random.randint(0, 50) * 1.0 for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    exact = {r.pct: r.value for r in A.percentile_table(df, ["x"], 0.1, "exact").collect()}
    srt = {r.pct: r.value for r in A.percentile_table(df, ["x"], 0.1, "sort").collect()}
    ref = pd.Series(vals).quantile([i / 10 for i in range(11)])
    for i in range(11):
        p = round(i / 10, 6)
        assert exact[p] == pytest.approx(ref.iloc[i]) and srt[p] == pytest.approx(ref.iloc[i])


def test_prefix_sums(spark):
    df = spark.createDataFrame([(i, i * 2) for i in range(50)], "k int, v int").repartition(5)
    got = {r.k: r.cum_v for r in E.prefix_sums(df, [F.asc("k")], ["v"]).collect()}
    assert got == {i: sum(j * 2 for j in range(i + 1)) for i in range(50)}


def _scored(n=300, seed=1):
    random.seed(seed)
    return [(i, int(random.random() < 0.4), round(random.random(), 2)) for i in range(n)]


def test_auc_ks_against_brute_force(spark):
    rows = _scored()
    df = spark.createDataFrame(rows, "id int, y int, p double")
    pos = [p for _, y, p in rows if y == 1]
    neg = [p for _, y, p in rows if y == 0]
    brute = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg) / (len(pos) * len(neg))
    assert E.auc(df, "y", "p").first().auc == pytest.approx(brute)
    ks = max(sum(p >= s for p in pos) / len(pos) - sum(p >= s for p in neg) / len(neg) for s in set(pos + neg))
    assert E.ks(df, "y", "p").first().ks == pytest.approx(ks)


def test_cutoff_sweep_against_brute_force(spark):
    rows = _scored()
    df = spark.createDataFrame(rows, "id int, y int, p double")
    got = {round(r.cutoff, 9): (r.sensitivity, r.specificity) for r in E.cutoff_sweep(df, "y", "p", 0.01, 0.99, 100).collect()}
    P = sum(y for _, y, _ in rows)
    N = len(rows) - P
    step = (0.99 - 0.01) / 99
    for i in range(100):
        c = 0.01 + i * step
        tp = sum(1 for _, y, p in rows if y == 1 and p >= c)
        tn = sum(1 for _, y, p in rows if y == 0 and p < c)
        assert got[round(c, 9)] == (pytest.approx(tp / P), pytest.approx(tn / N))


def test_gain_lift_ends_at_100(spark):
    df = spark.createDataFrame(_scored(), "id int, y int, p double")
    g = E.gain_lift(df, "y", "p", "id").orderBy("bucket").collect()
    assert len(g) == 10 and g[-1].gain == pytest.approx(100.0) and g[-1].lift == pytest.approx(1.0)


def test_kappa_perfect(spark):
    df = spark.createDataFrame([(i % 3, i % 3) for i in range(30)], "y int, p int")
    r = E.multiclass_summary(df, "y", "p").first()
    assert r.accuracy == 1.0 and r.kappa == pytest.approx(1.0)


def test_read_delimited_skips_lines_per_file(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    for k in range(3):
        (d / f"part{k}.txt").write_text("junk header\nmore junk\n" + "".join(f"{k}|{i}|x{i}\n" for i in range(5)))
    df = IO.read_delimited(spark, str(d), "a int, b int, c string", sep="|", skip=2)
    assert df.count() == 15 and df.where("a IS NULL").count() == 0


def test_nullify_tokens(spark):
    df = spark.createDataFrame([("NA", 1), ("", 2), ("n/a", 3), ("ok", 4)], "s string, i int")
    assert [r.s for r in IO.nullify(df).orderBy("i").collect()] == [None, None, None, "ok"]


def test_write_partitioned_dynamic_overwrite(spark, tmp_path):
    path = str(tmp_path / "orc")
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "m int, d int, v string")
    IO.write_partitioned(df, path, ["m", "d"])
    IO.write_partitioned(spark.createDataFrame([(1, 1, "z")], "m int, d int, v string"), path, ["m", "d"])
    got = sorted((r.m, r.d, r.v) for r in spark.read.orc(path).collect())
    assert got == [(1, 1, "z"), (1, 2, "b"), (2, 1, "c")]


def test_union_years_common_columns(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(3,)], "x int")
    assert C.union_years({2015: a, 2016: b}).columns == ["x", "year"]
    assert C.union_years({2015: a, 2016: b}, fill=True).count() == 2


def test_box_stats_whiskers(spark):
    vals = [1, 2, 3, 4, 5, 6, 7, 8, 100]
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    r = A.box_stats(df, "x").first()
    assert (r.q1, r.median, r.q3) == (3.0, 5.0, 7.0)
    assert r.upper_whisker == 8.0 and r.outliers == 1
