"""Rank selection against sorted values: many shapes, both ways of holding intervals, plans."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import aggregate as A
from quarry.operators import selection as S
from quarry.operators import windows as W


def _type7(probs):
    return {p: lambda n, p=p: (n - 1) * F.lit(float(p)) for p in probs}


def _want(xs, p):
    xs = sorted(xs)
    h = (len(xs) - 1) * p
    a, b = xs[math.floor(h)], xs[math.ceil(h)]
    return a if a == b else a + (h - math.floor(h)) * (b - a)


RNG = np.random.default_rng(0)
SHAPES = {
    "normal": RNG.standard_normal(400), "ties": RNG.integers(0, 3, 600).astype(float), "one": np.array([3.5]),
    "spread": np.concatenate([RNG.standard_normal(50) * 1e-200, [1e300, -1e300, 0.0], RNG.standard_normal(50)]),
    "tiny": np.array([0.0, 5e-324, 1e-323] * 20), "hot": np.concatenate([np.full(900, 7.25), RNG.uniform(0, 100, 50)]),
}


@pytest.mark.parametrize("local", [20_000, 0])
def test_quantiles_of_groups(spark, monkeypatch, local):
    monkeypatch.setattr(S, "LOCAL_ROWS", local)
    rows = [(k, float(v)) for k, vs in SHAPES.items() for v in vs] + [(None, float(v)) for v in range(11)] + [("empty", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(3)
    probs = [0, 0.1, 0.25, 0.5, 0.97, 1]
    got = {(r._by0, r.pct): r.value for r in S.quantiles(df, "x", _type7(probs), ["g"]).collect()}
    want = {(k, p): _want(map(float, vs), p) for k, vs in [*SHAPES.items(), (None, range(11))] for p in probs}
    assert got == want


def test_ranks_over_all_of_bigint(spark):
    xs = [int(v) for v in RNG.integers(-2**63, 2**63 - 1, 300)] + list(range(-40, 40)) + [-2**63, 2**63 - 1, 5, 5, 5]
    df = spark.createDataFrame([(v,) for v in xs], "x bigint")
    got = S.select_ranks(df, "x", lambda n: F.sequence(F.lit(0), n - 1, F.lit(3)), len(xs)).collect()
    ordered = sorted(xs)
    assert len(got) == len(ordered[::3]) and all(r.value == ordered[r["rank"]] and r.below == ordered.index(r.value)
                                                 and r.same == ordered.count(r.value) and r.total == len(xs) for r in got)


def test_special_values_and_empty_tables(spark):
    xs = [float(v) for v in ("nan", "inf", "-inf", 1, 2, 2, "nan")]
    df = spark.createDataFrame([(v,) for v in xs] + [(None,)], "x double")
    got = sorted((r["rank"], str(r.value), r.below, r.same) for r in S.select_ranks(df, "x", lambda n: F.sequence(F.lit(0), n - 1), 9).collect())
    assert got == [(0, "-inf", 0, 1), (1, "1.0", 1, 1), (2, "2.0", 2, 2), (3, "2.0", 2, 2), (4, "inf", 4, 1), (5, "nan", 5, 2), (6, "nan", 5, 2)]
    for empty in (df.limit(0), df.where("x is null")):
        assert S.quantiles(empty, "x", _type7([0.5])).count() == 0
        assert S.select_ranks(empty.withColumn("g", F.lit(1)), "x", lambda n: F.array(F.lit(0)), 1, ["g"]).count() == 0


def test_rounds_do_not_follow_the_number_of_ranks(spark, monkeypatch):
    """No sort of values and no checkpoint; a hundred ranks take as many passes as three."""
    df = spark.range(40_000).select((F.xxhash64("id") / 1e9).alias("x"))
    passes, settle = [], S._settle
    monkeypatch.setattr(S, "_settle", lambda t, b: passes.append(t._jdf.queryExecution().optimizedPlan().toString()) or settle(t, b))
    took = []
    for probs in ([0.25, 0.5, 0.75], [i / 100 for i in range(101)]):
        passes.clear()
        A.quantiles_sorted(df, "x", probs).collect()
        took.append(len(passes))
        assert not any("Sort [" in p or "checkpoint" in p.lower() for p in passes)
        assert all("Aggregate [" in p for p in passes)
    assert took[1] <= took[0] + 1 <= 6


@pytest.mark.parametrize("ids", ["bigint", "string"])
def test_ntile_with_ties_and_null_ids(spark, ids):
    rows = [(None if i % 11 == 0 else 1000 - i, None if i % 13 == 0 else float(i % 3)) for i in range(230)] + [(7, float("nan"))] * 3
    df = spark.createDataFrame(rows, "id bigint, s double").withColumn("id", F.col("id").cast(ids))
    df.createOrReplaceTempView("sel_t")
    # rows equal in score and id share a bucket, so buckets are compared on the last row of each
    cuts = W.rank_cuts(df, "s", "id", 10)
    ranked = spark.sql("SELECT id, s, row_number() OVER (ORDER BY s DESC NULLS LAST, id) AS rn FROM sel_t").collect()
    q, rem = divmod(len(rows), 10)
    last = {r.rn: (r.s, r.id) for r in ranked}
    ends = [b * q + min(b, rem) for b in range(1, 10)]
    assert [str(c[0]) for c in cuts] == [str(last[e][0]) for e in ends]
    assert all(c[1] or c[2] == last[e][1] for c, e in zip(cuts, ends))
