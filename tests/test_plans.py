"""Plan shapes the scale design relies on, read from the physical plan text."""

from pyspark.sql import functions as F

from quarry.functions import in_fiscal_year
from quarry.operators import windows as W
from quarry.plans.registry import load_all
from quarry.sources.tables import Tables

from paths import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_n_has_partial_group_limit_before_shuffle(spark):
    li = Tables(spark, SF_SMALL).lineitem
    top = W.top_n_per_group(li, ["l_returnflag"], [F.desc("l_extendedprice")], 3, ties="cut")
    plan = _plan(top)
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_fiscal_year_filter_reaches_parquet(spark):
    o = Tables(spark, SF_SMALL).orders.where(in_fiscal_year("o_orderdate", 1998)).select("o_orderkey")
    plan = _plan(o)
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in plan


def test_registered_queries_avoid_cartesian_products(spark):
    reg = load_all()
    for name in ("jn_inner_multi", "ag_share_of_total", "win_total_over_all", "ag_box_stats",
                 "flt_outlier_cap", "dq_impute_mean", "pl_sector_investment"):
        plan = _plan(reg[name].build(spark, SF_SMALL))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_deciles_have_no_single_partition_window_on_rows(spark):
    df = Tables(spark, SF_SMALL).lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    d = W.deciles(df.withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")),
                  "l_extendedprice", "id")
    plan = _plan(d)
    assert "ntile(" not in plan.lower()  # no SQL ntile: that would be one window over all rows
    # the row total is one scalar subquery (one count), not one per reference
    assert plan.count("Exchange SinglePartition") <= 2
