"""Window functions and sort / top-k (§2.8) on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import cv
from quarry.operators import windows as W
from quarry.plans.registry import query
from quarry.plans.standins import (MONTHLY_FILLED_SQL, ORDER_MONTHS_SQL, SCORED_DOCS_SQL,
                                   TICKETS_SQL, monthly_filled, order_months, scored_docs,
                                   tickets)
from quarry.sources.tables import Tables


def _code_counts(spark, sf_dir, by):
    tk = tickets(Tables(spark, sf_dir))
    return tk.groupBy(*by, "code").agg(F.count(F.lit(1)).alias("n"))


@query("win_topn_dense", section="2.7", sql=f"""
WITH {TICKETS_SQL},
c AS (SELECT fy, code, COUNT(*) AS n FROM tickets GROUP BY 1, 2)
SELECT fy, code, CAST(n AS BIGINT) AS n, rnk FROM (
  SELECT *, CAST(dense_rank() OVER (PARTITION BY fy ORDER BY n DESC) AS INTEGER) AS rnk FROM c)
WHERE rnk <= 3""")
def win_topn_dense(spark, sf_dir):
    c = _code_counts(spark, sf_dir, ["fy"])
    return W.top_n_per_group(c, ["fy"], [F.desc("n")], 3, ties="keep")


@query("win_topn_rows", section="2.7", sql=f"""
WITH {TICKETS_SQL},
c AS (SELECT precinct, code, COUNT(*) AS n FROM tickets WHERE precinct IN (1, 2, 3) GROUP BY 1, 2)
SELECT precinct, code, CAST(n AS BIGINT) AS n, rnk FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY precinct ORDER BY n DESC, code) AS INTEGER) AS rnk FROM c)
WHERE rnk <= 3""")
def win_topn_rows(spark, sf_dir):
    tk = tickets(Tables(spark, sf_dir)).where(F.col("precinct").isin(1, 2, 3))
    c = tk.groupBy("precinct", "code").agg(F.count(F.lit(1)).alias("n"))
    return W.top_n_per_group(c, ["precinct"], [F.desc("n"), F.asc("code")], 3, ties="cut")


@query("win_topn_of_topn", section="2.7", sql=f"""
WITH {TICKETS_SQL},
c AS (SELECT precinct, code, COUNT(*) AS n FROM tickets WHERE precinct <> 0 GROUP BY 1, 2),
g AS (SELECT precinct FROM c GROUP BY precinct ORDER BY SUM(n) DESC, precinct LIMIT 3)
SELECT precinct, code, CAST(n AS BIGINT) AS n, rnk FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY precinct ORDER BY n DESC, code) AS INTEGER) AS rnk
  FROM c WHERE precinct IN (SELECT precinct FROM g))
WHERE rnk <= 3""")
def win_topn_of_topn(spark, sf_dir):
    tk = tickets(Tables(spark, sf_dir)).where(F.col("precinct") != 0)
    return W.top_n_of_top_groups(tk, "precinct", "code", 3, 3)


@query("win_nth_highest", section="2.7", sql="""
SELECT p_type, p_partkey, p_retailprice FROM (
  SELECT *, dense_rank() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC) AS r FROM part)
WHERE r = 2""")
def win_nth_highest(spark, sf_dir):
    p = Tables(spark, sf_dir).part.select("p_type", "p_partkey", "p_retailprice")
    return W.nth_highest(p, "p_retailprice", 2, ties="value", by=["p_type"])


@query("win_nth_highest_row", section="2.7", sql="""
SELECT p_type, p_partkey, p_retailprice FROM (
  SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS r FROM part)
WHERE r = 2""")
def win_nth_highest_row(spark, sf_dir):
    p = Tables(spark, sf_dir).part.select("p_type", "p_partkey", "p_retailprice")
    return W.nth_highest(p, "p_retailprice", 2, ties="row", by=["p_type"], tie_break=["p_partkey"])


@query("win_total_over_all", section="2.7", sql="""
SELECT o_orderkey, o_totalprice, ROUND(SUM(o_totalprice) OVER (), 2) AS grand_total,
       ROUND(o_totalprice / SUM(o_totalprice) OVER (), 10) AS share FROM orders""")
def win_total_over_all(spark, sf_dir):
    o = Tables(spark, sf_dir).orders.select("o_orderkey", "o_totalprice")
    out = W.with_grand_total(o, F.sum("o_totalprice"), "grand_total")
    return out.select("o_orderkey", "o_totalprice", F.round("grand_total", 2).alias("grand_total"),
                      F.round(F.col("o_totalprice") / F.col("grand_total"), 10).alias("share"))


@query("win_ntile_deciles", section="2.7", sql=f"""
WITH {SCORED_DOCS_SQL}
SELECT doc_id, y, p, CAST(ntile(10) OVER (ORDER BY p DESC, doc_id) AS INTEGER) AS bucket FROM scored_docs""")
def win_ntile_deciles(spark, sf_dir):
    return W.deciles(scored_docs(Tables(spark, sf_dir)), "p", "doc_id", 10)


@query("win_cumulative", section="2.7", sql="""
WITH c AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
                  COUNT(*) AS n FROM orders GROUP BY 1, 2)
SELECT year, month, CAST(n AS BIGINT) AS n,
       CAST(SUM(n) OVER (PARTITION BY year ORDER BY month ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_n,
       ROUND(SUM(n) OVER (PARTITION BY year ORDER BY month ROWS UNBOUNDED PRECEDING)
             / SUM(n) OVER (PARTITION BY year), 6) AS cum_n_share FROM c""")
def win_cumulative(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    c = o.groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")) \
        .agg(F.count(F.lit(1)).alias("n"))
    out = W.cumulative(c, ["month"], "n", "cum_n", by=["year"], share=True)
    return out.withColumn("cum_n_share", F.round("cum_n_share", 6))


def _smoothed(spark, sf_dir):
    mf = monthly_filled(Tables(spark, sf_dir))
    first = F.min("t").over(Window.partitionBy("market", "segment"))
    mf = mf.withColumn("pos", (F.col("t") - first + 1).cast("int"))
    return W.moving_avg(mf, ["market", "segment"], "pos", "sales", 1, "ma")


_SMOOTH_SQL = f"""{MONTHLY_FILLED_SQL},
s AS (SELECT market, segment, CAST(t - MIN(t) OVER (PARTITION BY market, segment) + 1 AS INTEGER) AS pos, sales
      FROM monthly_filled),
m AS (SELECT *, CASE WHEN COUNT(sales) OVER w = 3 THEN AVG(sales) OVER w END AS ma FROM s
      WINDOW w AS (PARTITION BY market, segment ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))"""


@query("win_moving_avg", section="2.7", sql=f"""
WITH {_SMOOTH_SQL}
SELECT market, segment, pos, ROUND(ma, 4) AS ma FROM m""")
def win_moving_avg(spark, sf_dir):
    out = _smoothed(spark, sf_dir)
    return out.select("market", "segment", "pos", F.round("ma", 4).alias("ma"))


@query("win_ma_end_fill", section="2.7", sql=f"""
WITH {_SMOOTH_SQL},
e AS (SELECT *, MAX(pos) OVER (PARTITION BY market, segment) AS n FROM m),
f AS (SELECT *, MAX(CASE WHEN pos = n - 1 THEN ma END) OVER g AS rb, MAX(CASE WHEN pos = n - 2 THEN ma END) OVER g AS rp,
             MAX(CASE WHEN pos = 2 THEN ma END) OVER g AS lb, MAX(CASE WHEN pos = 3 THEN ma END) OVER g AS ln
      FROM e WINDOW g AS (PARTITION BY market, segment))
SELECT market, segment, pos,
       ROUND(CASE WHEN ma IS NOT NULL THEN ma WHEN pos > n - 1 THEN rb + (pos - (n - 1)) * (rb - rp)
                  WHEN pos <= 1 THEN lb - (2 - pos) * (ln - lb) END, 4) AS smooth FROM f""")
def win_ma_end_fill(spark, sf_dir):
    out = W.extend_ends(_smoothed(spark, sf_dir), ["market", "segment"], "pos", "ma", 1, "smooth")
    return out.select("market", "segment", "pos", F.round("smooth", 4).alias("smooth"))


@query("win_month_sequence", section="2.7", sql=f"""
WITH {ORDER_MONTHS_SQL}
SELECT market, segment, year, month,
       CAST(year * 12 + month - MIN(year * 12 + month) OVER (PARTITION BY market, segment) + 1 AS INTEGER) AS month_seq
FROM order_months""")
def win_month_sequence(spark, sf_dir):
    om = order_months(Tables(spark, sf_dir)).select("market", "segment", "year", "month")
    return W.month_sequence(om, ["market", "segment"], "year", "month")


# ------------------------------------------------------------------ sort / top-k

@query("srt_multi_key", section="2.8", sql="""
SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders
ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey""")
def srt_multi_key(spark, sf_dir):
    o = Tables(spark, sf_dir).orders.select("o_orderkey", "o_orderpriority", "o_totalprice")
    return o.orderBy(F.asc("o_orderpriority"), F.desc("o_totalprice"), F.asc("o_orderkey"))


@query("srt_topk", section="2.8", sql="""
SELECT l_partkey, SUM(l_quantity) AS sum_qty FROM lineitem GROUP BY 1
ORDER BY sum_qty DESC, l_partkey LIMIT 10""")
def srt_topk(spark, sf_dir):
    s = Tables(spark, sf_dir).lineitem.groupBy("l_partkey").agg(F.sum("l_quantity").alias("sum_qty"))
    return W.top_k(s, [F.desc("sum_qty"), F.asc("l_partkey")], 10)


@query("srt_tail", section="2.8", sql="""
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 10""")
def srt_tail(spark, sf_dir):
    o = Tables(spark, sf_dir).orders.select("o_orderkey", "o_totalprice")
    return W.tail(o, "o_orderkey", 10)


@query("srt_first_n", section="2.8", sql="""
SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 5""")
def srt_first_n(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    return W.first_n(o, [F.asc("o_orderdate"), F.asc("o_orderkey")], 5).select("o_orderkey", "o_orderstatus")


@query("srt_intersect_topk", section="2.8", sql=f"""
WITH {ORDER_MONTHS_SQL},
s AS (SELECT market, segment, ROUND(SUM(sales), 2) AS total_sales,
             ROUND(100 * stddev_samp(sales) / AVG(sales), 4) AS cv_sales FROM order_months GROUP BY 1, 2),
a AS (SELECT * FROM s ORDER BY total_sales DESC LIMIT 10),
b AS (SELECT * FROM s ORDER BY cv_sales LIMIT 10)
SELECT * FROM a INTERSECT SELECT * FROM b""")
def srt_intersect_topk(spark, sf_dir):
    om = order_months(Tables(spark, sf_dir))
    s = om.groupBy("market", "segment").agg(F.round(F.sum("sales"), 2).alias("total_sales"),
                                            F.round(cv("sales"), 4).alias("cv_sales"))
    return W.in_both_top_k(s, [F.desc("total_sales")], [F.asc("cv_sales")], 10)
