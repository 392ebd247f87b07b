"""Aggregations on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import avg_where, bands, cv
from quarry.operators import aggregate as A
from quarry.plans.registry import query
from quarry.plans.standins import (CUSTOMERS_GEO_SQL, LOANS_SQL, ORDER_MONTHS_SQL, REQUESTS_SQL,
                                   PROFIT_SQL, TRIPS_SQL, customers_geo, loans, money, order_months,
                                   profit_col, requests, trips)
from quarry.sources.tables import Tables


@query("ag_global", section="2.6", sql="""
SELECT SUM(l_quantity) AS sum_qty, ROUND(AVG(l_extendedprice), 4) AS avg_price FROM lineitem""")
def ag_global(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem
    return A.totals(li, {"sum_qty": F.sum("l_quantity"), "avg_price": F.round(F.avg("l_extendedprice"), 4)})


@query("ag_group_count", section="2.6", sql="""
SELECT o_orderpriority, CAST(COUNT(*) AS BIGINT) AS n FROM orders GROUP BY 1""")
def ag_group_count(spark, sf_dir):
    return A.count_by(Tables(spark, sf_dir).orders, "o_orderpriority")


@query("ag_group_sum", section="2.6", sql="""
SELECT p.p_type, p.p_brand, ROUND(SUM(l.l_extendedprice), 2) AS sum_l_extendedprice,
       ROUND(SUM(l.l_quantity), 2) AS sum_l_quantity
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1, 2""")
def ag_group_sum(spark, sf_dir):
    t = Tables(spark, sf_dir)
    j = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return A.sum_by(j, ["p_type", "p_brand"], ["l_extendedprice", "l_quantity"], digits=2)


@query("ag_group_mean", section="2.6", sql="""
SELECT o_orderpriority, ROUND(AVG(o_totalprice), 4) AS avg_o_totalprice FROM orders GROUP BY 1""")
def ag_group_mean(spark, sf_dir):
    out = A.mean_by(Tables(spark, sf_dir).orders, ["o_orderpriority"], ["o_totalprice"])
    return out.withColumn("avg_o_totalprice", F.round("avg_o_totalprice", 4))


@query("ag_group_multi", section="2.6", sql="""
SELECT l_returnflag, SUM(l_quantity) AS qty, CAST(COUNT(NULLIF(l_linenumber, 7)) AS BIGINT) AS lines_known,
       CAST(COUNT(*) AS BIGINT) AS lines FROM lineitem GROUP BY 1""")
def ag_group_multi(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem
    return A.agg_by(li, ["l_returnflag"], {"qty": F.sum("l_quantity"),
                                           "lines_known": F.count(F.nullif("l_linenumber", F.lit(7))),
                                           "lines": F.count(F.lit(1))})


@query("ag_group_year_month", section="2.6", sql=f"""
WITH {CUSTOMERS_GEO_SQL}
SELECT c.r_name, c.c_mktsegment, CAST(year(o.o_orderdate) AS INTEGER) AS year,
       CAST(month(o.o_orderdate) AS INTEGER) AS month,
       ROUND(SUM(l.l_extendedprice), 2) AS sum_sales, ROUND(SUM(l.l_quantity), 2) AS sum_qty,
       CAST(ROUND(SUM({PROFIT_SQL}), 2) AS DOUBLE) AS sum_profit
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customers_geo c ON o.o_custkey = c.c_custkey
GROUP BY 1, 2, 3, 4""")
def ag_group_year_month(spark, sf_dir):
    t = Tables(spark, sf_dir)
    cg = customers_geo(t).select("c_custkey", "r_name", "c_mktsegment")
    j = (t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
         .join(cg, F.col("o_custkey") == F.col("c_custkey"))
         .select("r_name", "c_mktsegment", "o_orderdate", F.col("l_extendedprice").alias("sales"),
                 F.col("l_quantity").alias("qty"), profit_col().alias("profit")))
    out = A.monthly(j, "o_orderdate", ["r_name", "c_mktsegment"], ["sales", "qty", "profit"])
    return out.select("r_name", "c_mktsegment", "year", "month", F.round("sum_sales", 2).alias("sum_sales"),
                      F.round("sum_qty", 2).alias("sum_qty"), money(F.col("sum_profit")).alias("sum_profit"))


@query("ag_having_max", section="2.6", sql="""
WITH c AS (SELECT n.n_name, COUNT(*) AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY 1)
SELECT n_name, CAST(n AS BIGINT) AS n FROM c WHERE n = (SELECT MAX(n) FROM c)""")
def ag_having_max(spark, sf_dir):
    t = Tables(spark, sf_dir)
    j = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return A.modal_groups(j, ["n_name"])


@query("ag_count_distinct", section="2.6", sql="""
SELECT CAST(COUNT(DISTINCT l_partkey) AS BIGINT) AS nd_l_partkey,
       CAST(COUNT(DISTINCT l_suppkey) AS BIGINT) AS nd_l_suppkey,
       CAST(COUNT(DISTINCT l_orderkey) AS BIGINT) AS nd_l_orderkey FROM lineitem""")
def ag_count_distinct(spark, sf_dir):
    return A.distinct_count(Tables(spark, sf_dir).lineitem, ["l_partkey", "l_suppkey", "l_orderkey"])


@query("ag_conditional", section="2.6", sql=f"""
WITH {TRIPS_SQL}
SELECT vendor, ROUND(AVG(CASE WHEN payment = 1 THEN fare END), 4) AS avg_card_fare,
       ROUND(AVG(CASE WHEN payment = 2 THEN tip END), 4) AS avg_cash_tip
FROM trips GROUP BY vendor""")
def ag_conditional(spark, sf_dir):
    tr = trips(Tables(spark, sf_dir))
    return tr.groupBy("vendor").agg(
        F.round(avg_where("fare", F.col("payment") == 1), 4).alias("avg_card_fare"),
        F.round(avg_where("tip", F.col("payment") == 2), 4).alias("avg_cash_tip"))


@query("ag_percentile_approx", section="2.6", sql="""
SELECT ROUND(AVG(l_quantity), 4) AS avg, quantile_disc(l_quantity, 0.25) AS p25,
       quantile_disc(l_quantity, 0.5) AS p50, quantile_disc(l_quantity, 0.75) AS p75,
       CAST(COUNT(DISTINCT l_quantity) AS BIGINT) AS n_distinct FROM lineitem""")
def ag_percentile_approx(spark, sf_dir):
    out = A.spread(Tables(spark, sf_dir).lineitem, "l_quantity")
    return out.withColumn("avg", F.round("avg", 4))


_PCTS = ", ".join(repr(round(i / 100, 2)) for i in range(101))


@query("ag_percentile_table", section="2.6", sql=f"""
SELECT "column", pct, ROUND(value, 6) AS value FROM (
  SELECT 'l_quantity' AS "column", UNNEST(range(101)) / 100.0 AS pct,
         UNNEST(quantile_cont(l_quantity, [{_PCTS}])) AS value FROM lineitem
  UNION ALL
  SELECT 'l_discount', UNNEST(range(101)) / 100.0, UNNEST(quantile_cont(l_discount, [{_PCTS}])) FROM lineitem)""")
def ag_percentile_table(spark, sf_dir):
    out = A.percentile_table(Tables(spark, sf_dir).lineitem, ["l_quantity", "l_discount"], 0.01, "exact")
    return out.withColumn("value", F.round("value", 6))


@query("ag_percentile_sorted", section="2.6", sql=f"""
SELECT "column", pct, ROUND(value, 4) AS value FROM (
  SELECT 'o_totalprice' AS "column", UNNEST(range(101)) / 100.0 AS pct,
         UNNEST(quantile_cont(o_totalprice, [{_PCTS}])) AS value FROM orders)""")
def ag_percentile_sorted(spark, sf_dir):
    out = A.percentile_table(Tables(spark, sf_dir).orders, ["o_totalprice"], 0.01, "sort")
    return out.withColumn("value", F.round("value", 4))


@query("ag_corr", section="2.6", sql="""
SELECT l_returnflag, ROUND(corr(l_quantity, l_extendedprice), 6) AS "corr" FROM lineitem GROUP BY 1""")
def ag_corr(spark, sf_dir):
    out = A.pair_corr(Tables(spark, sf_dir).lineitem, "l_quantity", "l_extendedprice", ["l_returnflag"])
    return out.withColumn("corr", F.round("corr", 6))


_DIST_BANDS_SQL = """CASE WHEN distance >= 0 AND distance < 10 THEN 'short'
     WHEN distance >= 10 AND distance < 30 THEN 'medium'
     WHEN distance >= 30 AND distance < 45 THEN 'long' ELSE 'other' END"""


def _dist_band():
    return bands("distance", [0, 10, 30, 45], ["short", "medium", "long"], "other")


@query("ag_share_of_total", section="2.6", sql=f"""
WITH {TRIPS_SQL}
SELECT band, CAST(n AS BIGINT) AS n, ROUND(n / SUM(n) OVER (), 6) AS share
FROM (SELECT {_DIST_BANDS_SQL} AS band, COUNT(*) AS n FROM trips GROUP BY 1)""")
def ag_share_of_total(spark, sf_dir):
    tr = trips(Tables(spark, sf_dir)).withColumn("band", _dist_band())
    return A.share(tr, ["band"]).withColumn("share", F.round("share", 6))


@query("ag_share_within_group", section="2.6", sql=f"""
WITH {LOANS_SQL}
SELECT grade, status, CAST(n AS BIGINT) AS n, ROUND(n / SUM(n) OVER (PARTITION BY grade), 6) AS share
FROM (SELECT grade, status, COUNT(*) AS n FROM loans GROUP BY 1, 2)""")
def ag_share_within_group(spark, sf_dir):
    ln = loans(Tables(spark, sf_dir))
    return A.share(ln, ["status"], within=["grade"]).withColumn("share", F.round("share", 6))


@query("ag_cv", section="2.6", sql=f"""
WITH {ORDER_MONTHS_SQL}
SELECT market, segment, ROUND(100 * stddev_samp(sales) / AVG(sales), 4) AS cv_sales
FROM order_months GROUP BY 1, 2""")
def ag_cv(spark, sf_dir):
    om = order_months(Tables(spark, sf_dir))
    return om.groupBy("market", "segment").agg(F.round(cv("sales"), 4).alias("cv_sales"))


@query("ag_col_max", section="2.6", sql="""
SELECT MAX(l_quantity) AS max_l_quantity, MAX(l_extendedprice) AS max_l_extendedprice,
       MAX(l_tax) AS max_l_tax FROM lineitem""")
def ag_col_max(spark, sf_dir):
    return A.col_max(Tables(spark, sf_dir).lineitem, ["l_quantity", "l_extendedprice", "l_tax"])


@query("ag_argmax", section="2.6", sql="""
SELECT p_type, p_retailprice, p_name, p_partkey FROM (
  SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS r FROM part)
WHERE r = 1""")
def ag_argmax(spark, sf_dir):
    return A.argmax(Tables(spark, sf_dir).part, "p_retailprice", ["p_name", "p_partkey"],
                    by=["p_type"], tie=["p_partkey"])


@query("ag_argmax_global", section="2.6", sql="""
SELECT c_acctbal, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 1""")
def ag_argmax_global(spark, sf_dir):
    return A.argmax(Tables(spark, sf_dir).customer, "c_acctbal", ["c_name"], tie=["c_custkey"])


@query("ag_frequency_1d", section="2.6", sql=f"""
WITH {LOANS_SQL}
SELECT col AS "column", value, status, CAST(COUNT(*) AS BIGINT) AS n FROM (
  SELECT 'grade' AS col, grade AS value, status FROM loans
  UNION ALL SELECT 'purpose', purpose, status FROM loans
  UNION ALL SELECT 'emp_length', emp_length, status FROM loans)
GROUP BY 1, 2, 3""")
def ag_frequency_1d(spark, sf_dir):
    return A.frequencies(loans(Tables(spark, sf_dir)), ["grade", "purpose", "emp_length"], split_by="status")


# The event types of the events table (the pivot columns).
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("ag_frequency_2d", section="2.6", sql=f"""
WITH {REQUESTS_SQL}
SELECT pickup_point, CAST(hour(requested) AS INTEGER) AS hour,
       {", ".join(f"CAST(COUNT(*) FILTER (WHERE status = '{s}') AS BIGINT) AS {s}" for s in EVENT_TYPES)}
FROM requests GROUP BY 1, 2""")
def ag_frequency_2d(spark, sf_dir):
    rq = requests(Tables(spark, sf_dir)).withColumn("hour", F.hour("requested"))
    return A.cross_counts(rq, ["pickup_point", "hour"], pivot="status", values=EVENT_TYPES).fillna(0)


@query("ag_describe", section="2.6", sql="""
WITH long AS (SELECT 'l_quantity' AS col, l_quantity AS x FROM lineitem
              UNION ALL SELECT 'l_discount', l_discount FROM lineitem),
m AS (SELECT col, AVG(x) AS mu, quantile_cont(x, 0.5) AS med FROM long GROUP BY col)
SELECT l.col AS "column", CAST(COUNT(x) AS BIGINT) AS n,
       CAST(COUNT(*) FILTER (WHERE x IS NULL) AS BIGINT) AS nulls,
       CAST(COUNT(DISTINCT x) AS BIGINT) AS n_distinct,
       CAST(COUNT(*) FILTER (WHERE x = 0) AS BIGINT) AS zeros,
       ROUND(AVG(x), 8) AS mean, ROUND(stddev_samp(x), 6) AS sd, MIN(x) AS min,
       ROUND(quantile_cont(x, 0.25), 6) AS q1, ROUND(quantile_cont(x, 0.5), 6) AS median,
       ROUND(quantile_cont(x, 0.75), 6) AS q3, MAX(x) AS max,
       ROUND(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) AS iqr,
       ROUND(1.4826 * quantile_cont(abs(x - med), 0.5), 6) AS mad,
       ROUND(AVG(power(x - mu, 3)) / power(AVG(power(x - mu, 2)), 1.5), 6) AS skew,
       ROUND(AVG(power(x - mu, 4)) / power(AVG(power(x - mu, 2)), 2) - 3, 6) AS kurt
FROM long l JOIN m USING (col) GROUP BY l.col""")
def ag_describe(spark, sf_dir):
    out = A.describe_numeric(Tables(spark, sf_dir).lineitem, ["l_quantity", "l_discount"])
    # eight digits: means of two-decimal values can end in a 5 after the sixth, where the engines' sums round apart
    out = out.withColumn("mean", F.round("mean", 8))
    return out.select(*[F.round(c, 6).alias(c) if c in ("sd", "q1", "median", "q3", "iqr", "mad", "skew", "kurt")
                        else F.col(c) for c in out.columns])


@query("ag_describe_categorical", section="2.6", sql="""
WITH c AS (SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY 1)
SELECT o_orderpriority, CAST(n AS BIGINT) AS n, ROUND(100.0 * n / SUM(n) OVER (), 4) AS pct,
       ROUND(100.0 * SUM(n) OVER (ORDER BY n DESC, o_orderpriority ROWS UNBOUNDED PRECEDING)
             / SUM(n) OVER (), 4) AS cum_pct FROM c""")
def ag_describe_categorical(spark, sf_dir):
    out = A.describe_categorical(Tables(spark, sf_dir).orders, "o_orderpriority")
    return out.withColumn("pct", F.round("pct", 4)).withColumn("cum_pct", F.round("cum_pct", 4))


@query("ag_box_stats", section="2.6", sql="""
WITH q AS (SELECT l_returnflag, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS median,
                  quantile_cont(l_quantity, 0.75) AS q3 FROM lineitem GROUP BY 1),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT l.l_returnflag, f.q1, f.median, f.q3, MIN(l.l_quantity) AS min, MAX(l.l_quantity) AS max,
       MIN(l.l_quantity) FILTER (WHERE l.l_quantity BETWEEN f.lo AND f.hi) AS lower_whisker,
       MAX(l.l_quantity) FILTER (WHERE l.l_quantity BETWEEN f.lo AND f.hi) AS upper_whisker,
       CAST(COUNT(*) FILTER (WHERE NOT l.l_quantity BETWEEN f.lo AND f.hi) AS BIGINT) AS outliers,
       CAST(COUNT(*) AS BIGINT) AS n
FROM lineitem l JOIN f USING (l_returnflag) GROUP BY l.l_returnflag, f.q1, f.median, f.q3""")
def ag_box_stats(spark, sf_dir):
    return A.box_stats(Tables(spark, sf_dir).lineitem, "l_quantity", by=["l_returnflag"])


@query("ag_box_stats_hinges", section="2.6", sql="""
WITH r AS (SELECT l_returnflag, l_extendedprice AS x, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS i,
                  COUNT(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem),
d AS (SELECT *, floor((n + 3) / 2) / 2 AS depth FROM r),
q AS (SELECT l_returnflag, AVG(x) FILTER (WHERE i IN (floor(depth), ceil(depth))) AS q1,
             AVG(x) FILTER (WHERE i IN (floor((n + 1) / 2), ceil((n + 1) / 2))) AS median,
             AVG(x) FILTER (WHERE i IN (floor(n + 1 - depth), ceil(n + 1 - depth))) AS q3 FROM d GROUP BY 1)
SELECT l.l_returnflag, ROUND(q1, 4) AS q1, ROUND(median, 4) AS median, ROUND(q3, 4) AS q3,
       CAST(COUNT(*) FILTER (WHERE NOT x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS BIGINT) AS outliers,
       CAST(COUNT(*) AS BIGINT) AS n
FROM r l JOIN q USING (l_returnflag) GROUP BY l.l_returnflag, q1, median, q3""")
def ag_box_stats_hinges(spark, sf_dir):
    out = A.box_stats(Tables(spark, sf_dir).lineitem, "l_extendedprice", by=["l_returnflag"], method="hinges")
    return out.select("l_returnflag", *[F.round(c, 4).alias(c) for c in ("q1", "median", "q3")], "outliers", "n")


@query("ag_histogram", section="2.6", sql="""
SELECT floor(c_acctbal / 1000) * 1000 AS bin_lo, CAST(COUNT(*) AS BIGINT) AS n FROM customer GROUP BY 1""")
def ag_histogram(spark, sf_dir):
    out = A.histogram(Tables(spark, sf_dir).customer, "c_acctbal", 1000)
    return out.withColumn("bin_lo", F.col("bin_lo").cast("double"))


@query("ag_crosstab", section="2.6", sql="""
SELECT l_returnflag, l_linestatus, CAST(COUNT(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2""")
def ag_crosstab(spark, sf_dir):
    return A.crosstab(Tables(spark, sf_dir).lineitem, "l_returnflag", "l_linestatus")
