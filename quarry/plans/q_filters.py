"""Projections, filters and predicates on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import any_of, eq_ci, in_fiscal_year, in_range, ne
from quarry.operators import filters as FL
from quarry.operators.windows import top_k
from quarry.plans.registry import query
from quarry.plans.standins import (CUSTOMERS_GEO_SQL, LOANS_SQL, TRIPS_SQL, customers_geo,
                                   loans, trips)
from quarry.sources.tables import Tables


@query("flt_equality", section="2.3", sql="""
SELECT o_orderkey, o_totalprice FROM orders
WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'""")
def flt_equality(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    return o.where((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")) \
        .select("o_orderkey", "o_totalprice")


@query("flt_ci_string", section="2.3", sql="""
SELECT p_partkey, p_type FROM part WHERE lower(p_type) = lower('Economy')""")
def flt_ci_string(spark, sf_dir):
    return Tables(spark, sf_dir).part.where(eq_ci("p_type", "Economy")).select("p_partkey", "p_type")


@query("flt_in_list", section="2.3", sql="""
SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber IN (1, 2, 3)""")
def flt_in_list(spark, sf_dir):
    return Tables(spark, sf_dir).lineitem.where(F.col("l_linenumber").isin(1, 2, 3)) \
        .select("l_orderkey", "l_linenumber")


@query("flt_range", section="2.3", sql="""
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20""")
def flt_range(spark, sf_dir):
    return Tables(spark, sf_dir).lineitem.where(in_range("l_quantity", 10, 20)) \
        .select("l_orderkey", "l_linenumber", "l_quantity")


@query("flt_date_window", section="2.3", sql="""
SELECT o_orderkey, o_totalprice FROM orders
WHERE o_orderdate >= TIMESTAMP '1997-07-01' AND o_orderdate < TIMESTAMP '1998-07-01'""")
def flt_date_window(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    return o.where(in_fiscal_year("o_orderdate", 1998, start_month=7)).select("o_orderkey", "o_totalprice")


@query("flt_or_predicates", section="2.3", sql=f"""
WITH {LOANS_SQL}
SELECT loan_id, status FROM loans WHERE status = 'Charged Off' OR grade = '1-URGENT'""")
def flt_or_predicates(spark, sf_dir):
    ln = loans(Tables(spark, sf_dir))
    return ln.where(any_of(F.col("status") == "Charged Off", F.col("grade") == "1-URGENT")) \
        .select("loan_id", "status")


@query("flt_not_null", section="2.3", sql=f"""
WITH {TRIPS_SQL}
SELECT trip_order, trip_line FROM trips WHERE passengers IS NOT NULL AND tip IS NOT NULL""")
def flt_not_null(spark, sf_dir):
    return FL.require(trips(Tables(spark, sf_dir)), "passengers", "tip").select("trip_order", "trip_line")


@query("flt_is_null", section="2.3", sql=f"""
WITH {TRIPS_SQL}
SELECT CAST(COUNT(*) FILTER (WHERE passengers IS NULL) AS BIGINT) AS n_missing FROM trips""")
def flt_is_null(spark, sf_dir):
    return FL.missing(trips(Tables(spark, sf_dir)), "passengers")


@query("flt_ne_drops_null", section="2.3", sql=f"""
WITH {TRIPS_SQL}
SELECT trip_order, trip_line, passengers FROM trips WHERE passengers != 2""")
def flt_ne_drops_null(spark, sf_dir):
    return trips(Tables(spark, sf_dir)).where(ne("passengers", 2)) \
        .select("trip_order", "trip_line", "passengers")


@query("flt_outlier_cap", section="2.3", sql="""
SELECT o_orderkey, o_totalprice FROM orders
WHERE o_totalprice <= (SELECT quantile_cont(o_totalprice, 0.9) FROM orders)""")
def flt_outlier_cap(spark, sf_dir):
    o = Tables(spark, sf_dir).orders.select("o_orderkey", "o_totalprice")
    return FL.cap_at_quantile(o, "o_totalprice", 0.9, method="sort")


@query("flt_exclude_rank", section="2.3", sql=f"""
WITH {CUSTOMERS_GEO_SQL}
SELECT n_name, ROUND(SUM(c_acctbal), 2) AS total_balance FROM customers_geo
WHERE n_name <> 'NATION_3'
GROUP BY n_name ORDER BY total_balance DESC, n_name LIMIT 9""")
def flt_exclude_rank(spark, sf_dir):
    cg = customers_geo(Tables(spark, sf_dir))
    agg = cg.groupBy("n_name").agg(F.round(F.sum("c_acctbal"), 2).alias("total_balance"))
    return top_k(agg, [F.desc("total_balance"), F.asc("n_name")], 9,
                 skip=F.col("n_name") == "NATION_3")


@query("flt_time_order", section="2.3", sql=f"""
WITH {TRIPS_SQL}
SELECT trip_order, trip_line FROM trips WHERE pickup > dropoff""")
def flt_time_order(spark, sf_dir):
    return FL.out_of_order(trips(Tables(spark, sf_dir)), "pickup", "dropoff") \
        .select("trip_order", "trip_line")
