"""Data quality on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import not_sentinel
from quarry.operators import quality as Q
from quarry.operators.windows import top_k
from quarry.plans.registry import query
from quarry.plans.standins import (REQUESTS_SQL, TICKETS_SQL, TRIPS_SQL, requests, tickets,
                                   trips)
from quarry.sources.tables import Tables


def trip_rules():
    """One shared rule list for the report and the load filter (each says when a row passes)."""
    c = F.col
    return {
        "period": F.year("pickup").between(1996, 2000) & F.year("dropoff").between(1996, 2000),
        "time_order": c("pickup") < c("dropoff"),
        "passengers": c("passengers").isin(1, 2, 3, 4, 5, 6),
        "distance": c("distance") > 0,
        "payment": c("payment").isin(1, 2, 3),
        "fare": c("fare") > 0,
        "extra": c("extra").isin(0.0, 0.5, 1.0),
        "tip": c("tip") >= 0,
        "cash_tip": ~((c("payment") == 2) & (c("tip") != 0)),
    }


# The same rules in SQL, for the oracle texts.
TRIP_RULES_SQL = {
    "period": "(year(pickup) BETWEEN 1996 AND 2000 AND year(dropoff) BETWEEN 1996 AND 2000)",
    "time_order": "(pickup < dropoff)",
    "passengers": "(passengers IN (1, 2, 3, 4, 5, 6))",
    "distance": "(distance > 0)",
    "payment": "(payment IN (1, 2, 3))",
    "fare": "(fare > 0)",
    "extra": "(extra IN (0.0, 0.5, 1.0))",
    "tip": "(tip >= 0)",
    "cash_tip": "(NOT (payment = 2 AND tip <> 0))",
}
_ANY_FAIL_SQL = " OR ".join(f"NOT COALESCE({r}, FALSE)" for r in TRIP_RULES_SQL.values())
_ALL_PASS_SQL = " AND ".join(TRIP_RULES_SQL.values())


@query("dq_null_profile", section="2.4", sql=f"""
WITH {TRIPS_SQL}
SELECT col AS "column", CAST(nulls AS BIGINT) AS nulls, CAST(rows AS BIGINT) AS rows,
       ROUND(100.0 * nulls / rows, 1) AS pct
FROM (SELECT COUNT(*) AS rows,
             COUNT(*) FILTER (WHERE passengers IS NULL) AS passengers,
             COUNT(*) FILTER (WHERE tip IS NULL) AS tip,
             COUNT(*) FILTER (WHERE fare IS NULL) AS fare,
             COUNT(*) FILTER (WHERE vendor IS NULL) AS vendor FROM trips)
UNPIVOT (nulls FOR col IN (passengers, tip, fare, vendor))""")
def dq_null_profile(spark, sf_dir):
    return Q.null_profile(trips(Tables(spark, sf_dir)), ["passengers", "tip", "fare", "vendor"])


@query("dq_shape", section="2.4", sql="""
SELECT CAST(COUNT(*) AS BIGINT) AS rows, CAST(11 AS INTEGER) AS columns FROM lineitem""")
def dq_shape(spark, sf_dir):
    return Q.shape(Tables(spark, sf_dir).lineitem)


@query("dq_null_total", section="2.4", sql=f"""
WITH {TRIPS_SQL}
SELECT CAST(SUM((passengers IS NULL)::INT + (tip IS NULL)::INT) AS BIGINT) AS nulls FROM trips""")
def dq_null_total(spark, sf_dir):
    return Q.null_total(trips(Tables(spark, sf_dir)))


@query("dq_null_percent", section="2.4", sql=f"""
WITH {REQUESTS_SQL}
SELECT ROUND(100.0 * COUNT(*) FILTER (WHERE dropped IS NULL) / COUNT(*), 2) AS pct_null FROM requests""")
def dq_null_percent(spark, sf_dir):
    return Q.null_percent(requests(Tables(spark, sf_dir)), "dropped")


@query("dq_blank_count", section="2.4", sql="""
SELECT col AS "column", CAST(blanks AS BIGINT) AS blanks
FROM (SELECT COUNT(*) FILTER (WHERE trim(p_name) = '') AS p_name,
             COUNT(*) FILTER (WHERE trim(p_brand) = '') AS p_brand,
             COUNT(*) FILTER (WHERE trim(CASE WHEN p_size < 5 THEN '' ELSE p_type END) = '') AS p_type2
      FROM part)
UNPIVOT (blanks FOR col IN (p_name, p_brand, p_type2))""")
def dq_blank_count(spark, sf_dir):
    p = Tables(spark, sf_dir).part.select(
        "p_name", "p_brand", F.when(F.col("p_size") < 5, "").otherwise(F.col("p_type")).alias("p_type2"))
    return Q.blank_profile(p)


@query("dq_duplicate_rows", section="2.4", sql="""
SELECT CAST(COUNT(*) AS BIGINT) AS rows,
       CAST((SELECT COUNT(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS BIGINT) AS distinct_rows,
       CAST(COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS BIGINT) AS duplicates
FROM lineitem""")
def dq_duplicate_rows(spark, sf_dir):
    return Q.duplicate_count(Tables(spark, sf_dir).lineitem, ["l_orderkey", "l_linenumber"])


@query("dq_dedup_key", section="2.4", sql="""
SELECT l_orderkey, l_linenumber, l_extendedprice, l_partkey, l_suppkey
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
              ORDER BY l_extendedprice DESC, l_partkey, l_suppkey) AS rn FROM lineitem)
WHERE rn = 1""")
def dq_dedup_key(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice",
                                               "l_partkey", "l_suppkey")
    return Q.dedup(li, ["l_orderkey", "l_linenumber"],
                   [F.desc("l_extendedprice"), F.asc("l_partkey"), F.asc("l_suppkey")])


@query("dq_key_unique", section="2.4", sql="""
SELECT CAST(SUM(n) AS BIGINT) AS rows, CAST(COUNT(*) AS BIGINT) AS distinct_keys,
       CAST(0 AS BIGINT) AS null_keys, MAX(n) <= 1 AS is_key
FROM (SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY 1, 2)""")
def dq_key_unique(spark, sf_dir):
    return Q.key_report(Tables(spark, sf_dir).lineitem, ["l_orderkey", "l_linenumber"])


@query("dq_key_overlap", section="2.4", sql="""
WITH a AS (SELECT DISTINCT doc_id FROM documents), b AS (SELECT DISTINCT doc_id FROM labels)
SELECT CAST((SELECT COUNT(*) FROM a WHERE doc_id NOT IN (SELECT doc_id FROM b)) AS BIGINT) AS only_a,
       CAST((SELECT COUNT(*) FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)) AS BIGINT) AS only_b,
       CAST((SELECT COUNT(*) FROM a JOIN b USING (doc_id)) AS BIGINT) AS both""")
def dq_key_overlap(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return Q.key_overlap(t.documents, t.labels, "doc_id")


@query("dq_domain_audit", section="2.4", sql=f"""
WITH {TRIPS_SQL}
SELECT col AS "column", value, CAST(COUNT(*) AS BIGINT) AS n
FROM (SELECT 'passengers' AS col, CAST(passengers AS VARCHAR) AS value FROM trips
      UNION ALL SELECT 'payment', CAST(payment AS VARCHAR) FROM trips
      UNION ALL SELECT 'vendor', CAST(vendor AS VARCHAR) FROM trips)
GROUP BY 1, 2""")
def dq_domain_audit(spark, sf_dir):
    return Q.domain_audit(trips(Tables(spark, sf_dir)), ["passengers", "payment", "vendor"])


@query("dq_column_summary", section="2.4", sql=f"""
WITH {TRIPS_SQL}
SELECT MIN(fare) AS min_fare, MAX(fare) AS max_fare, ROUND(AVG(fare), 4) AS avg_fare,
       MIN(distance) AS min_distance, MAX(distance) AS max_distance,
       CAST(COUNT(DISTINCT vendor) AS BIGINT) AS nd_vendor,
       CAST(COUNT(DISTINCT payment) AS BIGINT) AS nd_payment FROM trips""")
def dq_column_summary(spark, sf_dir):
    s = Q.column_summary(trips(Tables(spark, sf_dir)),
                         {"fare": ["min", "max", "avg"], "distance": ["min", "max"],
                          "vendor": ["nd"], "payment": ["nd"]})
    return s.withColumn("avg_fare", F.round("avg_fare", 4))


@query("dq_rule_violations", section="2.4", sql=f"""
WITH {TRIPS_SQL}
SELECT vendor, CAST(COUNT(*) FILTER (WHERE {_ANY_FAIL_SQL}) AS BIGINT) AS violations,
       CAST(COUNT(*) AS BIGINT) AS rows,
       ROUND(100.0 * COUNT(*) FILTER (WHERE {_ANY_FAIL_SQL}) / COUNT(*), 3) AS pct
FROM trips GROUP BY vendor""")
def dq_rule_violations(spark, sf_dir):
    return Q.rule_report(trips(Tables(spark, sf_dir)), trip_rules(), ["vendor"])


_BREAKDOWN_SELECTS = "\nUNION ALL ".join(
    f"SELECT vendor, '{n}' AS rule, CAST(COUNT(*) FILTER (WHERE NOT COALESCE({r}, FALSE)) AS BIGINT) AS failures "
    f"FROM trips GROUP BY vendor" for n, r in TRIP_RULES_SQL.items())


@query("dq_rule_breakdown", section="2.4", sql=f"""
WITH {TRIPS_SQL}
{_BREAKDOWN_SELECTS}""")
def dq_rule_breakdown(spark, sf_dir):
    return Q.rule_breakdown(trips(Tables(spark, sf_dir)), trip_rules(), ["vendor"])


@query("dq_conform", section="2.4", sql=f"""
WITH {TRIPS_SQL}
SELECT trip_order, trip_line, vendor FROM trips WHERE {_ALL_PASS_SQL}""")
def dq_conform(spark, sf_dir):
    return Q.conform(trips(Tables(spark, sf_dir)), trip_rules()).select("trip_order", "trip_line", "vendor")


@query("dq_period_audit", section="2.4", sql="""
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
       CAST(COUNT(*) AS BIGINT) AS n FROM orders GROUP BY 1, 2""")
def dq_period_audit(spark, sf_dir):
    return Q.period_audit(Tables(spark, sf_dir).orders, "o_orderdate")


@query("dq_impute_const", section="2.4", sql=f"""
WITH {TRIPS_SQL}
SELECT trip_order, trip_line, COALESCE(passengers, 0) AS passengers FROM trips""")
def dq_impute_const(spark, sf_dir):
    tr = trips(Tables(spark, sf_dir)).select("trip_order", "trip_line", "passengers")
    return Q.impute_const(tr, {"passengers": 0})


@query("dq_impute_mean", section="2.4", sql=f"""
WITH {TRIPS_SQL}
SELECT trip_order, trip_line,
       ROUND(COALESCE(passengers, (SELECT AVG(passengers) FROM trips)), 4) AS passengers,
       ROUND(COALESCE(tip, (SELECT AVG(tip) FROM trips)), 4) AS tip FROM trips""")
def dq_impute_mean(spark, sf_dir):
    tr = trips(Tables(spark, sf_dir)).select("trip_order", "trip_line", "passengers", "tip")
    out = Q.impute_mean(tr, ["passengers", "tip"])
    return out.select("trip_order", "trip_line", F.round("passengers", 4).alias("passengers"),
                      F.round("tip", 4).alias("tip"))


@query("dq_impute_mode", section="2.4", sql=f"""
WITH {TICKETS_SQL},
mode AS (SELECT state FROM tickets WHERE state <> 99 GROUP BY state ORDER BY COUNT(*) DESC, state LIMIT 1)
SELECT summons, CASE WHEN state = 99 THEN (SELECT state FROM mode) ELSE state END AS state FROM tickets""")
def dq_impute_mode(spark, sf_dir):
    tk = tickets(Tables(spark, sf_dir)).select("summons", "state")
    return Q.impute_mode(tk, "state", [99])


# Spelling fixes for whole category names.
TYPE_FIXES = {"ECONOMY": "BUDGET", "PROMO": "PROMOTION"}


@query("dq_standardise_text", section="2.4", sql="""
SELECT p_partkey,
       CASE p_type WHEN 'ECONOMY' THEN 'BUDGET' WHEN 'PROMO' THEN 'PROMOTION' ELSE p_type END AS p_type,
       regexp_replace(p_brand, 'Brand#', 'B-') AS p_brand FROM part""")
def dq_standardise_text(spark, sf_dir):
    p = Tables(spark, sf_dir).part.select("p_partkey", "p_type", "p_brand")
    p = Q.recode(p, "p_type", TYPE_FIXES)
    return Q.recode(p, "p_brand", patterns=[("Brand#", "B-")])


@query("dq_zero_as_missing", section="2.4", sql=f"""
WITH {TICKETS_SQL}
SELECT precinct, CAST(COUNT(*) AS BIGINT) AS n FROM tickets WHERE precinct <> 0
GROUP BY precinct ORDER BY n DESC, precinct LIMIT 5""")
def dq_zero_as_missing(spark, sf_dir):
    tk = tickets(Tables(spark, sf_dir)).where(not_sentinel("precinct", 0))
    counts = tk.groupBy("precinct").agg(F.count(F.lit(1)).alias("n"))
    return top_k(counts, [F.desc("n"), F.asc("precinct")], 5)
