"""Composite business queries on the driver-table stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import functions as S
from quarry.plans import composites as P
from quarry.plans.q_joins import FINE_RATES
from quarry.plans.registry import query
from quarry.plans.standins import (LOANS_SQL, ORDER_MONTHS_SQL, PROFIT_SQL, REQUESTS_SQL,
                                   TICKETS_SQL, customers_geo, loans, money, order_months,
                                   profit_col, requests, tickets)
from quarry.sources.tables import Tables

_SEASON_SQL = """CASE WHEN month(issued) IN (1, 2, 12) THEN 'Winter' WHEN month(issued) BETWEEN 3 AND 5 THEN 'Spring'
     WHEN month(issued) BETWEEN 6 AND 8 THEN 'Summer' WHEN month(issued) BETWEEN 9 AND 12 THEN 'Fall' END"""
_HOUR_BIN_SQL = """CAST(CAST(floor(hour(issued) / 4) * 4 AS INTEGER) AS VARCHAR) || '_' ||
     CAST(CAST(floor(hour(issued) / 4) * 4 + 3 AS INTEGER) AS VARCHAR)"""
_SLOT_SQL = """CASE WHEN hour(requested) BETWEEN 0 AND 4 THEN 'LateNight'
            WHEN hour(requested) > 4 AND hour(requested) <= 8 THEN 'EarlyMorning'
            WHEN hour(requested) > 8 AND hour(requested) <= 12 THEN 'Morning'
            WHEN hour(requested) > 12 AND hour(requested) <= 16 THEN 'Afternoon'
            WHEN hour(requested) > 16 AND hour(requested) <= 20 THEN 'Evening'
            WHEN hour(requested) > 20 AND hour(requested) <= 23 THEN 'LateEvening' END"""


@query("pl_ticket_seasonality", section="2.11", sql=f"""
WITH {TICKETS_SQL},
c AS (SELECT fy, {_SEASON_SQL} AS season, code, COUNT(*) AS n FROM tickets GROUP BY 1, 2, 3),
tot AS (SELECT fy, season, SUM(n) AS season_total FROM c GROUP BY 1, 2),
r AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY fy, season ORDER BY n DESC) AS INTEGER) AS rnk FROM c)
SELECT r.fy, r.season, r.code, CAST(r.n AS BIGINT) AS n, r.rnk, CAST(tot.season_total AS BIGINT) AS season_total
FROM r JOIN tot USING (fy, season) WHERE rnk <= 3""")
def pl_ticket_seasonality(spark, sf_dir):
    return P.ticket_seasonality(tickets(Tables(spark, sf_dir)), 3)


@query("pl_ticket_hour_profile", section="2.11", sql=f"""
WITH {TICKETS_SQL},
c AS (SELECT fy, {_HOUR_BIN_SQL} AS hour_bin, code, COUNT(*) AS n FROM tickets GROUP BY 1, 2, 3)
SELECT fy, hour_bin, code, CAST(n AS BIGINT) AS n, rnk FROM (
  SELECT *, CAST(dense_rank() OVER (PARTITION BY fy, hour_bin ORDER BY n DESC) AS INTEGER) AS rnk FROM c)
WHERE rnk <= 3""")
def pl_ticket_hour_profile(spark, sf_dir):
    return P.ticket_hour_profile(tickets(Tables(spark, sf_dir)), 3)


@query("pl_ticket_hour_common", section="2.11", sql=f"""
WITH {TICKETS_SQL},
pc AS (SELECT fy, code, COUNT(*) AS code_n FROM tickets GROUP BY 1, 2),
tc AS (SELECT fy, code FROM (SELECT *, row_number() OVER (PARTITION BY fy ORDER BY code_n DESC, code) AS r FROM pc)
       WHERE r <= 3),
c AS (SELECT t.fy, t.code, {_HOUR_BIN_SQL} AS hour_bin, COUNT(*) AS n FROM tickets t
      WHERE (t.fy, t.code) IN (SELECT (fy, code) FROM tc) GROUP BY 1, 2, 3)
SELECT fy, code, hour_bin, CAST(n AS BIGINT) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY fy, code ORDER BY n DESC, hour_bin) AS r FROM c) WHERE r = 1""")
def pl_ticket_hour_common(spark, sf_dir):
    return P.common_hours_of_top_codes(tickets(Tables(spark, sf_dir)), 3)


@query("pl_fines_by_year", section="2.11", sql=f"""
WITH {TICKETS_SQL},
c AS (SELECT fy, code, code // 10 AS band, COUNT(*) AS tickets FROM tickets GROUP BY 1, 2, 3),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fy ORDER BY tickets DESC, code) AS r FROM c) WHERE r <= 3)
SELECT fy, code, CAST(tickets AS BIGINT) AS tickets, CAST(50 + 5 * band + 10 * (fy - 2015) AS INTEGER) AS fine,
       CAST(tickets * (50 + 5 * band + 10 * (fy - 2015)) AS BIGINT) AS collected FROM t""")
def pl_fines_by_year(spark, sf_dir):
    rates = spark.createDataFrame(FINE_RATES, "fy int, band int, fine int")
    return P.fines_by_year(tickets(Tables(spark, sf_dir)), rates, 3)


def _requests_with_slot(spark, sf_dir):
    rq = requests(Tables(spark, sf_dir))
    return rq.withColumn("slot", S.cut(F.hour("requested"), S.SLOT_BREAKS, S.SLOT_LABELS))


@query("pl_supply_demand_gap", section="2.11", sql=f"""
WITH {REQUESTS_SQL},
g AS (SELECT {_SLOT_SQL} AS slot, pickup_point, COUNT(*) AS demand,
             COUNT(*) FILTER (WHERE status = 'purchase') AS supply FROM requests GROUP BY 1, 2)
SELECT slot, pickup_point, CAST(demand AS BIGINT) AS demand, CAST(supply AS BIGINT) AS supply,
       CAST(demand - supply AS BIGINT) AS gap,
       (demand - supply) = MAX(demand - supply) OVER (PARTITION BY pickup_point) AS is_worst FROM g""")
def pl_supply_demand_gap(spark, sf_dir):
    return P.supply_demand_gap(_requests_with_slot(spark, sf_dir))


@query("pl_status_by_slot", section="2.11", sql=f"""
WITH {REQUESTS_SQL}
SELECT {_SLOT_SQL} AS slot, pickup_point, status, CAST(COUNT(*) AS BIGINT) AS n
FROM requests WHERE status IN ('error', 'view') GROUP BY 1, 2, 3""")
def pl_status_by_slot(spark, sf_dir):
    return P.status_by_slot(_requests_with_slot(spark, sf_dir), ["error", "view"])


# Product item -> sector, as a wide 0/1 mapping table
# (columns: category, Hardware, Manufacturing, Other, Tools).
SECTOR_COLUMNS = ["Hardware", "Manufacturing", "Other", "Tools"]
SECTOR_OF_ITEM = {"anvil": "Tools", "bolt": "Hardware", "gear": "Manufacturing", "gizmo": "Other",
                  "plate": "Manufacturing", "ring": "Hardware", "rod": "Tools", "widget": "Other"}


def _mapping_wide(spark):
    rows = [(item, *[int(SECTOR_OF_ITEM[item] == s) for s in SECTOR_COLUMNS]) for item in SECTOR_OF_ITEM]
    return spark.createDataFrame(rows, "category string, " + ", ".join(f"{s} int" for s in SECTOR_COLUMNS))


_MAPPING_SQL = "mapping AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{k}', '{v}')" for k, v in SECTOR_OF_ITEM.items()) + ") m(category, sector))"


@query("pl_sector_investment", section="2.11", sql=f"""
WITH {_MAPPING_SQL},
r AS (SELECT p.p_name AS company, n.n_name AS country, l.l_extendedprice AS amount,
             split_part(split_part(p.p_name, ' ', 2) || '|' || split_part(p.p_name, ' ', 1), '|', 1) AS category
      FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
      JOIN nation n ON s.s_nationkey = n.n_nationkey WHERE l.l_extendedprice BETWEEN 20000 AND 60000),
rm AS (SELECT r.*, m.sector FROM r JOIN mapping m USING (category)),
tc AS (SELECT country FROM rm GROUP BY country ORDER BY SUM(amount) DESC, country LIMIT 3),
ps AS (SELECT country, sector, COUNT(*) AS n_rounds, SUM(amount) AS total_amount FROM rm
       WHERE country IN (SELECT country FROM tc) GROUP BY 1, 2),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY country ORDER BY n_rounds DESC, sector) AS INTEGER) AS sector_rank FROM ps),
pc AS (SELECT country, sector, company, SUM(amount) AS company_amount FROM rm
       WHERE country IN (SELECT country FROM tc) GROUP BY 1, 2, 3),
best AS (SELECT country, sector, company, company_amount FROM (
           SELECT *, row_number() OVER (PARTITION BY country, sector ORDER BY company_amount DESC, company) AS r FROM pc)
         WHERE r = 1)
SELECT rk.country, rk.sector, CAST(rk.n_rounds AS BIGINT) AS n_rounds, ROUND(rk.total_amount, 2) AS total_amount,
       rk.sector_rank, best.company, ROUND(best.company_amount, 2) AS company_amount
FROM rk LEFT JOIN best USING (country, sector) WHERE rk.sector_rank <= 3""")
def pl_sector_investment(spark, sf_dir):
    t = Tables(spark, sf_dir)
    li = t.lineitem.select("l_partkey", "l_suppkey", "l_extendedprice")
    part = t.part.select("p_partkey", "p_name")
    geo = t.supplier.select("s_suppkey", "s_nationkey").join(
        F.broadcast(t.nation.select("n_nationkey", "n_name")), F.col("s_nationkey") == F.col("n_nationkey"))
    words = F.split("p_name", " ")
    rounds = (li.join(part, F.col("l_partkey") == F.col("p_partkey"))
              .join(geo, F.col("l_suppkey") == F.col("s_suppkey"))
              .select(F.col("p_name").alias("company"), F.col("n_name").alias("country"),
                      F.col("l_extendedprice").alias("amount"),
                      S.first_token(F.concat_ws("|", F.get(words, 1), F.get(words, 0)), "|").alias("category")))
    out = P.sector_investment(rounds, _mapping_wide(spark), 20000, 60000)
    return out.select("country", "sector", "n_rounds", F.round("total_amount", 2).alias("total_amount"),
                      "sector_rank", "company", F.round("company_amount", 2).alias("company_amount"))


@query("pl_best_group_type", section="2.11", sql="""
SELECT p_type, ROUND(mean, 4) AS mean FROM (
  SELECT p.p_type, AVG(l.l_extendedprice) AS mean FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1)
WHERE mean BETWEEN 50000 AND 53150 ORDER BY mean DESC, p_type LIMIT 1""")
def pl_best_group_type(spark, sf_dir):
    t = Tables(spark, sf_dir)
    j = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    out = P.best_group(j, "p_type", "l_extendedprice", 50000, 53150)
    return out.select("p_type", F.round("mean", 4).alias("mean"))


@query("pl_attendance", section="2.11", sql="""
WITH d AS (SELECT user_id, day(ts) AS day, MIN(ts) AS t_in, MAX(ts) AS t_out FROM events GROUP BY 1, 2),
days AS (SELECT DISTINCT day(ts) AS day FROM events),
u AS (SELECT DISTINCT user_id FROM events),
g AS (SELECT u.user_id, days.day, d.t_in, d.t_out,
             date_diff('microsecond', d.t_in, d.t_out) / 3600000000.0 AS hours
      FROM u CROSS JOIN days LEFT JOIN d ON d.user_id = u.user_id AND d.day = days.day)
SELECT user_id, ROUND(AVG(hours), 6) AS mean_hours,
       CAST(COUNT(*) FILTER (WHERE hours > 8) AS BIGINT) AS overtime_days,
       CAST(COUNT(*) FILTER (WHERE hours < 7) AS BIGINT) AS short_days,
       CAST(COUNT(*) FILTER (WHERE t_in IS NULL) AS BIGINT) AS leave_days FROM g GROUP BY user_id""")
def pl_attendance(spark, sf_dir):
    e = Tables(spark, sf_dir).events.withColumn("day", F.dayofmonth("ts"))
    days = list(range(1, 32))  # calendar days of a month: a fixed pivot list
    in_wide = e.groupBy("user_id").pivot("day", days).agg(F.min("ts"))
    out_wide = e.groupBy("user_id").pivot("day", days).agg(F.max("ts"))
    out = P.attendance(in_wide, out_wide, "user_id")
    return out.withColumn("mean_hours", F.round("mean_hours", 6))


@query("pl_least_profitable_region", section="2.11", sql=f"""
WITH f AS (SELECT p.p_brand, r.r_name, l.l_orderkey, {PROFIT_SQL} AS profit
           FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN orders o ON l.l_orderkey = o.o_orderkey
           JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
           JOIN region r ON n.n_regionkey = r.r_regionkey),
w AS (SELECT p_brand FROM f GROUP BY 1 ORDER BY SUM(profit), p_brand LIMIT 1)
SELECT r_name, CAST(COUNT(l_orderkey) AS BIGINT) AS n_shipments, CAST(ROUND(SUM(profit), 2) AS DOUBLE) AS profit
FROM f WHERE p_brand = (SELECT p_brand FROM w) GROUP BY r_name""")
def pl_least_profitable_region(spark, sf_dir):
    t = Tables(spark, sf_dir)
    cg = customers_geo(t).select("c_custkey", "r_name")
    fact = (t.lineitem.join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
            .join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(cg, F.col("o_custkey") == F.col("c_custkey"))
            .select("p_brand", "r_name", "l_orderkey", profit_col().alias("profit")))
    out = P.least_profitable_by_region(fact, "p_brand", "r_name", "profit", "l_orderkey")
    return out.withColumn("profit", money(F.col("profit")))


@query("pl_default_profile", section="2.11", sql=f"""
WITH {LOANS_SQL},
long AS (SELECT 'grade' AS attribute, grade AS level, status FROM loans
         UNION ALL SELECT 'purpose', purpose, status FROM loans
         UNION ALL SELECT 'emp_length', emp_length, status FROM loans)
SELECT attribute, level, CAST(COUNT(*) AS BIGINT) AS n,
       CAST(COUNT(*) FILTER (WHERE status = 'Charged Off') AS BIGINT) AS n_bad,
       ROUND(COUNT(*) FILTER (WHERE status = 'Charged Off') / COUNT(*), 6) AS bad_rate
FROM long GROUP BY 1, 2""")
def pl_default_profile(spark, sf_dir):
    ln = loans(Tables(spark, sf_dir))
    out = P.default_profile(ln, ["grade", "purpose", "emp_length"], F.col("status") == "Charged Off")
    return out.withColumn("n_bad", F.col("n_bad").cast("long")).withColumn("bad_rate", F.round("bad_rate", 6))


@query("pl_monthly_series", section="2.11", sql=f"""
WITH {ORDER_MONTHS_SQL},
s AS (SELECT market, segment, SUM(sales) AS total, 100 * stddev_samp(sales) / AVG(sales) AS cv
      FROM order_months GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (ORDER BY total DESC, market, segment) AS INTEGER) AS total_rank,
             CAST(row_number() OVER (ORDER BY cv, market, segment) AS INTEGER) AS cv_rank FROM s)
SELECT market, segment, ROUND(total, 2) AS total, ROUND(cv, 4) AS cv, total_rank, cv_rank,
       total_rank <= 2 AND cv_rank <= 2 AS picked FROM r""")
def pl_monthly_series(spark, sf_dir):
    om = order_months(Tables(spark, sf_dir))
    out = P.monthly_series(om, ["market", "segment"], "sales", k=2)
    return out.withColumn("total", F.round("total", 2)).withColumn("cv", F.round("cv", 4))
