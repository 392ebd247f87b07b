"""Scalar functions, bins and reshaping on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import functions as S
from quarry.operators import reshape as R
from quarry.operators.columns import map_strings
from quarry.plans.registry import query
from quarry.plans.standins import (LOANS_SQL, REQUESTS_SQL, TICKETS_SQL, TRIPS_SQL, loans,
                                   requests, tickets, trips)
from quarry.sources.tables import Tables


@query("sc_lower_upper", section="2.10", sql="""
SELECT p_partkey, upper(p_name) AS p_name, upper(p_brand) AS p_brand, p_size FROM part""")
def sc_lower_upper(spark, sf_dir):
    p = Tables(spark, sf_dir).part.select("p_partkey", "p_name", "p_brand", "p_size")
    return map_strings(p, F.upper)


@query("sc_split_first", section="2.10", sql="""
SELECT p_partkey, split_part(p_name, ' ', 1) AS first_word FROM part""")
def sc_split_first(spark, sf_dir):
    p = Tables(spark, sf_dir).part
    return p.select("p_partkey", S.first_token("p_name", " ").alias("first_word"))


@query("sc_split_columns", section="2.10", sql="""
SELECT p_partkey, p_name, split_part(p_name, ' ', 1) AS color, split_part(p_name, ' ', 2) AS item FROM part""")
def sc_split_columns(spark, sf_dir):
    p = Tables(spark, sf_dir).part.select("p_partkey", "p_name")
    return R.split_into(p, "p_name", ["color", "item"], " ")


@query("sc_cast", section="2.10", sql=f"""
WITH {LOANS_SQL}
SELECT loan_id, TRY_CAST(replace(int_rate, '%', '') AS DOUBLE) AS rate,
       TRY_CAST(emp_length AS INTEGER) AS emp_int, CAST(trunc(amount) AS BIGINT) AS amount_whole FROM loans""")
def sc_cast(spark, sf_dir):
    ln = loans(Tables(spark, sf_dir))
    return ln.select("loan_id", S.to_type(F.regexp_replace("int_rate", "%", ""), "double").alias("rate"),
                     S.to_type("emp_length", "int").alias("emp_int"),
                     F.col("amount").cast("long").alias("amount_whole"))


@query("sc_substr_concat", section="2.10", sql=f"""
WITH {TICKETS_SQL}
SELECT summons, substring(clock, 1, 2) AS hh, substring(clock, 3, 2) AS mi,
       substring(clock, 1, 2) || ':' || substring(clock, 3, 2) || ' ' || substring(clock, 5, 1) || 'M' AS clock_text
FROM tickets""")
def sc_substr_concat(spark, sf_dir):
    tk = tickets(Tables(spark, sf_dir))
    hh, mi, ap = F.substring("clock", 1, 2), F.substring("clock", 3, 2), F.substring("clock", 5, 1)
    return tk.select("summons", hh.alias("hh"), mi.alias("mi"),
                     F.concat(hh, F.lit(":"), mi, F.lit(" "), ap, F.lit("M")).alias("clock_text"))


@query("sc_regexp_replace", section="2.10", sql="""
SELECT p_partkey, regexp_replace(p_brand, '^Brand#([0-9]+)$', 'B\\1') AS brand_code FROM part""")
def sc_regexp_replace(spark, sf_dir):
    p = Tables(spark, sf_dir).part
    return p.select("p_partkey", F.regexp_replace("p_brand", r"^Brand#([0-9]+)$", "B$1").alias("brand_code"))


@query("sc_strip_percent", section="2.10", sql=f"""
WITH {LOANS_SQL}
SELECT loan_id, int_rate, round_even(TRY_CAST(replace(int_rate, '%', '') AS DOUBLE), 1) AS rate FROM loans""")
def sc_strip_percent(spark, sf_dir):
    ln = loans(Tables(spark, sf_dir))
    return ln.select("loan_id", "int_rate", S.parse_percent("int_rate", 1).alias("rate"))


@query("sc_parse_years", section="2.10", sql=f"""
WITH {LOANS_SQL}
SELECT loan_id, emp_length,
       TRY_CAST(NULLIF(trim(regexp_replace(regexp_replace(emp_length, '< ?1', '0'), '[^0-9]', '', 'g')), '') AS INTEGER) AS years
FROM loans""")
def sc_parse_years(spark, sf_dir):
    ln = loans(Tables(spark, sf_dir))
    return ln.select("loan_id", "emp_length", S.parse_tenure("emp_length").alias("years"))


@query("sc_parse_date_multi", section="2.10", sql="""
WITH s AS (SELECT o_orderkey, o_orderdate,
                  CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%d-%m-%Y %H:%M:%S')
                       ELSE strftime(o_orderdate, '%-m/%-d/%Y %H:%M') END AS raw FROM orders)
SELECT o_orderkey, raw, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS parsed FROM s""")
def sc_parse_date_multi(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd-MM-yyyy HH:mm:ss")) \
        .otherwise(F.date_format("o_orderdate", "M/d/yyyy HH:mm"))
    s = o.select("o_orderkey", raw.alias("raw"))
    parsed = S.parse_ts("raw", "dd-MM-yyyy HH:mm:ss", "M/d/yyyy HH:mm")
    return s.select("o_orderkey", "raw", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("sc_parse_clock", section="2.10", sql=f"""
WITH {TICKETS_SQL}
SELECT summons, clock, CAST(hour(issued) AS INTEGER) AS hour, CAST(minute(issued) AS INTEGER) AS minute FROM tickets""")
def sc_parse_clock(spark, sf_dir):
    tk = tickets(Tables(spark, sf_dir))
    p = S.parse_clock("clock")
    return tk.select("summons", "clock", p["hour"].alias("hour"), p["minute"].alias("minute"))


@query("sc_date_parts", section="2.10", sql="""
SELECT event_id, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
       CAST(day(ts) AS INTEGER) AS day, CAST(hour(ts) AS INTEGER) AS hour, dayname(ts) AS weekday,
       strftime(ts, '%m') AS month_text FROM events""")
def sc_date_parts(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    return e.select("event_id", *S.date_parts("ts", ("year", "month", "day", "hour", "weekday", "month_text")))


@query("sc_duration", section="2.10", sql=f"""
WITH {REQUESTS_SQL}
SELECT request_id, ROUND(date_diff('microsecond', requested, dropped) / 60000000.0, 4) AS minutes FROM requests""")
def sc_duration(spark, sf_dir):
    rq = requests(Tables(spark, sf_dir))
    return rq.select("request_id", F.round(S.elapsed("requested", "dropped", "minutes"), 4).alias("minutes"))


@query("sc_speed", section="2.10", sql=f"""
WITH {TRIPS_SQL}
SELECT vendor, CAST(year(pickup) AS INTEGER) AS year,
       ROUND(AVG(distance / (date_diff('microsecond', pickup, dropoff) / 3600000000.0)), 6) AS avg_speed
FROM trips WHERE pickup < dropoff GROUP BY 1, 2""")
def sc_speed(spark, sf_dir):
    tr = trips(Tables(spark, sf_dir)).where(F.col("pickup") < F.col("dropoff"))
    return tr.groupBy("vendor", F.year("pickup").alias("year")).agg(
        F.round(F.avg(S.speed("distance", "pickup", "dropoff")), 6).alias("avg_speed"))


@query("sc_round_modes", section="2.10", sql="""
SELECT o_orderkey, round_even(o_totalprice / 1000, 0) AS half_even, ROUND(o_totalprice / 1000, 0) AS half_up,
       round_even((o_orderkey % 20) / 4.0, 0) AS q_even, ROUND((o_orderkey % 20) / 4.0, 0) AS q_up FROM orders""")
def sc_round_modes(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    q = (F.col("o_orderkey") % 20) / 4.0
    return o.select("o_orderkey",
                    S.round_to(F.col("o_totalprice") / 1000, 0, "half_even").alias("half_even"),
                    S.round_to(F.col("o_totalprice") / 1000, 0, "half_up").alias("half_up"),
                    S.round_to(q, 0, "half_even").alias("q_even"), S.round_to(q, 0, "half_up").alias("q_up"))


@query("sc_ratio_features", section="2.10", sql="""
SELECT p_partkey, round_even(p_retailprice / p_size, 8) AS price_per_size FROM part""")
def sc_ratio_features(spark, sf_dir):
    p = Tables(spark, sf_dir).part
    return p.select("p_partkey", S.ratio("p_retailprice", "p_size", 8).alias("price_per_size"))


@query("sc_flag", section="2.10", sql=f"""
WITH {TRIPS_SQL}
SELECT trip_order, trip_line, CASE WHEN tip > 0 THEN 1 WHEN NOT tip > 0 THEN 0 END AS tipped FROM trips""")
def sc_flag(spark, sf_dir):
    tr = trips(Tables(spark, sf_dir))
    return tr.select("trip_order", "trip_line", S.flag(F.col("tip") > 0).alias("tipped"))


@query("bin_case_hours", section="2.10", sql="""
SELECT CAST(CAST(floor(hour(ts) / 4) * 4 AS INTEGER) AS VARCHAR) || '_' || CAST(CAST(floor(hour(ts) / 4) * 4 + 3 AS INTEGER) AS VARCHAR) AS hour_bin,
       CAST(COUNT(*) AS BIGINT) AS n FROM events GROUP BY 1""")
def bin_case_hours(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    return e.groupBy(S.hour_bin(F.hour("ts"), 4).alias("hour_bin")).agg(F.count(F.lit(1)).alias("n"))


@query("bin_right_closed", section="2.10", sql=f"""
WITH {REQUESTS_SQL}
SELECT CASE WHEN hour(requested) BETWEEN 0 AND 4 THEN 'LateNight'
            WHEN hour(requested) > 4 AND hour(requested) <= 8 THEN 'EarlyMorning'
            WHEN hour(requested) > 8 AND hour(requested) <= 12 THEN 'Morning'
            WHEN hour(requested) > 12 AND hour(requested) <= 16 THEN 'Afternoon'
            WHEN hour(requested) > 16 AND hour(requested) <= 20 THEN 'Evening'
            WHEN hour(requested) > 20 AND hour(requested) <= 23 THEN 'LateEvening' END AS slot,
       CAST(COUNT(*) AS BIGINT) AS n FROM requests GROUP BY 1""")
def bin_right_closed(spark, sf_dir):
    rq = requests(Tables(spark, sf_dir))
    slot = S.cut(F.hour("requested"), S.SLOT_BREAKS, S.SLOT_LABELS)
    return rq.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))


@query("bin_season", section="2.10", sql="""
SELECT CASE WHEN month(o_orderdate) IN (1, 2, 12) THEN 'Winter' WHEN month(o_orderdate) BETWEEN 3 AND 5 THEN 'Spring'
            WHEN month(o_orderdate) BETWEEN 6 AND 8 THEN 'Summer' WHEN month(o_orderdate) BETWEEN 9 AND 12 THEN 'Fall' END AS season,
       CAST(COUNT(*) AS BIGINT) AS n FROM orders GROUP BY 1""")
def bin_season(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    return o.groupBy(S.season(F.month("o_orderdate")).alias("season")).agg(F.count(F.lit(1)).alias("n"))


@query("bin_amount_case", section="2.10", sql=f"""
WITH {TRIPS_SQL}
SELECT CASE WHEN tip >= 0 AND tip < 5 THEN '0_Bucket_5' WHEN tip >= 5 AND tip < 10 THEN '5_Bucket_10'
            WHEN tip >= 10 AND tip < 15 THEN '10_Bucket_15' WHEN tip >= 15 AND tip < 20 THEN '15_Bucket_20'
            ELSE '20above_Bucket' END AS tip_bucket,
       CAST(COUNT(*) AS BIGINT) AS n FROM trips GROUP BY 1""")
def bin_amount_case(spark, sf_dir):
    tr = trips(Tables(spark, sf_dir))
    b = S.bands("tip", S.TIP_EDGES, S.TIP_LABELS, S.TIP_OTHER)
    return tr.groupBy(b.alias("tip_bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("bin_round_to", section="2.10", sql="""
SELECT round_even(o_totalprice / 10000, 0) * 10000 AS amount_bin, CAST(COUNT(*) AS BIGINT) AS n
FROM orders GROUP BY 1""")
def bin_round_to(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    return o.groupBy(S.round_bin("o_totalprice", 10000).alias("amount_bin")).agg(F.count(F.lit(1)).alias("n"))


@query("rs_wide_to_long", section="2.10", sql="""
SELECT p_partkey, name, value FROM (
  SELECT p_partkey, CAST(p_size < 10 AS INTEGER) AS small, CAST(p_type = 'PROMO' AS INTEGER) AS promo,
         CAST(p_retailprice < 1000 AS INTEGER) AS cheap FROM part)
UNPIVOT (value FOR name IN (small, promo, cheap)) WHERE value <> 0""")
def rs_wide_to_long(spark, sf_dir):
    p = Tables(spark, sf_dir).part.select(
        "p_partkey", (F.col("p_size") < 10).cast("int").alias("small"),
        (F.col("p_type") == "PROMO").cast("int").alias("promo"),
        (F.col("p_retailprice") < 1000).cast("int").alias("cheap"))
    return R.melt_flags(p, ["p_partkey"], ["small", "promo", "cheap"])


# Loan status levels (the wide columns).
LOAN_STATUSES = ["Charged Off", "Current", "Fully Paid"]


@query("rs_long_to_wide", section="2.10", sql=f"""
WITH {LOANS_SQL}
SELECT purpose, {", ".join(f'ROUND(SUM(amount) FILTER (WHERE status = {s!r}), 2) AS "{s}"' for s in LOAN_STATUSES)}
FROM loans GROUP BY purpose""")
def rs_long_to_wide(spark, sf_dir):
    ln = loans(Tables(spark, sf_dir))
    return R.spread_wide(ln, ["purpose"], "status", LOAN_STATUSES, F.round(F.sum("amount"), 2))


@query("rs_row_mean", section="2.10", sql=f"""
WITH {TRIPS_SQL}
SELECT trip_order, trip_line,
       ROUND((COALESCE(passengers, 0) + COALESCE(tip, 0) + extra)
             / ((passengers IS NOT NULL)::INT + (tip IS NOT NULL)::INT + 1), 6) AS row_mean FROM trips""")
def rs_row_mean(spark, sf_dir):
    tr = trips(Tables(spark, sf_dir))
    out = R.row_mean(tr, ["trip_order", "trip_line"], ["passengers", "tip", "extra"])
    return out.withColumn("row_mean", F.round("row_mean", 6))


@query("rs_row_null_count", section="2.10", sql=f"""
WITH {TRIPS_SQL}
SELECT trip_order, trip_line, (passengers IS NULL)::INT + (tip IS NULL)::INT AS n_null FROM trips""")
def rs_row_null_count(spark, sf_dir):
    tr = trips(Tables(spark, sf_dir))
    return R.row_null_count(tr, ["trip_order", "trip_line"], ["passengers", "tip"])
