"""Stand-in tables: the reference's domain roles derived from the driver tables.

Each derivation is a projection or a join over the driver tables, so its
size grows with them.  The ``*_SQL`` strings are the DuckDB counterparts,
written as CTE bodies for the oracle texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import clock_text
from quarry.sources.tables import Tables


# ---------------------------------------------------------------- retail star schema
# fact = lineitem, product = part (category p_type, sub-category p_brand),
# customer = customer + nation + region, profit = revenue - 1000 * quantity

def profit_col() -> F.Column:
    """Profit in units of 1e-4 as an exact 64-bit integer.

    Cents times whole percent stays in long arithmetic (fast, inside
    codegen) and sums exactly, so totals round the same on every engine;
    convert a sum back with :func:`money`.
    """
    price_c = F.round(F.col("l_extendedprice") * 100).cast("long")
    disc_p = F.round(F.col("l_discount") * 100).cast("long")
    qty_c = F.round(F.col("l_quantity") * 100).cast("long")
    return price_c * (100 - disc_p) - qty_c * 100000


def money(total_e4: F.Column, digits: int = 2) -> F.Column:
    """A sum of :func:`profit_col` values back to money, rounded half-up exactly."""
    return F.round(total_e4.cast("decimal(38,0)") / F.lit(10000), digits).cast("double")


PROFIT_SQL = ("(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(15,2)))"
              " - CAST(l_quantity AS DECIMAL(15,2)) * 1000)")


def customers_geo(t: Tables) -> DataFrame:
    """Customer with nation and region names.  nation/region are fixed-size code tables."""
    geo = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    return t.customer.join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey"))


CUSTOMERS_GEO_SQL = """customers_geo AS (
  SELECT c.*, n.n_name, r.r_name FROM customer c
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey)"""


# ---------------------------------------------------------------- taxi trips
# lineitem x orders.  Passengers 0 and payment 4 are bad codes; a NULL is
# planted in passengers (line 3) and in tip (line 5) so NULL rules show.

def trips(t: Tables) -> DataFrame:
    li = t.lineitem.select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity",
                           "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    od = t.orders.select("o_orderkey", "o_orderdate")
    j = li.join(od, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(
        F.col("l_orderkey").alias("trip_order"), F.col("l_linenumber").alias("trip_line"),
        (F.col("l_suppkey") % 2 + 1).cast("int").alias("vendor"),
        F.col("o_orderdate").alias("pickup"), F.col("l_shipdate").alias("dropoff"),
        F.nullif(F.col("l_linenumber") - 1, F.lit(3)).alias("passengers"),
        F.col("l_quantity").alias("distance"),
        F.col("l_extendedprice").alias("fare"),
        F.when(F.col("l_linenumber") == 5, F.lit(None).cast("double"))
         .otherwise(F.col("l_tax") * 100 - 2).alias("tip"),
        (F.col("l_linenumber") % 4 + 1).cast("int").alias("payment"),
        F.round(F.col("l_discount") * 10, 1).alias("extra"))


TRIPS_SQL = """trips AS (
  SELECT l.l_orderkey AS trip_order, l.l_linenumber AS trip_line,
         CAST(l.l_suppkey % 2 + 1 AS INTEGER) AS vendor,
         o.o_orderdate AS pickup, l.l_shipdate AS dropoff,
         NULLIF(l.l_linenumber - 1, 3) AS passengers,
         l.l_quantity AS distance, l.l_extendedprice AS fare,
         CASE WHEN l.l_linenumber = 5 THEN NULL ELSE l.l_tax * 100 - 2 END AS tip,
         CAST(l.l_linenumber % 4 + 1 AS INTEGER) AS payment,
         ROUND(l.l_discount * 10, 1) AS extra
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""


# ---------------------------------------------------------------- parking tickets
# events: code from props, precinct user_id % 20 (0 = unknown), state
# user_id % 70 with 99 (bad code) where it is 0, fiscal year 2015..2017,
# clock text hhmm + A/P with 00 for the midnight hour.

def tickets(t: Tables) -> DataFrame:
    e = t.events
    return e.select(
        F.col("event_id").alias("summons"),
        F.regexp_extract("props", r"(\d+)", 1).cast("int").alias("code"),
        (F.col("user_id") % 20).cast("int").alias("precinct"),
        F.when(F.col("user_id") % 70 == 0, F.lit(99)).otherwise(F.col("user_id") % 70)
         .cast("int").alias("state"),
        (F.col("event_id") % 3 + 2015).cast("int").alias("fy"),
        F.col("ts").alias("issued"),
        clock_text(F.col("ts")).alias("clock"),
        F.col("event_type").alias("body"))


TICKETS_SQL = r"""tickets AS (
  SELECT event_id AS summons,
         CAST(regexp_extract(props, '(\d+)', 1) AS INTEGER) AS code,
         CAST(user_id % 20 AS INTEGER) AS precinct,
         CAST(CASE WHEN user_id % 70 = 0 THEN 99 ELSE user_id % 70 END AS INTEGER) AS state,
         CAST(event_id % 3 + 2015 AS INTEGER) AS fy,
         ts AS issued,
         lpad(CAST(CASE WHEN hour(ts) > 12 THEN hour(ts) - 12 ELSE hour(ts) END AS VARCHAR), 2, '0')
           || lpad(CAST(minute(ts) AS VARCHAR), 2, '0')
           || CASE WHEN hour(ts) < 12 THEN 'A' ELSE 'P' END AS clock,
         event_type AS body
  FROM events)"""


# ---------------------------------------------------------------- ride requests
def requests(t: Tables) -> DataFrame:
    e = t.events
    return e.select(
        F.col("event_id").alias("request_id"),
        F.when(F.col("event_id") % 2 == 0, "Airport").otherwise("City").alias("pickup_point"),
        F.col("event_type").alias("status"),
        F.col("ts").alias("requested"),
        F.when(F.col("event_type") == "purchase",
               F.timestamp_add("MICROSECOND", (F.col("value") * 60_000_000).cast("long"), F.col("ts")))
         .alias("dropped"),
        F.when(F.col("event_type") == "purchase", F.col("user_id")).alias("driver_id"))


REQUESTS_SQL = """requests AS (
  SELECT event_id AS request_id,
         CASE WHEN event_id % 2 = 0 THEN 'Airport' ELSE 'City' END AS pickup_point,
         event_type AS status, ts AS requested,
         CASE WHEN event_type = 'purchase'
              THEN ts + to_microseconds(CAST(value * 60000000 AS BIGINT)) END AS dropped,
         CASE WHEN event_type = 'purchase' THEN user_id END AS driver_id
  FROM events)"""


# ---------------------------------------------------------------- loans
def loans(t: Tables) -> DataFrame:
    o = t.orders
    c = t.customer.select("c_custkey", "c_acctbal", "c_mktsegment")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    return j.select(
        k.alias("loan_id"), F.col("o_totalprice").alias("amount"),
        F.col("c_acctbal").alias("income"),
        F.when(F.col("o_orderstatus") == "F", "Fully Paid")
         .when(F.col("o_orderstatus") == "O", "Current").otherwise("Charged Off").alias("status"),
        F.col("o_orderpriority").alias("grade"), F.col("c_mktsegment").alias("purpose"),
        F.col("o_orderdate").alias("issued"),
        F.concat((k % 25).cast("string"), F.lit("."), F.lpad((k % 100).cast("string"), 2, "0"),
                 F.lit("%")).alias("int_rate"),
        F.when(k % 12 == 0, "< 1 year").when(k % 12 == 11, "10+ years")
         .when(k % 12 == 5, "n/a").when(k % 12 == 1, "1 year")
         .otherwise(F.concat((k % 12).cast("string"), F.lit(" years"))).alias("emp_length"))


LOANS_SQL = """loans AS (
  SELECT o.o_orderkey AS loan_id, o.o_totalprice AS amount, c.c_acctbal AS income,
         CASE WHEN o.o_orderstatus = 'F' THEN 'Fully Paid'
              WHEN o.o_orderstatus = 'O' THEN 'Current' ELSE 'Charged Off' END AS status,
         o.o_orderpriority AS grade, c.c_mktsegment AS purpose, o.o_orderdate AS issued,
         CAST(o.o_orderkey % 25 AS VARCHAR) || '.' || lpad(CAST(o.o_orderkey % 100 AS VARCHAR), 2, '0') || '%' AS int_rate,
         CASE WHEN o.o_orderkey % 12 = 0 THEN '< 1 year' WHEN o.o_orderkey % 12 = 11 THEN '10+ years'
              WHEN o.o_orderkey % 12 = 5 THEN 'n/a' WHEN o.o_orderkey % 12 = 1 THEN '1 year'
              ELSE CAST(o.o_orderkey % 12 AS VARCHAR) || ' years' END AS emp_length
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"""


# ---------------------------------------------------------------- monthly series
def order_months(t: Tables) -> DataFrame:
    """Order value by (region, segment, year, month)."""
    cg = customers_geo(t).select("c_custkey", "r_name", "c_mktsegment")
    j = t.orders.join(cg, F.col("o_custkey") == F.col("c_custkey"))
    return (j.groupBy(F.col("r_name").alias("market"), F.col("c_mktsegment").alias("segment"),
                      F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
            .agg(F.sum("o_totalprice").alias("sales"), F.count(F.lit(1)).alias("quantity")))


ORDER_MONTHS_SQL = """order_months AS (
  SELECT r.r_name AS market, c.c_mktsegment AS segment,
         CAST(year(o.o_orderdate) AS INTEGER) AS year, CAST(month(o.o_orderdate) AS INTEGER) AS month,
         SUM(o.o_totalprice) AS sales, COUNT(*) AS quantity
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  GROUP BY 1, 2, 3, 4)"""


def monthly_filled(t: Tables) -> DataFrame:
    """Gap-free series: every (market, segment) x every month of the span, 0 where empty.

    Each series key gets the month range of the whole data set by
    ``explode(sequence(first, last))`` -- generated per key, no cross join.
    """
    om = order_months(t).withColumn("_t", F.col("year") * 12 + F.col("month") - 1)
    lo = om.agg(F.min("_t")).scalar()
    hi = om.agg(F.max("_t")).scalar()
    spine = (om.select("market", "segment").distinct()
             .withColumn("_t", F.explode(F.sequence(lo, hi)))
             .withColumn("year", F.floor(F.col("_t") / 12).cast("int"))
             .withColumn("month", (F.col("_t") % 12 + 1).cast("int"))
             .withColumn("t", (F.col("_t") - lo + 1).cast("int")).drop("_t"))
    out = spine.join(om.drop("_t"), ["market", "segment", "year", "month"], "left")
    return out.select("market", "segment", "year", "month",
                      F.coalesce("sales", F.lit(0.0)).alias("sales"),
                      F.coalesce("quantity", F.lit(0)).alias("quantity"), "t")


MONTHLY_FILLED_SQL = ORDER_MONTHS_SQL + """,
monthly_filled AS (
  SELECT k.market, k.segment, m.year, m.month,
         COALESCE(om.sales, 0.0) AS sales, COALESCE(om.quantity, 0) AS quantity,
         CAST(m.year * 12 + m.month - 1 - m.lo + 1 AS INTEGER) AS t
  FROM (SELECT DISTINCT market, segment FROM order_months) k
  CROSS JOIN (SELECT CAST(x // 12 AS INTEGER) AS year, CAST(x % 12 + 1 AS INTEGER) AS month, lo
              FROM (SELECT MIN(year * 12 + month - 1) AS lo, UNNEST(range(MIN(year * 12 + month - 1), MAX(year * 12 + month - 1) + 1)) AS x
                    FROM order_months)) m
  LEFT JOIN order_months om ON om.market = k.market AND om.segment = k.segment
        AND om.year = m.year AND om.month = m.month)"""


# ---------------------------------------------------------------- scored documents
def scored_docs(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "n_chars")
    lab = t.labels.select("doc_id", "quality")
    return d.join(lab, "doc_id").select(
        "doc_id", F.col("quality").alias("y"), ((F.col("n_chars") % 100) / 100.0).alias("p"))


SCORED_DOCS_SQL = """scored_docs AS (
  SELECT d.doc_id, l.quality AS y, (d.n_chars % 100) / 100.0 AS p
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
