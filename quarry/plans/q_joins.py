"""Joins and set operations on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import eq_ci
from quarry.operators import joins as J
from quarry.plans.registry import query
from quarry.plans.standins import customers_geo, money, profit_col
from quarry.sources.tables import Tables


def asia_economy_quantity(spark, sf_dir):
    """Quantity bought per customer in one region and one product type (case-blind)."""
    t = Tables(spark, sf_dir)
    cust = customers_geo(t).where(F.col("r_name") == "ASIA").select("c_custkey", "c_name")
    part = t.part.where(eq_ci("p_type", "economy")).select("p_partkey")
    orders = t.orders.select("o_orderkey", "o_custkey")
    li = t.lineitem.select("l_orderkey", "l_partkey", "l_quantity")
    j = J.star_join(li, [(part, "l_partkey", "p_partkey"), (orders, "l_orderkey", "o_orderkey"),
                         (cust, "o_custkey", "c_custkey")])
    return (j.groupBy("c_name").agg(F.sum("l_quantity").alias("sum_qty"))
            .orderBy(F.desc("sum_qty"), "c_name"))


query("jn_inner_multi", section="2.5", sql="""
SELECT c.c_name, SUM(l.l_quantity) AS sum_qty
FROM lineitem l
JOIN part p ON l.l_partkey = p.p_partkey
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
WHERE r.r_name = 'ASIA' AND lower(p.p_type) = 'economy'
GROUP BY c.c_name""")(asia_economy_quantity)


@query("jn_inner_two", section="2.5", sql="""
SELECT p.p_type, CAST(ROUND(SUM(CAST(l.l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l.l_discount AS DECIMAL(15,2)))
                         - CAST(l.l_quantity AS DECIMAL(15,2)) * 1000), 2) AS DOUBLE) AS profit
FROM part p JOIN lineitem l ON p.p_partkey = l.l_partkey
GROUP BY p.p_type""")
def jn_inner_two(spark, sf_dir):
    t = Tables(spark, sf_dir)
    j = J.star_join(t.lineitem.select("l_partkey", "l_extendedprice", "l_discount", "l_quantity"),
                    [(t.part.select("p_partkey", "p_type"), "l_partkey", "p_partkey")])
    return j.groupBy("p_type").agg(money(F.sum(profit_col())).alias("profit"))


@query("jn_inner_same_key", section="2.5", sql="""
SELECT d.doc_id, d.lang, l.quality, l.toxic, d.n_chars
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def jn_inner_same_key(spark, sf_dir):
    t = Tables(spark, sf_dir)
    a = t.documents.select("doc_id", "lang")
    b = t.labels.select("doc_id", "quality")
    c = t.labels.select("doc_id", "toxic")
    d = t.documents.select("doc_id", "n_chars")
    return J.join_all([a, b, c, d], "doc_id")


@query("jn_left_diff_names", section="2.5", sql="""
SELECT d.doc_id, d.lang, l.quality
FROM documents d LEFT JOIN (SELECT doc_id AS labelled_doc, quality FROM labels) l
  ON d.doc_id = l.labelled_doc""")
def jn_left_diff_names(spark, sf_dir):
    t = Tables(spark, sf_dir)
    lab = t.labels.select(F.col("doc_id").alias("labelled_doc"), "quality")
    return J.left_lookup(t.documents.select("doc_id", "lang"), lab, "doc_id", "labelled_doc")


@query("jn_common_columns", section="2.5", sql="""
SELECT c.conv_id, c.turn, c.role, c.n_chars, k.n_turns
FROM (SELECT conv_id, turn, role, CAST(length(text) AS INTEGER) AS n_chars FROM conversations) c
JOIN (SELECT conv_id, CAST(COUNT(*) AS BIGINT) AS n_turns FROM conversations GROUP BY conv_id) k
  USING (conv_id)""")
def jn_common_columns(spark, sf_dir):
    t = Tables(spark, sf_dir)
    conv = t.conversations
    a = conv.select("conv_id", "turn", "role", F.length("text").alias("n_chars"))
    b = conv.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"))
    return J.natural_join(a, b)


@query("jn_agg_back", section="2.5", sql="""
SELECT o.o_orderkey, o.o_custkey, ROUND(o.o_totalprice, 2) AS o_totalprice,
       ROUND(SUM(o.o_totalprice) OVER (PARTITION BY o.o_custkey), 2) AS cust_total,
       CAST(COUNT(*) OVER (PARTITION BY o.o_custkey) AS BIGINT) AS cust_orders
FROM orders o""")
def jn_agg_back(spark, sf_dir):
    t = Tables(spark, sf_dir)
    o = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    out = J.with_group_totals(o, ["o_custkey"], {"cust_total": F.sum("o_totalprice"),
                                                 "cust_orders": F.count(F.lit(1))})
    return out.select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("o_totalprice"),
                      F.round("cust_total", 2).alias("cust_total"), "cust_orders")


@query("jn_anti_keys", section="2.5", sql="""
SELECT DISTINCT d.doc_id AS key FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def jn_anti_keys(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return J.keys_missing(t.documents, t.labels, "doc_id")


@query("jn_column_bind", section="2.5", sql="""
SELECT a.c_custkey, a.c_acctbal, b.orders_n
FROM customer a JOIN (SELECT o_custkey AS c_custkey, CAST(COUNT(*) AS BIGINT) AS orders_n
                      FROM orders GROUP BY o_custkey) b USING (c_custkey)""")
def jn_column_bind(spark, sf_dir):
    t = Tables(spark, sf_dir)
    a = t.customer.select("c_custkey", "c_acctbal")
    b = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders_n"))
    return J.bind_columns(a, b, "c_custkey")


# Fine per ticket code band, by fiscal year (a small rate card).
FINE_RATES = [(fy, band, 50 + 5 * band + 10 * (fy - 2015)) for fy in (2015, 2016, 2017)
              for band in range(10)]


@query("jn_lookup_rate", section="2.5", sql="""
WITH counts AS (
  SELECT CAST(event_id % 3 + 2015 AS INTEGER) AS fy,
         CAST(CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) // 10 AS INTEGER) AS band,
         CAST(COUNT(*) AS BIGINT) AS tickets
  FROM events GROUP BY 1, 2),
rates AS (
  SELECT fy, band, CAST(50 + 5 * band + 10 * (fy - 2015) AS INTEGER) AS fine
  FROM (SELECT UNNEST([2015, 2016, 2017]) AS fy) a, (SELECT UNNEST(range(10)) AS band) b)
SELECT c.fy, c.band, c.tickets, r.fine, CAST(c.tickets * r.fine AS BIGINT) AS total_fine
FROM counts c LEFT JOIN rates r ON c.fy = r.fy AND c.band = r.band""")
def jn_lookup_rate(spark, sf_dir):
    t = Tables(spark, sf_dir)
    from quarry.plans.standins import tickets
    tk = tickets(t).withColumn("band", (F.col("code") / 10).cast("int"))
    counts = tk.groupBy("fy", "band").agg(F.count(F.lit(1)).alias("tickets"))
    rates = spark.createDataFrame(FINE_RATES, "fy int, band int, fine int")
    out = J.apply_rate(counts, rates, ["fy", "band"], "tickets", "fine", "total_fine")
    return out.select("fy", "band", "tickets", "fine", F.col("total_fine").cast("long").alias("total_fine"))


# ------------------------------------------------------------------ set operations

@query("set_union_all", section="2.9", sql="""
SELECT 'F' AS src, o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'
UNION ALL
SELECT 'P' AS src, o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'
UNION ALL
SELECT 'U' AS src, o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'""")
def set_union_all(spark, sf_dir):
    t = Tables(spark, sf_dir)
    o = t.orders.where(F.col("o_orderpriority") == "1-URGENT")
    f = o.where(F.col("o_orderstatus") == "F").select(F.lit("F").alias("src"), "o_orderkey")
    p = o.where(F.col("o_orderstatus") == "P").select(F.lit("P").alias("src"), "o_orderkey")
    u = o.select(F.lit("U").alias("src"), "o_orderkey")
    return J.union_all(f, p, u)


@query("set_except", section="2.9", sql="""
SELECT NULLIF(l_linenumber, 7) AS ln, l_returnflag FROM lineitem
EXCEPT
SELECT NULLIF(l_linenumber, 7) AS ln, l_returnflag FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag = 'A'""")
def set_except(spark, sf_dir):
    t = Tables(spark, sf_dir)
    li = t.lineitem
    a = li.select(F.nullif("l_linenumber", F.lit(7)).alias("ln"), "l_returnflag")
    b = li.where((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "A")) \
        .select(F.nullif("l_linenumber", F.lit(7)).alias("ln"), "l_returnflag")
    return J.except_distinct(a, b)


@query("set_distinct", section="2.9", sql="""
SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem""")
def set_distinct(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return J.distinct_rows(t.lineitem, ["l_returnflag", "l_linestatus"])
