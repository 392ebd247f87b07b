"""Schema and column shaping on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import columns as C
from quarry.plans.registry import query
from quarry.plans.standins import TICKETS_SQL, tickets
from quarry.sources.tables import Tables


@query("col_clean_names", section="2.2", sql="""
SELECT c_custkey AS Cust_Key, c_name AS Customer_Name, c_acctbal AS Acct_Bal FROM customer""")
def col_clean_names(spark, sf_dir):
    t = Tables(spark, sf_dir)
    raw = t.customer.select(F.col("c_custkey").alias(" Cust Key"), F.col("c_name").alias("Customer Name?"),
                            F.col("c_acctbal").alias("Acct  Bal "))
    return C.clean_names(raw)


@query("col_select_prune", section="2.2", sql="""
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem""")
def col_select_prune(spark, sf_dir):
    return Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", "l_quantity")


@query("col_drop", section="2.2", sql="""
SELECT p_partkey, p_brand, p_type, p_size FROM part""")
def col_drop(spark, sf_dir):
    return Tables(spark, sf_dir).part.drop("p_name", "p_retailprice")


@query("col_drop_all_null", section="2.2", sql="""
SELECT o_orderkey, o_orderstatus FROM orders""")
def col_drop_all_null(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    wide = o.select("o_orderkey", "o_orderstatus",
                    F.nullif("o_orderstatus", F.col("o_orderstatus")).alias("never_set"))
    return C.drop_all_null(wide)


@query("col_drop_all_zero", section="2.2", sql="""
SELECT o_orderkey, o_totalprice FROM orders""")
def col_drop_all_zero(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    wide = o.select("o_orderkey", "o_totalprice", (F.col("o_totalprice") * 0).alias("zeroed"))
    return C.drop_all_zero(wide)


@query("col_drop_constant", section="2.2", sql="""
SELECT 'o_orderstatus' AS "column", CAST(COUNT(o_orderstatus) AS BIGINT) AS n_values,
       COUNT(DISTINCT o_orderstatus) <= 1 AND COUNT(o_orderstatus) IN (0, COUNT(*)) AS is_constant FROM orders
UNION ALL
SELECT 'status_len', CAST(COUNT(length(o_orderstatus)) AS BIGINT),
       COUNT(DISTINCT length(o_orderstatus)) <= 1 AND COUNT(length(o_orderstatus)) IN (0, COUNT(*)) FROM orders
UNION ALL
SELECT 'o_orderpriority', CAST(COUNT(o_orderpriority) AS BIGINT),
       COUNT(DISTINCT o_orderpriority) <= 1 AND COUNT(o_orderpriority) IN (0, COUNT(*)) FROM orders""")
def col_drop_constant(spark, sf_dir):
    o = Tables(spark, sf_dir).orders.select(
        "o_orderstatus", F.length("o_orderstatus").alias("status_len"), "o_orderpriority")
    return C.constant_profile(o, ["o_orderstatus", "status_len", "o_orderpriority"])


@query("col_add_literal", section="2.2", sql="""
SELECT p_partkey, 'train' AS split FROM part""")
def col_add_literal(spark, sf_dir):
    return C.add_literal(Tables(spark, sf_dir).part.select("p_partkey"), "split", "train")


@query("col_rename", section="2.2", sql="""
SELECT s_suppkey AS supplier_id, s_name AS supplier, s_nationkey AS nation_id FROM supplier""")
def col_rename(spark, sf_dir):
    s = Tables(spark, sf_dir).supplier.select("s_suppkey", "s_name", "s_nationkey")
    return C.rename(s, {"s_suppkey": "supplier_id", 1: "supplier", "s_nationkey": "nation_id"})


@query("col_union_schema", section="2.2", sql=f"""
WITH {TICKETS_SQL}
SELECT summons, code, fy AS year FROM tickets WHERE fy = 2015
UNION ALL SELECT summons, code, fy FROM tickets WHERE fy = 2016
UNION ALL SELECT summons, code, fy FROM tickets WHERE fy = 2017""")
def col_union_schema(spark, sf_dir):
    tk = tickets(Tables(spark, sf_dir))
    y15 = tk.where("fy = 2015").select("summons", "code", "precinct", "state")
    y16 = tk.where("fy = 2016").select("summons", "code", "precinct")
    y17 = tk.where("fy = 2017").select("summons", "code", "state")
    return C.union_years({2015: y15, 2016: y16, 2017: y17}, fill=False)


@query("col_value_domain", section="2.2", sql="""
SELECT DISTINCT 'o_orderstatus' AS "column", o_orderstatus AS value FROM orders
UNION
SELECT DISTINCT 'o_orderpriority', o_orderpriority FROM orders""")
def col_value_domain(spark, sf_dir):
    return C.value_domain(Tables(spark, sf_dir).orders, ["o_orderstatus", "o_orderpriority"])
