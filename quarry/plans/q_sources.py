"""Sources and sinks: write Spark-derived slices of the driver
tables, read them back with the operator under test, and compare with the
tables themselves in the oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import quality as Q
from quarry.plans.q_quality import trip_rules, TRIP_RULES_SQL
from quarry.plans.registry import query
from quarry.plans.standins import LOANS_SQL, TRIPS_SQL, loans, trips
from quarry.sources import files as IO
from quarry.sources.tables import Tables


@query("src_csv_infer", section="2.1", sql="""
SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer""")
def src_csv_infer(spark, sf_dir):
    t = Tables(spark, sf_dir)
    path = IO.write_csv(t.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"),
                       IO.scratch_path(spark, "customer_csv"))
    df = IO.read_csv(spark, path, infer=True)
    return df.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name",
                     F.col("c_acctbal").cast("double").alias("c_acctbal"), "c_mktsegment")


@query("src_csv_schema", section="2.1", sql="""
SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem""")
def src_csv_schema(spark, sf_dir):
    t = Tables(spark, sf_dir)
    cols = ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"]
    # several files, each starting with one header line that must be skipped
    path = IO.write_csv(t.lineitem.select(*cols).repartition(4), IO.scratch_path(spark, "lineitem_psv"),
                        sep="|", header=True)
    return IO.read_delimited(spark, path, "l_orderkey bigint, l_linenumber int, l_quantity double, "
                             "l_returnflag string", sep="|", skip=1)


@query("src_tsv", section="2.1", sql="""
SELECT doc_id, lang, source FROM documents""")
def src_tsv(spark, sf_dir):
    t = Tables(spark, sf_dir)
    path = IO.write_csv(t.documents.select("doc_id", "lang", "source"), IO.scratch_path(spark, "docs_tsv"),
                        sep="\t")
    df = IO.read_csv(spark, path, sep="\t", schema="doc_id bigint, lang string, source string")
    return df


@query("src_null_tokens", section="2.1", sql=f"""
WITH {LOANS_SQL}
SELECT loan_id, CASE WHEN trim(emp_length) IN ('', 'NA', 'n/a') THEN NULL ELSE emp_length END AS emp_length,
       CASE WHEN trim(grade) IN ('', 'NA', 'n/a') THEN NULL ELSE grade END AS grade FROM loans""")
def src_null_tokens(spark, sf_dir):
    ln = loans(Tables(spark, sf_dir)).select("loan_id", "emp_length", "grade")
    return IO.nullify(ln)


@query("src_catalog_view", section="2.1", sql="""
SELECT o_orderstatus, CAST(COUNT(*) AS BIGINT) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1""")
def src_catalog_view(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    name = IO.register(o.where(F.col("o_totalprice") > 100000), "quarry_big_orders")
    return spark.sql(f"SELECT o_orderstatus, COUNT(*) AS n FROM {name} GROUP BY o_orderstatus")


_ALL_PASS_SQL = " AND ".join(TRIP_RULES_SQL.values())


@query("snk_orc_partitioned", section="2.1", sql=f"""
WITH {TRIPS_SQL}
SELECT CAST(month(pickup) AS INTEGER) AS mnth, CAST(COUNT(*) AS BIGINT) AS n, ROUND(AVG(fare), 2) AS avg_fare
FROM trips WHERE {_ALL_PASS_SQL} GROUP BY 1""")
def snk_orc_partitioned(spark, sf_dir):
    tr = Q.conform(trips(Tables(spark, sf_dir)), trip_rules())
    tr = tr.withColumn("mnth", F.month("pickup")).withColumn("m_day", F.dayofmonth("pickup"))
    path = IO.write_partitioned(tr, IO.scratch_path(spark, "trips_orc"), ["mnth", "m_day"], fmt="orc")
    back = spark.read.orc(path)
    # the month filter sits in WHERE, so partition pruning applies when one is given
    return back.groupBy("mnth").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("fare"), 2).alias("avg_fare"))


@query("snk_csv", section="2.1", sql=f"""
WITH {TRIPS_SQL}
SELECT trip_order, trip_line, passengers, tip FROM trips""")
def snk_csv(spark, sf_dir):
    tr = trips(Tables(spark, sf_dir)).select("trip_order", "trip_line", "passengers", "tip")
    path = IO.write_csv(tr, IO.scratch_path(spark, "trips_csv"), null_value="")
    return IO.read_csv(spark, path, schema="trip_order bigint, trip_line int, passengers int, tip double")
