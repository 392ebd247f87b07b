"""Features and classifier evaluation on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import label_at
from quarry.operators import evaluate as E
from quarry.operators import features as FT
from quarry.operators import gram as G
from quarry.plans.registry import query
from quarry.plans.standins import SCORED_DOCS_SQL, scored_docs
from quarry.sources.tables import Tables


@query("ft_binary_encode", section="2.12", sql="""
WITH c AS (SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'high' ELSE 'low' END AS band FROM customer)
SELECT c_custkey, CASE WHEN band = (SELECT MIN(band) FROM c) THEN 0 ELSE 1 END AS band FROM c""")
def ft_binary_encode(spark, sf_dir):
    c = Tables(spark, sf_dir).customer.select(
        "c_custkey", F.when(F.col("c_acctbal") > 5000, "high").otherwise("low").alias("band"))
    return FT.binary_encode(c, ["band"])


@query("ft_dummies", section="2.12", sql="""
SELECT o_orderkey, CAST(o_orderpriority = '2-HIGH' AS INTEGER) AS "o_orderpriority_2-HIGH",
       CAST(o_orderpriority = '3-MEDIUM' AS INTEGER) AS "o_orderpriority_3-MEDIUM",
       CAST(o_orderpriority = '4-NOT SPECIFIED' AS INTEGER) AS "o_orderpriority_4-NOT SPECIFIED",
       CAST(o_orderpriority = '5-LOW' AS INTEGER) AS "o_orderpriority_5-LOW" FROM orders""")
def ft_dummies(spark, sf_dir):
    o = Tables(spark, sf_dir).orders.select("o_orderkey", "o_orderpriority")
    return FT.dummies(o, ["o_orderpriority"])


@query("ft_zscore", section="2.12", sql="""
SELECT c_custkey, ROUND((c_acctbal - (SELECT AVG(c_acctbal) FROM customer))
                        / (SELECT stddev_samp(c_acctbal) FROM customer), 6) AS c_acctbal FROM customer""")
def ft_zscore(spark, sf_dir):
    c = Tables(spark, sf_dir).customer.select("c_custkey", "c_acctbal")
    return FT.zscore(c, ["c_acctbal"]).withColumn("c_acctbal", F.round("c_acctbal", 6))


@query("ft_stratified_split", section="2.12", sql=f"""
WITH {SCORED_DOCS_SQL}
SELECT doc_id, y, CASE WHEN row_number() OVER (PARTITION BY y ORDER BY md5('42' || CAST(doc_id AS VARCHAR)), doc_id)
                            <= ROUND(COUNT(*) OVER (PARTITION BY y) * 0.7) THEN 'train' ELSE 'test' END AS split
FROM scored_docs""")
def ft_stratified_split(spark, sf_dir):
    d = scored_docs(Tables(spark, sf_dir)).select("doc_id", "y")
    return FT.stratified_split(d, "y", 0.7, "doc_id", seed=42)


@query("ft_random_split", section="2.12", sql="""
SELECT c_custkey, CASE WHEN row_number() OVER (ORDER BY md5('42' || CAST(c_custkey AS VARCHAR)), c_custkey)
                            <= FLOOR(COUNT(*) OVER () * 0.7) THEN 'train' ELSE 'test' END AS split FROM customer""")
def ft_random_split(spark, sf_dir):
    c = Tables(spark, sf_dir).customer.select("c_custkey")
    return FT.random_split(c, 0.7, "c_custkey", seed=42)


@query("ml_gram", section="2.12", sql="""
SELECT l_returnflag, CAST(COUNT(*) AS BIGINT) AS n,
  CAST(SUM(1) AS DOUBLE) AS xx_0_0, CAST(SUM(q) AS DOUBLE) AS xx_0_1, CAST(SUM(d) AS DOUBLE) AS xx_0_2,
  CAST(SUM(y) AS DOUBLE) AS xy_0, CAST(SUM(q * q) AS DOUBLE) AS xx_1_1, CAST(SUM(q * d) AS DOUBLE) AS xx_1_2,
  CAST(SUM(q * y) AS DOUBLE) AS xy_1, CAST(SUM(d * d) AS DOUBLE) AS xx_2_2, CAST(SUM(d * y) AS DOUBLE) AS xy_2,
  CAST(SUM(y * y) AS DOUBLE) AS yy
FROM (SELECT l_returnflag, CAST(l_quantity AS DECIMAL(15,2)) AS q, CAST(l_discount AS DECIMAL(15,2)) AS d,
             CAST(l_extendedprice AS DECIMAL(15,2)) AS y FROM lineitem)
GROUP BY l_returnflag""")
def ml_gram(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem.select(
        "l_returnflag", *[F.col(c).cast("decimal(15,2)").alias(a) for c, a in
                          (("l_quantity", "q"), ("l_discount", "d"), ("l_extendedprice", "y"))])
    g = G.gram(li, ["q", "d"], "y", by=["l_returnflag"])
    return g.select("l_returnflag", "n", *[F.col(c).cast("double").alias(c) for c in g.columns
                                           if c not in ("l_returnflag", "n")])


# ------------------------------------------------------------------ evaluation

@query("ev_threshold_labels", section="2.12", sql=f"""
WITH {SCORED_DOCS_SQL}
SELECT doc_id, y, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS pred FROM scored_docs""")
def ev_threshold_labels(spark, sf_dir):
    d = scored_docs(Tables(spark, sf_dir))
    return d.select("doc_id", "y", label_at("p", 0.5).alias("pred"))


@query("ev_confusion", section="2.12", sql=f"""
WITH {SCORED_DOCS_SQL},
c AS (SELECT COUNT(*) FILTER (WHERE y = 1 AND p >= 0.5) AS tp, COUNT(*) FILTER (WHERE y <> 1 AND p < 0.5) AS tn,
             COUNT(*) FILTER (WHERE y <> 1 AND p >= 0.5) AS fp, COUNT(*) FILTER (WHERE y = 1 AND p < 0.5) AS fn
      FROM scored_docs)
SELECT CAST(tp AS BIGINT) AS tp, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
       ROUND((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, ROUND(tp / (tp + fn), 6) AS sensitivity,
       ROUND(tn / (tn + fp), 6) AS specificity FROM c""")
def ev_confusion(spark, sf_dir):
    d = scored_docs(Tables(spark, sf_dir)).withColumn("pred", label_at("p", 0.5))
    out = E.confusion(d, "y", "pred")
    return out.select("tp", "tn", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("accuracy", "sensitivity", "specificity")])


_DIGIT_PRED_SQL = "CASE WHEN vec_id % 4 = 0 THEN (label + 1) % 10 ELSE label END"


def _digits_with_pred(spark, sf_dir):
    e = Tables(spark, sf_dir).embeddings
    return e.select("vec_id", "label", F.when(F.col("vec_id") % 4 == 0, (F.col("label") + 1) % 10)
                    .otherwise(F.col("label")).cast("int").alias("pred"))


@query("ev_confusion_multi", section="2.12", sql=f"""
SELECT label, CAST({_DIGIT_PRED_SQL} AS INTEGER) AS pred, CAST(COUNT(*) AS BIGINT) AS n FROM embeddings GROUP BY 1, 2""")
def ev_confusion_multi(spark, sf_dir):
    return E.confusion_matrix(_digits_with_pred(spark, sf_dir), "label", "pred")


@query("ev_kappa", section="2.12", sql=f"""
WITH d AS (SELECT label, {_DIGIT_PRED_SQL} AS pred FROM embeddings),
n AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE label = pred) AS hit FROM d),
pe AS (SELECT SUM(r.c * c.c) / ((SELECT n FROM n) * (SELECT n FROM n)) AS pe
       FROM (SELECT label AS k, COUNT(*) AS c FROM d GROUP BY 1) r JOIN (SELECT pred AS k, COUNT(*) AS c FROM d GROUP BY 1) c USING (k))
SELECT ROUND(hit / n, 6) AS accuracy, ROUND((hit / n - pe) / (1 - pe), 6) AS kappa FROM n, pe""")
def ev_kappa(spark, sf_dir):
    out = E.multiclass_summary(_digits_with_pred(spark, sf_dir), "label", "pred")
    return out.select(F.round("accuracy", 6).alias("accuracy"), F.round("kappa", 6).alias("kappa"))


_LO, _HI, _N = 0.01, 0.99, 100
_STEP = (_HI - _LO) / (_N - 1)


@query("ev_cutoff_sweep", section="2.12", sql=f"""
WITH {SCORED_DOCS_SQL},
cuts AS (SELECT {_LO!r} + CAST(i AS DOUBLE) * {_STEP!r} AS cutoff FROM range({_N}) t(i)),
tot AS (SELECT COUNT(*) FILTER (WHERE y = 1) AS P, COUNT(*) FILTER (WHERE y <> 1) AS N FROM scored_docs),
c AS (SELECT cutoff, COUNT(*) FILTER (WHERE y = 1 AND p >= cutoff) AS tp, COUNT(*) FILTER (WHERE y <> 1 AND p >= cutoff) AS fp
      FROM cuts CROSS JOIN scored_docs GROUP BY cutoff)
SELECT ROUND(cutoff, 6) AS cutoff, ROUND(tp / P, 6) AS sensitivity, ROUND((N - fp) / N, 6) AS specificity,
       ROUND((tp + N - fp) / (P + N), 6) AS accuracy, abs(tp / P - (N - fp) / N) < 0.01 AS balanced FROM c, tot""")
def ev_cutoff_sweep(spark, sf_dir):
    d = scored_docs(Tables(spark, sf_dir))
    out = E.cutoff_sweep(d, "y", "p", _LO, _HI, _N)
    return out.select(*[F.round(c, 6).alias(c) for c in ("cutoff", "sensitivity", "specificity", "accuracy")],
                      "balanced")


@query("ev_roc", section="2.12", sql=f"""
WITH {SCORED_DOCS_SQL},
s AS (SELECT p AS score, COUNT(*) FILTER (WHERE y = 1) AS pos, COUNT(*) FILTER (WHERE y <> 1) AS neg FROM scored_docs GROUP BY 1)
SELECT score, ROUND(SUM(pos) OVER (ORDER BY score DESC) / SUM(pos) OVER (), 6) AS tpr,
       ROUND(SUM(neg) OVER (ORDER BY score DESC) / SUM(neg) OVER (), 6) AS fpr FROM s""")
def ev_roc(spark, sf_dir):
    r = E.roc(scored_docs(Tables(spark, sf_dir)), "y", "p")
    return r.select("score", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


@query("ev_auc", section="2.12", sql=f"""
WITH {SCORED_DOCS_SQL},
pairs AS (SELECT SUM(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) AS s
          FROM scored_docs a JOIN scored_docs b ON a.y = 1 AND b.y <> 1),
t AS (SELECT COUNT(*) FILTER (WHERE y = 1) AS P, COUNT(*) FILTER (WHERE y <> 1) AS N FROM scored_docs)
SELECT ROUND(s / (P * N), 6) AS auc FROM pairs, t""")
def ev_auc(spark, sf_dir):
    a = E.auc(scored_docs(Tables(spark, sf_dir)), "y", "p")
    return a.select(F.round("auc", 6).alias("auc"))


@query("ev_ks", section="2.12", sql=f"""
WITH {SCORED_DOCS_SQL},
s AS (SELECT p AS score, COUNT(*) FILTER (WHERE y = 1) AS pos, COUNT(*) FILTER (WHERE y <> 1) AS neg FROM scored_docs GROUP BY 1),
r AS (SELECT SUM(pos) OVER (ORDER BY score DESC) / SUM(pos) OVER () - SUM(neg) OVER (ORDER BY score DESC) / SUM(neg) OVER () AS d
      FROM s)
SELECT ROUND(MAX(d), 6) AS ks FROM r""")
def ev_ks(spark, sf_dir):
    k = E.ks(scored_docs(Tables(spark, sf_dir)), "y", "p")
    return k.select(F.round("ks", 6).alias("ks"))


@query("ev_gain_lift", section="2.12", sql=f"""
WITH {SCORED_DOCS_SQL},
d AS (SELECT *, ntile(10) OVER (ORDER BY p DESC, doc_id) AS bucket FROM scored_docs),
g AS (SELECT CAST(bucket AS INTEGER) AS bucket, COUNT(*) AS total, COUNT(*) FILTER (WHERE y = 1) AS responses FROM d GROUP BY 1)
SELECT bucket, CAST(total AS BIGINT) AS total, CAST(responses AS BIGINT) AS responses,
       CAST(SUM(responses) OVER (ORDER BY bucket) AS BIGINT) AS cum_responses,
       ROUND(100.0 * SUM(responses) OVER (ORDER BY bucket) / SUM(responses) OVER (), 6) AS gain,
       ROUND(100.0 * SUM(responses) OVER (ORDER BY bucket) / SUM(responses) OVER () / (bucket * 10.0), 6) AS lift FROM g""")
def ev_gain_lift(spark, sf_dir):
    g = E.gain_lift(scored_docs(Tables(spark, sf_dir)), "y", "p", "doc_id", 10)
    return g.select("bucket", "total", "responses", "cum_responses",
                    F.round("gain", 6).alias("gain"), F.round("lift", 6).alias("lift"))
