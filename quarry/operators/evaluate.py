"""Classifier evaluation.

Everything is an aggregate over the scored rows.  Curves that need
running totals over scores (ROC, AUC, KS) use a distributed prefix sum:
scores are range-partitioned and sorted, each partition's totals become
offsets, so no single task sees all scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators.windows import deciles, prefix_sums


def confusion(df: DataFrame, y: str, pred: str, positive=1) -> DataFrame:
    """Accuracy, sensitivity (true positive rate) and specificity in one row."""
    pos = F.col(y) == F.lit(positive)
    hit = F.col(pred) == F.lit(positive)
    return df.agg(
        F.count(F.when(pos & hit, 1)).alias("tp"), F.count(F.when(~pos & ~hit, 1)).alias("tn"),
        F.count(F.when(~pos & hit, 1)).alias("fp"), F.count(F.when(pos & ~hit, 1)).alias("fn"),
    ).select("tp", "tn", "fp", "fn",
             ((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))).alias("accuracy"),
             F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")).alias("sensitivity"),
             F.try_divide(F.col("tn"), F.col("tn") + F.col("fp")).alias("specificity"))


def confusion_matrix(df: DataFrame, y: str, pred: str) -> DataFrame:
    """k x k matrix in long form: (y, pred, n)."""
    return df.groupBy(y, pred).agg(F.count(F.lit(1)).alias("n"))


def multiclass_summary(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Accuracy and Cohen's kappa from the class marginals (two small aggregates)."""
    total = df.agg(F.count(F.lit(1)).alias("_n"), F.count(F.when(F.col(y) == F.col(pred), 1)).alias("_hit"))
    rows = df.groupBy(F.col(y).alias("_k")).agg(F.count(F.lit(1)).alias("_r"))
    cols = df.groupBy(F.col(pred).alias("_k")).agg(F.count(F.lit(1)).alias("_c"))
    pe = rows.join(cols, "_k").agg(F.sum(F.col("_r") * F.col("_c")).alias("_s")) \
        .withColumn("_n", total.select("_n").scalar()) \
        .select((F.col("_s") / (F.col("_n") * F.col("_n"))).alias("_pe"))
    pe = pe.withColumn("_pe", F.coalesce("_pe", F.lit(0.0)))  # no class on both sides
    return total.select(F.try_divide("_hit", "_n").alias("accuracy"), pe.scalar().alias("_pe")) \
        .select("accuracy", F.try_divide(F.col("accuracy") - F.col("_pe"), 1 - F.col("_pe")).alias("kappa"))


def cutoff_sweep(df: DataFrame, y: str, p: str, lo: float = 0.01, hi: float = 0.99, n: int = 100,
                 positive=1, tol: float = 0.01) -> DataFrame:
    """Accuracy, sensitivity and specificity at ``n`` evenly spaced cut-offs.

    Each score is put in the bucket of the highest cut-off it reaches (one
    pass, a bounded table of ``n + 1`` bucket counts); suffix sums over the
    buckets give the counts at or above every cut-off.  ``balanced`` marks
    cut-offs where sensitivity and specificity differ by less than ``tol``.
    Rows without a score or a label are left out; a rate without cases is NULL.
    """
    step = (hi - lo) / (n - 1)
    df = df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    spark = df.sparkSession
    cuts = spark.range(n).select(F.col("id").cast("int").alias("i"),
                                 (F.lit(lo) + F.col("id").cast("double") * F.lit(step)).alias("cutoff"))
    x = F.col(p)
    k0 = F.floor((x - F.lit(lo)) / F.lit(step)).cast("int")
    # exact correction of the float bucket against the cut-off values themselves
    k1 = F.when(x >= F.lit(lo) + (k0 + 1) * F.lit(step), k0 + 1) \
        .when(x < F.lit(lo) + k0 * F.lit(step), k0 - 1).otherwise(k0)
    bucket = F.least(F.greatest(k1, F.lit(-1)), F.lit(n - 1))
    pos = F.col(y) == F.lit(positive)
    b = df.groupBy(bucket.alias("i")).agg(F.count(F.when(pos, 1)).alias("_pos"),
                                          F.count(F.when(~pos, 1)).alias("_neg"))
    tot = b.agg(F.sum("_pos").alias("P"), F.sum("_neg").alias("N"))
    # every bucket -1 .. n-1 present (n + 1 rows), then suffix sums over them
    full = spark.range(-1, n).select(F.col("id").cast("int").alias("i")).join(b, "i", "left").fillna(0)
    w = Window.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    full = full.select("i", F.sum("_pos").over(w).alias("tp"), F.sum("_neg").over(w).alias("fp"))
    j = cuts.join(full, "i").withColumns({"_P": tot.select("P").scalar(), "_N": tot.select("N").scalar()})
    P, N = F.col("_P"), F.col("_N")
    tp, fp = F.col("tp"), F.col("fp")
    out = j.select("cutoff", F.try_divide(tp, P).alias("sensitivity"), F.try_divide(N - fp, N).alias("specificity"),
                   F.try_divide(tp + N - fp, P + N).alias("accuracy"))
    return out.withColumn("balanced", F.abs(F.col("sensitivity") - F.col("specificity")) < tol)


def roc(df: DataFrame, y: str, p: str, positive=1) -> DataFrame:
    """TPR and FPR at every distinct score (as the cut-off ``p >= s``).

    Rows without a score or a label are left out; without a class its rate is NULL.
    """
    df = df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    pos = F.col(y) == F.lit(positive)
    per = df.groupBy(F.col(p).alias("score")).agg(F.count(F.when(pos, 1)).alias("pos"),
                                                   F.count(F.when(~pos, 1)).alias("neg"))
    tot = per.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    c = prefix_sums(per, [F.desc("score")], ["pos", "neg"])
    return c.select("score", F.try_divide(F.col("cum_pos"), tot.select("P").scalar()).alias("tpr"),
                    F.try_divide(F.col("cum_neg"), tot.select("N").scalar()).alias("fpr"))


def auc(df: DataFrame, y: str, p: str, positive=1) -> DataFrame:
    """Area under the ROC curve by the rank-sum identity (ties count half); NULL with one class only."""
    df = df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    pos = F.col(y) == F.lit(positive)
    per = df.groupBy(F.col(p).alias("score")).agg(F.count(F.when(pos, 1)).alias("pos"),
                                                   F.count(F.when(~pos, 1)).alias("neg"))
    c = prefix_sums(per, [F.asc("score")], ["neg"])
    # negatives strictly below the score = running total minus this score's own
    s = c.agg(F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") + 0.5 * F.col("neg"))).alias("_s"),
              F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    return s.select(F.try_divide(F.col("_s"), F.col("_P") * F.col("_N")).alias("auc"))


def ks(df: DataFrame, y: str, p: str, positive=1) -> DataFrame:
    """Kolmogorov-Smirnov statistic: max(TPR - FPR) over the ROC points."""
    return roc(df, y, p, positive).agg(F.max(F.col("tpr") - F.col("fpr")).alias("ks"))


def gain_lift(df: DataFrame, y: str, p: str, id_col: str, groups: int = 10, positive=1) -> DataFrame:
    """Decile table by descending score: total, responses, cumulative responses, gain %, lift."""
    d = deciles(df, p, id_col, groups, "bucket")
    g = d.groupBy("bucket").agg(F.count(F.lit(1)).alias("total"),
                                F.count(F.when(F.col(y) == F.lit(positive), 1)).alias("responses"))
    # running totals over <= groups rows
    w = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    g = g.withColumn("cum_responses", F.sum("responses").over(w))
    all_resp = F.sum("responses").over(Window.partitionBy())
    return g.withColumn("gain", 100.0 * F.col("cum_responses") / all_resp) \
        .withColumn("lift", F.col("gain") / (F.col("bucket") * (100.0 / groups)))
