"""Aggregations.

All grouped work is a ``groupBy().agg()``: Spark aggregates partially
inside each map task before the shuffle, so a key holding a third of the
rows still moves one partial row per task.  Shares and totals are taken
on the aggregated result, never with a whole-table window on detail rows.
"""

from __future__ import annotations

from functools import reduce
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators.selection import bounded, quantiles


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def totals(df: DataFrame, aggs: dict[str, Column]) -> DataFrame:
    """Global aggregates as one row."""
    return df.agg(*[a.alias(n) for n, a in aggs.items()])


def count_by(df: DataFrame, *by: str, name: str = "n") -> DataFrame:
    """Count per key, largest first."""
    return (df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
            .orderBy(F.desc(name), *[F.asc(b) for b in by]))


def sum_by(df: DataFrame, by: Sequence[str], cols: Sequence[str], digits: int | None = 2,
           mode: str = "half_up", prefix: str = "sum_") -> DataFrame:
    rnd = F.round if mode == "half_up" else F.bround
    aggs = [(rnd(F.sum(c), digits) if digits is not None else F.sum(c)).alias(prefix + c)
            for c in cols]
    return df.groupBy(*by).agg(*aggs)


def mean_by(df: DataFrame, by: Sequence[str], cols: Sequence[str], prefix: str = "avg_") -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(c).alias(prefix + c) for c in cols])


def agg_by(df: DataFrame, by: Sequence[str], aggs: dict[str, Column]) -> DataFrame:
    return df.groupBy(*by).agg(*[a.alias(n) for n, a in aggs.items()])


def monthly(df: DataFrame, ts: str, by: Sequence[str], sums: Sequence[str],
            digits: int | None = None) -> DataFrame:
    """Sums per key, year and month of ``ts``."""
    aggs = [(F.round(F.sum(c), digits) if digits is not None else F.sum(c)).alias(f"sum_{c}")
            for c in sums]
    return df.groupBy(*by, F.year(ts).alias("year"), F.month(ts).alias("month")).agg(*aggs)


def modal_groups(df: DataFrame, by: Sequence[str], name: str = "n") -> DataFrame:
    """Groups whose count equals the largest count, ties kept (HAVING n = max)."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    top = counts.agg(F.max(name)).scalar()
    return counts.where(F.col(name) == top)


def distinct_count(df: DataFrame, cols: Sequence[str], approx: bool = False,
                   rsd: float = 0.01) -> DataFrame:
    """Distinct values per column in one row.

    Exact ``count(distinct)`` on several columns makes Spark expand every row
    once per column; ``approx=True`` uses HyperLogLog++ with bounded memory.
    """
    if approx:
        return df.agg(*[F.approx_count_distinct(c, rsd).alias(f"nd_{c}") for c in cols])
    return df.agg(*[F.count_distinct(c).alias(f"nd_{c}") for c in cols])


def spread(df: DataFrame, col: str, probs: Sequence[float] = (0.25, 0.5, 0.75),
           accuracy: int = 100_000, by: Sequence[str] = ()) -> DataFrame:
    """Average, approximate quantiles and distinct count of one column."""
    aggs = [F.avg(col).alias("avg")]
    aggs += [F.percentile_approx(col, p, accuracy).alias(f"p{int(round(p * 100))}") for p in probs]
    aggs.append(F.count_distinct(col).alias("n_distinct"))
    return df.groupBy(*by).agg(*aggs)


def _join_groups(rows: DataFrame, groups: DataFrame, named: Sequence[str], how: str = "inner") -> DataFrame:
    """NULL-safe join of one row per group; a group without a value is a group too."""
    right = groups.withColumnsRenamed({a: f"_r{a}" for a in named})
    on = [rows[a].eqNullSafe(right[f"_r{a}"]) for a in named]
    return rows.join(right, reduce(lambda p, q: p & q, on), how).drop(*[f"_r{a}" for a in named])


def _type7(probs: Sequence[float]) -> dict[float, Callable[[Column], Column]]:
    return {p: lambda n, p=p: (n - 1) * F.lit(float(p)) for p in probs}


def _hinges() -> dict[float, Callable[[Column], Column]]:
    """Tukey's hinges: the medians of both halves, the middle value in each when n is odd."""
    depth = lambda n: F.floor((n + 3) / 2) / 2
    return {0.25: lambda n: depth(n) - 1, 0.5: lambda n: (n - 1) / 2, 0.75: lambda n: n - depth(n)}


def percentile_table(df: DataFrame, cols: Sequence[str], step: float = 0.01,
                     method: str = "exact") -> DataFrame:
    """Percentiles 0..1 in ``step`` for each column: (column, pct, value).

    ``exact`` (``sort`` is the same) is R type 7 / ``quantile_cont`` by
    :func:`selection.quantiles`, for any number of distinct values; ``approx``
    is the bounded-memory sketch.
    """
    n_steps = int(round(1 / step))
    probs = [round(i * step, 10) for i in range(n_steps + 1)]
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "column", "x")
    if method in ("exact", "sort"):
        return quantiles(long, "x", _type7(probs), ["column"]).withColumnRenamed("_by0", "column")
    sketch = F.percentile_approx("x", F.array(*[F.lit(p) for p in probs]), 1_000_000)
    out = long.groupBy("column").agg(sketch.alias("_v")).select("column", F.posexplode("_v").alias("_i", "value"))
    return out.select("column", F.round(F.col("_i") * step, 6).alias("pct"), "value")


def quantiles_sorted(df: DataFrame, col: str, probs: Sequence[float]) -> DataFrame:
    """Exact type-7 quantiles of one column: (pct, value), see :func:`selection.quantiles`."""
    return quantiles(df, col, _type7(probs))


def pair_corr(df: DataFrame, x: str, y: str, by: Sequence[str] = (), name: str = "corr") -> DataFrame:
    return df.groupBy(*by).agg(F.corr(x, y).alias(name))


def share(df: DataFrame, by: Sequence[str], within: Sequence[str] = (), name: str = "n",
          share_name: str = "share") -> DataFrame:
    """Count per bucket and its share of the total (or of its ``within`` group).

    The total is taken over the aggregated buckets, never over detail rows.
    """
    keys = list(within) + [b for b in by if b not in within]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    if not within:  # grand total as a scalar subquery, not a one-partition window
        return counts.withColumn(share_name, F.col(name) / counts.agg(F.sum(name)).scalar())
    w = Window.partitionBy(*within)
    return counts.withColumn(share_name, F.col(name) / F.sum(name).over(w))


def col_max(df: DataFrame, cols: Sequence[str], prefix: str = "max_") -> DataFrame:
    return df.agg(*[F.max(c).alias(prefix + c) for c in cols])


def argmax(df: DataFrame, value: str, ret: Sequence[str], by: Sequence[str] = (),
           tie: Sequence[str] = (), lowest: bool = False) -> DataFrame:
    """Row holding the max (or min) of ``value``; first ``tie`` order wins a tie.

    NULL values never win.  Grouped: ``row_number() = 1`` is cut map-side
    by a partial window-group limit before any shuffle.
    """
    order = [F.asc(value) if lowest else F.desc(value)] + [F.asc(t) for t in tie]
    base = df.where(F.col(value).isNotNull())
    cols = list(by) + [value] + [r for r in ret if r != value and r not in by]
    if not by:
        return base.orderBy(*order).limit(1).select(*cols)
    w = Window.partitionBy(*by).orderBy(*order)
    return base.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*cols)


def frequencies(df: DataFrame, cols: Sequence[str], split_by: str | None = None,
                name: str = "n") -> DataFrame:
    """Value counts of many categorical columns in one job: (column, value[, split], n)."""
    ids = [split_by] if split_by else []
    long = df.select(*ids, *[F.col(c).cast("string").alias(c) for c in cols]) \
        .unpivot(ids, list(cols), "column", "value")
    keys = ["column", "value"] + ids
    return long.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def cross_counts(df: DataFrame, by: Sequence[str], pivot: str | None = None,
                 values: Sequence | None = None, name: str = "n") -> DataFrame:
    """Two- or three-way counts; wide when ``pivot`` (give ``values`` to skip a scan)."""
    if pivot is None:
        return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    return df.groupBy(*by).pivot(pivot, list(values) if values is not None else None).count()


def crosstab(df: DataFrame, a: str, b: str, name: str = "n") -> DataFrame:
    """Confusion-style table in long form: (a, b, n)."""
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias(name))


def describe_numeric(df: DataFrame, cols: Sequence[str], method: str = "exact") -> DataFrame:
    """Per column: n, nulls, distinct, zeros, mean, sd, min, quartiles, max, IQR, MAD
    (1.4826 times the median distance from the median), population skewness and excess kurtosis.

    Quartiles and MAD come from :func:`selection.quantiles`, moments are taken
    about the mean.  ``method="approx"`` uses the
    bounded-memory quantile sketch on the rows instead, without a MAD.  Moments
    that need more values or some spread are NULL.
    """
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]) \
        .unpivot([], list(cols), "column", "x")
    if method == "approx":
        out = long.groupBy("column").agg(
            F.count("x").alias("n"), F.count_if(F.col("x").isNull()).alias("nulls"),
            F.approx_count_distinct("x", 0.01).alias("n_distinct"), F.count_if(F.col("x") == 0).alias("zeros"),
            F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.min("x").alias("min"),
            _sketch("x").alias("_q"), F.max("x").alias("max"), F.skewness("x").alias("skew"), F.kurtosis("x").alias("kurt"))
        q = [F.col("_q")[i] for i in range(3)]
        return out.select("column", "n", "nulls", "n_distinct", "zeros", "mean", "sd", "min", q[0].alias("q1"),
                          q[1].alias("median"), q[2].alias("q3"), "max", (q[2] - q[0]).alias("iqr"),
                          F.lit(None).cast("double").alias("mad"), "skew", "kurt")
    x = F.col("x")
    base = long.groupBy(F.col("column").alias("_by0")).agg(
        F.count(x).alias("n"), F.count_if(x.isNull()).alias("nulls"), F.count_distinct(x).alias("n_distinct"),
        F.count_if(x == 0).alias("zeros"), F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"))
    q = _quartile_columns(quantiles(long, "x", _type7((0.25, 0.5, 0.75)), ["column"]), ["_by0"])
    base = bounded(_join_groups(base, q, ["_by0"], "left"))
    about = _join_groups(long.where(x.isNotNull()).withColumnRenamed("column", "_by0"), base.select("_by0", "mean", "median"), ["_by0"])
    d = x - F.col("mean")
    moments = about.groupBy("_by0").agg(*[F.sum(d ** k).alias(f"_m{k}") for k in (2, 3, 4)])
    away = quantiles(about.select("_by0", F.abs(x - F.col("median")).alias("_d")), "_d", _type7((0.5,)), ["_by0"])
    out = _join_groups(_join_groups(base, moments, ["_by0"], "left"), away, ["_by0"], "left")
    var = F.try_divide("_m2", "n")
    return out.select(
        F.col("_by0").alias("column"), "n", "nulls", "n_distinct", "zeros", "mean",
        F.sqrt(F.try_divide(F.col("_m2"), F.col("n") - 1)).alias("sd"), "min", "q1", "median", "q3", "max",
        (F.col("q3") - F.col("q1")).alias("iqr"), (F.lit(1.4826) * F.col("value")).alias("mad"),
        F.try_divide(F.try_divide("_m3", "n"), var ** 1.5).alias("skew"),
        (F.try_divide(F.try_divide("_m4", "n"), var ** 2) - 3).alias("kurt"))


def _quartile_columns(long: DataFrame, by: Sequence[str]) -> DataFrame:
    return long.groupBy(*by).agg(*[F.max(F.when(F.col("pct") == p, F.col("value"))).alias(c)
                                   for p, c in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])


def describe_categorical(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    """Level counts with percent and cumulative percent (levels sorted by count desc)."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias(name))
    w_all = Window.partitionBy()
    w_cum = Window.orderBy(F.desc(name), F.asc(col)).rowsBetween(Window.unboundedPreceding, 0)
    # the window runs over the level table, one row per distinct level
    return counts.select(col, name, (100.0 * F.col(name) / F.sum(name).over(w_all)).alias("pct"),
                         (100.0 * F.sum(name).over(w_cum) / F.sum(name).over(w_all)).alias("cum_pct"))


def _sketch(x: str) -> Column:
    return F.percentile_approx(F.col(x).cast("double"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 100_000)


def box_stats(df: DataFrame, x: str, by: Sequence[str] = (), k: float = 1.5,
              method: str = "exact") -> DataFrame:
    """Five-number summary with 1.5 IQR whiskers and outlier count.

    ``exact`` has type-7 quartiles and ``hinges`` Tukey's hinges, both by
    :func:`selection.quantiles`; whiskers and outliers are one more aggregate.  ``approx`` takes the quartiles from the bounded-memory sketch.
    Groups without a value of ``x`` have no row.
    """
    named = [f"_by{i}" for i in range(len(by))]
    rows = df.select(*[F.col(b).alias(a) for b, a in zip(by, named)], F.col(x).cast("double").alias("_x")) \
        .where(F.col("_x").isNotNull())
    if method == "approx":
        q = rows.groupBy(*named).agg(_sketch("_x").alias("_q")).select(
            *named, *[F.col("_q")[i].alias(c) for i, c in enumerate(("q1", "median", "q3"))])
    else:
        q = _quartile_columns(quantiles(rows, "_x", _hinges() if method == "hinges" else _type7((0.25, 0.5, 0.75)), named), named)
    q = bounded(q)
    if named:
        joined = _join_groups(rows, q, named)
    else:  # one row: scalar subqueries, evaluated once
        joined = rows.withColumns({c: q.select(c).scalar() for c in ("q1", "median", "q3")})
    reach = k * (F.col("q3") - F.col("q1"))
    inside = (F.col("_x") >= F.col("q1") - reach) & (F.col("_x") <= F.col("q3") + reach)
    out = joined.groupBy(*named, "q1", "median", "q3").agg(
        F.min("_x").alias("min"), F.max("_x").alias("max"),
        F.min(F.when(inside, F.col("_x"))).alias("lower_whisker"),
        F.max(F.when(inside, F.col("_x"))).alias("upper_whisker"),
        F.count_if(~inside).alias("outliers"), F.count(F.lit(1)).alias("n"))
    return out.withColumnsRenamed(dict(zip(named, by)))


def histogram(df: DataFrame, x: str, width: float, boundary: float = 0.0,
              by: Sequence[str] = (), name: str = "n") -> DataFrame:
    """Fixed-width bins ``[lo, lo + width)``; bins are anchored on ``boundary``."""
    lo = F.floor((F.col(x) - boundary) / width) * width + boundary
    return (df.where(F.col(x).isNotNull()).groupBy(*by, lo.alias("bin_lo"))
            .agg(F.count(F.lit(1)).alias(name)))
