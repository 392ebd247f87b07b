"""Data quality: profiles, keys, conformance rules, repair.

Profiles are one aggregate job each (many counters in one ``agg``), and
their one-row result is turned long with ``unpivot`` on the executors.
Conformance rules are plain named boolean Columns, so the same list drives
the violation report and the load filter.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def null_profile(df: DataFrame, cols: Sequence[str] | None = None, digits: int = 1) -> DataFrame:
    """(column, nulls, rows, pct) for every column, one scan."""
    cols = list(cols or df.columns)
    wide = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in cols],
                  F.count(F.lit(1)).alias("__rows"))
    long = wide.unpivot(["__rows"], cols, "column", "nulls")
    return long.select("column", "nulls", F.col("__rows").alias("rows"),
                       F.round(100.0 * F.col("nulls") / F.col("__rows"), digits).alias("pct"))


def shape(df: DataFrame) -> DataFrame:
    """(rows, columns) as one row."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def null_total(df: DataFrame) -> DataFrame:
    """NULL cells in the whole table."""
    total = None
    for c in df.columns:
        term = F.count(F.when(F.col(c).isNull(), 1))
        total = term if total is None else total + term
    return df.agg(total.alias("nulls"))


def null_percent(df: DataFrame, col: str, digits: int = 2, name: str = "pct_null") -> DataFrame:
    return df.agg(F.round(100.0 * F.count(F.when(F.col(col).isNull(), 1)) / F.count(F.lit(1)),
                          digits).alias(name))


def blank_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, blanks): empty or all-blank strings per string column."""
    cols = list(cols or [f.name for f in df.schema.fields if f.dataType.typeName() == "string"])
    wide = df.agg(*[F.count(F.when(F.trim(F.col(c)) == "", 1)).alias(c) for c in cols])
    return wide.unpivot([], cols, "column", "blanks")


def duplicate_count(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(rows, distinct_rows, duplicates) over ``cols`` (all by default); NULLs group together."""
    cols = list(cols or df.columns)
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("distinct_rows")) \
        .withColumn("duplicates", F.col("rows") - F.col("distinct_rows"))


def dedup(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order`` (repeatable, unlike dropDuplicates)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def key_report(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """(rows, distinct_keys, null_keys, is_key)."""
    keys = [key] if isinstance(key, str) else list(key)
    any_null = F.lit(False)
    for k in keys:
        any_null = any_null | F.col(k).isNull()
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max(any_null).alias("_null"))
    return g.agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("distinct_keys"),
                 F.sum(F.when(F.col("_null"), F.col("_n")).otherwise(0)).alias("null_keys"),
                 F.max("_n").alias("_max")) \
        .select("rows", "distinct_keys", "null_keys",
                ((F.col("_max") <= 1) & (F.col("null_keys") == 0)).alias("is_key"))


def key_overlap(a: DataFrame, b: DataFrame, key_a: str, key_b: str | None = None) -> DataFrame:
    """(only_a, only_b, both) counts of distinct non-NULL keys."""
    key_b = key_b or key_a
    ka = a.select(F.col(key_a).alias("_k")).where("_k IS NOT NULL").distinct().withColumn("_a", F.lit(1))
    kb = b.select(F.col(key_b).alias("_k")).where("_k IS NOT NULL").distinct().withColumn("_b", F.lit(1))
    j = ka.join(kb, "_k", "full")
    return j.agg(F.count(F.when(F.col("_b").isNull(), 1)).alias("only_a"),
                 F.count(F.when(F.col("_a").isNull(), 1)).alias("only_b"),
                 F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("both"))


def domain_audit(df: DataFrame, cols: Sequence[str], name: str = "n") -> DataFrame:
    """Value frequency of coded columns: (column, value, n), one job."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]) \
        .unpivot([], list(cols), "column", "value")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias(name))


_STATS = {"min": F.min, "max": F.max, "avg": F.avg, "sum": F.sum,
          "count": F.count, "nd": F.count_distinct, "approx_nd": F.approx_count_distinct}


def column_summary(df: DataFrame, spec: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row of ``stat_column`` values, e.g. ``{"fare": ["min", "max", "avg"]}``.

    Each exact ``nd`` adds one copy of the rows (Spark's Expand); use
    ``approx_nd`` when many distinct counts share a job.
    """
    return df.agg(*[_STATS[s](c).alias(f"{s}_{c}") for c, stats in spec.items() for s in stats])


# --------------------------------------------------------------------------- conformance rules

def rule_fails(rules: Mapping[str, Column], null_is_fail: bool = True) -> dict[str, Column]:
    """Per rule, a non-NULL boolean "this row breaks it".

    A rule Column says when a row *passes*.  A NULL verdict (a NULL input)
    counts as a failure by default; ``null_is_fail=False`` ignores it.
    """
    return {n: ~F.coalesce(c, F.lit(not null_is_fail)) for n, c in rules.items()}


def any_fail(rules: Mapping[str, Column], null_is_fail: bool = True) -> Column:
    fails = list(rule_fails(rules, null_is_fail).values())
    out = fails[0]
    for f in fails[1:]:
        out = out | f
    return out


def rule_report(df: DataFrame, rules: Mapping[str, Column], by: Sequence[str] = (),
                null_is_fail: bool = True, digits: int = 3) -> DataFrame:
    """Rows breaking any rule per group: (by..., violations, rows, pct)."""
    bad = any_fail(rules, null_is_fail)
    return df.groupBy(*by).agg(F.count(F.when(bad, 1)).alias("violations"),
                               F.count(F.lit(1)).alias("rows")) \
        .withColumn("pct", F.round(100.0 * F.col("violations") / F.col("rows"), digits))


def rule_breakdown(df: DataFrame, rules: Mapping[str, Column], by: Sequence[str] = (),
                   null_is_fail: bool = True) -> DataFrame:
    """Failures per rule per group: (by..., rule, failures), one scan."""
    fails = rule_fails(rules, null_is_fail)
    wide = df.groupBy(*by).agg(*[F.count(F.when(f, 1)).alias(n) for n, f in fails.items()])
    return wide.unpivot(list(by), list(fails), "rule", "failures")


def conform(df: DataFrame, rules: Mapping[str, Column], skip: Sequence[str] = ()) -> DataFrame:
    """Rows that pass every rule (a NULL verdict does not pass).

    ``skip`` leaves named rules out, e.g. to reproduce a load filter that
    forgot one of the report's rules.
    """
    cond = None
    for name, c in rules.items():
        if name in skip:
            continue
        cond = c if cond is None else cond & c
    return df if cond is None else df.where(cond)


def period_audit(df: DataFrame, ts: str, name: str = "n") -> DataFrame:
    """Rows per (year, month) of ``ts`` to spot dates outside the expected span."""
    return df.groupBy(F.year(ts).alias("year"), F.month(ts).alias("month")) \
        .agg(F.count(F.lit(1)).alias(name))


# --------------------------------------------------------------------------- repair

def impute_const(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.fillna(dict(values))


def impute_mean(df: DataFrame, cols: Sequence[str], fit: DataFrame | None = None) -> DataFrame:
    """NULL -> column mean.  ``fit`` gives the rows the means come from (e.g. the train split).

    The means are scalar subqueries; Spark merges them into one aggregate.
    """
    src = fit if fit is not None else df
    return df.select(*[F.coalesce(F.col(c), src.agg(F.avg(c)).scalar()).alias(c) if c in cols
                       else F.col(c) for c in df.columns])


def mode_value(df: DataFrame, col: str, invalid: Sequence = ()) -> Column:
    """Most frequent valid value (smallest on a tie) as a scalar subquery."""
    counts = df.where(~F.col(col).isin(*invalid) if invalid else F.col(col).isNotNull()) \
        .where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    return counts.orderBy(F.desc("_n"), F.asc(col)).limit(1).select(col).scalar()


def impute_mode(df: DataFrame, col: str, invalid: Sequence) -> DataFrame:
    """Replace invalid codes by the most frequent valid code."""
    mode = mode_value(df, col, invalid)
    return df.withColumn(col, F.when(F.col(col).isin(*invalid), mode).otherwise(F.col(col)))


# A "0" typed for the letters "na" inside a word, but not a real zero
# such as the one in "2.0" (the zero must touch a letter).
ZERO_IN_WORD = (r"(?<=[A-Za-z])0|0(?=[A-Za-z])", "na")


def recode(df: DataFrame, col: str, mapping: Mapping[str, str] | None = None,
           patterns: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Fix spellings: whole-value dictionary (a literal map, no join) then regex rules."""
    c = F.col(col)
    if mapping:
        m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
        c = F.coalesce(m[c], c)
    for pat, rep in patterns:
        c = F.regexp_replace(c, pat, rep)
    return df.withColumn(col, c)
