"""Row filters that need more than one predicate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require(df: DataFrame, *cols: str) -> DataFrame:
    """Keep rows with a value in every listed column."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
    return df.where(cond)


def missing(df: DataFrame, col: str, name: str = "n_missing") -> DataFrame:
    """Count of rows without a value in ``col`` (one row)."""
    return df.agg(F.count(F.when(F.col(col).isNull(), 1)).alias(name))


def cap_at_quantile(df: DataFrame, col: str, p: float | None = None, cutoff: float | None = None,
                    method: str = "sort", accuracy: int = 1_000_000) -> DataFrame:
    """Keep rows at or under the ``p`` quantile of ``col`` (or a literal cut-off).

    The cut-off is a scalar subquery computed once.  ``sort`` or ``exact``:
    type-7 quantile by rank selection (any number of distinct values); ``approx``: the bounded-memory sketch.
    """
    if cutoff is not None:
        return df.where(F.col(col) <= F.lit(cutoff))
    if method in ("sort", "exact"):
        from quarry.operators.aggregate import quantiles_sorted
        q = quantiles_sorted(df, col, [p]).select("value").scalar()
    else:
        q = df.agg(F.percentile_approx(col, p, accuracy)).scalar()
    return df.where(F.col(col) <= q)


def out_of_order(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows whose end comes before their start."""
    return df.where(F.col(start) > F.col(end))
