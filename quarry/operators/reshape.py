"""Wide <-> long reshaping and row-wise stats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def melt_flags(df: DataFrame, ids: Sequence[str], cols: Sequence[str],
               name: str = "name", value: str = "value", keep_zero: bool = False) -> DataFrame:
    """Gather ``cols`` to (name, value) rows, dropping zero (and NULL) values."""
    long = df.unpivot(list(ids), list(cols), name, value)
    return long if keep_zero else long.where(F.col(value) != 0)


def spread_wide(df: DataFrame, by: Sequence[str], col: str, values: Sequence,
                agg: Column, fill=None) -> DataFrame:
    """One column per category.  ``values`` is given so Spark skips the distinct scan."""
    out = df.groupBy(*by).pivot(col, list(values)).agg(agg)
    return out.fillna(fill) if fill is not None else out


def row_mean(df: DataFrame, id_cols: Sequence[str], cols: Sequence[str], name: str = "row_mean") -> DataFrame:
    """Mean over many columns of each row, NULLs skipped, computed in-row (no shuffle)."""
    arr = F.filter(F.array(*[F.col(c).cast("double") for c in cols]), lambda x: x.isNotNull())
    total = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)
    return df.select(*id_cols, F.when(F.size(arr) > 0, total / F.size(arr)).alias(name))


def row_null_count(df: DataFrame, id_cols: Sequence[str], cols: Sequence[str],
                   name: str = "n_null") -> DataFrame:
    """Number of NULL cells among ``cols`` per row, keyed by id (not by row position)."""
    total = None
    for c in cols:
        term = F.when(F.col(c).isNull(), 1).otherwise(0)
        total = term if total is None else total + term
    return df.select(*id_cols, total.alias(name))


def split_into(df: DataFrame, col: str, names: Sequence[str], sep: str) -> DataFrame:
    """One delimited string column into several (missing parts are NULL)."""
    import re
    parts = F.split(F.col(col), re.escape(sep))
    return df.select("*", *[F.get(parts, i).alias(n) for i, n in enumerate(names)])
