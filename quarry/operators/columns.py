"""Schema and column shaping.

Operators that decide *which* columns to keep from the data
(``drop_all_null`` and friends) run one aggregate job that returns one
row of counts; only that row reaches the driver.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.joins import union_all


def clean_name(name: str) -> str:
    """Trim, blanks to ``_``, drop ``?``."""
    return re.sub(r"\s+", "_", name.strip()).replace("?", "")


def clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[clean_name(c) for c in df.columns])


def _one_row(df: DataFrame, aggs) -> dict:
    return df.agg(*aggs).first().asDict()


def all_null_columns(df: DataFrame) -> list[str]:
    counts = _one_row(df, [F.count(F.col(c)).alias(c) for c in df.columns])
    return [c for c in df.columns if counts[c] == 0]


def drop_all_null(df: DataFrame) -> DataFrame:
    """Drop columns that hold no value at all."""
    return df.drop(*all_null_columns(df))


def all_zero_columns(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    num = cols or [f.name for f in df.schema.fields
                   if f.dataType.typeName() in ("integer", "long", "double", "float", "short", "decimal")]
    if not num:
        return []
    counts = _one_row(df, [F.count(F.when(F.col(c) != 0, 1)).alias(c) for c in num])
    return [c for c in num if counts[c] == 0]


def drop_all_zero(df: DataFrame) -> DataFrame:
    """Drop numeric columns with no non-zero value (NULL is not zero)."""
    return df.drop(*all_zero_columns(df))


def constant_columns(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    """Columns with a single value: min = max and no NULL next to a value."""
    cols = list(cols or df.columns)
    aggs = []
    for c in cols:
        aggs += [F.min(c).alias(f"{c}__min"), F.max(c).alias(f"{c}__max"),
                 F.count(c).alias(f"{c}__n")]
    aggs.append(F.count(F.lit(1)).alias("__rows"))
    r = _one_row(df, aggs)
    out = []
    for c in cols:
        n = r[f"{c}__n"]
        if n == 0 or (r[f"{c}__min"] == r[f"{c}__max"] and n == r["__rows"]):
            out.append(c)
    return out


def constant_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, n_values, is_constant) for many columns in one aggregate pass.

    A column is constant when it holds no value at all, or one value in
    every row (min = max, no NULL).  min/max/count need no distinct-count
    expansion, so the pass costs the same for 3 or 300 columns.
    """
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(cols):
        aggs += [F.count(c).alias(f"n{i}"), (F.min(c) == F.max(c)).alias(f"same{i}")]
    wide = df.agg(*aggs)
    structs = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n_values"),
                        ((F.col(f"n{i}") == 0) | (F.col(f"same{i}") & (F.col(f"n{i}") == F.col("__rows"))))
                        .alias("is_constant")) for i, c in enumerate(cols)]
    return wide.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def drop_constant(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.drop(*constant_columns(df, cols))


def add_literal(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def rename(df: DataFrame, mapping: Mapping[str | int, str]) -> DataFrame:
    """Rename by name or by 0-based position."""
    names = list(df.columns)
    for k, v in mapping.items():
        idx = k if isinstance(k, int) else names.index(k)
        names[idx] = v
    return df.toDF(*names)


def union_years(frames: Mapping[int, DataFrame], fill: bool = False,
                year_col: str = "year") -> DataFrame:
    """Stack yearly tables with differing columns.

    ``fill=False`` keeps the columns every year has; ``fill=True`` keeps all
    and fills the missing ones with NULL.
    """
    tagged = [df.withColumn(year_col, F.lit(y)) for y, df in frames.items()]
    if fill:
        return union_all(*tagged, allow_missing=True)
    common = [c for c in tagged[0].columns if all(c in d.columns for d in tagged[1:])]
    return union_all(*[d.select(*common) for d in tagged])


def value_domain(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct levels of categorical columns: (column, value), one job via unpivot."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]) \
        .unpivot([], list(cols), "column", "value")
    return long.distinct()


def map_strings(df: DataFrame, fn, cols: Sequence[str] | None = None) -> DataFrame:
    """Apply a Column function (``F.lower``, ``F.upper``...) to some or all string columns."""
    cols = set(cols or [f.name for f in df.schema.fields if f.dataType.typeName() == "string"])
    return df.select(*[fn(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])
