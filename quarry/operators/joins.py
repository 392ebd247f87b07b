"""Joins and set operations (§2.9).

Broadcast policy: an explicit ``broadcast()`` hint is only put on tables
whose size is bounded by construction (a fixed code list, a top-k result,
region/nation-sized dimensions the caller marks ``bounded=True``).  Every
other join is left to Catalyst + AQE, which measures the real size at
run time and turns the join into a broadcast only below
``spark.sql.autoBroadcastJoinThreshold``; above it a shuffle join runs and
AQE's skew-join splits a hot key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def bounded(df: DataFrame) -> DataFrame:
    """A table that is small by construction; its measured size decides on a broadcast at run time."""
    return df


def _cond(left: DataFrame, right: DataFrame, lk: str, rk: str):
    return lk if lk == rk else left[lk] == right[rk]


def star_join(fact: DataFrame, dims: Sequence[tuple], how: str = "inner") -> DataFrame:
    """Join a fact table to dimensions.

    ``dims`` holds ``(dim, fact_key, dim_key)`` or ``(dim, fact_key, dim_key, bounded)``.
    Filter the dimensions before passing them in: Catalyst keeps the
    filters at the scan and the runtime bloom filter prunes the fact side.
    """
    out = fact
    for spec in dims:
        dim, fk, pk = spec[:3]
        if len(spec) > 3 and spec[3]:
            dim = bounded(dim)
        out = out.join(dim, _cond(out, dim, fk, pk), how)
    return out


def join_all(dfs: Sequence[DataFrame], key: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Chain of joins that all share one key (one hash partitioning is reused)."""
    keys = [key] if isinstance(key, str) else list(key)
    return reduce(lambda a, b: a.join(b, keys, how), dfs)


def left_lookup(df: DataFrame, dim: DataFrame, left_key: str, right_key: str,
                keep_right_key: bool = False) -> DataFrame:
    """Left outer join whose key names differ; the right key is dropped."""
    out = df.join(dim, df[left_key] == dim[right_key], "left")
    return out if keep_right_key or left_key == right_key else out.drop(dim[right_key])


def natural_join(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Join on every column name the two frames share."""
    common = [c for c in a.columns if c in set(b.columns)]
    if not common:
        raise ValueError("no common columns")
    return a.join(b, common, how)


def with_group_totals(df: DataFrame, by: Sequence[str], aggs: dict[str, Column],
                      method: str = "join") -> DataFrame:
    """Attach group aggregates to each detail row.

    ``join`` (default): partial aggregation, then a NULL-safe join of one row
    per group back to the detail rows; a hot group is split by AQE's skew
    join instead of landing whole in one window task.  ``window``: a
    ``partitionBy`` window, one pass, fine when no group is large.
    """
    if method == "window":
        w = Window.partitionBy(*by)
        return df.select("*", *[agg.over(w).alias(name) for name, agg in aggs.items()])
    totals = df.groupBy(*by).agg(*[agg.alias(name) for name, agg in aggs.items()])
    t = totals.select(*[F.col(k).alias(f"_g_{k}") for k in by], *aggs)
    cond = None
    for k in by:
        c = df[k].eqNullSafe(t[f"_g_{k}"])
        cond = c if cond is None else cond & c
    return df.join(t, cond, "left").drop(*[f"_g_{k}" for k in by])


def keys_missing(a: DataFrame, b: DataFrame, key_a: str, key_b: str | None = None,
                 name: str = "key") -> DataFrame:
    """Distinct keys of ``a`` that ``b`` lacks (NULL keys never match)."""
    key_b = key_b or key_a
    ka = a.select(F.col(key_a).alias(name)).distinct()
    kb = b.select(F.col(key_b).alias(name))
    return ka.join(kb, name, "left_anti")


def bind_columns(a: DataFrame, b: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Put the columns of two frames side by side, aligned by key, not by position."""
    return a.join(b, on, "inner")


def apply_rate(df: DataFrame, rates: DataFrame, on: Sequence[str], qty: str, rate: str,
               out: str, rates_bounded: bool = True) -> DataFrame:
    """Attach a rate per code and derive ``qty * rate``.  A rate card is a fixed code list."""
    r = bounded(rates) if rates_bounded else rates
    return df.join(r, list(on), "left").withColumn(out, F.col(qty) * F.col(rate))


# --------------------------------------------------------------------------- set operations

def union_all(*dfs: DataFrame, allow_missing: bool = False) -> DataFrame:
    """Stack frames by column name, duplicates kept."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), dfs)


def except_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    """EXCEPT DISTINCT: NULL equals NULL here, unlike an anti join."""
    return a.subtract(b)


def distinct_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return (df.select(*cols) if cols else df).distinct()
