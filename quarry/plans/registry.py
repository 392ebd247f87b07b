"""Named queries: a Spark builder and, where SQL can say it, an oracle SQL text.

Each builder takes ``(spark, sf_dir)`` and returns a DataFrame over the driver tables.  Some run jobs
while building: model fits, checkpoints, scratch files, and plans that need column contents or levels.  The SQL is written separately, for DuckDB, over
the same tables; computed columns carry the same names on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class NamedQuery:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    section: str


REGISTRY: dict[str, NamedQuery] = {}


def query(name: str, sql: str | None = None, section: str = ""):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = NamedQuery(name, fn, sql, section)
        return fn
    return deco


def load_all() -> dict[str, NamedQuery]:
    # importing the modules fills the registry
    from quarry.plans import (q_aggregate, q_columns, q_features, q_filters,  # noqa: F401
                              q_joins, q_quality, q_scalars, q_series, q_sources,
                              q_windows, q_composites, q_models)
    return REGISTRY
