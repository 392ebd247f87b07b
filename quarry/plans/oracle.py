"""Side-by-side check of a Spark query and its DuckDB oracle text.

Used by the tests and by ``tools/oracle_check.py``.  Comparison is by
column names (sorted), row count and an order-insensitive multiset of
normalised rows.  Floats are compared exactly by default (every pair
matches bit for bit); ``digits`` rounds them first when wanted.
"""

from __future__ import annotations

import math
from datetime import date, datetime
from decimal import Decimal

from quarry.sources.tables import TABLES


def duck_connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, digits: int | None = None):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if math.isinf(v):
            return "inf" if v > 0 else "-inf"
        if digits is None:  # exact: the bit pattern must agree
            return repr(v)
        r = round(v, digits)
        return int(r) if r == int(r) and abs(r) < 1e15 else r
    if isinstance(v, Decimal):
        return _norm(float(v), digits)
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, int):
        return v
    if isinstance(v, (datetime, date)):
        return v.isoformat(sep=" ") if isinstance(v, datetime) else v.isoformat()
    if hasattr(v, "item"):  # numpy scalar
        return _norm(v.item(), digits)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    return str(v)


def _rows(cols, records, digits=None):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i], digits) for i in order) for r in records]
    return sorted(out, key=repr)


def compare(spark_df, con, sql: str, digits: int | None = None) -> dict:
    """``digits=None`` compares floats exactly; an int rounds them first."""
    s_cols = list(spark_df.columns)
    s_rows = [tuple(r) for r in spark_df.collect()]
    rel = con.execute(sql)
    d_cols = [d[0] for d in rel.description]
    d_rows = rel.fetchall()
    res = {"spark_rows": len(s_rows), "oracle_rows": len(d_rows),
           "schema_ok": sorted(s_cols) == sorted(d_cols),
           "rows_ok": len(s_rows) == len(d_rows)}
    if not res["schema_ok"]:
        res["spark_cols"], res["oracle_cols"] = sorted(s_cols), sorted(d_cols)
        res["values_ok"] = False
        return res
    a, b = _rows(s_cols, s_rows, digits), _rows(d_cols, d_rows, digits)
    res["values_ok"] = a == b
    if not res["values_ok"]:
        sa, sb = set(a), set(b)
        res["only_spark"] = [r for r in a if r not in sb][:3]
        res["only_oracle"] = [r for r in b if r not in sa][:3]
    return res
