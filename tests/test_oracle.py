"""Every registered query: oracle pairs must match DuckDB at sf0.01; the rest must run."""

import importlib
import os
import sys

import pytest

from quarry.plans.oracle import compare, duck_connect
from quarry.plans.registry import load_all

from paths import SF_CHECK, SF_SMALL

REG = load_all()
WITH_SQL = sorted(n for n, q in REG.items() if q.sql)
# model fits are exercised on planted data in test_models; here only the cheap ones run
ROWS_ONLY = sorted(n for n, q in REG.items() if not q.sql and n not in
                   {"ml_grid_cv", "ml_linear_svm_multi", "ml_rff_svm"})


@pytest.fixture(scope="module")
def duck():
    return duck_connect(SF_CHECK)


@pytest.mark.parametrize("name", WITH_SQL)
def test_oracle(spark, duck, name):
    res = compare(REG[name].build(spark, SF_CHECK), duck, REG[name].sql)
    assert res["schema_ok"] and res["rows_ok"] and res["values_ok"], res


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_runs(spark, name):
    assert REG[name].build(spark, SF_SMALL).count() >= 0


def test_entry_contract(spark):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    entry = importlib.import_module("__spark_entry__")
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["c_name", "sum_qty"]
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 100
