"""The driver contract: every registered query runs on the smallest tables
and matches its DuckDB oracle (row count, column names, order-insensitive
values)."""

import datetime as dt
import decimal
import math
import sys

import duckdb
import pytest

import __spark_entry__
from __spark_entry__ import entry
from epiframe.oracles import ORACLES
from epiframe.queries import QUERIES
from tests.conftest import SF_SMALL

TABLES = ["region", "nation", "customer", "supplier", "orders", "events", "conversations"]


def _canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 5)
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_canon(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0 and "cases_per_million" in df.columns


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_registry_without_the_training_data_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(__spark_entry__.queries()) == set(QUERIES)
    assert set(__spark_entry__.oracle_sql()) == set(ORACLES)


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "date": "DATE", "boolean": "BOOLEAN"}

# The only query allowed to run Python in tasks (a per-entity numpy fit).
PYTHON_ALLOWED = {"forecast_changepoints"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    plan = sdf._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    if name not in PYTHON_ALLOWED:
        assert not any(n in plan for n in ("BatchEvalPython", "ArrowEvalPython", "InPandas"))
    rel = duck.sql(ORACLES[name])
    dcols, dtypes = rel.columns, [str(t) for t in rel.types]
    assert sorted(sdf.columns) == sorted(dcols)
    spark_types = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
                   for f in sdf.schema.fields}
    assert spark_types == dict(zip(dcols, dtypes))
    assert _rows(sdf.columns, srows) == _rows(dcols, rel.fetchall())
