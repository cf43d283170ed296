"""Plan shapes the design relies on (checked on the registered queries)."""

import pytest

from __spark_entry__ import queries
from tests.conftest import SF_SMALL


def _plan(spark, name, execute=False):
    df = queries()[name](spark, SF_SMALL)
    if execute:
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["country_totals", "enrich_countries", "forecast_all"])
def test_unused_lag_window_is_pruned(spark, name):
    assert "lag(cases" not in _plan(spark, name)


def test_forecast_is_one_pass(spark):
    plan = _plan(spark, "forecast_all")
    assert "Union" not in plan and plan.count("FileScan parquet") == 3   # orders, customer, nation once


def test_top_k_plans(spark):
    assert "TakeOrderedAndProject" in _plan(spark, "top_deaths")
    plan = _plan(spark, "profile_top_values")
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_top_values_reads_its_stored_counts(spark):
    """The counts are made once and stored: neither branch computes the panel again."""
    final = _plan(spark, "profile_top_values", execute=True).split("== Initial Plan ==")[0]
    assert "ReadSchema: struct<_k:int,value:string,freq:bigint>" in final and "o_custkey" not in final


def test_panel_preaggregates_orders_before_the_join(spark):
    plan = _plan(spark, "country_totals")
    join_at = plan.index("Join")
    # the (customer, day) partial aggregate sits below (after, in the text) the join
    assert "partial_count(1)" in plan[join_at:]
