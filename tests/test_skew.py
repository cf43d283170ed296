"""One key holding a third of all rows: results stay whole and exact, and
the plans reduce the hot key map-side before anything is shuffled."""

import datetime as dt

from pyspark.sql import functions as F

from epiframe.operators import aggregates as agg
from epiframe.plans.enrichment import enrich
from epiframe.sources.files import mapping_keys

DDL = "country_region string, date date, cases long, deaths long, cases_since_prev_day long, population long"


def _skewed(spark, n=3000):
    base = dt.date(2020, 1, 1)
    # every third row belongs to HOT; dates repeat so (entity, date) is not unique
    # here on purpose: these operators do not need it
    rows = [("HOT" if i % 3 == 0 else f"c{i % 97}", base + dt.timedelta(days=i % 50), 1, i % 2, None, None)
            for i in range(n)]
    return spark.createDataFrame(rows, DDL).repartition(6)


def test_hot_key_totals_exact_and_partial(spark):
    df = _skewed(spark)
    totals = agg.country_totals(df)
    got = {r.country_region: r.total_cases for r in totals.collect()}
    assert got["HOT"] == 1000 and sum(got.values()) == 3000
    plan = totals._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan            # map-side combine before the exchange


def test_hot_key_through_enrichment(spark):
    df = _skewed(spark)
    dim = spark.createDataFrame([("hot", "X", 100, 10)], "country string, continent string, population_2020 long, area_km2 long")
    m = mapping_keys(spark.createDataFrame([], "source_name string, target_name string"))
    r = enrich(df, dim, m).first()
    assert (r.country_region, r.total_cases, r.cases_per_km2) == ("HOT", 1000, 100.0)


def test_hot_key_top_k_and_counts(spark):
    df = _skewed(spark)
    assert agg.top_deaths(df, 1).first().country_region == "HOT"
    assert agg.rows_per_entity(df).first().total_records == 1000
    assert agg.with_count(df.filter(F.col("country_region") == "HOT")).first()["count"] == 1000
