"""Empty input => empty (or all-NULL one-row) output for every operator, and
required-column guards fail at plan time."""

import pytest

from epiframe.operators import aggregates as agg
from epiframe.operators import cluster as km
from epiframe.operators import filters as flt
from epiframe.operators import forecast as fc
from epiframe.operators import profile as pf
from epiframe.operators import regression as rg
from epiframe.operators import waves as wv
from epiframe.plans import charts
from epiframe.plans.enrichment import enrich, unmatched_countries
from epiframe.schemas import ENRICHED
from epiframe.sources.files import mapping_keys

PANEL = "country_region string, date date, cases long, deaths long, cases_since_prev_day long, population long"


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], PANEL)


@pytest.fixture(scope="module")
def empty_enriched(spark):
    return spark.createDataFrame([], ENRICHED)


@pytest.mark.parametrize("op", [
    agg.country_totals, agg.country_totals_positive, agg.rows_per_entity, agg.value_stats,
    agg.value_stats_active, agg.daily_sum, agg.daily_sum_active, agg.top_deaths,
    lambda d: agg.country_totals_for(d, "x"), lambda d: agg.daily_sum_window(d, "2020-01-01", "2020-02-01"),
    lambda d: flt.select_entities(d, ["a"]), flt.active_rows, wv.direction_class, wv.waves,
    lambda d: fc.forecast(fc.history(d), 7), lambda d: fc.future_dates(fc.history(d), 7),
    lambda d: fc.history(d, "x"), lambda d: pf.top_values(d, ["country_region"]),
    lambda d: pf.histogram(d, ["cases"]), pf.missing,
])
def test_panel_operators_empty(empty, op):
    assert op(empty).count() == 0 or op(empty).count() == len(empty.columns)


def test_one_row_aggregates_on_empty(empty):
    assert agg.row_count(empty).first().total_rows == 0
    assert agg.date_range(empty).first().start_date is None
    assert agg.completeness(empty, ["cases"]).first().cases_not_null == 0
    assert pf.overview(empty).first().n_rows == 0
    assert {r.n for r in pf.numeric_summary(empty, ["cases", "deaths"]).collect()} == {0}


def test_enriched_consumers_empty(spark, empty, empty_enriched):
    dim = spark.createDataFrame([], "country string, continent string, population_2020 long, area_km2 long")
    m = mapping_keys(spark.createDataFrame([], "source_name string, target_name string"))
    assert enrich(empty, dim, m).count() == 0 and unmatched_countries(empty, dim, m).count() == 0
    assert charts.cases_vs_deaths(empty_enriched).count() == 0
    assert charts.cfr_top(empty_enriched).count() == 0
    assert charts.density_curve(empty_enriched).count() == 0
    fit = rg.fit_loglog(empty_enriched).first()
    assert fit.slope is None and fit.n == 0
    assert agg.axis_bound(empty_enriched, "cfr_pct").first()[0] == 1.0
    labels, centres = km.lloyd(km.features(spark.createDataFrame([], "country_region string, total_cases long, total_deaths long")))
    assert labels.count() == 0 and centres == []


def test_guards(spark, empty):
    with pytest.raises(ValueError, match="missing required column"):
        wv.waves(empty.drop("cases_since_prev_day"))
    with pytest.raises(ValueError, match="missing required column"):
        fc.forecast(empty)
