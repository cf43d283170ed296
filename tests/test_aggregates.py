import datetime as dt

from epiframe.operators import aggregates as agg
from epiframe.operators import filters as flt

DDL = "country_region string, date date, cases long, deaths long, cases_since_prev_day long, population long"


def _df(spark, rows):
    return spark.createDataFrame(rows, DDL)


def _rows(spark):
    d = dt.date
    return _df(spark, [
        ("A", d(2020, 1, 1), 5, None, None, 10), ("A", d(2020, 1, 2), 7, None, 2, 10),
        ("B", d(2020, 1, 1), 3, 4, -1, None), ("B", d(2020, 1, 3), 3, 6, 0, None),
        ("C", d(2020, 1, 2), 1, 10, 5, 3), ("D", d(2020, 1, 2), 1, 10, 7, 3),
    ])


def test_totals_keep_all_null_groups_null(spark):
    out = {r.country_region: (r.total_cases, r.total_deaths) for r in agg.country_totals(_rows(spark)).collect()}
    assert out == {"A": (12, None), "B": (6, 10), "C": (1, 10), "D": (1, 10)}


def test_top_k_ties_break_by_entity_and_nulls_last(spark):
    top = [r.country_region for r in agg.top_deaths(_rows(spark), 3).collect()]
    assert top == ["B", "C", "D"]
    assert [r.country_region for r in agg.top_deaths(_rows(spark), 10).collect()][-1] == "A"


def test_active_and_window(spark):
    active = flt.active_rows(_rows(spark))
    assert sorted(r.cases_since_prev_day for r in active.collect()) == [2, 5, 7]
    win = agg.daily_sum_window(_rows(spark), "2020-01-02", "2020-01-02").collect()
    assert [(r.date, r.total_new_cases) for r in win] == [(dt.date(2020, 1, 2), 14)]


def test_stats_all_vs_active_differ(spark):
    full = {r.country_region: r.min_new_cases for r in agg.value_stats(_rows(spark)).collect()}
    act = {r.country_region: r.min_new_cases for r in agg.value_stats_active(_rows(spark)).collect()}
    assert full["B"] == -1 and "B" not in act


def test_completeness_and_range(spark):
    r = agg.completeness(_rows(spark), ["cases", "deaths", "population"]).first()
    assert (r.total_rows, r.cases_not_null, r.deaths_not_null, r.population_not_null) == (6, 6, 4, 4)
    r2 = agg.completeness(_rows(spark), ["cases_not_null=cases_since_prev_day"]).first()
    assert r2.cases_not_null == 5
    dr = agg.date_range(_rows(spark)).first()
    assert (dr.start_date, dr.end_date) == (dt.date(2020, 1, 1), dt.date(2020, 1, 3))


def test_axis_bound_fallback_and_count(spark):
    df = spark.createDataFrame([(None,), (None,)], "c double")
    assert agg.axis_bound(df, "c").first()[0] == 1.0
    df2 = spark.createDataFrame([(2.0,), (None,)], "c double")
    assert abs(agg.axis_bound(df2, "c").first()[0] - 2.4) < 1e-12
    assert [r["count"] for r in agg.with_count(df2).collect()] == [2, 2]
    per = agg.with_count(_rows(spark), per="country_region").collect()
    assert {(r.country_region, r["count"]) for r in per} == {("A", 2), ("B", 2), ("C", 1), ("D", 1)}


def test_selection_empty_means_all(spark):
    assert flt.select_entities(_rows(spark), []).count() == 6
    assert flt.select_entities(_rows(spark), ["A", "C"]).count() == 3


def test_empty_inputs(spark):
    empty = _df(spark, [])
    assert agg.country_totals(empty).count() == 0
    assert agg.row_count(empty).first().total_rows == 0
    assert agg.daily_sum(empty).count() == 0
    assert agg.top_deaths(empty).count() == 0
