"""The level-2 forecast from sums against fits from the rows themselves."""

import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from epiframe.operators import forecast as fc

BASE = dt.date(2020, 2, 3)
SCHEMA = "country_region string, ds date, y double"


def design(days, span, k, reach, weekly, yearly):
    """The terms of every row: 1, t, changepoints, weekly, yearly."""
    t = np.asarray(days, float) / span
    cols = [np.ones_like(t), t] + [np.maximum(t - reach * j / (k + 1), 0) for j in range(1, k + 1)]
    for on, period, order in ((weekly, 7.0, 3), (yearly, 365.25, 10)):
        if on:
            cols += [np.sin(2 * np.pi * j * np.asarray(days) / period) for j in range(1, order + 1)]
            cols += [np.cos(2 * np.pi * j * np.asarray(days) / period) for j in range(1, order + 1)]
    return np.column_stack(cols)


def objective(x, y, beta, k, penalty, ridge):
    return ((y - x @ beta) ** 2).sum() / 2 + penalty * np.abs(beta[2:2 + k]).sum() + ridge / 2 * (beta[2 + k:] ** 2).sum()


def brute(x, y, k, penalty, ridge):
    """Every choice of signs of the slope changes, the best that keeps them."""
    best = None
    for signs in itertools.product((-1, 0, 1), repeat=k):
        keep = [i for i in range(x.shape[1]) if not 2 <= i < 2 + k or signs[i - 2]]
        lift = np.array([penalty * signs[i - 2] if 2 <= i < 2 + k else 0.0 for i in keep])
        damp = np.diag([ridge if i >= 2 + k else 0.0 for i in keep])
        beta = np.zeros(x.shape[1])
        beta[keep] = np.linalg.lstsq(x[:, keep].T @ x[:, keep] + damp, x[:, keep].T @ y - lift, rcond=None)[0]
        if all(beta[2 + j] * s >= 0 for j, s in enumerate(signs)):
            value = objective(x, y, beta, k, penalty, ridge)
            if best is None or value < best[0] - 1e-15:
                best = (value, beta)
    return best


def series(n, seed, gaps=True):
    rng = np.random.default_rng(seed)
    days = np.sort(rng.choice(int(n * 1.4), n, replace=False)) if gaps else np.arange(n)
    days = days - days[0]
    y = np.where(days < days[-1] * 0.4, 2.0 * days, 0.8 * days[-1] - 1.0 * (days - days[-1] * 0.4)) + np.array([0, 3, 1, 0, -2, -1, -1])[days % 7]
    return days, y + rng.normal(0, 2, n)


def rows_of(name, days, y):
    return [(name, BASE + dt.timedelta(days=int(d)), float(v)) for d, v in zip(days, y)]


@pytest.mark.parametrize("n,k,weekly,yearly", [(40, 4, "off", "off"), (60, 5, "on", "off"), (500, 3, "on", "on"), (4, 25, "off", "off")])
def test_fit_equals_a_brute_force_solve_over_the_rows(spark, n, k, weekly, yearly):
    days, y = series(n, n)
    hist = spark.createDataFrame(rows_of("A", days, y), SCHEMA).repartition(4)
    fit = fc.changepoint_fits(hist, n_changepoints=k, changepoint_penalty=0.05, weekly=weekly, yearly=yearly).first()
    k = min(k, n - 2)
    span, scale = float(days[-1]), max(np.abs(y).max(), 1.0)
    x = design(days, span, k, 0.8, weekly == "on", yearly == "on")
    best, want = brute(x, y / scale, k, 0.05, 0.1)
    yhat = x @ want * scale
    got = np.concatenate([[fit.level, fit.slope], fit.turns])
    assert np.allclose(got, want[:2 + k] * scale, rtol=1e-6, atol=1e-6 * scale)
    out = fc.forecast_changepoints(hist, 5, n_changepoints=k, changepoint_penalty=0.05, weekly=weekly, yearly=yearly).orderBy("ds").collect()
    assert np.allclose([r.yhat for r in out][:n], yhat, rtol=1e-7, atol=1e-6 * scale)
    assert np.isclose(fit.sigma, np.std(y - yhat), rtol=1e-5) and abs(np.sum(y - yhat)) < 1e-6 * scale
    drift = 2 * np.abs(want[2:2 + k] * scale).mean() ** 2 * k / 0.8 / 3
    last = out[-1]
    assert np.isclose(last.yhat_upper - last.yhat, fc.Z80 * np.sqrt(fit.sigma ** 2 + drift * (5 / span) ** 3), rtol=1e-6)


def test_lasso_equals_all_sign_patterns_also_where_terms_are_nearly_equal():
    rng = np.random.default_rng(2)
    for trial in range(40):
        x = rng.normal(0, 1, (30, 6))
        x[:, 1] = x[:, 0] + 1e-3 * rng.normal(0, 1, 30)
        y = x @ np.array([2, 0, -1, 0, 0, 0.2]) + rng.normal(0, 0.3, 30)
        penalty = [0.01, 0.5, 5.0, 500.0][trial % 4]
        s, g = x.T @ x, x.T @ y
        got = fc.lasso(s, g, penalty)
        value = lambda b: b @ s @ b / 2 - g @ b + penalty * np.abs(b).sum()
        wants = []
        for signs in itertools.product((-1, 0, 1), repeat=6):
            on = np.flatnonzero(signs)
            b = np.zeros(6)
            b[on] = np.linalg.solve(s[np.ix_(on, on)], g[on] - penalty * np.array(signs)[on])
            if all(b[i] * signs[i] >= 0 for i in on):
                wants.append(value(b))
        assert value(got) <= min(wants) + 1e-9 * (1 + abs(min(wants)))


def test_a_series_split_over_tasks_gives_the_same_fit(spark):
    a, b = series(800, 5), series(30, 6)
    rows = rows_of("A", *a) + rows_of("B", *b) + [("one", BASE, 3.0)]
    fits = []
    for parts in (1, 16):
        df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
        fits.append({r.country_region: r for r in fc.changepoint_fits(df).collect()})
    assert set(fits[0]) == set(fits[1]) == {"A", "B"}
    for name in fits[0]:
        x, y = fits[0][name], fits[1][name]
        assert np.allclose([x.level, x.slope, x.sigma, *x.turns, *x.week, *x.year], [y.level, y.slope, y.sigma, *y.turns, *y.week, *y.year], rtol=1e-6, atol=1e-6)
    assert any(fits[0]["A"].year) and not any(fits[0]["B"].year)


def test_python_sees_sums_only_and_a_hot_series_is_added_up_before_the_shuffle(spark):
    hist = spark.range(0, 30_000, 1, 4).select(F.lit("hot").alias("country_region"), F.date_add(F.lit("1950-01-01"), F.col("id").cast("int")).alias("ds"),
                                               F.sin(F.col("id") / 500.0).alias("y"))
    sums = fc.fit_sums(hist)
    assert sums.count() == 26 * 7 and sums.agg(F.sum("n")).first()[0] == 30_000
    plan = fc.changepoint_fits(hist)._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    python = next(i for i, x in enumerate(lines) if "FlatMapGroupsInPandas" in x)
    assert sum("HashAggregate" in x and "partial_sum" in x for x in lines[python:]) >= 1


def test_slopes_that_change_widen_the_band_and_straight_lines_do_not(spark):
    line = [("L", BASE + dt.timedelta(days=i), 2.0 * i + (i % 2) * 0.1) for i in range(50)]
    days, y = series(60, 1, gaps=False)
    out = fc.forecast_changepoints(spark.createDataFrame(line + rows_of("K", days, y), SCHEMA), 20).orderBy("ds").collect()
    width = {c: [r.yhat_upper - r.yhat_lower for r in out if r.country_region == c and r.is_future] for c in "LK"}
    assert width["K"][-1] > 1.5 * width["K"][0] and width["L"][-1] < 1.2 * width["L"][0]
