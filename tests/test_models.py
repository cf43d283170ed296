import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from epiframe.operators import cluster as km
from epiframe.operators import forecast as fc
from epiframe.operators.regression import fit_loglog, predict_loglog, standardise


def _totals(spark, n=60, seed=3):
    rnd = np.random.default_rng(seed)
    rows = [(f"e{i:03d}", int(rnd.integers(1, 10_000)), int(rnd.integers(0, 500))) for i in range(n)]
    return spark.createDataFrame(rows, "country_region string, total_cases long, total_deaths long")


def test_standardise_population_sd(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    got = [r.x for r in standardise(df, ["x"]).orderBy("x").collect()]
    xs = np.array([1, 2, 3, 4.0])
    assert np.allclose(got, (xs - xs.mean()) / xs.std())
    const = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    assert [r.x for r in standardise(const, ["x"]).collect()] == [0.0, 0.0]


def test_lloyd_invariants_and_partition_independence(spark):
    feats = km.features(_totals(spark))
    labels, centres = km.lloyd(feats, 3, 20)
    rows = labels.collect()
    assert {r.cluster for r in rows} <= {0, 1, 2} and len(centres) == 3
    # canonical: centres ascending by first feature
    assert [c[0] for c in centres] == sorted(c[0] for c in centres)
    # every point is nearest to its own centre
    for r in rows:
        d = [round((r.f0 - a) ** 2 + (r.f1 - b) ** 2, 9) for a, b in centres]
        assert d[r.cluster] == min(d)
    again, _ = km.lloyd(km.features(_totals(spark).repartition(7)), 3, 20)
    assert {r.country_region: r.cluster for r in again.collect()} == {r.country_region: r.cluster for r in rows}


def test_k_bounds_and_few_points(spark):
    feats = km.features(_totals(spark, 2))
    with pytest.raises(ValueError):
        km.lloyd(feats, 11)
    labels, _ = km.lloyd(feats, 3, 5)
    assert labels.count() == 2 and len({r.cluster for r in labels.collect()}) <= 2


def test_seed_ranks():
    assert km.seed_ranks(10, 3) == [1, 5, 8]
    assert km.seed_ranks(1, 2) == [0, 0]


def test_regression_matches_numpy(spark):
    rows = [(10.0, 100.0), (20.0, 400.0), (40.0, 900.0), (80.0, 3000.0), (None, 5.0), (float("inf"), 1.0)]
    df = spark.createDataFrame(rows, "population_density_calc double, cases_per_million double")
    coef = fit_loglog(df).first()
    x = np.log1p([10, 20, 40, 80.0]); y = np.log1p([100, 400, 900, 3000.0])
    b, a = np.polyfit(x, y, 1)
    assert math.isclose(coef.slope, b, rel_tol=1e-9) and math.isclose(coef.intercept, a, rel_tol=1e-9)
    assert coef.n == 4
    fitted = predict_loglog(df, fit_loglog(df)).collect()
    assert math.isclose(fitted[4].fitted, math.expm1(a), rel_tol=1e-9)   # null density -> 0


def test_regression_degenerate(spark):
    one = spark.createDataFrame([(10.0, 100.0)], "population_density_calc double, cases_per_million double")
    assert fit_loglog(one).first().slope is None
    assert predict_loglog(one, fit_loglog(one)).first().fitted is None
    const = spark.createDataFrame([(10.0, 1.0), (10.0, 2.0)], "population_density_calc double, cases_per_million double")
    assert fit_loglog(const).first().slope is None


def test_forecast_invariants(spark):
    base = dt.date(2021, 3, 1)
    rows = [("A", base + dt.timedelta(days=i), float(i % 7 + i * 0.5)) for i in range(40)] + [("B", base, 3.0)]
    hist = spark.createDataFrame(rows, "country_region string, ds date, y double")
    out = fc.forecast(hist, 14)
    fut = out.filter("is_future").groupBy("country_region").count().collect()
    assert {r.country_region: r["count"] for r in fut} == {"A": 14, "B": 14}
    a = out.filter("country_region = 'A'").collect()
    assert all(r.yhat_lower <= r.yhat <= r.yhat_upper for r in a)
    assert all(r.yhat is None for r in out.filter("country_region = 'B'").collect())
    assert out.filter("country_region = 'A' AND NOT is_future").count() == 40
    frame = fc.future_dates(hist, 7)
    assert frame.filter("is_future").count() == 14


def test_history_coercion(spark):
    df = spark.createDataFrame([("A", "2020-01-02", None), ("A", "bad", "3"), ("a ", "2020-01-01", "4")],
                               "country_region string, date string, cases string")
    rows = fc.history(df, "A").orderBy("ds").collect()
    assert [(str(r.ds), r.y) for r in rows] == [("2020-01-01", 4.0), ("2020-01-02", 0.0)]


def test_actuals_overlay_join_and_carried(spark):
    from epiframe.operators.joins import overlay_actuals
    base = dt.date(2021, 3, 1)
    hist = spark.createDataFrame([("A", base + dt.timedelta(days=i), float(i)) for i in range(10)],
                                 "country_region string, ds date, y double")
    joined = overlay_actuals(fc.forecast(hist, 5), hist, ["country_region", "ds"])
    carried = fc.forecast(hist, 5, with_actuals=True)
    key = lambda r: (r.ds, r.y, r.is_future)
    assert sorted(map(key, joined.collect())) == sorted(map(key, carried.collect()))
    assert carried.filter("is_future AND y IS NULL").count() == 5


def test_changepoint_forecast_follows_a_kink(spark):
    base = dt.date(2021, 1, 1)
    # slope 2 for 60 days, then slope -1; plus a weekly pattern
    ys = [(2 * i if i < 60 else 120 - (i - 60)) + [0, 3, 1, 0, -2, -1, -1][i % 7] for i in range(120)]
    rows = [("K", base + dt.timedelta(days=i), float(v)) for i, v in enumerate(ys)] + [("S", base, 5.0)]
    hist = spark.createDataFrame(rows, "country_region string, ds date, y double")
    out = fc.forecast_changepoints(hist, 14).filter("country_region = 'K'").orderBy("ds").collect()
    assert len(out) == 134 and sum(r.is_future for r in out) == 14
    past = [r.yhat for r in out if not r.is_future]
    rmse = (sum((a - b) ** 2 for a, b in zip(past, ys)) / len(ys)) ** 0.5
    assert rmse < 3.0                                                # close fit on both sides of the kink
    fut = [r.yhat for r in out if r.is_future]
    assert fut[-1] < fut[0]                                          # keeps the latest (downward) slope
    assert all(r.yhat_lower <= r.yhat <= r.yhat_upper for r in out)
    single = fc.forecast_changepoints(hist, 3).filter("country_region = 'S'").collect()
    assert len(single) == 4 and all(r.yhat is None for r in single)


def _lloyd_numpy(names, x0, x1, k, rounds):
    """Brute-force reference of the same specification, in numpy."""
    pts = sorted(zip(x0, x1, names))
    n = len(pts)
    centres = [(pts[r][0], pts[r][1]) for r in km.seed_ranks(n, k)]
    f = {nm: (a, b) for a, b, nm in pts}

    def assign(cs):
        out = {}
        for nm, (a, b) in f.items():
            d = [round((a - c0) * (a - c0) + (b - c1) * (b - c1), 9) for c0, c1 in cs]
            out[nm] = d.index(min(d))
        return out
    for _ in range(rounds):
        lab = assign(centres)
        new = []
        for j, c in enumerate(centres):
            mem = [f[nm] for nm, l in lab.items() if l == j]
            new.append((round(sum(m[0] for m in mem) / len(mem), 9), round(sum(m[1] for m in mem) / len(mem), 9))
                       if mem else c)
        if new == centres:
            break
        centres = new
    order = sorted(range(k), key=lambda j: (centres[j][0], centres[j][1], j))
    relabel = {old: new for new, old in enumerate(order)}
    return {nm: relabel[l] for nm, l in assign(centres).items()}


def test_lloyd_matches_brute_force(spark):
    feats = km.features(_totals(spark, 80, seed=5)).collect()
    names = [r.country_region for r in feats]
    want = _lloyd_numpy(names, [r.f0 for r in feats], [r.f1 for r in feats], 4, 15)
    labels, _ = km.lloyd(km.features(_totals(spark, 80, seed=5)), 4, 15)
    assert {r.country_region: r.cluster for r in labels.collect()} == want


def _forecast_numpy(ds, y, h):
    """Brute-force level-1 forecast of one series (numpy)."""
    import numpy as np
    t = np.array([(d - ds[0]).days for d in ds], float)
    y = np.array(y, float)
    b, a = np.polyfit(t, y, 1)
    dow = np.array([(d.weekday() + 1) % 7 for d in ds])          # 0 = Sunday
    resid = y - a - b * t
    s = {k: resid[dow == k].mean() for k in set(dow)}
    sigma = np.std(resid - np.array([s[k] for k in dow]))
    n, tbar, sxx = len(t), t.mean(), ((t - t.mean()) ** 2).sum()
    out = []
    for j in range(len(ds) + h):
        d = ds[j] if j < len(ds) else ds[-1] + dt.timedelta(days=j - len(ds) + 1)
        tj = (d - ds[0]).days
        yhat = a + b * tj + s.get((d.weekday() + 1) % 7, 0.0)
        spread = 1.2815515594600038 * sigma * math.sqrt(1 + 1 / n + (tj - tbar) ** 2 / sxx)
        out.append((d, yhat, yhat - spread, yhat + spread))
    return out


def test_forecast_matches_numpy(spark):
    rnd = np.random.default_rng(9)
    base = dt.date(2020, 2, 3)
    days = sorted(rnd.choice(90, 40, replace=False).tolist())      # gaps between dates
    ds = [base + dt.timedelta(days=int(d)) for d in days]
    y = (np.array(days) * 0.7 + rnd.normal(0, 3, 40)).tolist()
    hist = spark.createDataFrame([("E", d, float(v)) for d, v in zip(ds, y)], "country_region string, ds date, y double")
    got = sorted((r.ds, r.yhat, r.yhat_lower, r.yhat_upper) for r in fc.forecast(hist, 10).collect())
    want = _forecast_numpy(ds, y, 10)
    assert [g[0] for g in got] == [w[0] for w in want]
    for g, w in zip(got, want):
        assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(g[1:], w[1:]))
