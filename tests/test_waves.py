import datetime as dt
import random
import re

import pytest

from pyspark.sql import functions as F

from epiframe.operators.waves import assert_unique_order, direction_class, long_waves, waves

DDL = "country_region string, date date, cases_since_prev_day long"


def _series(spark, values, entity="E"):
    base = dt.date(2020, 1, 1)
    return spark.createDataFrame([(entity, base + dt.timedelta(days=i), v) for i, v in enumerate(values)], DDL)


def _brute(values):
    """Reference semantics by regular expression over the class string."""
    cls = []
    for i, v in enumerate(values):
        p = values[i - 1] if i else None
        cls.append("N" if v is None or p is None else "U" if v > p else "P" if v == p else "D")
    s = "".join(cls)
    out = []
    for m in re.finditer("U+P*D+", s):
        a, b = m.start(), m.end() - 1
        seg = values[a:b + 1]
        out.append((a, b, sum(seg), max(seg)))
    return out


def _ours(spark, values):
    base = dt.date(2020, 1, 1)
    rows = waves(_series(spark, values)).collect()
    return sorted(((r.wave_start_date - base).days, (r.wave_end_date - base).days,
                   r.total_cases_in_wave, r.peak_cases_in_wave) for r in rows)


@pytest.mark.parametrize("values", [
    [1, 2, 1],            # U D
    [1, 2, 2, 1],         # U P D
    [1, 2, 2, 3, 1],      # U P U D
    [2, 2, 1],            # P D: no wave
    [1, 2, 2],            # U P: no wave
    [1, 3, None, 4, 2],   # null inside a rise breaks it
    [1, 3, 1, 4, 0, 5, 2],  # back-to-back waves
    [5, 4, 3],            # only down
    [], [7],
])
def test_hand_patterns(spark, values):
    assert _ours(spark, values) == _brute(values)


def test_random_against_regex(spark):
    rnd = random.Random(7)
    seqs = []
    for _ in range(400):
        n = rnd.randint(0, 25)
        seqs.append([rnd.choice([None, 0, 1, 2, 3, 3, 4]) if rnd.random() < 0.9 else None for _ in range(n)])
    base = dt.date(2020, 1, 1)
    rows = [(f"e{k}", base + dt.timedelta(days=i), v) for k, s in enumerate(seqs) for i, v in enumerate(s)]
    df = spark.createDataFrame(rows, DDL)
    got = {}
    for r in waves(df).collect():
        got.setdefault(r.country_region, []).append(
            ((r.wave_start_date - base).days, (r.wave_end_date - base).days, r.total_cases_in_wave, r.peak_cases_in_wave))
    for k, s in enumerate(seqs):
        assert sorted(got.get(f"e{k}", [])) == _brute(s), s


def test_direction_class(spark):
    out = [r.direction for r in direction_class(_series(spark, [1, 2, 2, 1, None, 3])).orderBy("date").collect()]
    assert out == [None, "UP", "PLATEAU", "DOWN", None, None]


def test_single_exchange(spark):
    df = _series(spark, [1, 2, 1]).repartition(3)
    plan = waves(df)._jdf.queryExecution().executedPlan().toString()
    # one hash exchange on the entity (the repartition above is the other)
    assert plan.count("Exchange hashpartitioning(country_region") == 1


def test_uniqueness_precondition(spark):
    dup = _series(spark, [1, 2]).unionByName(_series(spark, [3]))
    assert assert_unique_order(dup).count() == 1


def test_user_panel_against_regex(spark):
    """The whole user-by-day binding U: Spark waves == regex brute force per user."""
    from epiframe import fixtures as fx
    from tests.conftest import SF_SMALL
    u = fx.user_panel(spark, SF_SMALL)
    series = {}
    for r in u.collect():
        series.setdefault(r.country_region, []).append((r.date, r.cases_since_prev_day))
    want = set()
    for user, pts in series.items():
        pts.sort()
        for a, b, total, peak in _brute([v for _, v in pts]):
            want.add((user, pts[a][0], pts[b][0], total, peak))
    got = {(r.country_region, r.wave_start_date, r.wave_end_date, r.total_cases_in_wave, r.peak_cases_in_wave)
           for r in waves(u).collect()}
    assert got == want and len(got) > 0


@pytest.mark.parametrize("parts", [1, 2, 7, 40])
def test_series_cut_anywhere_have_the_same_waves(spark, parts):
    """Long runs that cross several cuts, short ones, nulls, and many small entities between."""
    rnd = random.Random(parts)
    series = {"A": [], "B": [], None: [], "z": [1, 2, 1]}
    for name in ("A", "B", None):
        v = 0
        while len(series[name]) < 2000:
            step, n = rnd.choice([1, 0, -1, 1, -1, None]), rnd.choice([1, 1, 2, 3, 25, 60])
            for _ in range(n):
                v += step or 0
                series[name].append(None if step is None else v)
    for i in range(30):
        series[f"m{i:02d}"] = [rnd.choice([0, 1, 2, None]) for _ in range(rnd.randint(1, 6))]
    rows = [(name, i, v) for name, vs in series.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "country_region string, date int, cases_since_prev_day long").repartition(5)
    got = sorted((tuple(r) for r in long_waves(df, partitions=parts).collect()), key=repr)
    want = sorted(((name, *w) for name, vs in series.items() for w in _brute(vs)), key=repr)
    assert got == want and len(want) > 20


def test_one_hot_series_is_spread_over_tasks(spark):
    n = 60_000
    df = spark.range(0, n, 1, 4).select(F.lit("hot").alias("country_region"), F.col("id").alias("date"),
                                        F.pmod(F.xxhash64("id"), F.lit(7)).alias("cases_since_prev_day"))
    got = long_waves(df, partitions=12)
    values = [r[0] for r in df.orderBy("date").select("cases_since_prev_day").collect()]
    assert sorted(tuple(r)[1:] for r in got.collect()) == sorted(_brute(values))
    sizes = [r[0] for r in spark.read.parquet(_stored(spark, "wave_rows")).groupBy("_pid").count().select("count").collect()]
    assert len(sizes) == 12 and max(sizes) < n / 6


def _stored(spark, name):
    """The newest folder that ``materialise`` wrote under that name."""
    import glob
    import os
    base = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return max(glob.glob(f"{base}/epiframe/{name}-*"), key=os.path.getmtime)


def test_long_waves_of_an_empty_table(spark):
    assert long_waves(spark.createDataFrame([], DDL)).collect() == []
