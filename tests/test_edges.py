import json
import os

import pytest
from pyspark.sql import functions as F

from epiframe import fixtures as fx
from epiframe import session
from epiframe.functions.numeric import coerce_long, pct_label
from epiframe.operators import aggregates as agg
from epiframe.operators import cluster as km
from epiframe.operators import forecast as fc
from epiframe.operators import profile as pf
from epiframe.plans import charts
from epiframe.sources import files
from epiframe.sources.records import to_records
from tests.conftest import SF_SMALL


def test_null_label(spark):
    df = spark.createDataFrame([(None,), (1.005,), (12.0,)], "x double")
    assert [r[0] for r in df.select(pct_label("x")).collect()] == [None, "1.01%", "12.00%"]


def test_records_keep_null_fields(spark):
    df = spark.createDataFrame([(None, 1), ("x", None)], "a string, b int")
    assert [json.loads(r[0]) for r in to_records(df).collect()] == [{"a": None, "b": 1}, {"a": "x", "b": None}]


def test_histogram_counts_infinities_apart(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 1.0, 9.5, 10.0, float("inf"), float("inf"), float("-inf"), float("nan"), None)], "x double")
    rows = {(r["bin"], r["lo"], r["hi"], r["freq"]) for r in pf.histogram(df).collect()}
    assert rows == {(0, 0.0, 1.0, 1), (1, 1.0, 2.0, 1), (9, 9.0, 10.0, 2),
                    (None, float("inf"), float("inf"), 2), (None, float("-inf"), float("-inf"), 1)}


def test_whole_number_coercion(spark):
    df = spark.createDataFrame([(x,) for x in ("7", "7.5", "1e6", "n/a", None, "9007199254740993", "NaN", "inf", "")], "x string")
    assert [r[0] for r in df.select(coerce_long("x")).collect()] == [7, 7, 1000000, None, None, 9007199254740993, None, None, None]


def test_csv_columns_are_read_by_name(spark, tmp_dir):
    path = os.path.join(tmp_dir, "m")
    spark.createDataFrame([("Target", "Source", 1)], "target_name string, source_name string, extra int").write.option("header", True).csv(path)
    assert [tuple(r) for r in files.read_mapping(spark, path).collect()] == [("source", "target")]
    bad = os.path.join(tmp_dir, "bad")
    spark.createDataFrame([("a", "b")], "x string, source_name string").write.option("header", True).csv(bad)
    with pytest.raises(Exception, match="target_name"):
        files.read_mapping(spark, bad)


def test_session_refuses_a_local_folder_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_session_leaves_master_and_partitions_to_the_launcher(monkeypatch):
    seen = {}

    class Builder:
        def appName(self, name):
            return self

        def master(self, m):
            seen["master"] = m
            return self

        def config(self, k, v):
            seen[k] = v
            return self

        def getOrCreate(self):
            raise StopIteration

    monkeypatch.setattr(session, "SparkSession", type("S", (), {"builder": Builder()}))
    with pytest.raises(StopIteration):
        session.build_session()
    assert "master" not in seen and "spark.sql.shuffle.partitions" not in seen


def test_lloyd_reaches_its_fixed_point_or_fails(spark):
    df = spark.range(60).select(F.col("id").cast("string").alias("country_region"), (F.col("id") * F.col("id") / 100.0).alias("f0"),
                                (F.col("id") % 7 / 1.0).alias("f1"))
    labels, centres = km.lloyd(df, 4)
    again = km.update(km.assign(labels.drop("cluster"), centres), centres)
    assert again == centres
    with pytest.raises(RuntimeError):
        km.lloyd(df, 4, max_rounds=1)


def test_horizon_and_seasons_are_parameters(spark):
    hist = spark.range(40).select(F.lit("a").alias("country_region"), F.date_add(F.lit("2020-01-01"), F.col("id").cast("int")).alias("ds"),
                                  (F.col("id") % 7 * 1.0).alias("y"))
    assert fc.future_dates(hist, 5000).count() == 5040
    with pytest.raises(ValueError):
        fc.future_dates(hist, 0)
    fits = {w: fc.forecast_changepoints(hist, 10, weekly=w).orderBy("ds").collect() for w in ("on", "off", "auto")}
    # sums of doubles are added up in any order, so fits agree to rounding
    near = {w: [pytest.approx(tuple(r)[2:5], rel=1e-6, abs=1e-6) for r in fits[w]] for w in fits}
    assert [tuple(r)[2:5] for r in fits["on"]] == near["auto"] and [tuple(r)[2:5] for r in fits["on"]] != near["off"]
    width = [r["yhat_upper"] - r["yhat_lower"] for r in fits["off"]]
    assert width[39] < width[40] < width[49]
    with pytest.raises(ValueError):
        fc.forecast_changepoints(hist, 10, weekly="maybe")


def test_row_order_of_ordered_results(spark):
    panel = fx.panel(spark, SF_SMALL)

    def check(df, key):
        rows = df.collect()
        assert len(rows) > 1 and rows == sorted(rows, key=key)

    check(agg.rows_per_entity(panel), lambda r: (-r["total_records"], r["country_region"]))
    check(agg.daily_sum(panel), lambda r: r["date"])
    check(agg.top_deaths(panel, 10), lambda r: (-r["total_deaths"], r["country_region"]))
    totals = agg.country_totals(panel)
    check(agg.preview(totals, [F.desc_nulls_last("total_cases"), F.asc_nulls_last("country_region")], 5),
          lambda r: (-r["total_cases"], r["country_region"]))
    rates = totals.select("country_region", (F.col("total_deaths") / F.col("total_cases")).alias("cfr_pct"))
    check(charts.cfr_top(rates, None, 20), lambda r: (-r["cfr_pct"], r["country_region"]))
