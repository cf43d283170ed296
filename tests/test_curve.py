"""The layout clustered on two keys: rows, files opened, upkeep."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from epiframe import fixtures as fx
from epiframe.plans.curve import CurvedTable, boundaries, cell, coordinates, stretch

KEYS = ["date", "country_region"]
DAY = dt.date(2020, 1, 1)


def facts(spark, n=4000, seed=1, start=0):
    rng = random.Random(seed)
    rows = [(DAY + dt.timedelta(days=rng.randrange(400)), f"C{rng.randrange(40):02d}", start + i) for i in range(n)]
    return spark.createDataFrame(rows, "date date, country_region string, v long"), rows


def got(df):
    return sorted(r["v"] for r in df.collect())


def test_cells_and_their_coordinates(spark):
    for bits in (1, 3):
        n = 1 << bits
        grid = spark.range(n * n).select((F.col("id") % n).cast("int").alias("x"), F.floor(F.col("id") / n).cast("int").alias("y"))
        rows = grid.select("x", "y", cell([F.col("x"), F.col("y")], bits).alias("c")).collect()
        assert sorted(r["c"] for r in rows) == list(range(n * n))
        assert all(coordinates(r["c"], 2, bits) == [r["x"], r["y"]] for r in rows)


def test_boundaries_cut_evenly_and_keep_a_frequent_value_whole(spark):
    df = spark.range(800).select(F.col("id").alias("v"))
    assert len(boundaries(df, "v", 3)) == 7
    sizes = df.groupBy(stretch(F.col("v"), boundaries(df, "v", 3)).alias("s")).count().collect()
    assert len(sizes) == 8 and all(abs(r["count"] - 100) <= 2 for r in sizes)
    hot = spark.range(900).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("v"))
    bounds = boundaries(hot, "v", 2)
    assert hot.where("v = 7").select(stretch(F.col("v"), bounds).alias("s")).distinct().count() == 1 and len(bounds) <= 3
    assert boundaries(df.where("v is null"), "v", 2) == []


def test_each_key_alone_opens_a_small_share_of_the_files(spark, tmp_dir):
    df, rows = facts(spark)
    table = CurvedTable.create(df, f"{tmp_dir}/t", KEYS, bits=3)
    n = len(table.files())
    assert n == 64 and got(table.read()) == sorted(v for *_, v in rows)
    for c in ("C00", "C17", "C39"):
        ranges = {"country_region": (c, c)}
        assert len(table.files(**ranges)) <= n / 8  # one stretch of eight
        assert got(table.read(**ranges)) == sorted(v for _, x, v in rows if x == c)
    lo, hi = DAY + dt.timedelta(days=100), DAY + dt.timedelta(days=120)
    assert len(table.files(date=(lo, hi))) <= n / 4 and got(table.read(date=(lo, hi))) == sorted(v for d, _, v in rows if lo <= d <= hi)
    both = {"date": (lo, hi), "country_region": ("C05", "C05")}
    assert len(table.files(**both)) <= 2 and got(table.read(**both)) == sorted(v for d, c, v in rows if lo <= d <= hi and c == "C05")
    assert table.files(country_region=("Z", "Z")) == [] and table.read(country_region=("Z", None)).count() == 0


def test_appended_rows_are_merged_cell_by_cell(spark, tmp_dir):
    df, rows = facts(spark, 1500)
    table = CurvedTable.create(df, f"{tmp_dir}/t", KEYS, bits=2)
    first = len(table.files())
    late, more = facts(spark, 60, seed=9, start=10_000)
    late = late.where(F.col("country_region") < "C10")
    more = [r for r in more if r[1] < "C10"]
    table.append(late)
    opened = len(table.files(country_region=("C03", "C03")))
    touched = table.merge()
    assert 0 < len(touched) <= first / 2 and len(table.files()) == first
    assert len(table.files(country_region=("C03", "C03"))) < opened and table.merge() == []
    again = CurvedTable(spark, f"{tmp_dir}/t", df.schema, KEYS)
    assert got(again.read()) == sorted(v for *_, v in rows + more)
    assert got(again.read(country_region=("C03", "C03"))) == sorted(v for _, c, v in rows + more if c == "C03")


def test_values_outside_the_first_boundaries_nulls_and_empty_tables(spark, tmp_dir):
    df, rows = facts(spark, 300)
    table = CurvedTable.create(df, f"{tmp_dir}/t", KEYS, bits=2)
    odd = spark.createDataFrame([(None, "C01", 1000), (DAY - dt.timedelta(days=900), None, 1001), (DAY + dt.timedelta(days=9000), "zz", 1002)], df.schema)
    table.append(odd).merge()
    assert got(table.read()) == sorted([v for *_, v in rows] + [1000, 1001, 1002])
    assert got(table.read(country_region=("zz", "zz"))) == [1002] and got(table.read(date=(None, DAY - dt.timedelta(days=1)))) == [1001]
    assert 1000 in got(table.read(country_region=("C01", "C01")))
    empty = CurvedTable.create(df.limit(0), f"{tmp_dir}/e", KEYS)
    assert empty.read().count() == 0 and empty.files() == [] and empty.merge() == []
    assert got(empty.append(df).read(country_region=("C01", "C01"))) == sorted(v for _, c, v in rows if c == "C01")


@pytest.mark.parametrize("bits", [1, 2])
def test_panel_rows_survive_the_round_trip(spark, tmp_dir, bits):
    from tests.conftest import SF_SMALL
    panel = fx.panel(spark, SF_SMALL)
    table = CurvedTable.create(panel, f"{tmp_dir}/p", KEYS, bits=bits)
    assert sorted(map(repr, table.read().collect())) == sorted(map(repr, panel.collect()))
