"""Builds that write changed months only, against full builds."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from epiframe import fixtures as fx
from epiframe.plans import rebuild as rb
from epiframe.plans import warehouse as wh
from epiframe.session import materialise
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def panel(spark):
    return materialise(fx.panel(spark, SF_SMALL).where("date between '1996-01-01' and '1996-08-31'"), "panel")


def rows(tables):
    return {n: sorted(map(repr, t.select(*sorted(t.columns)).collect())) for n, t in tables.items()}


def full(panel, root):
    return rows(wh.build(panel, root))


def files(root):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{root}/*/*/*/*.parquet")}


def test_second_build_with_one_changed_month_writes_one_month(spark, panel, tmp_dir):
    tables, written = rb.rebuild(panel, f"{tmp_dir}/w")
    months = sorted(r[0] for r in panel.select(rb.month_of(F.col("date"))).distinct().collect())
    assert written == months and rows(tables) == full(panel, f"{tmp_dir}/f1")
    before = files(f"{tmp_dir}/w")
    month = months[len(months) // 2]
    bumped = panel.withColumn("cases_since_prev_day", F.when(rb.month_of(F.col("date")) == month, F.col("cases_since_prev_day") + 3).otherwise(F.col("cases_since_prev_day")))
    tables, written = rb.rebuild(bumped, f"{tmp_dir}/w")
    assert written == [month] and rows(tables) == full(bumped, f"{tmp_dir}/f2")
    new = [f for f, at in files(f"{tmp_dir}/w").items() if before.get(f) != at]
    assert new and all(f"{rb.MONTH}={month}/" in f for f in new)
    assert rb.rebuild(bumped.repartition(7), f"{tmp_dir}/w")[1] == []  # the order of rows does not matter
    tables, written = rb.rebuild(panel, f"{tmp_dir}/w")
    assert written == [month] and rows(tables) == full(panel, f"{tmp_dir}/f1b")


def test_months_that_are_gone_new_or_without_active_rows(spark, panel, tmp_dir):
    root = f"{tmp_dir}/w"
    rb.rebuild(panel, root)
    months = sorted(r[0] for r in panel.select(rb.month_of(F.col("date"))).distinct().collect())
    gone, idle = months[0], months[3]
    month = rb.month_of(F.col("date"))
    other = (panel.where(month != gone).withColumn("cases_since_prev_day", F.when(month == idle, F.lit(0)).otherwise(F.col("cases_since_prev_day")).cast("long"))
             .unionByName(panel.limit(5).withColumn("date", F.lit(None).cast("date")))
             .unionByName(panel.limit(4).withColumn("date", F.lit(dt.date(2031, 5, 5)))))
    tables, written = rb.rebuild(other, root)
    assert set(written) <= {idle, "none", "2031-05"} and {"none", "2031-05"} <= set(written)
    got, want = rows(tables), full(other, f"{tmp_dir}/f")
    assert got == want
    assert rows(rb.rebuild(other.limit(0), root)[0]) == full(other.limit(0), f"{tmp_dir}/f0")
    assert rows(rb.rebuild(panel, root)[0]) == full(panel, f"{tmp_dir}/f3")


def test_a_build_that_fails_half_way_changes_nothing_for_readers(spark, panel, tmp_dir, monkeypatch):
    root = f"{tmp_dir}/w"
    tables, _ = rb.rebuild(panel, root)
    want = rows(tables)
    doubled = panel.withColumn("deaths", F.col("deaths") * 2)
    with monkeypatch.context() as m:
        m.setattr(rb, "write_manifest", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            rb.rebuild(doubled, root)
    assert rows(rb.read_tables(panel, root)) == want
    tables, written = rb.rebuild(doubled, root)
    assert written and rows(tables) == full(doubled, f"{tmp_dir}/f")
