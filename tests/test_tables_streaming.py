import datetime as dt
import os

from pyspark.sql import functions as F

from epiframe import fixtures as fx
from epiframe import schemas
from epiframe.operators.filters import active_rows
from epiframe.plans import comments as cm
from epiframe.plans import warehouse as wh
from epiframe.streaming.comments import ingest
from epiframe.streaming.upkeep import run_complete_aggregate
from tests.conftest import SF_SMALL


def _sorted(df):
    return sorted(tuple(r) for r in df.collect())


def test_database_and_copies(spark, tmp_dir):
    db = wh.create_database(spark, "epiframe_test_db", os.path.join(tmp_dir, "db"))
    wh.create_database(spark, "epiframe_test_db", os.path.join(tmp_dir, "db"))   # idempotent, never replaced
    panel = fx.panel(spark, SF_SMALL)
    copy = wh.table_copy(panel, os.path.join(tmp_dir, "copy"), f"{db}.panel_full")
    assert copy.count() == panel.count()
    pruned = wh.pruned_copy(copy, os.path.join(tmp_dir, "pruned"), f"{db}.panel_pruned")
    assert pruned.columns == wh.PRUNED_COLUMNS
    active = wh.active_copy(pruned, os.path.join(tmp_dir, "active"))
    assert active.filter("cases_since_prev_day <= 0 OR cases_since_prev_day IS NULL").count() == 0
    names = {r.tableName for r in wh.list_tables(spark, db).collect()}
    assert names == {"panel_full", "panel_pruned"}
    desc = {r.col_name: r.data_type for r in wh.describe_table(spark, f"{db}.panel_pruned").collect()}
    assert desc["date"] == "date" and desc["deaths"] == "bigint"
    wh.use_database(spark, db)
    assert spark.catalog.currentDatabase() == db
    wh.use_database(spark, "default")


def test_clustered_layout_prunes(spark, tmp_dir):
    from epiframe.operators.filters import in_date_range
    panel = fx.panel(spark, SF_SMALL)
    laid = wh.write_clustered(panel, os.path.join(tmp_dir, "clustered"), files=4)
    q = in_date_range(laid, "1996-01-01", "1996-06-30", month_directory="month")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(date), GreaterThanOrEqual(date,1996-01-01)" in plan
    assert "PartitionFilters: [isnotnull(month" in plan
    assert q.count() == panel.filter("date BETWEEN '1996-01-01' AND '1996-06-30'").count()
    flat = wh.write_clustered(panel, os.path.join(tmp_dir, "flat"), month_of=None)
    assert "month" not in flat.columns


def test_a_month_column_of_the_table_is_no_directory(spark):
    from epiframe.operators.filters import in_date_range
    rows = [(dt.date(2020, 1, 5), dt.date(2019, 7, 1)), (dt.date(2020, 2, 5), dt.date(2020, 1, 1))]
    df = spark.createDataFrame(rows, "date date, month date")
    assert [tuple(r) for r in in_date_range(df, "2020-01-01", "2020-01-31").collect()] == rows[:1]


def test_selection_keeps_columns_at_any_length(spark):
    from epiframe.operators.filters import select_entities
    panel = fx.panel(spark, SF_SMALL).select("date", "country_region", "cases")
    assert select_entities(panel, ["NATION_0"]).columns == panel.columns
    many = [f"NATION_{i}" for i in range(3)] + [f"x{i}" for i in range(2000)]
    out = select_entities(panel, many)
    assert out.columns == panel.columns
    assert out.count() == panel.filter(F.col("country_region").isin("NATION_0", "NATION_1", "NATION_2")).count()


def test_stream_equals_batch(spark, tmp_dir):
    panel = fx.panel(spark, SF_SMALL)
    src = os.path.join(tmp_dir, "in")
    panel.repartitionByRange(4, "date").write.parquet(src)  # several files, one micro-batch each below
    body = lambda s: wh.new_stats_state(active_rows(s))
    streamed = run_complete_aggregate(spark, src, schemas.PANEL, body, os.path.join(tmp_dir, "out"),
                                      os.path.join(tmp_dir, "ckpt"), bytes_per_trigger="1")
    assert spark.read.parquet(os.path.join(tmp_dir, "out")).select("_epoch").distinct().count() == 2
    assert _sorted(streamed) == _sorted(body(panel))
    daily = run_complete_aggregate(spark, src, schemas.PANEL, lambda s: wh.daily_new_body(active_rows(s)),
                                   os.path.join(tmp_dir, "out2"), os.path.join(tmp_dir, "ckpt2"))
    assert _sorted(daily) == _sorted(wh.daily_new_body(active_rows(panel)))


def test_upkeep_rerun_and_new_files(spark, tmp_dir):
    panel = fx.panel(spark, SF_SMALL)
    early, late = panel.filter("date < '1997-01-01'"), panel.filter("date >= '1997-01-01'")
    src, out, ck = (os.path.join(tmp_dir, n) for n in ("in", "out", "ck"))
    early.write.parquet(src)
    run = lambda: _sorted(run_complete_aggregate(spark, src, schemas.PANEL, wh.deaths_body, out, ck))
    want = _sorted(wh.deaths_body(early))
    assert run() == want
    assert run() == want  # nothing new: the snapshot stays
    late.write.mode("append").parquet(src)
    assert run() == _sorted(wh.deaths_body(panel))
    assert run() == _sorted(wh.deaths_body(panel))


def test_comment_lookups_open_only_their_directories(spark, tmp_dir):
    store = cm.add_comments(fx.comments(spark, SF_SMALL).drop("timestamp"), os.path.join(tmp_dir, "store"))
    for df in (cm.comments_for_key(store, " NATION_3 "), cm.comments_for_keys(store, ["Nation_1", " NATION_2"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
        assert cm.BUCKET not in df.columns


def test_comments_round_trip(spark, tmp_dir):
    c = fx.comments(spark, SF_SMALL).drop("timestamp")
    store = cm.add_comments(c, os.path.join(tmp_dir, "store"))
    rows = store.collect()
    assert len(rows) == c.count() and all(r.timestamp is not None and r.comment_id for r in rows)
    assert all(r.country_key == r.country_key.strip().lower() for r in rows)
    one = cm.comments_for_key(store, " NATION_3 ").collect()
    assert one and all(r["count"] == len(one) for r in one)
    sel = cm.comments_for_keys(store, ["Nation_1", "NATION_2 "]).collect()
    assert [r.country_key for r in sel] == sorted(r.country_key for r in sel)
    fan = cm.fan_out(c, ["A", "B"])
    assert fan.count() == 2 * c.count()
    assert cm.fan_out(c, []).count() == 0


def test_comment_stream(spark, tmp_dir):
    c = fx.comments(spark, SF_SMALL).drop("timestamp")
    c.repartition(3).write.json(os.path.join(tmp_dir, "json"))
    out = ingest(spark, os.path.join(tmp_dir, "json"), os.path.join(tmp_dir, "store"), os.path.join(tmp_dir, "ck"))
    cols = ["country_key", "comment_text", "user", "source", "additional_notes"]
    assert _sorted(out.select(*cols)) == _sorted(cm.prepare(c).select(*cols))


def test_utc_stamp(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    now = spark.range(1).select(F.current_timestamp().cast("string")).first()[0]
    assert now is not None and len(now) >= 19


def test_long_running_upkeep_picks_up_new_files(spark, tmp_dir):
    from epiframe.streaming.upkeep import read_current, start_complete_aggregate
    panel = fx.panel(spark, SF_SMALL)
    src = os.path.join(tmp_dir, "in")
    early, late = panel.filter("date < '1997-01-01'"), panel.filter("date >= '1997-01-01'")
    early.write.parquet(os.path.join(src, "part=1"))
    body = lambda s: wh.deaths_body(s)
    q = start_complete_aggregate(spark, src + "/*", schemas.PANEL, body, os.path.join(tmp_dir, "out"),
                                 os.path.join(tmp_dir, "ckpt"), every="1 second")
    try:
        q.processAllAvailable()
        assert _sorted(read_current(spark, os.path.join(tmp_dir, "out"))) == _sorted(wh.deaths_body(early))
        late.write.parquet(os.path.join(src, "part=2"))
        q.processAllAvailable()
        assert _sorted(read_current(spark, os.path.join(tmp_dir, "out"))) == _sorted(wh.deaths_body(panel))
        # both slots exist, each a complete snapshot of its own epoch
        raw = spark.read.parquet(os.path.join(tmp_dir, "out"))
        assert raw.select("_slot").distinct().count() == 2
    finally:
        q.stop()


def test_warehouse_build_x4(spark, tmp_dir):
    from epiframe.operators.filters import active_rows as act
    db = wh.create_database(spark, "epiframe_x4", os.path.join(tmp_dir, "db"))
    panel = fx.panel(spark, SF_SMALL)
    t = wh.build(panel, os.path.join(tmp_dir, "wh"), db)
    assert {r.tableName for r in wh.list_tables(spark, db).collect()} == set(t)
    assert t["panel_full"].count() == panel.count()
    assert t["panel_pruned"].columns == t["panel_active"].columns == wh.PRUNED_COLUMNS
    t = wh.build(panel.filter("date >= '1996-01-01'"), os.path.join(tmp_dir, "wh2"), db)  # replaces every table
    assert spark.table(f"{db}.panel_full").count() == panel.filter("date >= '1996-01-01'").count()
    t = wh.build(panel, os.path.join(tmp_dir, "wh"), db)
    assert _sorted(t["agg_total_deaths"]) == _sorted(wh.deaths_body(panel))
    assert _sorted(t["agg_new_case_stats"]) == _sorted(wh.new_stats_state(act(panel)))
    assert _sorted(spark.table(f"{db}.agg_daily_new_cases")) == _sorted(wh.daily_new_body(act(panel)))


def test_read_panel_sources(spark, tmp_dir):
    from epiframe.sources import read_panel
    panel = fx.panel(spark, SF_SMALL)
    db = wh.create_database(spark, "epiframe_src", os.path.join(tmp_dir, "db"))
    wh.table_copy(panel, os.path.join(tmp_dir, "t"), f"{db}.panel")
    assert read_panel(spark, f"{db}.panel", fmt="table").count() == panel.count()
    panel.write.option("header", True).csv(os.path.join(tmp_dir, "csv"))
    back = read_panel(spark, os.path.join(tmp_dir, "csv"), fmt="csv", header="true")
    assert back.schema == schemas.PANEL and _sorted(back) == _sorted(panel)


def test_built_tables_answer_plain_sql(spark, tmp_dir):
    from epiframe.operators import aggregates as agg
    db = wh.create_database(spark, "epiframe_sql", os.path.join(tmp_dir, "db"))
    panel = fx.panel(spark, SF_SMALL)
    wh.build(panel, os.path.join(tmp_dir, "wh"), db)
    per_country = spark.sql(f"SELECT country_region, count(*) AS total_records FROM {db}.panel_pruned "
                            "GROUP BY country_region")
    assert _sorted(per_country) == _sorted(agg.rows_per_entity(panel))
    window = spark.sql(f"SELECT date, sum(cases_since_prev_day) AS total_new_cases FROM {db}.panel_active "
                       "WHERE date BETWEEN DATE'1996-01-01' AND DATE'1996-06-30' GROUP BY date")
    assert _sorted(window) == _sorted(agg.daily_sum_window(panel, "1996-01-01", "1996-06-30"))
    stats = spark.sql(f"SELECT country_region, sum_new_cases / n_new_cases AS avg_new_cases "
                      f"FROM {db}.agg_new_case_stats")
    want = {r.country_region: r.avg_new_cases for r in agg.value_stats_active(panel).collect()}
    assert all(abs(r.avg_new_cases - want[r.country_region]) < 1e-9 for r in stats.collect())


def test_stream_with_no_input_yet(spark, tmp_dir):
    src = os.path.join(tmp_dir, "empty_in")
    os.makedirs(src)
    out = run_complete_aggregate(spark, src, schemas.PANEL, wh.deaths_body, os.path.join(tmp_dir, "out"),
                                 os.path.join(tmp_dir, "ckpt"))
    assert out.count() == 0 and out.columns == ["country_region", "total_deaths"]
