"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

They bind the driver tables to the reference's input shapes
(``epiframe.fixtures``) and run the library operators over whole tables.
Doubles are rounded to 6 places here, never inside operators.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from epiframe import fixtures as fx
from epiframe import schemas
from epiframe.functions.keys import norm
from epiframe.functions.numeric import pct_label
from epiframe.operators import aggregates as agg
from epiframe.operators import cluster as km
from epiframe.operators import filters as flt
from epiframe.operators import forecast as fc
from epiframe.operators import profile as pf
from epiframe.operators import regression as rg
from epiframe.operators import waves as wv
from epiframe.operators.ranking import global_row_number, grouped_average_ranks
from epiframe.operators.similar import nearest_names
from epiframe.plans import charts
from epiframe.plans import comments as cm
from epiframe.plans import enrichment
from epiframe.plans import rebuild as rb
from epiframe.plans.comment_log import CommentLog
from epiframe.plans.curve import CurvedTable
from epiframe.plans import warehouse as wh
from epiframe.session import materialise, work_dir
from epiframe.sources.files import read_enriched, read_mapping, read_population, read_table, write_csv
from epiframe.sources.records import to_records
from epiframe.streaming import changes as ch
from epiframe.streaming.comments import checked_ingest, ingest
from epiframe.streaming.upkeep import run_complete_aggregate

# Parameters of the registered queries (fixed inputs of the checks).
ONE_COUNTRY = "  Nation_7 "
WINDOW_START, WINDOW_END = "1996-01-01", "1996-06-30"
SELECTION = ["NATION_0", "NATION_1", "NATION_5", "NATION_10", "NATION_19", "NATION_3"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[
        F.round(F.col(f.name), places).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        else F.col(f.name) for f in df.schema.fields])


def _enriched(spark: SparkSession, sf: str) -> DataFrame:
    return enrichment.enrich(fx.panel(spark, sf), fx.dimension(spark, sf), fx.mapping(spark))


def _stored_enriched(spark: SparkSession, sf: str) -> DataFrame:
    """The enriched table as the dashboard reads it: written once (S4, as
    Parquet in the shared folder) and read back (S5).  Used where a query
    reads the table twice (a fit or bound, then the rows), so the enrichment
    is not recomputed from the facts."""
    return materialise(_enriched(spark, sf), "enriched")


# --- X1 / J4 -----------------------------------------------------------------

@query
def enrich_countries(spark, sf):
    """X1 on P, D, M: totals, key mapping, dimension join, ratios."""
    return rounded(_enriched(spark, sf))


@query
def unmatched_countries(spark, sf):
    """J4 on P, D, M: entities the inner dimension join drops, with their mapped key."""
    return enrichment.unmatched_countries(fx.panel(spark, sf), fx.dimension(spark, sf), fx.mapping(spark))


# --- A1-A16, O1-O5 over the panel ----------------------------------------------

@query
def country_totals(spark, sf):
    """A1 on P: total cases and deaths per country."""
    return agg.country_totals(fx.panel(spark, sf))


@query
def country_totals_one(spark, sf):
    """A2 + P9 on P: totals of one country matched case- and space-insensitively."""
    return agg.country_totals_for(fx.panel(spark, sf), ONE_COUNTRY)


@query
def country_totals_positive(spark, sf):
    """A3 on P: totals with total_cases > 0."""
    return agg.country_totals_positive(fx.panel(spark, sf))


@query
def row_count(spark, sf):
    """A4 on P: number of rows."""
    return agg.row_count(fx.panel(spark, sf))


@query
def rows_per_country(spark, sf):
    """A5 + O1 on P: rows per country, largest first."""
    return agg.rows_per_entity(fx.panel(spark, sf))


@query
def date_range(spark, sf):
    """A6 on P: first and last date."""
    return agg.date_range(fx.panel(spark, sf))


@query
def completeness(spark, sf):
    """A9 on P: total rows and non-null counts of cases, deaths, population."""
    return agg.completeness(fx.panel(spark, sf), ["cases", "deaths", "population"])


@query
def completeness_new_cases(spark, sf):
    """A9 on P, second column set: non-null new cases, deaths, population."""
    return agg.completeness(fx.panel(spark, sf),
                            ["cases_not_null=cases_since_prev_day", "deaths", "population"])


@query
def new_case_stats_all(spark, sf):
    """A7 on P: avg/max/min new cases per country over all rows."""
    return rounded(agg.value_stats(fx.panel(spark, sf)))


@query
def new_case_stats_active(spark, sf):
    """A8 + P11 on P: the same statistics over active rows only."""
    return rounded(agg.value_stats_active(fx.panel(spark, sf)))


@query
def daily_new_all(spark, sf):
    """A10 + O2 on P: new cases per date over all rows."""
    return agg.daily_sum(fx.panel(spark, sf))


@query
def daily_new_active(spark, sf):
    """A11 on P: new cases per date over active rows."""
    return agg.daily_sum_active(fx.panel(spark, sf))


@query
def daily_new_window(spark, sf):
    """A13 + P12 on P: active new cases per date inside a closed date window."""
    return agg.daily_sum_window(fx.panel(spark, sf), WINDOW_START, WINDOW_END)


@query
def top_deaths(spark, sf):
    """A12 + O3 on P: ten countries with most deaths, ties by name."""
    return agg.top_deaths(fx.panel(spark, sf), 10)


@query
def preview_totals(spark, sf):
    """O5 over O1 on P: first five countries by total cases."""
    totals = agg.country_totals(fx.panel(spark, sf))
    return agg.preview(totals, [F.desc_nulls_last("total_cases"), F.asc_nulls_last("country_region")], 5)


@query
def country_list(spark, sf):
    """A14 on X1: distinct non-null country names, sorted."""
    return agg.distinct_sorted(_enriched(spark, sf), "country_region")


@query
def axis_bound(spark, sf):
    """A15 on X1: max CFR x 1.2, or 1 when every CFR is NULL."""
    return rounded(agg.axis_bound(_enriched(spark, sf), "cfr_pct"))


@query
def selected_countries(spark, sf):
    """P10 on X1: rows of the selected countries."""
    return rounded(flt.select_entities(_enriched(spark, sf), SELECTION))


@query
def finite_rows(spark, sf):
    """P19 + P20 on X1: rows whose density and cases per million are finite."""
    return rounded(flt.finite_rows(_enriched(spark, sf), ["population_density_calc", "cases_per_million"]))


# --- W1-W3 ------------------------------------------------------------------------


@query
def direction_class(spark, sf):
    """W1 on P: UP / PLATEAU / DOWN of new cases versus the previous row."""
    return wv.direction_class(fx.panel(spark, sf)).select(
        "country_region", "date", "cases_since_prev_day", "direction")


@query
def waves_country(spark, sf):
    """W2 + W3 on P: rise-plateau-fall waves per country with their measures."""
    return wv.waves(fx.panel(spark, sf))


@query
def waves_user(spark, sf):
    """W2 + W3 on U: rise-plateau-fall waves per user."""
    return wv.waves(fx.user_panel(spark, sf))


@query
def waves_events(spark, sf):
    """W2 + W3 on single events, one series per event type in the order of their ids: series cut over several tasks."""
    events = read_table(spark, sf, "events").select(F.col("event_type").alias("country_region"), F.col("event_id").alias("date"),
                                                    F.floor("value").cast("long").alias("cases_since_prev_day"))
    return wv.long_waves(events)


# --- S10-S19, T1: tables, layout, materialised aggregates, streaming upkeep ---------


def _pruned(spark, sf, root):
    return wh.pruned_copy(fx.panel(spark, sf), f"{root}/pruned")


def _active(spark, sf, root):
    return wh.active_copy(_pruned(spark, sf, root), f"{root}/active")


@query
def table_copy(spark, sf):
    """S10 on P: full copy written and read back."""
    return wh.table_copy(fx.panel(spark, sf), work_dir(spark, "table_copy"))


@query
def pruned_copy(spark, sf):
    """S11 on P: five-column copy written and read back."""
    return _pruned(spark, sf, work_dir(spark, "pruned_copy"))


@query
def active_copy(spark, sf):
    """S12 on P: active-row copy written and read back."""
    return _active(spark, sf, work_dir(spark, "active_copy"))


@query
def clustered_window(spark, sf):
    """S13 + A13 on P: the date-window query over the clustered, month-partitioned layout."""
    root = work_dir(spark, "clustered")
    laid_out = wh.write_clustered(_active(spark, sf, root), f"{root}/clustered")
    return agg.daily_sum_window(laid_out, WINDOW_START, WINDOW_END, month_directory=wh.MONTH)


def _curved(spark, sf, name):
    """P laid out by cells of (date, country): the rows up to 1997 first, then the later
    ones appended in two parts, cells with several files merged."""
    panel = materialise(fx.panel(spark, sf), name)
    table = CurvedTable.create(panel.where("date < '1998-01-01'"), f"{work_dir(spark, name)}/table", ["date", "country_region"])
    table.append(panel.where("date >= '1998-01-01' and cases > 1")).append(panel.where("date >= '1998-01-01' and not cases > 1")).merge()
    return table


@query
def curved_country(spark, sf):
    """S13 on P: one country's rows from a layout clustered on date and country, after appends and merges."""
    return _curved(spark, sf, "curved_country").read(country_region=(SELECTION[2], SELECTION[2]))


@query
def curved_window(spark, sf):
    """S13 + A13 on P: the date-window query from the same layout."""
    window = _curved(spark, sf, "curved_window").read(date=(dt.date.fromisoformat(WINDOW_START), dt.date.fromisoformat(WINDOW_END)))
    return agg.daily_sum_window(window, WINDOW_START, WINDOW_END)


@query
def view_daily_new(spark, sf):
    """S14 on P: stored daily-new-cases aggregate over active rows."""
    root = work_dir(spark, "view_daily_new")
    return wh.save_view(wh.daily_new_body(_active(spark, sf, root)), f"{root}/mv")


@query
def view_deaths(spark, sf):
    """S15 on P: stored deaths-per-country aggregate."""
    root = work_dir(spark, "view_deaths")
    return wh.save_view(wh.deaths_body(_pruned(spark, sf, root)), f"{root}/mv")


@query
def view_new_stats(spark, sf):
    """S16 on P: stored sum/count/min/max state, read as avg/max/min."""
    root = work_dir(spark, "view_new_stats")
    state = wh.save_view(wh.new_stats_state(_active(spark, sf, root)), f"{root}/mv")
    return rounded(wh.new_stats_read(state))


@query
def view_new_stats_ordered(spark, sf):
    """Read of the stored S16 state: statistics by average, largest first (A7's order)."""
    root = work_dir(spark, "view_new_stats_ordered")
    state = wh.save_view(wh.new_stats_state(_active(spark, sf, root)), f"{root}/mv")
    return rounded(wh.new_stats_read(state).orderBy(F.desc_nulls_last("avg_new_cases"), "country_region"))


@query
def view_daily_new_ordered(spark, sf):
    """O2 on the stored S14 view: the daily series in date order."""
    root = work_dir(spark, "view_daily_new_ordered")
    return wh.save_view(wh.daily_new_body(_active(spark, sf, root)), f"{root}/mv").orderBy(F.asc_nulls_last("date"))


@query
def view_top_deaths(spark, sf):
    """O3 on the stored S15 view: ten countries with most deaths, ties by name."""
    root = work_dir(spark, "view_top_deaths")
    return agg.top_k(wh.save_view(wh.deaths_body(_pruned(spark, sf, root)), f"{root}/mv"), "total_deaths", 10)


def _stream(spark, sf, name, body):
    """Stage P as files, then keep the aggregate current with the streaming job."""
    root = work_dir(spark, name)
    fx.panel(spark, sf).write.parquet(f"{root}/in")
    return run_complete_aggregate(spark, f"{root}/in", schemas.PANEL, body, f"{root}/out", f"{root}/ckpt")


@query
def stream_daily_new(spark, sf):
    """T1 on P staged as files: S14 kept current by a complete-mode stream."""
    return _stream(spark, sf, "stream_daily_new", lambda s: wh.daily_new_body(flt.active_rows(s)))


@query
def stream_deaths(spark, sf):
    """T1 on P staged as files: S15 kept current by a complete-mode stream."""
    return _stream(spark, sf, "stream_deaths", wh.deaths_body)


@query
def stream_new_stats(spark, sf):
    """T1 on P staged as files: S16 kept current by a complete-mode stream."""
    state = _stream(spark, sf, "stream_new_stats", lambda s: wh.new_stats_state(flt.active_rows(s)))
    return rounded(wh.new_stats_read(state))


def _orders_as_facts(spark, sf):
    """Orders as base rows: customer, day, the price in cents, and 1 where finished; and what picks their changes."""
    o = read_table(spark, sf, "orders")
    return o.select(F.col("o_custkey").cast("string").alias("country_region"), F.to_date("o_orderdate").alias("date"),
                    F.round(F.col("o_totalprice") * 100).cast("long").alias("cases_since_prev_day"),
                    F.when(F.col("o_orderstatus") == "F", F.lit(1).cast("long")).alias("deaths"),
                    (F.col("o_orderkey") % 10).alias("k"))


def _changed(spark, sf, name, view):
    """T1 under changes: most orders come first; then the rest is inserted, some
    rows move to another customer, day and value, and some are deleted, the files
    in any order.  The job runs after each step and once more with nothing new,
    and the last batch is applied again under its number."""
    root = work_dir(spark, name)
    facts = materialise(_orders_as_facts(spark, sf), name)
    rows = lambda where: facts.where(where).drop("k")
    moved = {"country_region": (F.col("country_region").cast("long") + 7).cast("string"), "date": F.date_add("date", 1),
             "cases_since_prev_day": F.col("cases_since_prev_day") - 10_000_000, "deaths": F.when(F.col("date") < "1998-01-01", F.col("deaths"))}
    base = rows("k < 8").schema
    later = ch.deletions(rows("k in (4, 5)")).unionByName(ch.updates(rows("k in (2, 3)"), moved)).unionByName(ch.inserts(rows("k >= 8")))
    run = lambda: ch.run_changes(spark, view, base, f"{root}/in", f"{root}/view", f"{root}/ckpt")
    ch.inserts(rows("k < 8")).write.mode("append").parquet(f"{root}/in")
    run()
    later.write.mode("append").parquet(f"{root}/in")
    run()
    ch.apply_batch(view, later, f"{root}/view", epoch=1)
    return run()


_ACTIVE_VALUE = "cases_since_prev_day"


@query
def changed_daily_new(spark, sf):
    """T1 on orders with inserts, updates and deletions: S14 kept current by signed rows."""
    out = _changed(spark, sf, "changed_daily_new", ch.View(["date"], _ACTIVE_VALUE, flt.active_rows))
    return out.select("date", F.col("total").alias("total_new_cases"))


@query
def changed_deaths(spark, sf):
    """T1 on orders with inserts, updates and deletions: S15 kept current by signed rows."""
    out = _changed(spark, sf, "changed_deaths", ch.View(["country_region"], "deaths"))
    return out.select("country_region", F.col("total").alias("total_deaths"))


@query
def changed_new_stats(spark, sf):
    """T1 on orders with inserts, updates and deletions: S16 with its least and greatest value from counts per value."""
    out = _changed(spark, sf, "changed_new_stats", ch.View(["country_region"], _ACTIVE_VALUE, flt.active_rows, extremes=True))
    return out.select("country_region", F.col("total").alias("sum_new_cases"), F.col("n").alias("n_new_cases"),
                      F.col("max").alias("max_new_cases"), F.col("min").alias("min_new_cases"))


@query
def warehouse_active(spark, sf):
    """X4 + S17: the build run twice into one database (tables are replaced), the active table read by name."""
    root = work_dir(spark, "warehouse_active")
    db = wh.create_database(spark, f"epiframe_{uuid.uuid4().hex[:10]}", f"{root}/db")
    for _ in range(2):
        wh.build(fx.panel(spark, sf), root, db)
    return spark.table(f"{db}.panel_active")


# --- S6-S9, T2: comments --------------------------------------------------------------


COMMENT_KEY = " NATION_3 "
FANOUT = ["Nation_1", "Nation_2"]
FETCH_KEYS = ["Nation_1", " NATION_2", "nation_24"]
_COMMENT_OUT = ["country_key", "comment_text", "user", "source", "additional_notes"]


def _store(spark, sf, name):
    return cm.add_comments(fx.comments(spark, sf).drop("timestamp"), f"{work_dir(spark, name)}/store")


@query
def comments_append(spark, sf):
    """S6 on C: comments appended with normalised key, stamp and id; read back."""
    return _store(spark, sf, "comments_append").select(*_COMMENT_OUT)


@query
def comments_for_key(spark, sf):
    """S7 + A16 on C: comments of one key with their count."""
    return cm.comments_for_key(_store(spark, sf, "comments_for_key"), COMMENT_KEY).select(*_COMMENT_OUT, "count")


@query
def comments_fanout(spark, sf):
    """S8 + S6 on C: each comment posted to every selected country."""
    posted = cm.fan_out(fx.comments(spark, sf).drop("timestamp"), FANOUT)
    return cm.add_comments(posted, f"{work_dir(spark, 'comments_fanout')}/store").select(*_COMMENT_OUT)


@query
def comments_selected(spark, sf):
    """X5 round trip: existing comments are stored, the same texts are posted
    to the selected countries (S8, a second append), then the comments of
    several keys are fetched (S9) and see both appends."""
    root = work_dir(spark, "comments_selected")
    posted = fx.comments(spark, sf).drop("timestamp")
    cm.add_comments(posted, f"{root}/store")
    store = cm.add_comments(cm.fan_out(posted, FANOUT), f"{root}/store")
    return cm.comments_for_keys(store, FETCH_KEYS).select(*_COMMENT_OUT)


@query
def stream_comments(spark, sf):
    """T2 on C staged as JSON files: streaming ingestion into the comment store."""
    root = work_dir(spark, "stream_comments")
    fx.comments(spark, sf).drop("timestamp").write.json(f"{root}/in")
    return ingest(spark, f"{root}/in", f"{root}/store", f"{root}/ckpt").select(*_COMMENT_OUT)


@query
def comments_stamped(spark, sf):
    """P24 on C: the appended comments, how many have a time and an id of their own,
    the number of times (one per append), and whether it is the session's UTC time now."""
    store = _store(spark, sf, "comments_stamped")
    age = F.abs(F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("timestamp"))
    return store.agg(F.count(F.lit(1)).alias("n_rows"), F.count("timestamp").alias("n_stamped"), F.count_distinct("comment_id").alias("n_ids"),
                     F.count_distinct("timestamp").alias("n_times"), F.bool_and(age < 3600).alias("fresh"))


def _log(spark, sf, name):
    """The comment log after three appends (all comments, then two fan-outs), merged two by two."""
    posted = materialise(fx.comments(spark, sf).drop("timestamp"), name)
    log = CommentLog(spark, f"{work_dir(spark, name)}/log", fanout=2)
    return log.append(posted).append(cm.fan_out(posted, FANOUT)).append(cm.fan_out(posted, FANOUT[:1]))


@query
def comment_log_key(spark, sf):
    """S6, S7, S8 + A16 on C: comments of one key after appends and merges, files by key range, the count from kept counts."""
    return _log(spark, sf, "comment_log_key").for_key(FANOUT[0]).select(*_COMMENT_OUT, "count")


@query
def comment_log_selected(spark, sf):
    """S9 on C: comments of several keys from the merged segments that hold them."""
    return _log(spark, sf, "comment_log_selected").for_keys(FETCH_KEYS).select(*_COMMENT_OUT)


def _checked(spark, sf, name):
    """C as JSON lines with client ids, every tenth line cut short, every eleventh
    without its user, sent once, then once more with the job run after each."""
    root = work_dir(spark, name)
    conv = read_table(spark, sf, "conversations")
    number = F.concat_ws("-", "conv_id", "turn")
    fields = F.struct(F.concat(F.lit(" Nation_"), F.col("conv_id") % 25).alias("country_key"), F.col("text").alias("comment_text"),
                      F.when(F.col("conv_id") % 11 != 0, F.col("role")).alias("user"), number.alias("client_id"))
    line = F.when(F.col("conv_id") % 10 == 0, F.concat(F.lit('{"country_key": "Nation, turn '), number)).otherwise(F.to_json(fields))
    for _ in range(2):
        conv.select(line.alias("value")).write.mode("append").text(f"{root}/in")
        found = checked_ingest(spark, f"{root}/in", f"{root}/log", f"{root}/rejects", f"{root}/ckpt")
    return found


@query
def stream_comments_checked(spark, sf):
    """T2 on C as JSON lines sent twice: each comment is stored once."""
    return _checked(spark, sf, "stream_checked")[0].read().select("country_key", "comment_text", "user")


@query
def stream_comment_rejects(spark, sf):
    """T2 on C as JSON lines sent twice: the lines that are no comment, with the reason, as often as they came."""
    return _checked(spark, sf, "stream_rejects")[1].groupBy("reason").agg(F.count("*").alias("n_lines"), F.count_distinct("line").alias("n_different"))


# --- M1-M5, F1-F3, F5 -------------------------------------------------------------------


K = 3


def _country_features(spark, sf):
    return km.features(agg.country_totals_positive(fx.panel(spark, sf)))


def _customer_features(spark, sf):
    return km.features(fx.customer_totals(spark, sf))


def _country_labels(spark, sf):
    labels, _ = km.lloyd(_country_features(spark, sf), K)
    return labels


@query
def scaled_features(spark, sf):
    """P17 + M1 on P: standardised log totals per country."""
    return rounded(_country_features(spark, sf))


@query
def kmeans_step(spark, sf):
    """M2 on customer totals: one assignment from quantile seeds and the updated centres."""
    return rounded(km.one_step(_customer_features(spark, sf), K))


@query
def cluster_countries(spark, sf):
    """M2 + M3 on P: deterministic Lloyd k-means labels per country."""
    return _country_labels(spark, sf).select("country_region", "cluster")


@query
def chart_clusters(spark, sf):
    """F5 + J3 + P21 on X1 and the M3 labels."""
    return rounded(charts.clusters(_enriched(spark, sf), _country_labels(spark, sf)))


@query
def cluster_customers(spark, sf):
    """M2 + M3 on customer totals: Lloyd k-means at its fixed point, members and centre per label."""
    labels, _ = km.lloyd(_customer_features(spark, sf), K)
    return rounded(labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.round(F.avg("f0"), 6).alias("c0"),
                                                 F.round(F.avg("f1"), 6).alias("c1")), 5)


@query
def density_fit(spark, sf):
    """M4 on X1: log-log OLS of cases per million on density."""
    return rounded(rg.fit_loglog(_enriched(spark, sf)))


@query
def chart_density(spark, sf):
    """F3 + M5 on X1: fit on the selection, fitted curve ordered by density."""
    return rounded(charts.density_curve(_stored_enriched(spark, sf), SELECTION))


@query
def chart_cases_deaths(spark, sf):
    """F1 on X1: scatter data of the selection, positive values for log axes."""
    return rounded(charts.cases_vs_deaths(_enriched(spark, sf), SELECTION))


@query
def chart_cfr_top20(spark, sf):
    """F2 + O4 + P22 + A15 on X1: top-20 CFR with labels and the axis bound."""
    return rounded(charts.cfr_top(_stored_enriched(spark, sf), None, 20))


# --- M6-M9, J5, F4, S20, A16 -------------------------------------------------------------


HORIZON = 30


def _history_one(spark, sf):
    return fc.history(fx.panel(spark, sf), ONE_COUNTRY)


@query
def history_one(spark, sf):
    """M6 on P: one country's (ds, y) series, ordered."""
    return _history_one(spark, sf).select("ds", "y").orderBy("ds")


@query
def history_with_count(spark, sf):
    """M6 + A16 + O2 on P: the series with its length beside each row."""
    counted = agg.with_count(_history_one(spark, sf), per="country_region")
    return counted.select("ds", "y", "count").orderBy("ds")


@query
def chart_history_json(spark, sf):
    """S20 on P: the series as one JSON record per row."""
    return to_records(_history_one(spark, sf).select("ds", "y").orderBy("ds"))


@query
def future_frame(spark, sf):
    """M8 on P: history dates plus the horizon per country."""
    return fc.future_dates(fc.history(fx.panel(spark, sf)), HORIZON)


@query
def forecast_all(spark, sf):
    """M7 + M9 on P: level-1 forecast with band for every country."""
    return rounded(fc.forecast(fc.history(fx.panel(spark, sf)), HORIZON))


@query
def chart_forecast(spark, sf):
    """F4 + J5 on P: one country's forecast with the actual values beside it."""
    hist = fc.history(fx.panel(spark, sf), SELECTION[0])
    out = fc.forecast(hist, HORIZON, with_actuals=True)
    return rounded(out.select("ds", "yhat", "yhat_lower", "yhat_upper", "y").orderBy("ds"))


# --- E1-E8 ----------------------------------------------------------------------------------


@query
def profile_info(spark, sf):
    """E1 on X1: type and non-null count per column."""
    return pf.column_info(_enriched(spark, sf))


@query
def profile_overview(spark, sf):
    """E3 on P: rows, columns, missing cells, duplicate rows."""
    return pf.overview(fx.panel(spark, sf))


@query
def profile_numeric(spark, sf):
    """E4 on X1: moments, extremes and quantiles per numeric column."""
    return rounded(pf.numeric_summary(_enriched(spark, sf)))


@query
def profile_top_values(spark, sf):
    """E5 on P: most frequent values of every column with distinct counts."""
    panel = fx.panel(spark, sf)
    return pf.top_values(panel, panel.columns, 5)


@query
def profile_report(spark, sf):
    """E2 on P: every section of the report as (section, column_name, item, text, number)."""
    return pf.flat_report(pf.report(fx.panel(spark, sf)))


@query
def profile_order_prices(spark, sf):
    """E4 on all orders: moments, extremes and exact quantiles of the total price."""
    return rounded(pf.numeric_summary(read_table(spark, sf, "orders"), ["o_totalprice"]), 4)


@query
def rank_orders(spark, sf):
    """Global position and average rank of every order by total price (the ranks of E7 and of M2's seeds)."""
    orders = read_table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("price"),
                                                    F.lit(0).alias("k"))
    placed = global_row_number(orders, ["price", "o_orderkey"], "position")
    ranks = grouped_average_ranks(orders, "k", "price", "avg_rank")
    return placed.join(ranks, ["k", "price"]).select("o_orderkey", "position", "avg_rank")


@query
def histogram_infinite(spark, sf):
    """E6 on all orders with some infinite values: finite values binned, infinities counted apart."""
    price = (F.when(F.col("o_orderkey") % 50 == 1, F.lit(float("inf"))).when(F.col("o_orderkey") % 50 == 2, F.lit(float("-inf")))
             .when(F.col("o_orderkey") % 50 == 3, F.lit(None)).otherwise(F.col("o_totalprice").cast("double")))
    return rounded(pf.histogram(read_table(spark, sf, "orders").select(price.alias("price"))), 4)


@query
def metric_labels(spark, sf):
    """P22 on X1: two-decimal labels of cases per km2, NULL where the ratio is."""
    return _enriched(spark, sf).select("country_region", pct_label(F.round("cases_per_km2", 2)).alias("label"))


@query
def panel_records(spark, sf):
    """S20 on P: every row as a JSON record, NULL fields as null."""
    return to_records(fx.panel(spark, sf))


@query
def enriched_csv(spark, sf):
    """X1 from files (S2-S5, P4-P6): D and M written as CSV in the published
    layout with bad, fractional and missing numbers, read by header name,
    enriched, written as CSV, read back."""
    root = work_dir(spark, "enriched_csv")
    name, people, area = F.trim(F.upper("country")), F.col("population_2020"), F.col("area_km2")
    text = (F.when(name == "NATION_5", "n/a").when(name == "NATION_6", F.lit(None))
            .when(name == "NATION_7", F.concat(people.cast("string"), F.lit(".75")))
            .when(name == "NATION_8", "1e6").otherwise(people.cast("string")))
    published = {"Country/Territory": F.col("country"), "Continent": F.col("continent"), "2020 Population": text,
                 "Area (km²)": F.concat(area.cast("string"), F.lit(".0"))}
    dim = fx.dimension(spark, sf).select(*[published.get(f.name, F.lit(None).cast("string")).alias(f.name)
                                           for f in reversed(schemas.POPULATION_CSV.fields)])
    dim.write.option("header", True).csv(f"{root}/population")
    mapping = spark.createDataFrame(fx.MAPPING_ROWS, schemas.MAPPING_CSV)
    mapping.select("target_name", "source_name").coalesce(1).write.option("header", True).csv(f"{root}/mapping")
    out = enrichment.enrich(fx.panel(spark, sf), read_population(spark, f"{root}/population"),
                            read_mapping(spark, f"{root}/mapping"))
    return rounded(read_enriched(spark, write_csv(out, f"{root}/enriched"), "csv"))


@query
def history_coerced(spark, sf):
    """P5 + P6 + M6 on P as text: bad dates drop the row, bad and NULL values are 0."""
    bad = F.col("date").cast("string")
    text = fx.panel(spark, sf).select("country_region", F.when(F.dayofmonth("date") == 31, "31st").otherwise(bad).alias("date"),
                                      F.when(F.dayofmonth("date") == 1, "n/a").when(F.dayofmonth("date") == 2, F.lit(None))
                                      .otherwise(F.col("cases").cast("string")).alias("cases"))
    return fc.history(text)


@query
def profile_histogram(spark, sf):
    """E6 on X1: equal-width histogram per numeric column."""
    return rounded(pf.histogram(_stored_enriched(spark, sf)))


@query
def profile_corr(spark, sf):
    """E7 on X1: Pearson and Spearman correlation per column pair."""
    return rounded(pf.correlations(_enriched(spark, sf)))


@query
def profile_missing(spark, sf):
    """E8 on P: missing count and percentage per column."""
    return rounded(pf.missing(fx.panel(spark, sf)))


@query
def forecast_changepoints(spark, sf):
    """M7 level 2 on P: changepoint trend + seasonality per country, as what
    must hold of each fit: its rows, its future rows, the order of the band,
    residuals that sum to zero, and a band that widens with the horizon."""
    hist = fc.history(fx.panel(spark, sf))
    fit = fc.forecast_changepoints(hist, HORIZON).join(hist, ["country_region", "ds"], "left")
    width = F.col("yhat_upper") - F.col("yhat_lower")
    return fit.groupBy("country_region").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("is_future").alias("n_future"),
        F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds"),
        F.bool_and((F.col("yhat_lower") <= F.col("yhat")) & (F.col("yhat") <= F.col("yhat_upper"))).alias("band_ordered"),
        (F.abs(F.sum(F.when(~F.col("is_future"), F.col("y") - F.col("yhat")))) < 1e-6 * F.sum("y")).alias("residuals_cancel"),
        (F.max_by(width, "ds") >= F.min_by(width, "ds") - F.lit(1e-6)).alias("band_widens"))


@query
def guarded_operators(spark, sf):
    """P23 on P: per operator its rows, its rows for an empty input, and whether it
    refuses an input without a required column before anything runs."""
    panel = fx.panel(spark, sf)
    operators = {"direction_class": (wv.direction_class, _ACTIVE_VALUE), "waves": (wv.waves, _ACTIVE_VALUE), "history": (fc.history, "cases")}

    def refuses(operator, column):
        try:
            operator(panel.drop(column))
        except ValueError:
            return True
        return False

    parts = [operator(panel).agg(F.lit(name).alias("operator"), F.count(F.lit(1)).alias("n_rows"))
             .withColumn("n_rows_empty", operator(panel.where("false")).agg(F.count(F.lit(1)).alias("n")).scalar())
             .withColumn("refuses", F.lit(refuses(operator, column))) for name, (operator, column) in operators.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


#: The column whose sum stands for each built table's content.
BUILT = {"panel_full": "cases", "panel_pruned": "cases_since_prev_day", "panel_active": "cases_since_prev_day",
         "agg_daily_new_cases": "total_new_cases", "agg_total_deaths": "total_deaths", "agg_new_case_stats": "sum_new_cases"}


def _contents(tables):
    """Each built table's columns, row count and sum."""
    parts = [t.select(F.lit(n).alias("table_name"), F.lit(",".join(t.columns)).alias("columns"),
                      F.count(F.lit(1)).alias("n_rows"), F.sum(BUILT[n]).cast("bigint").alias("total")) for n, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query
def warehouse_build(spark, sf):
    """Run the whole build; each table's columns, row count and sum."""
    return _contents(wh.build(fx.panel(spark, sf), work_dir(spark, "warehouse")))


@query
def rebuild_changed_month(spark, sf):
    """X4 on P, built twice: one month differs the second time and is the only one
    written; each table's row count and sum after that."""
    panel = materialise(fx.panel(spark, sf), "rebuild")
    root = work_dir(spark, "rebuild")
    odd = F.date_format("date", "yyyy-MM") == "1996-03"
    rb.rebuild(panel.withColumn("cases_since_prev_day", F.when(odd, F.lit(1).cast("long")).otherwise(F.col("cases_since_prev_day"))), root)
    tables, months = rb.rebuild(panel, root)
    return _contents(tables).drop("columns").withColumn("months_written", F.lit(",".join(months)))


@query
def nearest_countries(spark, sf):
    """J4 on P and D: for every normalised country name of the facts the nearest name of the dimension within three edits."""
    return nearest_names(fx.panel(spark, sf).select(norm("country_region")), fx.dimension(spark, sf).select(norm("country")), edits=3)
