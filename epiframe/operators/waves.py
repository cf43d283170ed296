"""Row-pattern wave detection: UP+ PLATEAU* DOWN+ per entity.

Semantics of the pattern query being rebuilt: rows of each entity in
``order``; a row is UP / PLATEAU / DOWN when its value is >, =, < the value
of the previous row of the partition (no class when either is NULL); a
match is one or more UP, zero or more PLATEAU, one or more DOWN; one output
row per match, matching resumes after the last row of a match.

Because the three classes are exclusive and the quantifiers greedy, a match
is exactly: an UP run, optionally one PLATEAU run, then a DOWN run, adjacent.
So the operator works on runs (gaps and islands):

1. class per row from ``lag`` over (entity ORDER BY order);
2. run id = running count of class changes;
3. aggregate each run (class, first/last order value, sum, max);
4. ``lag`` over runs: keep DOWN runs preceded by UP, or by PLATEAU then UP.

All windows and the run aggregate share ``partitionBy(entity)``, so the plan
has a single hash exchange.  A task holds one entity's rows; in an
entity-by-day panel that is bounded by the number of days, whatever the
entity's share of the raw facts.
Precondition: (entity, order) is unique (``assert_unique_order``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from epiframe.operators.guards import require_columns
from epiframe.session import materialise

UP, PLATEAU, DOWN = "UP", "PLATEAU", "DOWN"
# Inside ``waves`` the classes are small integers (hash-aggregatable, cheap
# to compare): 0 = no class, 1 = up, 2 = plateau, 3 = down.
_N, _U, _P, _D = 0, 1, 2, 3


def _class(value: Column, prev: Column) -> Column:
    return (F.when(value.isNull() | prev.isNull(), F.lit(None).cast("string"))
            .when(value > prev, F.lit(UP))
            .when(value == prev, F.lit(PLATEAU))
            .otherwise(F.lit(DOWN)))


def direction_class(df: DataFrame, entity: str = "country_region", order: str = "date",
                    value: str = "cases_since_prev_day", out: str = "direction") -> DataFrame:
    """UP / PLATEAU / DOWN versus the previous row of the entity; NULL
    when this or the previous value is NULL (and on the first row)."""
    require_columns(df, entity, order, value)
    w = Window.partitionBy(entity).orderBy(order)
    return df.withColumn(out, _class(F.col(value), F.lag(value).over(w)))


def _code(value: Column, prev: Column) -> Column:
    return (F.when(value.isNull() | prev.isNull(), F.lit(_N))
            .when(value > prev, F.lit(_U)).when(value == prev, F.lit(_P)).otherwise(F.lit(_D)))


def waves(df: DataFrame, entity: str = "country_region", order: str = "date",
          value: str = "cases_since_prev_day") -> DataFrame:
    """W2 + W3: one row per wave with (entity, wave_start_date, wave_end_date,
    total_cases_in_wave, peak_cases_in_wave)."""
    require_columns(df, entity, order, value)
    w = Window.partitionBy(entity).orderBy(order)
    rows = df.select(entity, order, value)
    marked = rows.withColumn("_cls", _code(F.col(value), F.lag(value).over(w)))
    changed = F.when(F.lag("_cls").over(w).eqNullSafe(F.col("_cls")), 0).otherwise(1)
    runs_of_rows = marked.withColumn(
        "_run", F.sum(changed).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = (runs_of_rows.groupBy(entity, "_run")
            .agg(F.max("_cls").alias("_cls"), F.min(order).alias("_first"), F.max(order).alias("_last"),
                 F.sum(value).alias("_sum"), F.max(value).alias("_max")))
    wr = Window.partitionBy(entity).orderBy("_run")
    lagged = runs.select(
        "*",
        *[F.lag(c, i).over(wr).alias(f"{c}{i}") for c in ("_cls", "_first", "_sum", "_max") for i in (1, 2)])
    two = F.col("_cls1") == _U
    three = (F.col("_cls1") == _P) & (F.col("_cls2") == _U)
    return (lagged.filter((F.col("_cls") == _D) & (two | three))
            .select(
                F.col(entity),
                F.when(two, F.col("_first1")).otherwise(F.col("_first2")).alias("wave_start_date"),
                F.col("_last").alias("wave_end_date"),
                F.when(two, F.col("_sum") + F.col("_sum1"))
                 .otherwise(F.col("_sum") + F.col("_sum1") + F.col("_sum2")).cast("bigint")
                 .alias("total_cases_in_wave"),
                F.when(two, F.greatest("_max", "_max1"))
                 .otherwise(F.greatest("_max", "_max1", "_max2")).alias("peak_cases_in_wave")))


def long_waves(df: DataFrame, entity: str = "country_region", order: str = "date",
               value: str = "cases_since_prev_day", partitions: int | None = None) -> DataFrame:
    """``waves`` for series too long for one task: same rows, but an entity may lie in
    any number of range partitions of (entity, order).

    Each partition turns its rows into runs, its first row being compared with the
    last one of the partition before (one row per partition is sent).  A wave whose
    runs are complete inside a partition is found there.  What is open at a cut
    is summarised: of an entity that goes on across it, the three runs on either
    side with their partial measures, at most twelve rows per partition.  One scan
    over these summaries in order merges runs that go on and finds the waves
    that cross cuts, over however many partitions.  Null entities are one entity;
    precondition as for ``waves``."""
    require_columns(df, entity, order, value)
    ranged = df.select(F.col(entity).alias("_e"), F.col(order).alias("_o"), F.col(value).alias("_v"))
    ranged = ranged.repartitionByRange(partitions, "_e", "_o") if partitions else ranged.repartitionByRange("_e", "_o")
    stored = materialise(ranged.withColumn("_pid", F.spark_partition_id()), "wave_rows")

    # one row per partition: the last row before it, and which entity goes on at either end
    ends = stored.groupBy("_pid").agg(F.min(F.struct("_e", "_o")).alias("_min"), F.max(F.struct("_e", "_o", "_v")).alias("_max"))
    by_pid = Window.orderBy("_pid")
    ends = materialise(ends.select("_pid", F.col("_min._e").alias("_head"), F.col("_max._e").alias("_tail"),
                                   F.lag("_max").over(by_pid).alias("_prev"), F.lead("_min").over(by_pid).alias("_next")), "wave_ends")

    part = Window.partitionBy("_pid", "_e").orderBy("_o")
    before = F.when(F.row_number().over(part) > 1, F.lag("_v").over(part)).otherwise(
        F.when(F.col("_prev").isNotNull() & F.col("_prev._e").eqNullSafe(F.col("_e")), F.col("_prev._v")))
    marked = stored.join(F.broadcast(ends.select("_pid", "_prev")), "_pid").withColumn("_cls", _code(F.col("_v"), before))
    changed = F.when(F.lag("_cls").over(part).eqNullSafe(F.col("_cls")), 0).otherwise(1)
    rows = marked.withColumn("_run", F.sum(changed).over(part.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = rows.groupBy("_pid", "_e", "_run").agg(F.max("_cls").alias("_cls"), F.min("_o").alias("_first"), F.max("_o").alias("_last"),
                                                  F.sum("_v").alias("_sum"), F.max("_v").alias("_max"))
    goes_on = {"_left": F.col("_prev").isNotNull() & F.col("_e").eqNullSafe(F.col("_head")) & F.col("_prev._e").eqNullSafe(F.col("_e")),
               "_right": F.col("_next").isNotNull() & F.col("_e").eqNullSafe(F.col("_tail")) & F.col("_next._e").eqNullSafe(F.col("_e"))}
    number = F.count(F.lit(1)).over(Window.partitionBy("_pid", "_e"))
    runs = runs.withColumn("_n", number).join(F.broadcast(ends), "_pid").withColumns(goes_on)
    # a run and the two before it are all inside and complete
    inside = (~F.col("_left") | (F.col("_run") > 3)) & (~F.col("_right") | (F.col("_run") < F.col("_n")))
    runs = materialise(runs.withColumn("_inside", inside).select(
        "_pid", "_e", "_run", "_n", "_left", "_right", "_inside", "_cls", "_first", "_last", "_sum", "_max"), "wave_runs")
    found = _waves_of_runs(runs.withColumn("_joined", F.lit(True)), Window.partitionBy("_pid", "_e").orderBy("_run"), F.col("_inside"))

    at_cut = runs.where("_left and _run <= 3 or _right and _run > _n - 3")
    line = Window.orderBy("_pid", "_e", "_run")
    crossing = F.col("_left") & (F.col("_run") == 1)
    at_cut = at_cut.withColumns({
        # the run before in the series is the row before: across the cut, or in the same partition
        "_joined": crossing | ((F.lag("_pid").over(line) == F.col("_pid")) & F.lag("_e").over(line).eqNullSafe(F.col("_e"))
                               & (F.lag("_run").over(line) == F.col("_run") - 1)),
        "_same": crossing & (F.lag("_cls").over(line) == F.col("_cls"))})
    whole = at_cut.withColumn("_run_id", F.sum(F.when(F.coalesce("_same", F.lit(False)), 0).otherwise(1)).over(
        line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = whole.groupBy("_run_id").agg(
        F.first("_e").alias("_e"), F.max("_cls").alias("_cls"), F.min("_first").alias("_first"), F.max("_last").alias("_last"),
        F.sum("_sum").alias("_sum"), F.max("_max").alias("_max"), F.bool_and("_inside").alias("_inside"),
        F.coalesce(F.min_by("_joined", F.struct("_pid", "_run")), F.lit(False)).alias("_joined"))
    found = found.unionByName(_waves_of_runs(merged, Window.orderBy("_run_id"), ~F.col("_inside")))
    return found.withColumnRenamed("_e", entity)


def _waves_of_runs(runs: DataFrame, line, wanted: Column) -> DataFrame:
    """The waves that end in a ``wanted`` run, runs being in the order of the window
    ``line``; ``_joined`` says whether a run follows the one before it without a gap."""
    lagged = runs.select("*", *[F.lag(c, i).over(line).alias(f"{c}{i}") for c in ("_cls", "_first", "_sum", "_max") for i in (1, 2)],
                         F.lag("_joined").over(line).alias("_joined1"))
    two = F.col("_joined") & (F.col("_cls1") == _U)
    three = F.col("_joined") & F.col("_joined1") & (F.col("_cls1") == _P) & (F.col("_cls2") == _U)
    return lagged.filter((F.col("_cls") == _D) & wanted & (two | three)).select(
        "_e", F.when(two, F.col("_first1")).otherwise(F.col("_first2")).alias("wave_start_date"), F.col("_last").alias("wave_end_date"),
        F.when(two, F.col("_sum") + F.col("_sum1")).otherwise(F.col("_sum") + F.col("_sum1") + F.col("_sum2")).cast("bigint").alias("total_cases_in_wave"),
        F.when(two, F.greatest("_max", "_max1")).otherwise(F.greatest("_max", "_max1", "_max2")).alias("peak_cases_in_wave"))


def assert_unique_order(df: DataFrame, entity: str = "country_region", order: str = "date") -> DataFrame:
    """Rows violating the (entity, order) uniqueness precondition (empty = ok)."""
    return df.groupBy(entity, order).count().filter(F.col("count") > 1)
