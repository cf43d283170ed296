"""Table profiling (E1, E3-E8) — the content of an exploratory report.

Column-wise profiles (E4, E6) unpivot the values with ``inline`` inside the
scan stage and run one small grouped aggregate keyed by column, so a profile is
a single pass with map-side partial aggregation and the expanded rows are never
shuffled.  Table-wide counts (E1, E8) are one aggregate reshaped to one row per
column.  Duplicate rows (E3) are found by fingerprints, frequent values (E5) by
summaries whose completeness a second scan proves.  Quantiles are exact at any size (the value at
rank ceil(p * n), by ``radix``), correlations come from sums per column pair
(``comoments``), skewness and kurtosis are the population (moment) forms, the
standard deviation is the sample one.  NaN counts as missing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F, types as T

from epiframe.functions.numeric import finite
from epiframe.operators.comoments import correlation, pair_sums
from epiframe.operators.radix import order_statistics
from epiframe.operators.ranking import row_average_ranks
from epiframe.session import materialise

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
QUANTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def _num(c: str):
    """The column as double with NaN treated as missing (NULL)."""
    x = F.col(f"`{c}`").cast("double")
    return F.nanvl(x, F.lit(None).cast("double"))


def _missing(f: T.StructField):
    """NULL, or NaN for floating columns (pandas' notion of missing)."""
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def column_info(df: DataFrame) -> DataFrame:
    """(column_name, data_type, non_null, position), one row per column;
    NaN counts as missing in floating columns."""
    counts = df.agg(*[F.count(F.when(~_missing(f), F.lit(1))).alias(f"n{i}") for i, f in enumerate(df.schema.fields)])
    structs = [F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"),
                        F.col(f"n{i}").alias("non_null"), F.lit(i).alias("position"))
               for i, f in enumerate(df.schema.fields)]
    return counts.select(F.inline(F.array(*structs)))


def _prints(df: DataFrame) -> list:
    """Two 64-bit hashes of a row.  Rows that are equal (NULL equal to NULL) have equal ones."""
    cells = [x for f in df.schema.fields for x in (F.col(f"`{f.name}`").isNull(), F.col(f"`{f.name}`"))]
    return [F.xxhash64(F.lit(seed), *cells).alias(f"_h{seed}") for seed in (1, 2)]


def overview(df: DataFrame) -> DataFrame:
    """n_rows, n_columns, missing_cells, duplicate_rows.

    Rows are counted by a 128-bit fingerprint, so whole rows stay where they are:
    the shuffle has 16 bytes and two counts per different row of a task.  Rows
    that are alone with their fingerprint are different from all others.  Only
    where several share one does a second scan compare those rows as a whole
    (they are copies unless fingerprints collide)."""
    missing_in_row = sum((F.when(_missing(f), 1).otherwise(0) for f in df.schema.fields), F.lit(0))
    groups = df.select(*_prints(df), missing_in_row.alias("_m")).groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n"), F.sum("_m").alias("_m"))
    shared = F.col("_n") > 1
    folded = groups.groupBy(F.when(shared, F.col("_h1")).alias("_h1"), F.when(shared, F.col("_h2")).alias("_h2")).agg(
        F.sum("_n").alias("_n"), F.sum("_m").alias("_m"))
    prints = materialise(folded, "profile_prints")  # a row for all that are alone, one per shared fingerprint
    counts = prints.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("n_rows"), F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
                        F.coalesce(F.sum("_m"), F.lit(0)).cast("bigint").alias("missing_cells"))
    again = prints.where("_h1 is not null").select("_h1", "_h2")
    if again.isEmpty():
        return counts.withColumn("duplicate_rows", F.lit(0).cast("bigint"))
    copies = df.select("*", *_prints(df)).join(again, ["_h1", "_h2"], "left_semi").drop("_h1", "_h2")
    copies = copies.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg((F.count(F.lit(1)) - 1).alias("_more"))
    more = copies.agg(F.coalesce(F.sum("_more"), F.lit(0)).cast("bigint").alias("n"))
    return counts.withColumn("duplicate_rows", more.scalar())


def _long(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """Unpivot ``columns`` to (_k, _x): column index and value as double
    (NaN -> NULL).  Generated inside the scan's stage, so it feeds the
    partial aggregation directly and never shuffles the expanded rows."""
    structs = [F.struct(F.lit(i).alias("_k"), _num(c).alias("_x")) for i, c in enumerate(columns)]
    return df.select(*(keep or []), F.inline(F.array(*structs)))


def _name(columns: list[str], idx: str = "_k"):
    return F.element_at(F.array(*[F.lit(c) for c in columns]), F.col(idx) + 1)


def numeric_summary(df: DataFrame, columns: list[str] | None = None, stored: bool = False) -> DataFrame:
    """Per numeric column — count, missing, zeros, negatives, min, max,
    mean, std, p25, p50, p75, skewness, kurtosis (excess).  One grouped
    aggregate over the unpivoted values, one group per column, and exact
    quantiles by radix selection (``radix``), which counts instead of moving
    values (NaN counts as missing).  The numeric columns are written once, as
    every pass reads them, unless ``df`` is ``stored`` already."""
    columns = columns or numeric_columns(df)
    df = df.select(*[_num(c).alias(c) for c in columns])
    df = df if stored else materialise(df, "profile_numeric")
    x = F.col("_x")
    stats = (_long(df, columns).groupBy("_k").agg(
        F.count(x).alias("n"), F.sum(F.when(x.isNull(), 1).otherwise(0)).cast("bigint").alias("n_missing"),
        F.sum(F.when(x == 0, 1).otherwise(0)).cast("bigint").alias("n_zeros"),
        F.sum(F.when(x < 0, 1).otherwise(0)).cast("bigint").alias("n_negative"),
        F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis")))
    # one row per column, also on an empty input
    quantiles = [(k, c, *q.values()) for k, (c, q) in enumerate(zip(columns, order_statistics(df, columns, QUANTILES)))]
    quantiles = df.sparkSession.createDataFrame(quantiles, f"_k int, column_name string, {', '.join(f'{q} double' for q in QUANTILES)}")
    counts = {c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in ("n", "n_missing", "n_zeros", "n_negative")}
    return (F.broadcast(quantiles).join(stats, "_k", "left")
            .select("column_name", *counts.values(), "min", "max", "mean", "std", *QUANTILES, "skewness", "kurtosis"))


def top_values(df: DataFrame, columns: list[str], k: int = 5, tracked: int = 10_000, buckets: int = 1 << 16,
               stored: bool = False) -> DataFrame:
    """E5: per column, the k most frequent non-null values (ties by value),
    with their rank, the column's distinct count and its non-null count; exact.

    A mergeable summary of ``tracked`` counters per column names candidates.  A
    second scan counts these exactly and all other values by ``buckets`` hash
    buckets.  No value is more frequent than its bucket, so a bucket below the
    k-th candidate proves that nothing is missing there; the values of other
    buckets, if any, are counted in a third scan.  The shuffles of the first two
    hold columns x (tracked + buckets) counts per task at most, whatever the
    number of values.  Distinct values beyond the candidates are counted by
    128-bit fingerprints (two different values share one with a chance of
    n^2 / 2^129).  The columns are written once, unless ``df`` is ``stored`` already."""
    df = df.select(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(columns)])
    df, names = df if stored else materialise(df, "profile_values"), range(len(columns))
    summary = df.agg(*[F.expr(f"approx_top_k(c{i}, {tracked}, {tracked})").alias(f"c{i}") for i in names])
    named = summary.select(F.inline(F.array(*[F.struct(F.lit(i).alias("_k"), F.col(f"c{i}.item").alias("items")) for i in names])))
    named = materialise(named.select("_k", F.explode("items").alias("value")).where("value is not null").withColumn("_known", F.lit(True)), "profile_named")
    long = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("_k"), F.col(f"c{i}").alias("value")) for i in names]))).where("value is not null")
    marked = (long.join(F.broadcast(named), ["_k", "value"], "left")
              .withColumn("_bucket", F.when(F.col("_known").isNull(), F.pmod(F.xxhash64("value"), F.lit(buckets)).cast("int"))))
    counts = materialise(marked.groupBy("_k", F.when(F.col("_known"), F.col("value")).alias("value"), "_bucket")
                         .agg(F.count(F.lit(1)).alias("freq")), "profile_counts")
    order = Window.partitionBy("_k").orderBy(F.desc("freq"), F.asc("value"))
    found = counts.where("value is not null").select("_k", "value", "freq")
    # the k-th candidate of each column: one number per column
    least = {r["_k"]: r["freq"] for r in found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).collect()}
    floor = F.coalesce(F.get(F.array(*[F.lit(least.get(i, 0)) for i in names]), F.col("_k")), F.lit(0))
    open_ = counts.where(F.col("_bucket").isNotNull() & (F.col("freq") >= floor)).select("_k", "_bucket")
    if not open_.isEmpty():
        more = marked.where("_bucket is not null").join(F.broadcast(open_), ["_k", "_bucket"]).groupBy("_k", "value").agg(F.count(F.lit(1)).alias("freq"))
        found = found.unionByName(more)
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    totals = counts.groupBy("_k").agg(F.sum("freq").cast("bigint").alias("n_values"), F.count("value").alias("_named"),
                                      F.max("_bucket").isNotNull().alias("_more"))
    rest = [r["_k"] for r in totals.where("_more").collect()]
    if rest:
        prints = long.where(F.col("_k").isin(rest)).select("_k", F.xxhash64("value").alias("_h1"), F.xxhash64(F.lit(1), "value").alias("_h2"))
        distinct = prints.groupBy("_k", "_h1", "_h2").agg(F.lit(1)).groupBy("_k").agg(F.count(F.lit(1)).alias("_distinct"))
        totals = totals.join(distinct, "_k", "left").withColumn("_named", F.coalesce("_distinct", "_named"))
    return (top.join(F.broadcast(totals), "_k")
            .select(_name(columns).alias("column_name"), "value", "freq", "rank", F.col("_named").alias("n_distinct"), "n_values"))


def histogram(df: DataFrame, columns: list[str] | None = None, bins: int = 10) -> DataFrame:
    """Equal-width bins over [min, max] per column: (column_name, bin, lo,
    hi, freq) for non-empty bins; the max falls in the last bin, a constant
    column in bin 0.  Infinite values have no bin: they are counted apart, in
    rows with a NULL bin whose lo and hi are that infinity.  Two passes: min/max per column, then (column, bin)
    counts; the per-column bounds table has one row per column."""
    columns = columns or numeric_columns(df)
    long = _long(df, columns).filter(F.col("_x").isNotNull())
    fin = finite("_x")
    bounds = long.groupBy("_k").agg(F.min(fin).alias("_lo"),
                                    ((F.max(fin) - F.min(fin)) / F.lit(float(bins))).alias("_w"))
    x, lo, w = F.col("_x"), F.col("_lo"), F.col("_w")
    b = F.when(fin.isNull(), F.lit(None)).when(w == 0, F.lit(0)).otherwise(F.least(F.floor((x - lo) / w).cast("int"), F.lit(bins - 1)))
    odd = F.when(fin.isNull(), x)
    edge = F.col("_odd")
    return (long.join(F.broadcast(bounds), "_k").withColumn("bin", b).withColumn("_odd", odd)
            .groupBy("_k", "bin", "_odd").agg(F.count(F.lit(1)).alias("freq"), F.first("_lo").alias("_lo"),
                                              F.first("_w").alias("_w"))
            .select(_name(columns).alias("column_name"), "bin", F.coalesce(edge, lo + F.col("bin") * w).alias("lo"),
                    F.coalesce(edge, lo + (F.col("bin") + 1) * w).alias("hi"), "freq"))


def correlations(df: DataFrame, columns: list[str] | None = None, stored: bool = False) -> DataFrame:
    """Every column pair (a before b): Pearson over pairwise-complete rows,
    Spearman (Pearson of average ranks) over rows complete in all columns.
    Both come from sums per pair that each task adds up over its rows
    (``comoments``).  Ranks come from one range sort of all (column, value, row)
    and travel back to their rows by the row number, so a frequent value is
    neither a join key nor one task's work."""
    columns = columns or numeric_columns(df)
    p = len(columns)
    # The numeric projection is read several times: written once in the shared
    # checkpoint folder instead of recomputing the upstream plan.
    num = df.select(*[_num(c).alias(f"c{i}") for i, c in enumerate(columns)]).withColumn("_row", F.monotonically_increasing_id())
    num = num if stored else materialise(num, "profile_corr")
    values = [F.col(f"c{i}") for i in range(p)]
    *means, complete = num.agg(*[F.coalesce(F.avg(finite(v)), F.lit(0.0)) for v in values],
                               F.count_if(reduce(lambda a, b: a & b, [v.isNotNull() for v in values]))).first()
    linear = pair_sums(num.select(F.array(*values)), means).select("i", "j", correlation().alias("pearson"))
    long = num.dropna().select("_row", F.inline(F.array(*[F.struct(F.lit(i).alias("_k"), v.alias("_v")) for i, v in enumerate(values)])))
    ranks = row_average_ranks(long, "_k", "_v", "_row", "_r")
    per_row = ranks.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("_k", "_r"))).alias("ranks"))
    ranked = pair_sums(per_row.select(F.col("ranks._r").alias("ranks")), [(complete + 1) / 2] * p).select("i", "j", correlation().alias("spearman"))
    names = F.array(*[F.lit(c) for c in columns])
    return (linear.join(ranked, ["i", "j"], "left")
            .select(F.get(names, F.col("i")).alias("column_a"), F.get(names, F.col("j")).alias("column_b"), "pearson", "spearman"))


def missing(df: DataFrame) -> DataFrame:
    """(column_name, n_missing, pct_missing) per column."""
    aggs = [F.count(F.lit(1)).alias("_n")] + [
        F.sum(F.when(_missing(f), 1).otherwise(0)).cast("bigint").alias(f"m{i}")
        for i, f in enumerate(df.schema.fields)]
    structs = [F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("n_missing"),
                        (F.try_divide(F.col(f"m{i}").cast("double"), F.col("_n").cast("double")) * 100.0)
                        .alias("pct_missing"))
               for i, c in enumerate(df.columns)]
    return df.agg(*aggs).select(F.inline(F.array(*structs)))


def report(df: DataFrame, top_columns: list[str] | None = None, k: int = 5,
           bins: int = 10) -> dict[str, DataFrame | None]:
    """The full exploratory profile of a table, section by section.
    The table is written once and every section reads that copy, in a number of
    scans that does not depend on its size.  Sections are DataFrames;
    ``correlations`` is None when the table has fewer than two numeric columns."""
    numeric = numeric_columns(df)
    df = materialise(df, "profile")
    non_numeric = [f.name for f in df.schema.fields if f.name not in numeric]
    return {
        "info": column_info(df),
        "overview": overview(df),
        "numeric": numeric_summary(df, numeric, stored=True),
        "top_values": top_values(df, top_columns or non_numeric or df.columns, k, stored=True),
        "histogram": histogram(df, numeric, bins),
        "missing": missing(df),
        "correlations": correlations(df, numeric, stored=True) if len(numeric) >= 2 else None,
    }


def flat_report(sections: dict[str, DataFrame | None], places: int = 6) -> DataFrame:
    """A report as one long table (section, column_name, item, text, number):
    every cell of every section, numbers rounded to ``places`` in ``number``,
    other values in ``text``.  A section's own keys (a value's rank, a bin, the
    second column of a pair) are part of ``item``."""
    keys = {"top_values": ["rank"], "histogram": ["bin"], "correlations": ["column_b"]}
    parts = []
    for name, df in sections.items():
        if df is None:
            continue
        first = "column_a" if name == "correlations" else "column_name"
        own = keys.get(name, [])
        cells = []
        for f in df.schema.fields:
            if f.name in (first, *own):
                continue
            c, number = F.col(f"`{f.name}`"), isinstance(f.dataType, NUMERIC)
            item = F.concat_ws(" ", F.lit(f.name), *[F.coalesce(F.col(k).cast("string"), F.lit("none")) for k in own])
            cells.append(F.struct(item.alias("item"), (F.lit(None) if number else c).cast("string").alias("text"),
                                  (F.round(c.cast("double"), places) if number else F.lit(None).cast("double")).alias("number")))
        column = F.col(first) if first in df.columns else F.lit("")
        parts.append(df.select(F.lit(name).alias("section"), column.alias("column_name"), F.inline(F.array(*cells))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
