import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from epiframe.operators import profile as pf
from epiframe.operators.ranking import global_row_number, grouped_average_ranks, grouped_quantiles, row_average_ranks

N = 300_000


def _rows(spark):
    """Values with ties, and columns the ranks do not read."""
    value = F.pmod(F.xxhash64("id"), F.lit(200_000)).cast("double")
    return spark.range(0, N, 1, 8).select("id", value.alias("v"), (F.col("v") * 0.5 + F.pmod(F.xxhash64("id", "v"), F.lit(100_000)))
                                          .alias("w"), F.lit("payload").alias("text"), F.lit("k").alias("k"))


def test_positions_ranks_and_quantiles_beyond_sampled_sizes(spark):
    df = _rows(spark)
    pdf = df.toPandas()
    got = global_row_number(df, ["v", "id"], "pos", partitions=8).select("id", "pos").toPandas().set_index("id")["pos"]
    order = pdf.sort_values(["v", "id"])["id"].to_numpy()
    assert (got.loc[order].to_numpy() == np.arange(N)).all()
    ranks = grouped_average_ranks(df.select("k", "v", "text"), "k", "v").toPandas().set_index("v")["rank"]
    assert (ranks.loc[pdf["v"]].to_numpy() == pdf["v"].rank().to_numpy()).all()
    q = grouped_quantiles(df, "k", "v", {"a": 0.25, "b": 0.5, "c": 0.75}).first()
    ordered = np.sort(pdf["v"].to_numpy())
    assert [q["a"], q["b"], q["c"]] == [ordered[int(np.ceil(p * N)) - 1] for p in (0.25, 0.5, 0.75)]


def test_spearman_equals_pandas(spark):
    df = _rows(spark).select("v", "w")
    got = pf.correlations(df).first()
    pdf = df.toPandas()
    assert abs(got["spearman"] - pdf["v"].rank().corr(pdf["w"].rank())) < 1e-9
    assert abs(got["pearson"] - pdf["v"].corr(pdf["w"])) < 1e-9


def test_quantiles_of_small_and_empty_groups(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("b", 2.0), ("c", None)], "k string, v double")
    got = {r["k"]: r["p"] for r in grouped_quantiles(df, "k", "v", {"p": 0.5}).collect()}
    assert got == {"a": 1.0, "b": 2.0}
    assert pd.isna(pf.numeric_summary(df.where("k = 'c'"), ["v"]).first()["p50"])


@pytest.mark.parametrize("partitions", [1, 7, None])
def test_row_ranks_with_values_that_span_partitions(spark, partitions):
    """A value nine rows in ten share, columns of different sizes, constants: pandas ranks."""
    rng = np.random.default_rng(4)
    cols = {0: np.where(rng.random(5000) < 0.9, 0.0, rng.normal(0, 1, 5000)), 1: np.full(3000, 2.5), 2: rng.integers(0, 40, 4000).astype(float),
            4: np.array([1.0])}
    rows = [(k, float(v), i) for k, x in cols.items() for i, v in enumerate(x)]
    long = spark.createDataFrame(rows, "k int, v double, r long").repartition(6)
    got = {(r["k"], r["r"]): r["rank"] for r in row_average_ranks(long, "k", "v", "r", partitions=partitions).collect()}
    assert got == {(k, i): x for k, v in cols.items() for i, x in enumerate(pd.Series(v).rank())}


def test_hot_value_is_spread_and_no_join_shuffles_by_value(spark):
    df = spark.range(0, 40_000, 1, 4).select(F.lit(0).alias("k"), F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(0).cast("double").alias("v"), "id")
    ranks = row_average_ranks(df, "k", "v", "id", partitions=16)
    plan = ranks._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
    assert "SortMergeJoin" not in plan and dealt and not any("v#" in x for x in dealt)
    assert ranks.agg(F.sum("rank")).first()[0] == 40_000 * 40_001 / 2


def test_correlations_with_nulls_constants_infinities_and_a_zero_column(spark):
    rng = np.random.default_rng(8)
    n = 4000
    base = rng.normal(0, 1, n)
    pdf = pd.DataFrame({"a": 1e9 + base, "zeros": np.where(rng.random(n) < 0.9, 0.0, base), "const": np.full(n, 0.1), "b": base + rng.normal(0, 1, n)})
    pdf.loc[::7, "b"] = np.nan
    got = {(r.column_a, r.column_b): r for r in pf.correlations(spark.createDataFrame(pdf).repartition(5)).collect()}
    assert len(got) == 6
    full = pdf.dropna().rank()
    for (x, y), r in got.items():
        if "const" in (x, y):
            assert r.pearson is None and r.spearman is None
        else:
            assert abs(r.pearson - pdf[x].corr(pdf[y])) < 1e-7 and abs(r.spearman - full[x].corr(full[y])) < 1e-9
    odd = spark.createDataFrame([(1.0, 2.0, float("inf")), (2.0, 1.0, 3.0), (4.0, 0.5, 1.0)], "a double, b double, c double")
    got = {(r.column_a, r.column_b): r for r in pf.correlations(odd).collect()}
    assert got["a", "c"].pearson is None and abs(got["a", "c"].spearman + 1) < 1e-9 and abs(got["a", "b"].spearman + 1) < 1e-9
    assert [tuple(r) for r in pf.correlations(odd.limit(0)).collect()] in ([], [("a", "b", None, None), ("a", "c", None, None), ("b", "c", None, None)])
