"""Order statistics by radix selection against sorting."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from epiframe.operators import profile as pf
from epiframe.operators.radix import image, order_statistics, value

SHARES = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p100": 1.0}
SPECIAL = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308,
           -1.7976931348623157e308, math.inf, -math.inf, 0.1, 3.0, math.nextafter(8.0, 0), 8.0, math.nextafter(8.0, 9)]


def bits_of(x):
    b = struct.unpack(">q", struct.pack(">d", abs(x)))[0]
    return -b if x < 0 else b


def test_image_is_the_bits_of_every_kind_of_double(spark):
    rng = random.Random(3)
    xs = SPECIAL + [struct.unpack(">d", struct.pack(">Q", rng.getrandbits(64)))[0] for _ in range(20_000)]
    xs += [s * 2.0 ** e * f for e in range(-1074, 1024, 7) for s in (1, -1) for f in (1, 1 + 2 ** -52)]
    xs = [x for x in xs if not math.isnan(x)]
    got = [r[1] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
           .select("i", image(F.col("x"))).orderBy("i").collect()]
    assert got == [bits_of(x) for x in xs]
    assert all(value(b) == x for b, x in zip(got, xs))
    odd = spark.createDataFrame([(float("nan"),), (None,)], "x double").select(image(F.col("x")))
    assert [r[0] for r in odd.collect()] == [None, None]


def expected(xs):
    ordered = sorted(x for x in xs if x is not None and not math.isnan(x))
    return {k: ordered[max(1, math.ceil(p * len(ordered))) - 1] if ordered else None for k, p in SHARES.items()}


@pytest.mark.parametrize("sort_up_to", [1, 40, 1 << 16])
def test_order_statistics_equal_sorting(spark, sort_up_to):
    """All passes (one row left at most), a few, or none: the same values."""
    rng = np.random.default_rng(1)
    n = 3_000
    cols = {"normal": rng.normal(0, 1e3, n).tolist(), "hot": [0.0 if i % 10 else float(i) for i in range(n)],
            "wide": [SPECIAL[i % len(SPECIAL)] * rng.random() for i in range(n)], "one": [7.5] * n,
            "close": (1e9 + rng.integers(0, 50, n) * 1e-7).tolist(), "some": [None if i % 3 else -float(i) for i in range(n)],
            "nan": [math.nan if i % 2 else float(i) for i in range(n)], "none": [None] * n}
    df = spark.createDataFrame(list(zip(*cols.values())), ", ".join(f"{c} double" for c in cols)).repartition(5).cache()
    got = order_statistics(df, list(cols), SHARES, sort_up_to=sort_up_to)
    for found, xs in zip(got, cols.values()):
        assert found == expected([None if x is not None and math.isnan(x) else x for x in xs])
    df.unpersist()


def test_no_rows_are_shuffled(spark):
    """A pass shuffles counts: one row per column and digit at most."""
    df = spark.range(0, 200_000, 1, 4).select((F.col("id") * 0.25).alias("a"), F.pmod("id", F.lit(9)).cast("double").alias("b"))
    got = order_statistics(df, ["a", "b"], SHARES, sort_up_to=100)
    assert got == [expected([i * 0.25 for i in range(200_000)]), expected([float(i % 9) for i in range(200_000)])]


def test_summary_of_long_and_decimal_columns(spark):
    df = spark.createDataFrame([(i, str(i * 1.5)) for i in range(101)], "n long, s string").select("n", F.col("s").cast("decimal(12,2)").alias("d"))
    rows = {r.column_name: r for r in pf.numeric_summary(df).collect()}
    assert (rows["n"].p25, rows["n"].p50, rows["n"].p75) == (25.0, 50.0, 75.0) and rows["d"].p50 == 75.0
    empty = {r.column_name: r for r in pf.numeric_summary(df.limit(0)).collect()}
    assert empty["n"].n == 0 and empty["n"].p50 is None and empty["d"].mean is None
