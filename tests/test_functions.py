from pyspark.sql import functions as F

from epiframe.functions import coerce_date, coerce_double, coerce_long, finite, key_equals, norm, pct_label, safe_ratio

def test_norm_strips_all_unicode_space(spark):
    rows = [(" Nation_1 ",), ("\tNATION_1 ",), ("　nation_1\n",), (None,), ("Côte d'Ivoire ",)]
    out = [r[0] for r in spark.createDataFrame(rows, "k string").select(norm("k")).collect()]
    assert out == [s.lower().strip() if s is not None else None for s, in rows]

def test_key_equals_binds_parameter(spark):
    df = spark.createDataFrame([("NATION_7",), ("nation_17",), ("x'; drop",)], "k string")
    assert df.filter(key_equals("k", "  Nation_7\t")).count() == 1
    assert df.filter(key_equals("k", "x'; drop")).count() == 1

def test_safe_ratio_zero_and_null(spark):
    df = spark.createDataFrame([(10, 0), (10, None), (None, 5), (10, 4)], "a long, b long")
    out = [r[0] for r in df.select(safe_ratio("a", "b", 100.0)).collect()]
    assert out == [None, None, None, 250.0]

def test_coercions(spark):
    df = spark.createDataFrame([("12", "1.5", "2020-02-30"), ("x", "abc", "2020-02-03"), (None, "1e3", "bad")],
                               "a string, b string, c string")
    rows = df.select(coerce_long("a"), coerce_double("b"), coerce_date("c").cast("string")).collect()
    assert [tuple(r) for r in rows] == [(12, 1.5, None), (None, None, "2020-02-03"), (None, 1000.0, None)]

def test_finite_and_label(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (-float("inf"),), (1.005,), (None,)], "x double")
    assert [r[0] for r in df.select(finite("x")).collect()] == [None, None, None, 1.005, None]
    assert spark.range(1).select(pct_label(F.lit(12.3456))).first()[0] == "12.35%"


def test_scale_settings():
    from epiframe.session import MB, scale_settings
    big = scale_settings(100 * 1024 ** 4)          # 100 TB
    assert int(big["spark.sql.shuffle.partitions"]) == 100 * 1024 ** 4 // (256 * MB)
    assert big["spark.sql.adaptive.advisoryPartitionSizeInBytes"] == str(256 * MB)
    assert scale_settings(1)["spark.sql.shuffle.partitions"] == "8"


def test_norm_equals_python_strip_for_every_whitespace(spark):
    spaces = [chr(c) for c in range(0x110000) if chr(c).isspace()]
    rows = [(w + "Ab" + w + w,) for w in spaces] + [("".join(spaces) + "X Y" + "".join(spaces),),
                                                    ("İstanbul ",), ("ΣΑΣ",), ("ǅx",)]
    out = [r[0] for r in spark.createDataFrame(rows, "k string").select(norm("k")).collect()]
    assert out == [r[0].lower().strip() for r in rows]
