"""Bindings that rebuild the reference's input shapes from the driver tables.

These only produce rows in the schemas the operators expect (FIXTURES.md);
they do none of the operators' work.  Each is a lazy DataFrame whose size
grows with the source tables.

P — nation x day panel      (orders ⋈ customer ⋈ nation)
U — user x day panel        (events)
D — country dimension       (nation ⋈ region, customer and supplier counts)
M — name mapping            (three fixed rows)
C — comments                (conversations)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from epiframe.sources.files import mapping_keys, read_table


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P: (country_region, date, cases, deaths, cases_since_prev_day, population)."""
    orders = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderdate")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")

    # Pre-aggregate orders to (customer, day) before the join: map-side
    # partial aggregation collapses a hot customer to at most one row per day
    # before anything is shuffled, so the join never sees a skewed key.  Then
    # roll up to (nation, day); only those small counts meet the nation table.
    per_customer_day = (orders.groupBy("o_custkey", F.to_date("o_orderdate").alias("date"))
                        .agg(F.count(F.lit(1)).alias("n"),
                             F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).cast("bigint").alias("nf")))
    daily = (per_customer_day.join(customer, per_customer_day.o_custkey == customer.c_custkey)
             .groupBy(F.col("c_nationkey").alias("nk"), "date")
             .agg(F.sum("n").cast("bigint").alias("cases"), F.sum("nf").cast("bigint").alias("f")))
    customers = customer.groupBy(F.col("c_nationkey").alias("nk")).agg(F.count(F.lit(1)).alias("n_cust"))
    names = nation.select(F.col("n_nationkey").alias("nk"), "n_name")

    w = Window.partitionBy("country_region").orderBy("date")
    return (daily.join(names, "nk").join(customers, "nk", "left")
            .select(F.col("n_name").alias("country_region"), "date", "cases",
                    F.when(F.col("f") > 0, F.col("f")).alias("deaths"),
                    F.when(F.col("n_name") != "NATION_4", F.col("n_cust")).alias("population"))
            .withColumn("cases_since_prev_day", F.col("cases") - F.lag("cases").over(w))
            .select("country_region", "date", "cases", "deaths", "cases_since_prev_day", "population"))


def user_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U: (country_region, date, cases_since_prev_day) = user, day, event count."""
    events = read_table(spark, sf_dir, "events").select("user_id", "ts")
    return (events.groupBy(F.col("user_id").cast("string").alias("country_region"),
                           F.to_date("ts").alias("date"))
            .agg(F.count(F.lit(1)).alias("cases_since_prev_day")))


def dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D: (country, continent, population_2020, area_km2) with padded, re-cased
    names so that key normalisation and the mapping have work to do."""
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    customers = (read_table(spark, sf_dir, "customer").groupBy("c_nationkey")
                 .agg(F.count(F.lit(1)).alias("n_cust")))
    suppliers = (read_table(spark, sf_dir, "supplier").groupBy("s_nationkey")
                 .agg(F.count(F.lit(1)).alias("n_supp")))
    name = F.col("n_name")
    country = (F.when(name == "NATION_1", F.lit("Nation One"))
               .when(name == "NATION_2", F.lit("Nation Deux"))
               .otherwise(F.concat(F.lit("  "), F.lower(name), F.lit(" "))))
    return (nation.join(region, nation.n_regionkey == region.r_regionkey)
            .join(customers, nation.n_nationkey == customers.c_nationkey, "left")
            .join(suppliers, nation.n_nationkey == suppliers.s_nationkey, "left")
            .select(country.alias("country"), F.col("r_name").alias("continent"),
                    F.col("n_cust").alias("population_2020"),
                    F.when(name == "NATION_3", F.lit(0).cast("bigint")).otherwise(F.col("n_supp"))
                    .alias("area_km2")))


# Fixed mapping rows (FIXTURES.md, binding M).
MAPPING_ROWS = [
    ("NATION_1", "Nation One"),
    ("NATION_2", "Nation Two"),
    ("NATION_99", "Nowhere"),
]


def mapping(spark: SparkSession) -> DataFrame:
    """M: normalised (src_key, dim_key)."""
    raw = spark.createDataFrame(MAPPING_ROWS, "source_name string, target_name string")
    return mapping_keys(raw)


COMMENT_TIME = "2024-01-01 00:00:00"


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C: comments in the submitted shape, plus a fixed timestamp."""
    conv = read_table(spark, sf_dir, "conversations")
    return conv.select(
        F.concat(F.lit(" Nation_"), (F.col("conv_id") % 25).cast("string"), F.lit(" ")).alias("country_key"),
        F.col("text").alias("comment_text"),
        F.col("role").alias("user"),
        F.lit(None).cast("string").alias("source"),
        F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("additional_notes"),
        F.to_timestamp(F.lit(COMMENT_TIME)).alias("timestamp"),
    )


def customer_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity = customer; (country_region, total_cases, total_deaths) = orders
    and finished orders per customer.  The large-entity input for k-means."""
    orders = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus")
    return (orders.groupBy(F.col("o_custkey").cast("string").alias("country_region"))
            .agg(F.count(F.lit(1)).alias("total_cases"),
                 F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).cast("bigint")
                 .alias("total_deaths")))
