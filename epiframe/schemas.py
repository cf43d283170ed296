"""Explicit schemas.  Nothing in the library relies on schema inference."""

from pyspark.sql import types as T

# Fact panel: one row per (entity, day).  cases_since_prev_day may be negative.
PANEL = T.StructType([
    T.StructField("country_region", T.StringType(), True),
    T.StructField("date", T.DateType(), True),
    T.StructField("cases", T.LongType(), True),
    T.StructField("deaths", T.LongType(), True),
    T.StructField("cases_since_prev_day", T.LongType(), True),
    T.StructField("population", T.LongType(), True),
])

# Population CSV as published (header names kept verbatim).
POPULATION_CSV = T.StructType([
    T.StructField("Rank", T.IntegerType(), True),
    T.StructField("CCA3", T.StringType(), True),
    T.StructField("Country/Territory", T.StringType(), True),
    T.StructField("Capital", T.StringType(), True),
    T.StructField("Continent", T.StringType(), True),
    T.StructField("2022 Population", T.StringType(), True),
    T.StructField("2020 Population", T.StringType(), True),
    T.StructField("2015 Population", T.StringType(), True),
    T.StructField("2010 Population", T.StringType(), True),
    T.StructField("2000 Population", T.StringType(), True),
    T.StructField("1990 Population", T.StringType(), True),
    T.StructField("1980 Population", T.StringType(), True),
    T.StructField("1970 Population", T.StringType(), True),
    T.StructField("Area (km²)", T.StringType(), True),
    T.StructField("Density (per km²)", T.StringType(), True),
    T.StructField("Growth Rate", T.StringType(), True),
    T.StructField("World Population Percentage", T.StringType(), True),
])

# Country dimension after loading (what the enrichment join consumes).
DIMENSION = T.StructType([
    T.StructField("country", T.StringType(), True),
    T.StructField("continent", T.StringType(), True),
    T.StructField("population_2020", T.LongType(), True),
    T.StructField("area_km2", T.LongType(), True),
])

MAPPING_CSV = T.StructType([
    T.StructField("source_name", T.StringType(), True),
    T.StructField("target_name", T.StringType(), True),
])

ENRICHED = T.StructType([
    T.StructField("country_region", T.StringType(), True),
    T.StructField("total_cases", T.LongType(), True),
    T.StructField("total_deaths", T.LongType(), True),
    T.StructField("population_2020", T.LongType(), True),
    T.StructField("area_km2", T.LongType(), True),
    T.StructField("cases_per_million", T.DoubleType(), True),
    T.StructField("deaths_per_million", T.DoubleType(), True),
    T.StructField("cfr_pct", T.DoubleType(), True),
    T.StructField("cases_per_km2", T.DoubleType(), True),
    T.StructField("deaths_per_km2", T.DoubleType(), True),
    T.StructField("population_density_calc", T.DoubleType(), True),
])

# Column names used when the enriched table is written as CSV (fixed values,
# the published header of the enriched file).
ENRICHED_CSV_NAMES = {
    "country_region": "COUNTRY_REGION",
    "total_cases": "Total_Cases",
    "total_deaths": "Total_Deaths",
    "population_2020": "Population_2020",
    "area_km2": "Area_km2",
    "cases_per_million": "Cases_per_Million",
    "deaths_per_million": "Deaths_per_Million",
    "cfr_pct": "CFR_%",
    "cases_per_km2": "Cases_per_km2",
    "deaths_per_km2": "Deaths_per_km2",
    "population_density_calc": "Population_Density_Calc",
}

# A comment as submitted.
COMMENT_IN = T.StructType([
    T.StructField("country_key", T.StringType(), False),
    T.StructField("comment_text", T.StringType(), False),
    T.StructField("user", T.StringType(), False),
    T.StructField("source", T.StringType(), True),
    T.StructField("additional_notes", T.StringType(), True),
])

# A comment as stored: key normalised, UTC stamp and id added on write.
COMMENT_STORED = T.StructType(COMMENT_IN.fields + [
    T.StructField("timestamp", T.TimestampType(), True),
    T.StructField("comment_id", T.StringType(), True),
])

HISTORY = T.StructType([
    T.StructField("ds", T.DateType(), True),
    T.StructField("y", T.DoubleType(), True),
])
