"""File sources and sinks.

CSV columns are picked by header name, whatever their order; a missing name is
an error.  Their values arrive as strings and are coerced with ``try_cast``
(bad value -> NULL), never inferred.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from epiframe import schemas
from epiframe.functions import coerce_double, coerce_long, norm


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a dataset folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_panel(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """The fact panel.  Parquet (default), a catalog table (``fmt='table'``)
    or any reader format such as ``jdbc`` with its options.  Nothing is pulled
    to the driver; the result stays a lazy distributed DataFrame."""
    if fmt == "table":
        return spark.table(path)
    reader = spark.read.format(fmt).options(**options)
    if fmt in ("csv", "json"):
        reader = reader.schema(schemas.PANEL)
    return reader.load(path) if path else reader.load()


def _csv(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The named columns as strings.  Only the header line names columns, so
    no schema is imposed by position."""
    raw = (spark.read.option("header", True).option("inferSchema", False).option("encoding", "UTF-8")
           .option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").csv(path))
    return raw.select(*[F.col(f"`{n}`") for n in names])


def read_population(spark: SparkSession, path: str) -> DataFrame:
    """Population CSV -> (country, dim_key, continent, population,
    population_2020, area_km2, density_published).  Numbers are coerced
    (bad -> NULL, P4); ``dim_key`` is the normalised name (P3)."""
    raw = _csv(spark, path, ["Country/Territory", "Continent", "2022 Population", "2020 Population",
                             "Area (km²)", "Density (per km²)"])
    return raw.select(
        F.col("`Country/Territory`").alias("country"),
        norm(F.col("`Country/Territory`")).alias("dim_key"),
        F.col("Continent").alias("continent"),
        coerce_long(F.trim(F.col("`2022 Population`"))).alias("population"),
        coerce_long(F.trim(F.col("`2020 Population`"))).alias("population_2020"),
        coerce_long(F.trim(F.col("`Area (km²)`"))).alias("area_km2"),
        coerce_double(F.col("`Density (per km²)`")).alias("density_published"),
    )


def read_mapping(spark: SparkSession, path: str, source: str = "source_name",
                 target: str = "target_name") -> DataFrame:
    """S3: name-mapping CSV -> (src_key, dim_key), both normalised.  ``source``
    and ``target`` are the headers of the fact table's and the dimension's names."""
    return mapping_keys(_csv(spark, path, [source, target]), source, target)


def mapping_keys(raw: DataFrame, src: str = "source_name", dst: str = "target_name") -> DataFrame:
    return raw.select(norm(src).alias("src_key"), norm(dst).alias("dim_key"))


def read_enriched(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read the enriched table back with its pinned schema.  The CSV form
    carries the published header names, renamed back here."""
    if fmt == "parquet":
        return spark.read.schema(schemas.ENRICHED).parquet(path)
    raw = _csv(spark, path, [schemas.ENRICHED_CSV_NAMES[f.name] for f in schemas.ENRICHED.fields])
    return raw.select(*[
        (F.col(f"`{schemas.ENRICHED_CSV_NAMES[f.name]}`") if f.dataType.typeName() == "string"
         else F.col(f"`{schemas.ENRICHED_CSV_NAMES[f.name]}`").try_cast(f.dataType)).alias(f.name)
        for f in schemas.ENRICHED.fields])


def write_csv(df: DataFrame, path: str, published_names: bool = True, mode: str = "overwrite") -> str:
    """Write with a header row and no index column.  One file per task —
    never funnelled through a single writer."""
    out = df
    if published_names:
        out = df.select(*[F.col(c).alias(schemas.ENRICHED_CSV_NAMES.get(c, c)) for c in df.columns])
    out.write.mode(mode).option("header", True).csv(path)
    return path
