"""Panel -> per-country totals -> key mapping -> dimension join -> ratios.

One lazy plan: scan -> partial/final aggregate -> two joins -> project.
Only the caller's action (or ``write_csv``) executes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from epiframe.functions.ratios import add_metrics
from epiframe.operators.aggregates import country_totals
from epiframe.operators.guards import require_columns
from epiframe.operators.joins import apply_mapping, merge_dimension, unmatched, with_key
from epiframe.schemas import ENRICHED

ENRICHED_COLUMNS = [f.name for f in ENRICHED.fields]


def mapped_totals(panel: DataFrame, mapping: DataFrame, entity: str = "country_region",
                  cases: str = "cases", deaths: str = "deaths") -> DataFrame:
    """A1 -> P3 -> J1."""
    require_columns(panel, entity, cases, deaths)
    require_columns(mapping, "src_key", "dim_key")
    totals = country_totals(panel, entity, cases, deaths)
    return apply_mapping(with_key(totals, entity), mapping)


def enrich(panel: DataFrame, dimension: DataFrame, mapping: DataFrame,
           entity: str = "country_region", cases: str = "cases", deaths: str = "deaths") -> DataFrame:
    """The enriched country table (11 columns, ``schemas.ENRICHED``).
    ``dimension`` has (country, population_2020, area_km2)."""
    require_columns(dimension, "country", "population_2020", "area_km2")
    dim = dimension.select("country", "population_2020", "area_km2")
    merged = merge_dimension(mapped_totals(panel, mapping, entity, cases, deaths), dim)
    out = add_metrics(merged).withColumnRenamed(entity, "country_region")
    return out.select(*ENRICHED_COLUMNS)


def unmatched_countries(panel: DataFrame, dimension: DataFrame, mapping: DataFrame,
                        entity: str = "country_region") -> DataFrame:
    """Entities lost by the inner join, with the key that failed."""
    mapped = mapped_totals(panel, mapping, entity)
    return unmatched(mapped, dimension.select("country")).select(entity, "country_key")
