"""Per-capita, per-area and fatality ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame

from epiframe.functions.numeric import safe_ratio

PER_MILLION = 1_000_000.0
PERCENT = 100.0


def add_metrics(df: DataFrame, cases: str = "total_cases", deaths: str = "total_deaths",
                population: str = "population_2020", area: str = "area_km2") -> DataFrame:
    """Six ratios; a zero or NULL denominator gives NULL."""
    return df.withColumns({
        "cases_per_million": safe_ratio(cases, population, PER_MILLION),
        "deaths_per_million": safe_ratio(deaths, population, PER_MILLION),
        "cfr_pct": safe_ratio(deaths, cases, PERCENT),
        "cases_per_km2": safe_ratio(cases, area),
        "deaths_per_km2": safe_ratio(deaths, area),
        "population_density_calc": safe_ratio(population, area),
    })
