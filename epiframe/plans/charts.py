"""Chart datasets — the data behind each figure, not the drawing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from epiframe.functions.numeric import pct_label
from epiframe.operators.aggregates import axis_bound, top_k
from epiframe.operators.filters import select_entities
from epiframe.operators.joins import with_labels
from epiframe.operators.regression import fit_loglog, predict_loglog


def cases_vs_deaths(enriched: DataFrame, selection: list[str] | None = None) -> DataFrame:
    """x = cases/M, y = deaths/M, size = population, colour = CFR, label =
    country; only points drawable on log axes (x > 0 and y > 0)."""
    sel = select_entities(enriched, selection)
    return (sel.filter((F.col("cases_per_million") > 0) & (F.col("deaths_per_million") > 0))
            .select("country_region", "cases_per_million", "deaths_per_million", "population_2020", "cfr_pct"))


def cfr_top(enriched: DataFrame, selection: list[str] | None = None, k: int = 20) -> DataFrame:
    """top-k by CFR with a two-decimal label and the y-axis bound
    (max CFR x 1.2, or 1 when every CFR is NULL) of the whole selection."""
    sel = select_entities(enriched, selection)
    bound = axis_bound(sel, "cfr_pct").scalar()
    return (top_k(sel.select("country_region", "cfr_pct"), "cfr_pct", k)
            .withColumn("cfr_label", pct_label("cfr_pct")).withColumn("axis_max", bound))


def density_curve(enriched: DataFrame, selection: list[str] | None = None) -> DataFrame:
    """density vs cases/M with the log-log fit of the *selection*, ordered
    by density (the fitted line)."""
    sel = select_entities(enriched, selection)
    fitted = predict_loglog(sel, fit_loglog(sel))
    return (fitted.select("country_region", "population_density_calc", "cases_per_million", "fitted")
            .orderBy(F.asc_nulls_last("population_density_calc"), "country_region"))


def clusters(enriched: DataFrame, labels: DataFrame) -> DataFrame:
    """enriched x labels (inner, J3), label as a string (P21); the whole
    table, regardless of any selection."""
    joined = with_labels(enriched, labels.select("country_region", "cluster"))
    return joined.select("country_region", "cases_per_million", "deaths_per_million", "population_2020",
                         F.col("cluster").cast("string").alias("cluster"))
