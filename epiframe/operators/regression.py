"""Feature scaling and the log-log density regression.

Global statistics (means, deviations, coefficients) are one-row aggregates
attached as scalar subqueries: Spark runs each once and substitutes the
value, so no cross join and no single-partition window is involved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from epiframe.functions.numeric import finite
from epiframe.operators.aggregates import scalar_row


def log_features(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """out = ln(1 + src) for each ``{out: src}``."""
    return df.withColumns({out: F.log1p(F.col(src).cast("double")) for out, src in columns.items()})


def standardise(df: DataFrame, columns: list[str], places: int | None = None) -> DataFrame:
    """M1: (x - mean) / population standard deviation, per column, over all
    rows.  A zero deviation scales by 1 (the value becomes 0)."""
    stats = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns],
                   *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    row = scalar_row(stats)
    out = {}
    for c in columns:
        mean, sd = row[f"_m_{c}"], row[f"_s_{c}"]
        scaled = (F.col(c) - mean) / F.when(sd == 0, F.lit(1.0)).otherwise(sd)
        out[c] = F.round(scaled, places) if places is not None else scaled
    return df.withColumns(out)


def fit_loglog(df: DataFrame, x: str = "population_density_calc", y: str = "cases_per_million") -> DataFrame:
    """M4: OLS of ln(1+y) on 1 + ln(1+x) over rows where both are finite.
    One row: slope, intercept, r2, n."""
    lx, ly = F.log1p(finite(x)), F.log1p(finite(y))
    pts = df.select(lx.alias("_x"), ly.alias("_y")).dropna()
    return pts.agg(F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"),
                   F.regr_r2("_y", "_x").alias("r2"), F.count(F.lit(1)).alias("n"))


def predict_loglog(df: DataFrame, coefficients: DataFrame, x: str = "population_density_calc",
                   out: str = "fitted") -> DataFrame:
    """M5: fitted = exp(intercept + slope * ln(1 + coalesce(x, 0))) - 1 for every
    row; NULL everywhere when the fit has no coefficients."""
    row = scalar_row(coefficients.select("slope", "intercept"))
    slope, intercept = row["slope"], row["intercept"]
    lx = F.log1p(F.coalesce(F.col(x).cast("double"), F.lit(0.0)))
    return df.withColumn(out, F.expm1(intercept + slope * lx))
