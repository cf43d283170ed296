"""Required-column guard.  Checked against the schema only — no action
runs — so a wrong input fails at plan time with a clear message, and an
empty input simply flows through every operator as an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame


def require_columns(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required column(s) {missing}; have {df.columns}")
    return df
