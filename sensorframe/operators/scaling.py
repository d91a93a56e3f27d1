"""Standardisation with population statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scaler_fit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, mean, std): one aggregate over all columns."""
    wide = df.agg(
        *[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(f"`{c}`").alias(f"s{i}") for i, c in enumerate(columns)],
    )
    rows = [
        F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"))
        for i, c in enumerate(columns)
    ]
    return wide.select(F.inline(F.array(*rows)))


def scaler_values(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """The fitted statistics on the driver: two numbers per column."""
    return {r["feature"]: (r["mean"], r["std"]) for r in scaler_fit(df, columns).collect()}


def scaled(column: str, mean: float, std: float) -> Column:
    """A constant column is centred, not divided."""
    centred = F.col(f"`{column}`") - F.lit(mean)
    return centred if not std else centred / F.lit(std)


def standardize(df: DataFrame, statistics: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: scaled(c, mean, std) for c, (mean, std) in statistics.items()})
