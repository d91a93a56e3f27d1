"""Scores of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold_metrics(predictions: DataFrame, by: Sequence[str] = ("model", "fold")) -> DataFrame:
    """R2, MSE, RMSE and MAE per group, in one pre-aggregated pass. On a constant label R2 is 1
    if every prediction is right, else 0."""
    error = F.col("actual") - F.col("predicted")
    sums = predictions.groupBy(*by).agg(
        F.avg(error * error).alias("mse"),
        F.avg(F.abs(error)).alias("mae"),
        F.var_pop("actual").alias("_var"),
    )
    r2 = F.when(F.col("_var") > 0, 1 - F.try_divide("mse", "_var")).when(F.col("mse") == 0, 1.0).otherwise(0.0)
    return sums.select(*by, r2.alias("r2"), "mse", F.sqrt("mse").alias("rmse"), "mae")


def model_summary(scores: DataFrame) -> DataFrame:
    """Macro averages over folds, best R2 first. ``avg_rmse`` is the mean of the folds' RMSEs."""
    return (
        scores.groupBy("model")
        .agg(
            F.avg("r2").alias("avg_r2"),
            F.avg("rmse").alias("avg_rmse"),
            F.avg("mae").alias("avg_mae"),
            F.avg("mse").alias("avg_mse"),
        )
        .orderBy(F.desc("avg_r2"), "model")
    )


def actual_range(predictions: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """End points of the diagonal in an actual-versus-predicted report."""
    return predictions.groupBy(*by).agg(F.min("actual").alias("lo"), F.max("actual").alias("hi"))
