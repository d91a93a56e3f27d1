"""Feature selection by importance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe.operators.models import forest

# The selector's forest and the number of bars in an importance report.
SELECTOR = {"numTrees": 200, "maxDepth": 30, "seed": 42}
TOP_N = 20


def importance_table(spark: SparkSession, features: Sequence[str], importances: Sequence[float]) -> DataFrame:
    """(position, feature, importance) from a fitted tree model; one row per feature."""
    rows = [(i, f, float(v)) for i, (f, v) in enumerate(zip(features, importances))]
    return spark.createDataFrame(rows, "position int, feature string, importance double")


def forest_importance(df: DataFrame, features: Sequence[str], label: str, **settings) -> DataFrame:
    """Importances of a forest over all features. Fitted once: the median cut reuses it."""
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    rows = assembler.transform(df).select("features", F.col(f"`{label}`").alias("label"))
    model = forest(**{**SELECTOR, **settings}).fit(rows)
    return importance_table(df.sparkSession, features, model.featureImportances.toArray())


def above_median(scores: DataFrame, score: str = "importance") -> DataFrame:
    """Rows whose score is at least the median score. For tables with one row per feature."""
    median = scores.agg(F.median(score).alias("_m"))
    return scores.where(F.col(score) >= median.scalar())


def top_scores(scores: DataFrame, n: int = TOP_N, score: str = "importance", name: str = "feature") -> DataFrame:
    """The ``n`` best rows, or all if there are fewer; ties go by name."""
    return scores.orderBy(F.desc(score), F.asc(name)).limit(n)


def selection_counts(scores: DataFrame, score: str = "importance") -> DataFrame:
    """How many features there are before and after the median cut."""
    median = scores.agg(F.median(score).alias("_m")).scalar()
    return scores.agg(
        F.count(F.lit(1)).alias("n_before"), F.count_if(F.col(score) >= median).alias("n_after")
    )
