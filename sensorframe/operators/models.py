"""Regression models as factories: every fold gets a fresh estimator."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.operators.kernel import fourier_map
from sensorframe.operators.scaling import standardize

# Settings of the five models.
KERNEL = {"C": 5000.0, "gamma": 0.005}
BOOSTING = {"maxIter": 300, "stepSize": 0.03, "maxDepth": 7, "subsamplingRate": 0.7, "seed": 42}
COLUMN_BOOSTING = {
    "maxIter": 400,
    "stepSize": 0.02,
    "maxDepth": 8,
    "subsamplingRate": 0.7,
    "featureSubsetStrategy": "0.7",
    "seed": 42,
}
FOREST = {"numTrees": 300, "maxDepth": 15, "minInstancesPerNode": 3, "seed": 42}

# Fourier features per kernel model: more approximates the kernel better, at quadratic cost.
FOURIER_DIM = 200


def forest(**settings) -> RandomForestRegressor:
    """Every split sees all features; MLlib alone would offer it a third of them."""
    return RandomForestRegressor(**{"featureSubsetStrategy": "all", **settings})


def boosting(**settings) -> GBTRegressor:
    return GBTRegressor(**{"featureSubsetStrategy": "all", **settings})


def fourier_features(df: DataFrame, features: Sequence[str], dim: int, gamma: float, seed: int) -> DataFrame:
    """``fourier_map`` of each row, as the vector column ``features``. One matrix product per Arrow batch."""
    map_ = fourier_map(len(features), dim, gamma, seed)

    @F.pandas_udf("array<double>")
    def project(x: pd.Series) -> pd.Series:
        return pd.Series(list(map_(np.stack(x.to_numpy()))))

    inputs = F.array(*[F.col(f"`{c}`") for c in features])
    return df.withColumn("features", array_to_vector(project(inputs)))


@dataclass(frozen=True)
class ModelSpec:
    """``scale``: standardise with training statistics first. Trees and least squares do not
    change under it, so they skip that pass. ``additive``: least squares, plain or on Fourier features with the
    penalty ``C``, which validation can solve for all folds from sums instead of fitting each."""

    make: Callable[[int], Estimator]  # takes the number of training rows
    scale: bool = False
    fourier: dict | None = None
    trees: bool = False
    additive: bool = False
    C: float | None = None

    def assemble(self, df: DataFrame, features: Sequence[str]) -> DataFrame:
        if self.fourier:
            return fourier_features(df, features, **self.fourier)
        return VectorAssembler(inputCols=list(features), outputCol="features").transform(df)


@dataclass(frozen=True)
class FittedModel:
    spec: ModelSpec
    features: tuple[str, ...]
    statistics: dict[str, tuple[float, float]] | None
    model: Model

    def predict(self, df: DataFrame, ids: Sequence[str]) -> DataFrame:
        rows = standardize(df, self.statistics) if self.statistics else df
        return self.model.transform(self.spec.assemble(rows, self.features)).select(*ids, "prediction")


def fit(
    spec: ModelSpec,
    train: DataFrame,
    features: Sequence[str],
    label: str,
    n_train: int,
    statistics: dict[str, tuple[float, float]] | None = None,
) -> FittedModel:
    used = statistics if spec.scale else None
    rows = standardize(train, used) if used else train
    rows = spec.assemble(rows, features).select("features", F.col(f"`{label}`").alias("label"))
    return FittedModel(spec, tuple(features), used, spec.make(n_train).fit(rows))


def kernel_model(
    dim: int = FOURIER_DIM, C: float = KERNEL["C"], gamma: float = KERNEL["gamma"], seed: int = 42, scale_within_fold: bool = False
) -> ModelSpec:
    """Kernel regression at scale: squared loss on Fourier features. The penalty 1/(C n) weighs
    the mean loss against the weights as C weighs the summed loss. Validation solves all folds from one pass, with
    features scaled by the statistics of all rows; ``scale_within_fold`` takes those of a fold's training rows, at the
    price of a fit per fold."""
    return ModelSpec(
        make=lambda n: LinearRegression(
            regParam=1.0 / (C * max(n, 1)), elasticNetParam=0.0, standardization=False, solver="normal"
        ),
        scale=True,
        fourier={"dim": dim, "gamma": gamma, "seed": seed},
        additive=not scale_within_fold,
        C=C,
    )


def reference_preset() -> dict[str, ModelSpec]:
    """The five models at full settings. Two are analogues of the originals and named for what they are: ridge
    regression on Fourier features for the kernel machine, boosting with column samples for the histogram booster."""
    return {
        "Fourier Ridge": kernel_model(),
        "Gradient Boosting": ModelSpec(lambda n: boosting(**BOOSTING), trees=True),
        "Column-Sampled Boosting": ModelSpec(lambda n: boosting(**COLUMN_BOOSTING), trees=True),
        "Random Forest": ModelSpec(lambda n: forest(**FOREST), trees=True),
        "Linear Regression": ModelSpec(lambda n: LinearRegression(regParam=0.0), additive=True),
    }
