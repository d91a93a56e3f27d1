"""Leave-one-run-out least squares from additive statistics.

Sums of products per fold and Arrow batch are formed where the rows are, and added up in one aggregate. Each fold's training sums are the
total minus its own, so no fold is fitted by a pass of its own, however many folds there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.functions import clip_negative, residual
from sensorframe.operators.joins import join_groups
from sensorframe.operators.scaling import scaled, scaler_values
from sensorframe.operators.tsqr import loro_factors
from sensorframe.session import checkpointed


def loro_coefficients(
    df: DataFrame, features: Sequence[str], label: str, fold: str = "run_id"
) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """(fold, n_train, n_test, intercept, weights) per fold, for standardised features, and the
    statistics they were standardised with (global: they only condition the sums)."""
    columns = [*features, label]
    statistics = scaler_values(df, columns)
    if any(mean is None for mean, _ in statistics.values()):  # no rows at all
        statistics = {c: (0.0, 0.0) for c in columns}
    size = len(columns)
    names = [f"_x{i}" for i in range(size)]
    rows = df.select(F.col(fold).alias("fold"), *[scaled(c, *statistics[c]).alias(x) for c, x in zip(columns, names)])
    fold_type = df.schema[fold].dataType.simpleString()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each fold and Arrow batch: the sums of the columns and of their products, as one product of
        matrices. Rows come sorted by fold, so a batch has few."""
        for batch in batches:
            x = np.column_stack([np.ones(batch.num_rows), *[batch.column(k + 1).to_numpy(zero_copy_only=False) for k in range(size)]])
            keys = batch.column(0)
            codes = keys.dictionary_encode()
            at = codes.indices.fill_null(len(codes.dictionary)).to_numpy(zero_copy_only=False)
            order = np.argsort(at, kind="stable")
            edges = np.flatnonzero(np.diff(at[order], prepend=-1))
            sums = [x[part].T @ x[part] for part in np.split(order, edges[1:])] if len(order) else []
            yield pa.record_batch(
                [keys.take(pa.array(order[edges])), pa.array([float(m[0, 0]) for m in sums], pa.float64()), pa.array([m.ravel().tolist() for m in sums], pa.list_(pa.float64()))],
                names=["fold", "n", "sums"],
            )

    parts = rows.sortWithinPartitions("fold").mapInArrow(partial, f"fold {fold_type}, n double, sums array<double>")
    # The only pass over the rows. Kept, as both the total and each fold's remainder come from it.
    added = parts.select("fold", "n", array_to_vector("sums").alias("sums")).groupBy("fold")
    per_fold = checkpointed(added.agg(F.sum("n").cast("bigint").alias("n"), Summarizer.sum(F.col("sums")).alias("sums")))
    overall = per_fold.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), Summarizer.sum(F.col("sums")).alias("sums")).head()
    n_all = overall["n"]
    all_sums = overall["sums"].toArray() if n_all else np.zeros((size + 1) ** 2)
    y_mean, y_std = statistics[label]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, n, sums in zip(batch["fold"], batch["n"], batch["sums"]):
                rest = n_all - n
                if rest == 0:  # nothing to train on: the fold is skipped
                    continue
                m = ((all_sums - np.asarray(sums)) / rest).reshape(size + 1, size + 1)
                s = m[0, 1:]
                cov = m[1:, 1:] - np.outer(s, s)
                w = np.linalg.pinv(cov[:-1, :-1], rcond=1e-12, hermitian=True) @ cov[:-1, -1]
                b = s[-1] - w @ s[:-1]
                unit = y_std or 1.0
                out.append((key, rest, n, float(b * unit + y_mean), [float(v) for v in w * unit]))
            yield pd.DataFrame(out, columns=["fold", "n_train", "n_test", "intercept", "weights"])

    schema = f"fold {fold_type}, n_train bigint, n_test bigint, intercept double, weights array<double>"
    return per_fold.withColumn("sums", vector_to_array("sums")).mapInPandas(solve, schema), statistics


def loro_linear(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    ids: Sequence[str],
    fold: str = "run_id",
    model: str = "Linear Regression",
    stable: bool = False,
) -> DataFrame:
    """Held-out predictions (model, fold, ids, actual, predicted, residual), negatives clipped.
    Without features this is the mean of the other folds. ``stable`` solves from triangular factors (``tsqr``) instead
    of sums of products, which keeps the digits where features are nearly collinear, at a higher price per fold."""
    coefficients, statistics = (loro_factors if stable else loro_coefficients)(df, features, label, fold)
    raw = F.col("intercept")
    for i, c in enumerate(features):
        raw = raw + F.get("weights", F.lit(i)) * scaled(c, *statistics[c])
    rows = df.select(*[f"`{c}`" for c in dict.fromkeys([*ids, *features, label])], F.col(fold).alias("_fold"))
    coefficients = coefficients.select(F.col("fold").alias("_fold"), "intercept", "weights")
    return (
        join_groups(rows, coefficients, ["_fold"], width=len(features) + 2)
        .select(
            F.lit(model).alias("model"),
            F.col("_fold").alias("fold"),
            *ids,
            F.col(f"`{label}`").alias("actual"),
            clip_negative(raw).alias("predicted"),
        )
        .withColumn("residual", residual(F.col("actual"), F.col("predicted")))
    )
