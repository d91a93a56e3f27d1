"""Pearson correlations between features and the filter built on them."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.session import written

# Fixed value.
THRESHOLD = 0.9

PAIR_SCHEMA = "i int, j int, feature_i string, feature_j string, corr double"


def co_moments(df: DataFrame, features: Sequence[str], by: str | None = None) -> DataFrame:
    """(by, sums): what the correlations of any pair need, over the rows in which both are known: how many there
    are, and the sums of the one, of its square and of the product. A saved table of one row per value of ``by``.

    Values are taken as distances from the overall means, which the one pass before it finds. Each task forms four
    products of matrices for its rows of a group, so rows are never expanded to pairs.
    """
    p = len(features)
    means = df.agg(*[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(features)]).head()
    away = [(F.col(f"`{c}`").cast("double") - F.lit(float(means[f"m{i}"] or 0.0))).alias(f"x{i}") for i, c in enumerate(features)]
    rows = df.select((F.col(by) if by else F.lit(0)).alias("by"), *away)
    kind = rows.schema["by"].dataType

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(k + 1).to_numpy(zero_copy_only=False) for k in range(p)]).astype(float)
            known = ~np.isnan(x)
            x, known = np.where(known, x, 0.0), known.astype(float)
            codes = batch.column("by").dictionary_encode()
            at = codes.indices.fill_null(len(codes.dictionary)).to_numpy(zero_copy_only=False)
            order = np.argsort(at, kind="stable")
            edges = np.flatnonzero(np.diff(at[order], prepend=-1))
            sums = []
            for part in np.split(order, edges[1:]) if len(order) else []:
                v, k = x[part], known[part]
                sums.append(np.concatenate([m.ravel() for m in (k.T @ k, v.T @ k, (v * v).T @ k, v.T @ v)]).tolist())
            yield pa.record_batch([batch.column("by").take(pa.array(order[edges])), pa.array(sums, pa.list_(pa.float64()))], names=["by", "sums"])

    parts = rows.sortWithinPartitions("by").mapInArrow(add, f"by {kind.simpleString()}, sums array<double>")
    return written(parts.groupBy("by").agg(Summarizer.sum(array_to_vector("sums")).alias("sums")).select("by", vector_to_array("sums").alias("sums")))


def correlations(sums: np.ndarray) -> np.ndarray:
    """The matrix of correlations that ``co_moments`` give; NaN where one of a pair has no spread among the rows in
    which both are known, or there are none."""
    p = math.isqrt(len(sums) // 4)
    n, x, xx, xy = sums.reshape(4, p, p)
    spread = n * xx - x * x
    spread = np.where(spread > 1e-12 * n * xx, spread, np.nan)  # below, what is left is rounding
    return (n * xy - x * x.T) / np.sqrt(spread * spread.T)


def _pairs(matrix: np.ndarray, features: Sequence[str]) -> list[tuple]:
    return [
        (i, j, features[i], features[j], None if math.isnan(matrix[i, j]) else float(matrix[i, j]))
        for j in range(len(features))
        for i in range(j)
    ]


def correlation_pairs(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(i, j, feature_i, feature_j, corr) for positions i < j, each over the rows in which both are known; NULL beside a
    feature that is constant there.

    Two distributed passes over the rows: means, then products. Only the sums, whose size is set by the number of
    features, pass through the driver.
    """
    found = co_moments(df, features).head()
    matrix = correlations(np.array(found["sums"])) if found else np.full((len(features), len(features)), np.nan)
    return df.sparkSession.createDataFrame(_pairs(matrix, features), PAIR_SCHEMA)


def correlated_without(df: DataFrame, features: Sequence[str], fold: str, threshold: float = THRESHOLD) -> DataFrame:
    """(fold, i, j) for each value of ``fold`` and positions i < j: the pairs that are correlated beyond the threshold in
    the rows of all other folds. One pass over the rows for any number of folds: what a fold's other rows have is the
    total less its own."""
    sums = co_moments(df, features, fold)
    p = len(features)
    found = sums.agg(Summarizer.sum(array_to_vector("sums")).alias("sums")).head()["sums"]
    total = found.toArray() if found is not None and found.size else np.zeros(4 * p * p)
    kind = sums.schema["by"].dataType.simpleString()

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, left, right = [], [], []
            for row, own in enumerate(batch.column("sums")):
                rest = total - own.values.to_numpy()
                rest[: p * p] = np.round(rest[: p * p])  # counts
                with np.errstate(invalid="ignore"):
                    j, i = np.nonzero(np.tril(np.abs(correlations(rest)) > threshold, -1))
                rows += [row] * len(i)
                left += i.tolist()
                right += j.tolist()
            yield pa.record_batch([batch.column("by").take(pa.array(rows, pa.int64())), pa.array(left, pa.int32()), pa.array(right, pa.int32())], names=["fold", "i", "j"])

    return sums.mapInArrow(pairs, f"fold {kind}, i int, j int")


def correlated_features(pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(j, feature_j, max_abs_corr) of the features to drop: those correlated beyond the threshold
    with any earlier feature, dropped or not."""
    return (
        pairs.groupBy("j", "feature_j")
        .agg(F.max(F.abs("corr")).alias("max_abs_corr"))
        .where(F.col("max_abs_corr") > threshold)
    )


def drop_correlated(
    df: DataFrame, features: Sequence[str], threshold: float = THRESHOLD
) -> tuple[DataFrame, list[str]]:
    """The frame without the dropped features, and their names in frame order."""
    rows = correlated_features(correlation_pairs(df, features), threshold).collect()  # at most one per feature
    dropped = [r["feature_j"] for r in sorted(rows, key=lambda r: r["j"])]
    return df.drop(*dropped), dropped
