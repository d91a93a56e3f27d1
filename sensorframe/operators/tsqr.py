"""Leave-one-run-out least squares from triangular factors, for features that are nearly collinear.

Sums of products square the condition of the features and lose half of the digits. Here each task factors its rows of a
fold (QR), factors of a fold are merged by factoring them one upon the other, and what a fold's training rows have is merged from the
factors of all other folds: folds are dealt to about as many groups as a group has folds, and within a group, as among the
groups, factors are merged forwards and backwards once, so no fold's factor is merged more than a few times.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.operators.scaling import scaled, scaler_values
from sensorframe.session import written


def merged(*factors: np.ndarray) -> np.ndarray:
    """The triangular factor of all rows that ``factors`` stand for."""
    return np.linalg.qr(np.vstack(factors), mode="r")


def all_but_one(factors: list[np.ndarray], size: int, outside: np.ndarray | None = None) -> list[np.ndarray]:
    """For each factor what all others, and ``outside``, have: what comes before it merged with what comes after."""
    none = np.zeros((0, size)) if outside is None else outside
    before, after = [none], [np.zeros((0, size))]
    for f in factors[:-1]:
        before.append(merged(before[-1], f))
    for f in factors[:0:-1]:
        after.append(merged(after[-1], f))
    return [merged(a, b) for a, b in zip(before, reversed(after))]


def _solved(factor: np.ndarray, size: int) -> np.ndarray:
    """Intercept and weights from the factor of (1, features, label)."""
    w, *_ = np.linalg.lstsq(factor[:, :-1], factor[:, -1], rcond=np.finfo(float).eps * size)
    return w


def loro_factors(
    df: DataFrame, features: Sequence[str], label: str, fold: str = "run_id"
) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """As ``loro_coefficients``: (fold, n_train, n_test, intercept, weights) and the statistics that features were
    standardised with. Folds that leave no rows to train on are skipped. The driver gets one factor per group of folds,
    that is as many as the root of their number."""
    columns = [*features, label]
    statistics = scaler_values(df, columns)
    if any(mean is None for mean, _ in statistics.values()):  # no rows at all
        statistics = {c: (0.0, 0.0) for c in columns}
    size = len(columns) + 1
    rows = df.select(F.col(fold).alias("fold"), *[scaled(c, *statistics[c]).alias(f"x{i}") for i, c in enumerate(columns)])
    fold_type = df.schema[fold].dataType.simpleString()
    y_mean, y_unit = statistics[label][0], statistics[label][1] or 1.0

    def factored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([np.ones(batch.num_rows), *[batch.column(k + 1).to_numpy(zero_copy_only=False) for k in range(size - 1)]])
            codes = batch.column("fold").dictionary_encode()
            at = codes.indices.fill_null(len(codes.dictionary)).to_numpy(zero_copy_only=False)
            order = np.argsort(at, kind="stable")
            edges = np.flatnonzero(np.diff(at[order], prepend=-1))
            parts = np.split(order, edges[1:]) if len(order) else []
            found = [np.linalg.qr(x[p], mode="r").ravel().tolist() for p in parts]
            yield pa.record_batch([batch.column("fold").take(pa.array(order[edges])), pa.array([len(p) for p in parts], pa.int64()), pa.array(found, pa.list_(pa.float64()))], names=["fold", "n", "r"])

    def by(key: str, kind: str, parts: DataFrame) -> DataFrame:
        """Rows of one ``key``, merged as a stream."""

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, n, total, begun = None, 0, np.zeros((0, size)), False

            def row() -> pa.RecordBatch:
                return pa.record_batch([pa.array([now], types[kind]), pa.array([n], pa.int64()), pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=[key, "n", "r"])

            for batch in batches:
                for value, count, r in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2)):
                    value = value.as_py()
                    if not begun or value != now:
                        if begun:
                            yield row()
                        now, n, total, begun = value, 0, np.zeros((0, size)), True
                    n, total = n + count, merged(total, r.values.to_numpy().reshape(-1, size))
            if begun:
                yield row()

        types = {kind: parts.select(key).limit(0).toArrow().schema.field(0).type}
        return written(parts.select(key, "n", "r").repartition(key).sortWithinPartitions(key).mapInArrow(add, f"{key} {kind}, n long, r array<double>"))

    per_fold = by("fold", fold_type, rows.sortWithinPartitions("fold").mapInArrow(factored, f"fold {fold_type}, n long, r array<double>"))
    n_folds, n_all = per_fold.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    groups = max(1, math.isqrt(n_folds))
    dealt = per_fold.withColumn("grp", F.pmod(F.xxhash64("fold"), F.lit(groups)).cast("int"))
    found = by("grp", "int", dealt).orderBy("grp").collect()
    outside = dict(zip([r["grp"] for r in found], all_but_one([np.array(r["r"]).reshape(-1, size) for r in found], size)))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[object, int, np.ndarray]] = []
        group = None

        def result() -> pa.RecordBatch:
            rest = all_but_one([r for _, _, r in held], size, outside[group])
            known = [(k, n, _solved(r, size)) for (k, n, _), r in zip(held, rest) if n_all > n]
            weights = [(w[1:] * y_unit).tolist() for _, _, w in known]
            columns = [
                pa.array([k for k, _, _ in known], key_type), pa.array([n_all - n for _, n, _ in known], pa.int64()), pa.array([n for _, n, _ in known], pa.int64()),
                pa.array([float(w[0] * y_unit + y_mean) for _, _, w in known], pa.float64()), pa.array(weights, pa.list_(pa.float64())),
            ]
            return pa.record_batch(columns, names=["fold", "n_train", "n_test", "intercept", "weights"])

        for batch in batches:
            for g, key, n, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if held and g != group:
                    yield result()
                    held.clear()
                group = g
                held.append((key, n, r.values.to_numpy().reshape(-1, size)))
        if held:
            yield result()

    key_type = per_fold.select("fold").limit(0).toArrow().schema.field(0).type
    schema = f"fold {fold_type}, n_train bigint, n_test bigint, intercept double, weights array<double>"
    return dealt.select("grp", "fold", "n", "r").repartition("grp").sortWithinPartitions("grp", "fold").mapInArrow(solve, schema), statistics
