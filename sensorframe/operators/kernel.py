"""Leave-one-run-out kernel regression: ridge regression on random Fourier features, solved for all folds from sums.

One pass adds up the products of all rows' Fourier features (a matrix of fixed size). A second pass deals rows by fold:
each fold's own products are taken from the total, the ridge system of what is left is solved, and the fold's rows are
predicted where they are. Folds too long for one task have sums of their own from the first pass, and their rows are
predicted in place: tasks get the weights, of which there is one set for ``LONG_FOLD`` rows at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sensorframe.functions import clip_negative, residual
from sensorframe.operators.scaling import scaled, scaler_values
from sensorframe.session import written

#: Rows of a fold that one task holds; longer folds are summed in parts.
LONG_FOLD = 100_000
#: Rows that are mapped to their features together, and groups that the tasks' sums are added up in first.
SLICE, SALTS = 4096, 32
#: Folds whose sums a task holds at once. Up to as many long folds, rows are summed where they are.
HELD = 16


def fourier_map(n_features: int, dim: int, gamma: float, seed: int) -> Callable[[np.ndarray], np.ndarray]:
    """Random Fourier features (Rahimi & Recht 2007) of the RBF kernel exp(-gamma |x-y|^2), for rows of a matrix."""
    rng = np.random.default_rng(seed)
    omega = rng.normal(0.0, np.sqrt(2.0 * gamma), size=(n_features, dim))
    phase = rng.uniform(0.0, 2.0 * np.pi, size=dim)
    scale = np.sqrt(2.0 / dim)

    def map_(x: np.ndarray) -> np.ndarray:
        out = x @ omega
        out += phase
        np.cos(out, out=out)
        out *= scale
        return out

    return map_


def ridge(sums: np.ndarray, penalty: Callable[[float, float], float]) -> tuple[float, np.ndarray] | None:
    """(intercept, weights) from the sums of products of (1, features, label). ``penalty`` takes the number of rows
    and the label's deviation and weighs the weights against half of the mean squared error; the intercept is free."""
    n = sums[0, 0]
    if n < 0.5:
        return None
    m = sums / n
    s = m[0, 1:]
    cov = m[1:, 1:] - np.outer(s, s)
    deviation = np.sqrt(max(cov[-1, -1], 0.0))
    if deviation == 0:
        return float(s[-1]), np.zeros(len(s) - 1)
    left = cov[:-1, :-1] + penalty(n, deviation) * np.eye(len(s) - 1)
    w = np.linalg.solve(left, cov[:-1, -1])
    return float(s[-1] - w @ s[:-1]), w


def _matrix(batch: pa.RecordBatch, n: int) -> np.ndarray:
    """The last ``n`` columns, as a matrix."""
    first = batch.num_columns - n
    return np.column_stack([batch.column(first + k).to_numpy(zero_copy_only=False) for k in range(n)])


def loro_kernel(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    ids: Sequence[str],
    fold: str = "run_id",
    model: str = "Fourier Ridge",
    dim: int = 200,
    gamma: float = 0.005,
    seed: int = 42,
    C: float = 5000.0,
    long_fold: int = LONG_FOLD,
) -> DataFrame:
    """Held-out predictions (model, fold, ids, actual, predicted, residual), negatives clipped.

    Features are standardised with the statistics of all rows, as the Fourier features of a row must not depend on the
    fold. For ``n`` training rows whose labels have the deviation ``d`` the penalty is 1 / (C n d), as a fit by MLlib
    with the parameter 1 / (C n) has it. A fold that leaves no training rows is skipped. Features and label must be
    known in all rows; a null fold is a fold of its own.
    """
    columns = [*features, label]
    statistics = scaler_values(df, columns)
    if any(mean is None for mean, _ in statistics.values()):  # no rows at all
        statistics = {c: (0.0, 0.0) for c in columns}
    carried = list(dict.fromkeys(ids))
    keys = [F.col(c).alias(f"i{k}") for k, c in enumerate(carried)]
    values = [scaled(c, *statistics[c]).cast("double").alias(f"x{k}") for k, c in enumerate(columns)]
    rows = df.select(F.col(fold).alias("fold"), F.col(f"`{label}`").cast("double").alias("actual"), *keys, *values)
    size, width = dim + 2, len(columns)
    y_mean, y_unit = statistics[label][0], statistics[label][1] or 1.0
    project = fourier_map(len(features), dim, gamma, seed)

    def mapped(x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), project(x[:, :-1]), x[:, -1]])

    def products(x: np.ndarray) -> np.ndarray:
        out = np.zeros((size, size))
        for at in range(0, len(x), SLICE):
            z = mapped(x[at : at + SLICE])
            out += z.T @ z
        return out

    def penalty(n: float, deviation: float) -> float:
        return 1.0 / (C * n * deviation * y_unit)

    lengths = written(rows.groupBy("fold").count())
    longest = lengths.filter(F.col("count") > long_fold).orderBy("fold").collect()
    n_long = len(longest)
    if n_long:
        rows = _numbered(rows, lengths, longest, long_fold, [c for c in rows.columns if c[0] == "i"])
    else:
        rows = rows.select("fold", F.lit(None).cast("int").alias("number"), *rows.columns[1:])
    sums = _sums(rows, products, size, width)
    found = sums.agg(Summarizer.sum(F.col("sums")).alias("sums")).head()["sums"]
    total = found.toArray().reshape(size, size) if found is not None and found.size else np.zeros((size, size))

    fold_type = df.schema[fold].dataType.simpleString()
    id_types = [df.schema[c].dataType.simpleString() for c in carried]
    schema = ", ".join([f"fold {fold_type}", "actual double", *[f"i{k} {t}" for k, t in enumerate(id_types)], "raw double"])
    names = ["fold", "actual", *[f"i{k}" for k in range(len(carried))]]

    def predicted(batch: pa.RecordBatch, raw: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([*[batch.column(c) for c in names], pa.array(raw * y_unit + y_mean)], names=[*names, "raw"])

    def of_folds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by fold; those of one fold are held until its last."""
        held: list[pa.RecordBatch] = []

        def close() -> Iterator[pa.RecordBatch]:
            xs = [_matrix(b, width) for b in held]
            solved = ridge(total - sum(map(products, xs)), penalty)
            if solved is not None:
                for b, x in zip(held, xs):
                    for at in range(0, len(x), SLICE):
                        yield predicted(b.slice(at, SLICE), solved[0] + project(x[at : at + SLICE, :-1]) @ solved[1])
            held.clear()

        for batch in batches:
            codes = batch.column("fold").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
            for a, b in zip(edges[:-1], edges[1:]):
                if held and held[0].column("fold")[0] != batch.column("fold")[a] and (held[0].column("fold")[0].is_valid or batch.column("fold")[a].is_valid):
                    yield from close()
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield from close()

    short = rows if not n_long else rows.filter("number is null")
    out = short.drop("number").repartition("fold").sortWithinPartitions("fold").mapInArrow(of_folds, schema)
    if n_long:
        weights = _weights(sums, total, penalty)
        out = out.unionByName(_long_folds(rows.filter("number is not null"), weights, project, predicted, width, schema))
    return out.select(
        F.lit(model).alias("model"), "fold", *[F.col(f"i{k}").alias(c) for k, c in enumerate(carried)], "actual", clip_negative(F.col("raw")).alias("predicted")
    ).withColumn("residual", residual(F.col("actual"), F.col("predicted")))


def _numbered(rows: DataFrame, lengths: DataFrame, longest: list, long_fold: int, ids: Sequence[str]) -> DataFrame:
    """``rows`` with the number of their fold, if it is a long one. Beyond ``HELD`` such folds, rows are dealt by fold in
    blocks of about ``long_fold``, so that a task meets few of them; the table of folds has one row for ``long_fold``
    rows at most."""
    spark, schema = rows.sparkSession, lengths.schema["fold"].dataType.simpleString()
    known = [(r["fold"], k, -(-r["count"] // long_fold)) for k, r in enumerate(longest)]
    table = spark.createDataFrame(known, f"long {schema}, number int, blocks long")
    flagged = rows.join(F.broadcast(table), F.col("fold").eqNullSafe(F.col("long")), "left")
    if len(known) > HELD:
        n_short = lengths.filter(F.col("count") <= long_fold).agg(F.coalesce(F.sum("count"), F.lit(0))).head()[0]
        blocks = F.coalesce("blocks", F.lit(max(1, -(-n_short // long_fold))))
        flagged = flagged.repartition("number", F.pmod(F.xxhash64("actual", *ids), blocks)).sortWithinPartitions("number")
    return flagged.select("fold", "number", *rows.columns[1:])


def _sums(rows: DataFrame, products: Callable[[np.ndarray], np.ndarray], size: int, width: int) -> DataFrame:
    """(number, sums) of each long fold, and of all other rows together (a null number), saved."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        salt = TaskContext.get().partitionId() % SALTS

        def emit() -> pa.RecordBatch:
            numbers = pa.array([k if k >= 0 else None for k in held], pa.int32())
            values = pa.array([m.ravel() for m in held.values()], pa.list_(pa.float64()))
            return pa.record_batch([numbers, pa.array([salt] * len(held), pa.int32()), values], names=["number", "salt", "sums"])

        for batch in batches:
            at, x = _numbers(batch), _matrix(batch, width)
            for key in np.unique(at).tolist():
                own = products(x[at == key])
                if key in held:
                    held[key] += own
                else:
                    if len(held) > HELD:
                        yield emit()
                        held.clear()
                    held[key] = own
        if held:
            yield emit()

    values = [c for c in rows.columns if c[0] == "x"]
    parts = rows.select("number", *values).mapInArrow(of_task, "number int, salt int, sums array<double>")
    parts = parts.select("number", "salt", array_to_vector("sums").alias("sums"))
    for keys in (["number", "salt"], ["number"]):
        parts = parts.groupBy(*keys).agg(Summarizer.sum(F.col("sums")).alias("sums"))
    return written(parts)


def _numbers(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("number").fill_null(-1).to_numpy(zero_copy_only=False)


def _weights(sums: DataFrame, total: np.ndarray, penalty: Callable[[float, float], float]) -> dict[int, np.ndarray]:
    """Intercept and weights of each long fold, solved where its sums are; none for a fold that leaves no other rows."""
    size = len(total)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ridge(total - s.values.to_numpy().reshape(size, size), penalty) for s in batch.column("sums")]
            some = [k for k, x in enumerate(found) if x is not None]
            weights = pa.array([np.append(found[k][0], found[k][1]) for k in some], pa.list_(pa.float64()))
            yield pa.record_batch([batch.column("number").take(pa.array(some, pa.int64())), weights], names=["number", "weights"])

    long = sums.filter("number is not null").select("number", vector_to_array("sums").alias("sums"))
    solved = long.mapInArrow(solve, "number int, weights array<double>")
    return {r["number"]: np.array(r["weights"]) for r in solved.toLocalIterator()}


def _long_folds(rows, weights, project, predicted, width, schema) -> DataFrame:
    """Predictions of folds that are spread over tasks, made where the rows are. No row carries the weights of its fold:
    a task has those of all long folds."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.slice(at, SLICE)
                z, numbers, raw = project(_matrix(part, width)[:, :-1]), _numbers(part), np.full(len(part), np.nan)
                for key in np.unique(numbers).tolist():
                    if key in weights:
                        own = numbers == key
                        raw[own] = weights[key][0] + z[own] @ weights[key][1:]
                known = np.isin(numbers, list(weights))
                yield predicted(part.filter(pa.array(known)), raw[known])

    return rows.mapInArrow(predict, schema)
