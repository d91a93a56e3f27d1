"""Leave-one-run-out cross-validation of any model."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import islice
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe.functions import clip_negative, residual
from sensorframe.operators.kernel import loro_kernel
from sensorframe.operators.linear import loro_linear
from sensorframe.operators.models import ModelSpec, fit
from sensorframe.operators.selection import importance_table
from sensorframe.session import table_path, written


def positive_label(df: DataFrame, label: str) -> DataFrame:
    """Rows with a label above 0. Apply after the features: dropping rows first would change the
    rows that lags and rolling windows see."""
    return df.where(F.col(f"`{label}`") > 0)


def fold_split(df: DataFrame, held_out: Column) -> tuple[DataFrame, DataFrame]:
    """(train, test): a filter on the stacked frame each, no union of the other runs."""
    return df.where(~held_out), df.where(held_out)


def grouped_folds(df: DataFrame, folds: int, run: str = "run_id", fold: str = "fold") -> DataFrame:
    """Whole runs dealt out to a fixed number of folds by a hash of the run."""
    return df.withColumn(fold, F.pmod(F.xxhash64(run), F.lit(folds)).cast("int"))


def fold_sizes(df: DataFrame, fold: str, label: str) -> DataFrame:
    """(fold, n_train, n_test, usable) counted over rows with a positive label. A fold without
    training or test rows is not usable."""
    per_fold = df.groupBy(F.col(fold).alias("fold")).agg(
        F.count_if(F.col(f"`{label}`") > 0).cast("bigint").alias("n_test")
    )
    total = per_fold.agg(F.coalesce(F.sum("n_test"), F.lit(0))).scalar()
    return per_fold.select("fold", (total - F.col("n_test")).alias("n_train"), "n_test").withColumn(
        "usable", (F.col("n_train") > 0) & (F.col("n_test") > 0)
    )


def pool_predictions(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class Evaluation:
    predictions: DataFrame
    importances: dict[str, DataFrame] = field(default_factory=dict)  # model -> last fold's importances
    mean_importances: dict[str, DataFrame] = field(default_factory=dict)  # model -> mean over folds


def _training_statistics(df: DataFrame, features: Sequence[str], fold: str) -> Callable[[object], dict]:
    """fold -> feature -> (mean, population std) of the other folds' rows. Sums about the overall means are saved per
    fold; what a fold's training rows have is the total less its own, so no number of folds meets on the driver."""
    centre = df.agg(*[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(features)]).head()
    off = [F.col(f"`{c}`") - F.lit(centre[f"m{i}"]) for i, c in enumerate(features)]
    sums = written(
        df.groupBy(F.col(fold).alias("fold")).agg(
            F.count(F.lit(1)).alias("n"),
            *[F.sum(x).alias(f"s{i}") for i, x in enumerate(off)],
            *[F.sum(x * x).alias(f"q{i}") for i, x in enumerate(off)],
        )
    )
    total = sums.agg(*[F.sum(c).alias(c) for c in sums.columns if c != "fold"]).head()

    def of(key: object) -> dict[str, tuple[float, float]]:
        own = sums.where(F.col("fold").eqNullSafe(F.lit(key))).head()
        n, out = total["n"] - own["n"], {}
        for i, c in enumerate(features):
            mean = (total[f"s{i}"] - own[f"s{i}"]) / n
            var = max(0.0, (total[f"q{i}"] - own[f"q{i}"]) / n - mean * mean)
            mean += centre[f"m{i}"]
            constant = var <= (1e-12 * abs(mean)) ** 2 or var <= 1e-14 * (total[f"q{i}"] / total["n"])
            out[c] = (mean, 0.0 if constant else math.sqrt(var))
        return out

    return of


def _fingerprint(data: DataFrame, models: dict[str, ModelSpec], about: tuple) -> str:
    """A name for what a validation depends on: the rows, whatever their order, the columns, and the models' settings."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in data.columns])
    rows = data.agg(F.count(F.lit(1)), F.bit_xor(row), F.sum(F.pmod(row, F.lit(1 << 31)))).head()
    settings = []
    for name, spec in sorted(models.items()):
        made = spec.make(1000)
        values = sorted((p.name, str(v)) for p, v in made.extractParamMap().items())
        settings.append((name, type(made).__name__, values, spec.scale, sorted((spec.fourier or {}).items())))
    return hashlib.sha256(repr((tuple(rows), data.dtypes, about, settings)).encode()).hexdigest()[:24]


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _saved_weights(spark: SparkSession, path: str, names: Sequence[str]) -> list[float]:
    found = {r["feature"]: r["importance"] for r in spark.read.parquet(path).collect()}
    return [found[f] for f in names]


def cross_validate(
    frame: DataFrame,
    features: Sequence[str] | dict[object, Sequence[str]],
    label: str,
    models: dict[str, ModelSpec],
    ids: Sequence[str],
    fold: str = "fold",
    parallelism: int = 2,
    store: bool = True,
    resume: str | None = None,
) -> Evaluation:
    """Per model and fold: train on the other folds, predict the held-out one, clip negatives.

    ``features`` may differ by fold (selection within the fold); a fold without features is skipped. The frame is
    written once, clustered by fold, so that each of the many training passes reads it back pruned instead of
    computing the features again (``store=False``: it is a stored table already). There is no limit to the folds: fits
    run ``parallelism`` at a time, and each one's predictions are saved at once, so that what reads the result
    predicts nothing again. A model marked ``additive`` is solved for all folds from one pass of sums instead, unless
    features differ by fold.

    With ``resume``, a folder in shared storage, fits are kept there under a name made from the rows, the columns and
    the models' settings: a validation that was ended goes on with the fits that are missing.
    """
    spark = frame.sparkSession
    per_fold = features if isinstance(features, dict) else None
    wanted = list(dict.fromkeys(f for fs in per_fold.values() for f in fs)) if per_fold else list(features)
    kept = list(dict.fromkeys([*ids, fold, label, *wanted]))
    data = positive_label(frame, label).select(*[f"`{c}`" for c in kept])
    if store:
        data = written(data, sort_by=(fold,))
    sizes = written(fold_sizes(data, fold, label).where("usable"))
    additive = [m for m in models if models[m].additive and not per_fold]
    each = [m for m in models if m not in additive] if wanted else []
    statistics = _training_statistics(data, wanted, fold) if wanted and any(models[m].scale for m in each) else None
    shape = data.select(
        F.lit("").alias("model"), F.col(fold).alias("fold"), *ids, F.col(f"`{label}`").alias("actual"), F.lit(0.0).alias("predicted"), F.lit(0.0).alias("residual")
    ).schema
    place = f"{resume}/{_fingerprint(data, models, (label, ids, fold, wanted, per_fold))}" if resume and each else table_path(spark)

    def one(task):
        number, name, row = task
        key, names = row["fold"], list(per_fold[row["fold"]] if per_fold else wanted)
        if resume and _exists(spark, f"{place}/part={number}/_SUCCESS"):
            return name, names, _saved_weights(spark, f"{place}/weights-{number}", names) if models[name].trees else None
        train, test = fold_split(data, F.col(fold) == F.lit(key))
        scaling = None
        if models[name].scale:
            known = statistics(key)
            scaling = {c: known[c] for c in names}
        fitted = fit(models[name], train, names, label, row["n_train"], scaling)
        carried = list(dict.fromkeys([*ids, label]))
        predictions = fitted.predict(test, carried).select(
            F.lit(name).alias("model"),
            F.lit(key).cast(data.schema[fold].dataType).alias("fold"),
            *ids,
            F.col(f"`{label}`").alias("actual"),
            clip_negative(F.col("prediction")).alias("predicted"),
        )
        predictions = predictions.withColumn("residual", residual(F.col("actual"), F.col("predicted")))
        weights = fitted.model.featureImportances.toArray() if models[name].trees else None
        if resume and weights is not None:
            importance_table(spark, names, weights).write.mode("overwrite").parquet(f"{place}/weights-{number}")
        predictions.write.mode("overwrite").parquet(f"{place}/part={number}")  # last: a fit that has these is complete
        return name, names, weights

    def tasks():
        number = 0
        for name in each:
            for row in sizes.orderBy("fold").toLocalIterator():
                if not per_fold or per_fold.get(row["fold"]):
                    yield number, name, row
                    number += 1

    # Importances are added up as fits come in: one vector per feature and model, however many folds.
    last: dict[str, DataFrame] = {}
    total: dict[str, dict[str, float]] = {}
    fits: dict[str, int] = {}
    done = 0
    with ThreadPool(max(1, parallelism)) as pool:
        run, queue = inheritable_thread_target(spark)(one), tasks()
        while batch := list(islice(queue, 4 * max(1, parallelism))):
            for name, names, weights in pool.map(run, batch, chunksize=1):
                done += 1
                if weights is not None:
                    last[name] = importance_table(spark, names, weights)
                    fits[name] = fits.get(name, 0) + 1
                    own = total.setdefault(name, {})
                    for f, w in zip(names, weights):
                        own[f] = own.get(f, 0.0) + float(w)
    mean = {m: importance_table(spark, list(t), [w / fits[m] for w in t.values()]) for m, t in total.items()}
    parts = [spark.read.schema(shape).parquet(f"{place}/part=*")] if done else []
    if wanted:
        usable = data.join(sizes.select(F.col("fold").alias(fold)), fold, "left_semi") if additive else data
        for m in additive:
            kernel = models[m].fourier
            solved = loro_kernel(usable, wanted, label, ids, fold, model=m, C=models[m].C, **kernel) if kernel else loro_linear(usable, wanted, label, ids, fold, model=m)
            parts.append(written(solved.select(*shape.fieldNames())))
    return Evaluation(pool_predictions(parts) if parts else spark.createDataFrame([], shape), last, mean)
