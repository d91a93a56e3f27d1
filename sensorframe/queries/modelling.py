"""Cross-validation and model queries."""

from __future__ import annotations

import functools
import math

from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.operators.crossval import cross_validate, grouped_folds, positive_label
from sensorframe.operators.layout import MOST_DEALT
from sensorframe.operators.linear import loro_linear
from sensorframe.operators.metrics import fold_metrics, model_summary
from sensorframe.operators.models import ModelSpec, boosting, forest, kernel_model, reference_preset
from sensorframe.operators.report import box_statistics
from sensorframe.operators.selection import above_median, forest_importance, top_scores
from sensorframe.plans import learning_frame, select_by_scores
from sensorframe.queries.common import (
    IDS,
    PREDICTIONS_SQL,
    SCORES_SQL,
    held_out_predictions,
    labelled,
    rounded,
    show,
    sql_show,
)
from sensorframe.queries.relational import NARROW, NARROW_SQL, SCORES_TABLE_SQL, feature_scores, narrow_frame
from sensorframe.session import written

QUERIES: dict = {}
SQL: dict[str, str] = {}

# Small settings: the full ones are in ``models.reference_preset``.
SMALL_SELECTOR = {"numTrees": 20, "maxDepth": 8}
SMALL_FOREST = {"numTrees": 10, "maxDepth": 6, "minInstancesPerNode": 3, "seed": 42}
SMALL_BOOSTING = {"maxIter": 5, "stepSize": 0.03, "maxDepth": 5, "subsamplingRate": 0.7, "seed": 42}
FOLDS = 3


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


@query(
    f"""WITH {PREDICTIONS_SQL} SELECT {sql_show(["model", "fold", *IDS], ["actual", "predicted", "residual"])}
    FROM predictions WHERE model = 'mean'"""
)
def q_loro_baseline(spark, sf_dir) -> DataFrame:
    rows = positive_label(labelled(spark, sf_dir), "hours_left")
    return _shown(loro_linear(rows, [], "hours_left", IDS, model="mean"))


@query(
    f"""WITH {PREDICTIONS_SQL} SELECT {sql_show(["model", "fold", *IDS], ["actual", "predicted", "residual"])}
    FROM predictions WHERE model = 'linear'"""
)
def q_loro_ols(spark, sf_dir) -> DataFrame:
    rows = positive_label(labelled(spark, sf_dir), "hours_left")
    return _shown(loro_linear(rows, ["value"], "hours_left", IDS, model="linear"))


@query(f"""WITH {PREDICTIONS_SQL} SELECT {sql_show(["model", "fold", *IDS], ["actual", "predicted", "residual"])} FROM predictions""")
def q_pooled_predictions(spark, sf_dir) -> DataFrame:
    return _shown(held_out_predictions(spark, sf_dir))


@query(f"WITH {SCORES_SQL} SELECT {sql_show(['model', 'fold'], ['r2', 'mse', 'rmse', 'mae'])} FROM scores")
def q_fold_metrics(spark, sf_dir) -> DataFrame:
    return show(fold_metrics(held_out_predictions(spark, sf_dir)), ["model", "fold"], ["r2", "mse", "rmse", "mae"])


@query(
    f"""WITH {SCORES_SQL}, means AS (SELECT model, avg(r2) AS avg_r2, avg(rmse) AS avg_rmse, avg(mae) AS avg_mae,
    avg(mse) AS avg_mse FROM scores GROUP BY model)
    SELECT {sql_show(["model"], ["avg_r2", "avg_rmse", "avg_mae", "avg_mse"])} FROM means ORDER BY 2 DESC, 1"""
)
def q_model_summary(spark, sf_dir) -> DataFrame:
    summary = model_summary(fold_metrics(held_out_predictions(spark, sf_dir)))
    return show(summary, ["model"], ["avg_r2", "avg_rmse", "avg_mae", "avg_mse"])


def _shown(predictions: DataFrame) -> DataFrame:
    return show(predictions, ["model", "fold", *IDS], ["actual", "predicted", "residual"])


def _learning(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    return learning_frame(narrow_frame(spark, sf_dir), "hours_left", IDS, NARROW.channels)


def _evaluate_runs(spark, sf_dir, models: dict[str, ModelSpec]):
    """One fold per run."""
    rows, names = _learning(spark, sf_dir)
    return cross_validate(rows, names, "hours_left", models, IDS, fold="run_id")


def _evaluate(spark, sf_dir, models: dict[str, ModelSpec], parallelism: int = 2, part_rows: int | None = None):
    rows, names = _learning(spark, sf_dir)
    if part_rows:
        rows = rows.coalesce(max(1, math.ceil(rows.count() / part_rows)))
    return cross_validate(grouped_folds(rows, FOLDS), names, "hours_left", models, IDS, parallelism=parallelism, store=False)


@query()
def q_loro_ols_all(spark, sf_dir) -> DataFrame:
    """Leave-one-run-out least squares on all narrow features."""
    rows, names = _learning(spark, sf_dir)
    return _shown(loro_linear(rows, names, "hours_left", IDS))


def _pairs_sql(names) -> str:
    pairs = ", ".join(
        f"struct_pack(i := {i}, j := {j}, c := abs(corr(\"{a}\", \"{b}\")))" for j, b in enumerate(names) for i, a in enumerate(names[:j])
    )
    return f"pairs AS (SELECT p.i AS i, p.j AS j, p.c AS c FROM (SELECT unnest([{pairs}]) AS p FROM frame WHERE hours_left > 0))"


@query(
    f"""WITH {SCORES_TABLE_SQL}, {_pairs_sql(NARROW.names())},
    placed AS (SELECT feature, importance, list_position([{", ".join(f"'{c}'" for c in NARROW.names())}], feature) - 1 AS position FROM score_table),
    kept AS (SELECT * FROM placed WHERE importance >= (SELECT median(importance) FROM score_table))
    SELECT position::INTEGER AS position, feature FROM kept WHERE NOT EXISTS (
      SELECT 1 FROM pairs JOIN kept earlier ON earlier.position = pairs.i WHERE pairs.j = kept.position AND pairs.c > 0.9)"""
)
def q_selection_chain(spark, sf_dir) -> DataFrame:
    """Scores that SQL can follow, the median cut, the correlation filter, and the names that are left."""
    rows, names = learning_frame(narrow_frame(spark, sf_dir), "hours_left", IDS, NARROW.channels)
    scores = feature_scores(spark, sf_dir)
    place = F.array_position(F.array(*map(F.lit, names)), F.col("feature")).cast("int") - 1
    chosen = select_by_scores(rows, scores.withColumn("position", place))
    return spark.createDataFrame([(names.index(f), f) for f in chosen.features], "position int, feature string")


MODELS = ("Fourier Ridge", "Gradient Boosting", "Column-Sampled Boosting", "Random Forest", "Linear Regression")


def _five() -> dict[str, ModelSpec]:
    return {
        "Fourier Ridge": kernel_model(),
        "Gradient Boosting": ModelSpec(lambda n: boosting(**SMALL_BOOSTING), trees=True),
        "Column-Sampled Boosting": ModelSpec(lambda n: boosting(**{**SMALL_BOOSTING, "featureSubsetStrategy": "0.7"}), trees=True),
        "Random Forest": ModelSpec(lambda n: forest(**SMALL_FOREST), trees=True),
        "Linear Regression": ModelSpec(lambda n: LinearRegression(), additive=True),
    }


@query()
def q_leaderboard(spark, sf_dir) -> DataFrame:
    """The five models at full settings by their mean scores over the folds. A boosting fit is thousands of short jobs,
    one after the other, so the folds of two models are fitted at a time, and few rows make few tasks."""
    found = _evaluate(spark, sf_dir, reference_preset(), parallelism=2 * FOLDS, part_rows=MOST_DEALT)
    summary = model_summary(fold_metrics(found.predictions))
    return show(summary, ["model"], ["avg_r2", "avg_rmse", "avg_mae", "avg_mse"])


@query()
def q_model_boxplot(spark, sf_dir) -> DataFrame:
    """The five models' scores: a box for each metric, with the score of each fold beside it."""
    scores = written(fold_metrics(_evaluate(spark, sf_dir, _five()).predictions))
    names, parts = [f"fold_{k}" for k in range(FOLDS)], []
    for metric in ("r2", "rmse", "mae"):
        each = scores.groupBy("model").pivot("fold", list(range(FOLDS))).agg(F.first(metric)).toDF("model", *names)
        parts.append(box_statistics(scores, metric).join(each, "model").withColumn("metric", F.lit(metric)))
    both = functools.reduce(DataFrame.unionByName, parts)
    return show(both, ["model", "metric", "n", "n_outliers"], ["q1", "median", "q3", "whisker_lo", "whisker_hi", *names])


@query(
    f"""WITH {NARROW_SQL} SELECT model, run_id, event_id, round_even((hours_left) * 1e6, 0) / 1e6 + 0.0 AS actual, true AS sane
    FROM frame, (VALUES {", ".join(f"('{m}')" for m in MODELS)}) AS names(model) WHERE hours_left > 0"""
)
def q_cv_rows(spark, sf_dir) -> DataFrame:
    """What must hold for every model: each row is predicted once, with its label, no negative or missing value, and
    a forest's predictions lie within the labels' range."""
    rows, names = _learning(spark, sf_dir)
    found = cross_validate(grouped_folds(rows, FOLDS), names, "hours_left", _five(), IDS, store=False).predictions
    low, high = rows.agg(F.min("hours_left"), F.max("hours_left")).head()
    inside = F.col("predicted").between(low, high) | (F.col("model") != "Random Forest")
    sane = F.coalesce((F.col("predicted") >= 0) & inside, F.lit(False))
    return found.select("model", *IDS, rounded("actual").alias("actual"), sane.alias("sane"))


@query(f"SELECT {len(NARROW.names())}::BIGINT AS n, 1.0::DOUBLE AS total, true AS positive FROM events LIMIT 1")
def q_rf_importance_sum(spark, sf_dir) -> DataFrame:
    """Importances are complete, not negative and sum up to 1."""
    found = q_rf_importance(spark, sf_dir)
    return found.agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("importance"), 9).alias("total"), F.min(F.col("importance") >= 0).alias("positive"))


@query()
def q_rf_importance(spark, sf_dir) -> DataFrame:
    """The whole vector."""
    rows, names = _learning(spark, sf_dir)
    return forest_importance(rows, names, "hours_left", **SMALL_SELECTOR)


@query()
def q_rf_select(spark, sf_dir) -> DataFrame:
    rows, names = _learning(spark, sf_dir)
    return above_median(forest_importance(rows, names, "hours_left", **SMALL_SELECTOR))


@query()
def q_cv_ols(spark, sf_dir) -> DataFrame:
    return _shown(_evaluate_runs(spark, sf_dir, {"Linear Regression": ModelSpec(lambda n: LinearRegression(regParam=0.0), additive=True)}).predictions)


@query()
def q_cv_rf(spark, sf_dir) -> DataFrame:
    models = {"Random Forest": ModelSpec(lambda n: forest(**SMALL_FOREST), trees=True)}
    return _shown(_evaluate(spark, sf_dir, models).predictions)


@query()
def q_cv_gbt(spark, sf_dir) -> DataFrame:
    models = {"Gradient Boosting": ModelSpec(lambda n: boosting(**SMALL_BOOSTING), trees=True)}
    return _shown(_evaluate(spark, sf_dir, models).predictions)


@query()
def q_cv_gbt_cols(spark, sf_dir) -> DataFrame:
    settings = {**SMALL_BOOSTING, "featureSubsetStrategy": "0.7"}
    models = {"Column-Sampled Boosting": ModelSpec(lambda n: boosting(**settings), trees=True)}
    return _shown(_evaluate(spark, sf_dir, models).predictions)


@query()
def q_cv_rff(spark, sf_dir) -> DataFrame:
    return _shown(_evaluate_runs(spark, sf_dir, {"Fourier Ridge": kernel_model()}).predictions)


def _importances(spark, sf_dir, name: str, make) -> DataFrame:
    """Importances of the last fold's model, and their mean over the folds."""
    found = _evaluate(spark, sf_dir, {name: ModelSpec(make, trees=True)})
    mean = found.mean_importances[name].select("feature", F.col("importance").alias("mean_importance"))
    return top_scores(found.importances[name].join(mean, "feature")).select(
        "feature", rounded("importance").alias("importance"), rounded("mean_importance").alias("mean_importance")
    )


@query()
def q_model_importance(spark, sf_dir) -> DataFrame:
    return _importances(spark, sf_dir, "Random Forest", lambda n: forest(**SMALL_FOREST))


@query()
def q_model_importance_gbt(spark, sf_dir) -> DataFrame:
    return _importances(spark, sf_dir, "Gradient Boosting", lambda n: boosting(**SMALL_BOOSTING))


@query()
def q_model_importance_gbt_cols(spark, sf_dir) -> DataFrame:
    return _importances(spark, sf_dir, "Column-Sampled Boosting", lambda n: boosting(**{**SMALL_BOOSTING, "featureSubsetStrategy": "0.7"}))
