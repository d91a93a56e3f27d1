"""Shared pieces: the run view, its SQL twin, output rounding."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe.operators.crossval import positive_label, pool_predictions
from sensorframe.operators.layout import RunLayout
from sensorframe.operators.linear import loro_linear
from sensorframe.session import written
from sensorframe.sources import event_channels, event_runs, with_hours_left
from sensorframe.sources.tables import KEYS, ORDER

IDS = ("run_id", "event_id")


def rounded(c: str | Column, decimals: int = 6) -> Column:
    """Engines sum in different orders, so outputs are rounded, by the same steps in both (their
    own ``round`` functions part on ties). Adding 0 turns -0.0 into 0.0."""
    unit = F.lit(float(10**decimals))
    return F.rint((F.col(c) if isinstance(c, str) else c) * unit) / unit + F.lit(0.0)


def show(df: DataFrame, ids: Iterable[str], values: Iterable[str], decimals: int = 6) -> DataFrame:
    return df.select(*ids, *[rounded(f"`{c}`", decimals).alias(c) for c in values])


def sql_rounded(c: str, decimals: int = 6) -> str:
    return f"round_even(({c}) * 1e{decimals}, 0) / 1e{decimals} + 0.0"


def sql_show(ids: Iterable[str], values: Iterable[str], decimals: int = 6) -> str:
    quoted = [(c, f'"{c}"') for c in values]
    return ", ".join([*ids, *[f"{sql_rounded(q, decimals)} AS {q}" for _, q in quoted]])


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_runs(spark, sf_dir)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_hours_left(event_runs(spark, sf_dir))


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_channels(labelled(spark, sf_dir))


def layout_of(df: DataFrame, profile: Iterable[str] = ()) -> RunLayout:
    return RunLayout.plan(df, KEYS, ORDER, profile=tuple(profile))


def held_out_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave-one-run-out predictions of two models that SQL can follow: the mean of the other
    runs, and least squares on ``value``."""
    rows = positive_label(labelled(spark, sf_dir), "hours_left").select(*IDS, "value", "hours_left")
    rows = written(rows)
    return written(
        pool_predictions(
            [
                loro_linear(rows, [], "hours_left", IDS, model="mean"),
                loro_linear(rows, ["value"], "hours_left", IDS, model="linear"),
            ]
        )
    )


RUNS_SQL = """runs AS (
  SELECT user_id AS run_id, ts, event_id, event_type, value,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
    CASE WHEN event_type = 'error' THEN 'nan'
         WHEN event_type = 'view' AND event_id % 7 = 0 THEN '1_0x'
         ELSE CAST(value AS VARCHAR) END AS t_raw,
    CASE WHEN event_id % 5 <> 0 THEN value END AS m,
    (epoch_us(max(ts) OVER (PARTITION BY user_id)) - epoch_us(ts)) / 3600000000.0 AS hours_left
  FROM events)"""

CHANNELS_SQL = f"""{RUNS_SQL},
channels AS (
  SELECT run_id, ts, event_id, hours_left, t_raw AS "Temp",
    CASE WHEN event_type = 'signup' THEN 'nan' ELSE CAST(40.0 + k / 4 AS VARCHAR) END AS "Hum",
    m AS "MQ2", 2 * value + event_id % 7 AS "MQ3", k AS "MQ4", value + k AS "MQ5",
    CAST(event_id % 100 AS DOUBLE) AS "MQ9", 3 * k + value / 2 AS "MQ135"
  FROM runs)"""

W_SQL = "(PARTITION BY run_id ORDER BY ts, event_id)"


def frame_sql(before: str | int, after: str | int) -> str:
    def edge(n: str | int, word: str) -> str:
        return f"{n} {word}" if n != 0 else "CURRENT ROW"

    return (
        f"(PARTITION BY run_id ORDER BY ts, event_id ROWS BETWEEN {edge(before, 'PRECEDING')}"
        f" AND {edge(after, 'FOLLOWING')})"
    )


UP_TO_SQL = frame_sql("UNBOUNDED", 0)
FROM_SQL = frame_sql(0, "UNBOUNDED")

NUMERIC_SQL = r"'^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$'"


def number_sql(c: str) -> str:
    return (
        f"CASE WHEN regexp_matches({c}, {NUMERIC_SQL}) AND isfinite(TRY_CAST(trim({c}) AS DOUBLE))"
        f" THEN TRY_CAST(trim({c}) AS DOUBLE) END"
    )


def repaired_sql(c: str) -> str:
    """Over a subquery in which ``c`` already is a number with gaps."""
    return (
        f"round_even(coalesce(last_value({c} IGNORE NULLS) OVER {UP_TO_SQL},"
        f" first_value({c} IGNORE NULLS) OVER {FROM_SQL}), 1)"
    )


def neighbours_sql(c: str) -> str:
    """Select items that give the known entries around each row; the source must have ``pos``."""
    at = f'CASE WHEN "{c}" IS NOT NULL THEN pos END'
    return (
        f'max({at}) OVER {UP_TO_SQL} AS "{c}__pp", last_value("{c}" IGNORE NULLS) OVER {UP_TO_SQL} AS "{c}__pv",'
        f' min({at}) OVER {FROM_SQL} AS "{c}__np", first_value("{c}" IGNORE NULLS) OVER {FROM_SQL} AS "{c}__nv"'
    )


def interpolated_sql(c: str) -> str:
    return (
        f'CASE WHEN "{c}" IS NOT NULL THEN "{c}" WHEN "{c}__pv" IS NULL THEN "{c}__nv"'
        f' WHEN "{c}__nv" IS NULL THEN "{c}__pv"'
        f' ELSE "{c}__pv" + ("{c}__nv" - "{c}__pv") / ("{c}__np" - "{c}__pp") * (pos - "{c}__pp") END AS "{c}"'
    )


PREDICTIONS_SQL = f"""{RUNS_SQL},
lab AS (SELECT * FROM runs WHERE hours_left > 0),
own AS (
  SELECT run_id, count(*) AS n, sum(value) AS sx, sum(hours_left) AS sy,
    sum(value * value) AS sxx, sum(value * hours_left) AS sxy
  FROM lab GROUP BY run_id),
every AS (SELECT sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM own),
train AS (
  SELECT run_id, every.n - own.n AS n, every.sx - own.sx AS sx, every.sy - own.sy AS sy,
    every.sxx - own.sxx AS sxx, every.sxy - own.sxy AS sxy
  FROM own, every),
coef AS (
  SELECT *, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS slope FROM train WHERE n > 0),
both_models AS (
  SELECT 'mean' AS model, run_id AS fold, run_id, event_id, hours_left AS actual,
    greatest(sy / n, 0.0) AS predicted FROM lab JOIN coef USING (run_id)
  UNION ALL
  SELECT 'linear', run_id, run_id, event_id, hours_left,
    greatest(sy / n + slope * (value - sx / n), 0.0) FROM lab JOIN coef USING (run_id)),
predictions AS (SELECT *, actual - predicted AS residual FROM both_models)"""

SCORES_SQL = f"""{PREDICTIONS_SQL},
scores AS (
  SELECT model, fold,
    CASE WHEN var_pop(actual) > 0 THEN 1 - avg(residual * residual) / var_pop(actual)
         WHEN avg(residual * residual) = 0 THEN 1.0 ELSE 0.0 END AS r2,
    avg(residual * residual) AS mse, sqrt(avg(residual * residual)) AS rmse, avg(abs(residual)) AS mae
  FROM predictions GROUP BY model, fold)"""
