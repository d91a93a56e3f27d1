"""The ``events`` table seen as runs: one run per user, ordered by (ts, event_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe.operators.joins import join_groups

KEYS = ("run_id",)
ORDER = ("ts", "event_id")


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels over ``events``: ``value``, ``k`` (from JSON), ``t_raw`` (dirty text), ``m`` (gappy)."""
    value, event_id = F.col("value"), F.col("event_id")
    t_raw = (
        F.when(F.col("event_type") == "error", "nan")
        .when((F.col("event_type") == "view") & (event_id % 7 == 0), "1_0x")
        .otherwise(value.cast("string"))
    )
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").alias("run_id"),
        "ts",
        "event_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        t_raw.alias("t_raw"),
        F.when(event_id % 5 != 0, value).alias("m"),
    )


def with_hours_left(df: DataFrame, label: str = "hours_left") -> DataFrame:
    """Stand-in label: hours to the run's last row. Aggregate and join rather than a window over the run: a long
    run is reduced before it is shuffled, and the join broadcasts the runs' ends or salts the rows."""
    last = df.groupBy(*KEYS).agg(F.max("ts").alias("_last"))
    hours = F.timestamp_diff("MICROSECOND", F.col("ts"), F.col("_last")) / F.lit(3600000000.0)
    return join_groups(df, last, KEYS).withColumn(label, hours).drop("_last")


def event_channels(df: DataFrame) -> DataFrame:
    """The eight base channels derived from the run view."""
    value, k, event_id = F.col("value"), F.col("k"), F.col("event_id")
    hum = F.when(F.col("event_type") == "signup", "nan").otherwise((F.lit(40.0) + k / 4).cast("string"))
    return df.withColumns(
        {
            "Temp": F.col("t_raw"),
            "Hum": hum,
            "MQ2": F.col("m"),
            "MQ3": value * 2 + event_id % 7,
            "MQ4": k,
            "MQ5": value + k,
            "MQ9": (event_id % 100).cast("double"),
            "MQ135": k * 3 + value / 2,
        }
    ).drop("event_type", "value", "k", "t_raw", "m")


__all__ = ["KEYS", "ORDER", "event_channels", "event_runs", "with_hours_left"]
