"""The tables behind the usual diagnostic plots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.operators.joins import join_groups
from sensorframe.operators.layout import MAX_ROWS
from sensorframe.operators.quantiles import exact_quantiles
from sensorframe.session import checkpointed, written

# Histogram bins, points of a density curve, whisker length in IQRs.
BINS = 30
DENSITY_POINTS = 200
WHISKER = 1.5

# Grid points of a density curve that one aggregate row holds.
STRIP = 20
REACH = 9.0  # bandwidths


def series_long(df: DataFrame, sensors: Sequence[str], ids: Sequence[str], ordered: bool = False) -> DataFrame:
    """(ids, sensor, value): one row per reading, to draw one line per run and sensor."""
    long = df.unpivot(list(ids), list(sensors), "sensor", "value")
    return long.orderBy(*ids, "sensor") if ordered else long


def actual_vs_predicted(predictions: DataFrame, ids: Sequence[str]) -> DataFrame:
    return predictions.select("model", "fold", *ids, "actual", "predicted")


def residual_vs_predicted(predictions: DataFrame, ids: Sequence[str]) -> DataFrame:
    return predictions.select("model", "fold", *ids, "predicted", "residual")


def histogram(df: DataFrame, value: str, by: Sequence[str] = ("model",), bins: int = BINS) -> DataFrame:
    """(by, bin, bin_lo, bin_hi, n): equal-width bins over the group's range, the last one closed,
    empty ones included. Where all values are equal the range is widened by 0.5 on both sides.

    The value range per group joins back to the rows; the counts are pre-aggregated per task.
    """
    keys = list(by)
    known = df.where(F.col(value).isNotNull())
    span = known.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))  # two numbers per group
    flat = F.col("_lo") == F.col("_hi")
    span = checkpointed(
        span.select(
            *keys,
            F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
            F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"),
        )
    )
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    at = F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    counts = join_groups(known.select(*keys, value), span, keys).groupBy(*keys, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # Empty bins come in as rows of 0, so that a group without a name needs no join to find its counts.
    empty = span.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), F.lit(0).alias("n"))
    counts = counts.select(*keys, "bin", "n").unionAll(empty).groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
    return (
        join_groups(counts, span, keys)
        .select(
            *keys,
            "bin",
            (F.col("_lo") + F.col("bin") * width).alias("bin_lo"),
            (F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
            F.col("n").cast("bigint").alias("n"),
        )
    )


def density(df: DataFrame, value: str, by: Sequence[str] = ("model",), points: int = DENSITY_POINTS) -> DataFrame:
    """(by, point, x, density): Gaussian kernel density on an even grid over the group's range,
    bandwidth ``std * n^(-1/5)``. NULL density where the group has no spread.

    The grid is evaluated inside an aggregate, in strips of ``STRIP`` sums: sums leave each task,
    not rows. Wider strips would make methods that the JVM leaves uncompiled. A row goes to the strips within ``REACH``
    bandwidths of it; what it would add beyond is less than 1e-17 of what it adds at its own place. So the work of a
    row falls as the bandwidth narrows with the number of rows.
    """
    keys = list(by)
    known = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x"))
    span = known.groupBy(*keys).agg(
        F.min("_x").alias("_lo"),
        ((F.max("_x") - F.min("_x")) / F.lit(float(points - 1))).alias("_step"),
        F.count(F.lit(1)).alias("_n"),
        F.nullif(F.stddev_samp("_x") * F.pow(F.count(F.lit(1)), F.lit(-0.2)), F.lit(0.0)).alias("_h"),
    )
    span = checkpointed(span)
    # Distances in bandwidths: row to the grid's first point, and from one point to the next.
    rows = join_groups(known, span, keys).select(
        *keys,
        ((F.col("_lo") - F.col("_x")) / F.col("_h")).alias("_z"),
        (F.col("_step") / F.col("_h")).alias("_dz"),
    )
    # The first and last point in reach; all of them where there is no bandwidth.
    near = F.floor((-F.lit(REACH) - F.col("_z")) / F.col("_dz") / F.lit(STRIP)) * F.lit(STRIP)
    far = F.floor((F.lit(REACH) - F.col("_z")) / F.col("_dz"))
    first = F.greatest(F.coalesce(near, F.lit(0)), F.lit(0)).cast("int")
    last = F.least(F.coalesce(far, F.lit(points - 1)), F.lit(points - 1)).cast("int")
    rows = rows.withColumn("_at", F.explode(F.sequence(first, F.greatest(first, last), F.lit(STRIP))))
    # Strips that no row reaches have sums of 0.
    empty = span.select(*keys, F.lit(None).cast("double").alias("_z"), F.lit(None).cast("double").alias("_dz"), F.explode(F.sequence(F.lit(0), F.lit(points - 1), F.lit(STRIP))).alias("_at"))
    rows = rows.unionByName(empty)
    rows = rows.select(*keys, "_at", "_dz", (F.col("_z") + F.col("_at") * F.col("_dz")).alias("_z"))
    strip = [f"coalesce(sum(exp(-0.5D * (_z + {i}D * _dz) * (_z + {i}D * _dz))), 0D) AS s{i}" for i in range(STRIP)]
    sums = rows.groupBy(*keys, "_at").agg(*[F.expr(e) for e in strip])
    scale = F.col("_n") * F.col("_h") * F.sqrt(F.lit(2.0) * F.pi())
    return (
        sums.select(*keys, "_at", F.posexplode(F.array(*[f"s{i}" for i in range(STRIP)])).alias("_i", "_s"))
        .withColumn("point", F.col("_at") + F.col("_i"))
        .where(F.col("point") < points)
        .transform(lambda found: join_groups(found, span, keys))
        .select(
            *keys,
            "point",
            (F.col("_lo") + F.col("point") * F.col("_step")).alias("x"),
            (F.col("_s") / scale).alias("density"),
        )
    )


def scores_wide(scores: DataFrame, metric: str, models: Sequence[str]) -> DataFrame:
    """One row per fold, one column per model."""
    return scores.groupBy("fold").pivot("model", list(models)).agg(F.first(metric))


def box_statistics(
    df: DataFrame, value: str, by: Sequence[str] = ("model",), max_rows: int = MAX_ROWS
) -> DataFrame:
    """(by, n, q1, median, q3, whisker_lo, whisker_hi, n_outliers). Whiskers end at the furthest
    value within 1.5 IQR of the box, and never inside it."""
    keys = list(by)
    df = written(df.select(*keys, value))  # read for the quantiles and again for the whiskers
    boxes = exact_quantiles(df, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, max_rows)
    x, iqr = F.col(value), F.col("q3") - F.col("q1")
    inside = (x >= F.col("q1") - WHISKER * iqr) & (x <= F.col("q3") + WHISKER * iqr)
    return (
        join_groups(df.where(x.isNotNull()).select(*keys, value), boxes, keys)
        .groupBy(*keys, "q1", "median", "q3")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.when(inside, x)).alias("_lo"),
            F.max(F.when(inside, x)).alias("_hi"),
            F.count_if(~inside).alias("n_outliers"),
        )
        .select(
            *keys,
            "n",
            "q1",
            "median",
            "q3",
            F.least("_lo", "q1").alias("whisker_lo"),
            F.greatest("_hi", "q3").alias("whisker_hi"),
            "n_outliers",
        )
    )


def box_outliers(df: DataFrame, boxes: DataFrame, value: str, by: Sequence[str] = ("model",)) -> DataFrame:
    """The rows beyond the whiskers."""
    x = F.col(value)
    marked = join_groups(df, boxes.select(*by, "whisker_lo", "whisker_hi"), by)
    return marked.where((x < F.col("whisker_lo")) | (x > F.col("whisker_hi"))).drop("whisker_lo", "whisker_hi")
