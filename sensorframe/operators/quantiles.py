"""Exact quantiles of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.operators.layout import MAX_ROWS, RunLayout
from sensorframe.session import written


def exact_quantiles(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    probabilities: dict[str, float],
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """One row per group with a linearly interpolated quantile per entry of ``probabilities``.

    Spark's ``percentile`` keeps every distinct value of a group in one buffer. Here equal values
    are counted first, the counts are summed up in value order (in chunks where a group has many
    distinct values), and the two ranks around each quantile are picked out by an aggregate.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).alias("_x")).agg(
        F.count(F.lit(1)).alias("_w")
    )
    counts = written(counts)  # the layout counts them, the ranking reads them
    layout = RunLayout.plan(counts, groups, ["_x"], max_rows)
    ranked = layout.running_total(counts, "_w", "_n", "_upto")
    first = F.col("_upto") - F.col("_w")  # ranks first .. _upto - 1 hold this value
    picks = []
    for name, p in probabilities.items():
        at = (F.col("_n") - 1) * F.lit(float(p))
        low, high = F.floor(at), F.ceil(at)
        picks += [
            F.max(F.when((first <= low) & (low < F.col("_upto")), F.col("_x"))).alias(f"{name}_low"),
            F.max(F.when((first <= high) & (high < F.col("_upto")), F.col("_x"))).alias(f"{name}_high"),
            F.max(at - low).alias(f"{name}_part"),
        ]
    line = [
        (F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * F.col(f"{n}_part")).alias(n)
        for n in probabilities
    ]
    return ranked.groupBy(*groups).agg(*picks).select(*groups, *line)
