"""Gap handling inside a run: fills, interpolation, repair, completeness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorframe.functions import round_half_even, to_number
from sensorframe.operators.layout import CHUNK, RunLayout, chunk_aware

_POS = "_pos"


class _Known:
    """Names of the helper columns that hold the known values around each row."""

    def __init__(self, i: int):
        self.prev_pos, self.prev = f"_pp{i}", f"_pv{i}"
        self.next_pos, self.next = f"_np{i}", f"_nv{i}"
        self.first = f"_fv{i}"

    def all(self) -> tuple[str, ...]:
        return self.prev_pos, self.prev, self.next_pos, self.next, self.first


def _known_neighbours(df: DataFrame, layout: RunLayout, columns: Sequence[str]) -> tuple[DataFrame, list[_Known]]:
    """Add, per column: position and value of the last known entry at or before the row, of the
    next one at or after it, and the first known value of the run. Callers use some of these;
    Catalyst prunes the windows (and the reverse sort) of the rest.

    "Next" runs over the reversed order: Spark evaluates a frame that is unbounded on its far
    side in time quadratic in the run.
    """
    known = [_Known(i) for i in range(len(columns))]
    w, back = layout.window(), layout.window(reverse=True)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    still_to_come = back.rowsBetween(Window.unboundedPreceding, 0)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    df = (layout.dealt(df) if layout.chunked else df).withColumn(_POS, F.row_number().over(w))
    at = [F.when(F.col(c).isNotNull(), F.col(_POS)) for c in columns]
    forward: list[Column] = []
    backward: list[Column] = []
    for c, a, k in zip(columns, at, known):
        forward += [
            F.last(c, ignorenulls=True).over(so_far).alias(k.prev),
            F.max(a).over(so_far).alias(k.prev_pos),
            F.first(c, ignorenulls=True).over(whole).alias(k.first),
        ]
        backward += [
            F.last(c, ignorenulls=True).over(still_to_come).alias(k.next),
            F.min(a).over(still_to_come).alias(k.next_pos),
        ]
    df = df.select("*", *forward).select("*", *backward)
    if not layout.chunked:
        return df, known

    # Carry the ends of each chunk over to its neighbours: one summary row per chunk.
    on = [*layout.keys, CHUNK]
    in_run = Window.partitionBy(*layout.keys).orderBy(CHUNK)
    in_run_back = Window.partitionBy(*layout.keys).orderBy(F.col(CHUNK).desc())
    before = in_run.rowsBetween(Window.unboundedPreceding, -1)
    after = in_run_back.rowsBetween(Window.unboundedPreceding, -1)
    run = in_run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = [F.count(F.lit(1)).alias("_rows")]
    for c, a, k in zip(columns, at, known):
        ends += [
            F.max(a).alias(k.prev_pos),
            F.max_by(F.col(c), a).alias(k.prev),
            F.min(a).alias(k.next_pos),
            F.min_by(F.col(c), a).alias(k.next),
        ]
    per_chunk = (
        df.where(F.col(CHUNK).isNotNull())
        .select(*on, _POS, *dict.fromkeys(columns))
        .groupBy(*on)
        .agg(*ends)
        .withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    )
    carried = [
        column
        for k in known
        for column in (
            F.max(F.col("_start") + F.col(k.prev_pos)).over(before).alias("c" + k.prev_pos),
            F.last(k.prev, ignorenulls=True).over(before).alias("c" + k.prev),
            F.min(F.col("_start") + F.col(k.next_pos)).over(after).alias("c" + k.next_pos),
            F.last(k.next, ignorenulls=True).over(after).alias("c" + k.next),
            F.first(k.next, ignorenulls=True).over(run).alias("c" + k.first),
        )
    ]
    df = df.join(per_chunk.select(*on, "_start", *carried), on, "left")
    start = F.coalesce("_start", F.lit(0))
    merged = {_POS: start + F.col(_POS)}
    for k in known:
        for name in (k.prev_pos, k.next_pos):
            merged[name] = F.coalesce(start + F.col(name), "c" + name)
        for name in (k.prev, k.next):
            merged[name] = F.coalesce(name, "c" + name)
        merged[k.first] = F.coalesce("c" + k.first, k.first)
    return df.withColumns(merged).drop("_start", *["c" + name for k in known for name in k.all()]), known


def _replace(df: DataFrame, like: DataFrame, values: dict[str, Column]) -> DataFrame:
    return df.select(*[values[c].alias(c) if c in values else F.col(f"`{c}`") for c in like.columns])


@chunk_aware
def forward_fill(df: DataFrame, layout: RunLayout, columns: Sequence[str]) -> DataFrame:
    """Carry the last known value forward."""
    wide, known = _known_neighbours(df, layout, columns)
    return _replace(wide, df, {c: F.col(k.prev) for c, k in zip(columns, known)})


@chunk_aware
def backward_fill(df: DataFrame, layout: RunLayout, columns: Sequence[str]) -> DataFrame:
    """Carry the next known value backward."""
    wide, known = _known_neighbours(df, layout, columns)
    return _replace(wide, df, {c: F.col(k.next) for c, k in zip(columns, known)})


@chunk_aware
def fill_both_ways(df: DataFrame, layout: RunLayout, columns: Sequence[str]) -> DataFrame:
    """Forward fill; what is left is the leading gap, which takes the run's first known value
    (so no second sort is needed)."""
    wide, known = _known_neighbours(df, layout, columns)
    return _replace(wide, df, {c: F.coalesce(k.prev, k.first) for c, k in zip(columns, known)})


@chunk_aware
def interpolate(
    df: DataFrame, layout: RunLayout, columns: Sequence[str], leading_only: Sequence[str] = ()
) -> DataFrame:
    """Linear interpolation by row position. A trailing gap repeats the last known value, a
    leading gap the first. ``leading_only`` names columns known to have leading gaps only: they
    need no search for the next known value."""
    both = [*columns, *leading_only]
    if not both:
        return df
    wide, known = _known_neighbours(df, layout, both)
    values: dict[str, Column] = {}
    for c, k in zip(both, known):
        x = F.col(f"`{c}`")
        if c in leading_only:
            values[c] = F.coalesce(x, F.col(k.first))
            continue
        v0, v1, p0, p1 = (F.col(n) for n in (k.prev, k.next, k.prev_pos, k.next_pos))
        line = v0 + (v1 - v0) / (p1 - p0) * (F.col(_POS) - p0)
        values[c] = F.when(x.isNotNull(), x).when(v0.isNull(), v1).when(v1.isNull(), v0).otherwise(line)
    return _replace(wide, df, values)


@chunk_aware
def repair_channels(df: DataFrame, layout: RunLayout, columns: Sequence[str], decimals: int = 1) -> DataFrame:
    """Text channels to numbers; bad text is filled both ways (stepwise, not linearly), then the
    value is rounded half to even."""
    numbers = df.withColumns({c: to_number(F.col(f"`{c}`")) for c in columns})
    filled = fill_both_ways(numbers, layout, columns)
    return filled.withColumns({c: round_half_even(F.col(f"`{c}`"), decimals) for c in columns})


def drop_incomplete(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with any missing value."""
    return df.na.drop(how="any", subset=None if subset is None else list(subset))


def null_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, n_missing, has_missing) in one pass over all columns."""
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(columns)])
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n_missing"))
                for i, c in enumerate(columns)
            ]
        )
    )
    return counts.select(rows.alias("r")).select(
        "r.column_name", "r.n_missing", (F.col("r.n_missing") > 0).alias("has_missing")
    )
