"""How runs are laid out for ordered work.

A window over a run puts the whole run into one task. That is right for runs of ordinary
length and wrong for a run that holds a large share of all rows. ``RunLayout.plan`` counts
rows per run once. If every run fits in a task, windows partition by the run alone. Otherwise
each long run is cut, by values of its own order key, into chunks of about ``max_rows`` rows:

* the cut points are rows picked by a hash of their key, so a recomputed task picks the same;
* windows partition by (run, chunk); short runs have a NULL chunk and stay whole;
* bounded frames get copies of the neighbouring rows (``with_halo``);
* unbounded carries get per-chunk summaries (``operators.gaps``, ``running_total``).

Both ways give the same rows and values.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sensorframe.session import checkpointed

CHUNK = "_chunk"
HALO = "_halo"

MAX_ROWS = 1_000_000
# Rows of a part of a wide frame: parts are no smaller for the session's number of partitions, and no larger.
LEAST_DEALT, MOST_DEALT = 10_000, 50_000
# Cut points are sent to every task only up to this many; each is one order key (16-40 bytes).
BROADCAST_CUTS = 2_000_000
_HASH_RANGE = 1 << 31
_OVERSAMPLE = 8


@dataclass(frozen=True)
class RunLayout:
    keys: tuple[str, ...]
    order: tuple[str, ...]
    max_rows: int = MAX_ROWS
    gappy: frozenset[str] = frozenset()
    negative: frozenset[str] = frozenset()
    cuts: DataFrame | None = field(default=None, repr=False)
    chunks: DataFrame | None = field(default=None, repr=False)
    n_cuts: int = 0
    longest_cut_list: int = 0
    rows: int = 0

    @classmethod
    def plan(
        cls,
        df: DataFrame,
        keys: Sequence[str] = ("run_id",),
        order: Sequence[str] = ("ts", "event_id"),
        max_rows: int = MAX_ROWS,
        profile: Sequence[str] = (),
    ) -> RunLayout:
        """One pre-aggregated pass: the longest run and, for ``profile`` columns, whether they
        have gaps or values below zero. Only that one summary row reaches the driver."""
        keys, order = tuple(keys), tuple(order)
        per_run = df.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"),
            *[F.count(c).alias(f"known_{i}") for i, c in enumerate(profile)],
            *[F.min(c).alias(f"least_{i}") for i, c in enumerate(profile)],
        )
        facts = per_run.agg(
            F.max("n").alias("longest"),
            F.sum("n").alias("rows"),
            *[F.bool_or(F.col(f"known_{i}") < F.col("n")).alias(f"gap_{i}") for i in range(len(profile))],
            *[F.bool_or(F.col(f"least_{i}") < 0).alias(f"neg_{i}") for i in range(len(profile))],
        ).first()
        gappy = frozenset(c for i, c in enumerate(profile) if facts[f"gap_{i}"])
        negative = frozenset(c for i, c in enumerate(profile) if facts[f"neg_{i}"])
        whole = cls(keys, order, max_rows, gappy, negative, rows=facts["rows"] or 0)
        if (facts["longest"] or 0) <= max_rows:
            return whole
        return whole._cut(df)

    # -- cutting ---------------------------------------------------------------------------

    def _cut(self, df: DataFrame) -> RunLayout:
        keys, order = list(self.keys), list(self.order)
        long_runs = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > self.max_rows)

        rate = min(1.0, _OVERSAMPLE / self.max_rows)
        every = max(1, round(rate * self.max_rows))
        picked = F.pmod(F.xxhash64(*keys, *order), F.lit(_HASH_RANGE)) < F.lit(int(rate * _HASH_RANGE))
        in_run = Window.partitionBy(*keys).orderBy(*order)
        cut_rows = (
            df.select(*keys, *order)
            .where(picked)
            .join(long_runs.select(*keys), keys, "left_semi")
            .withColumn("_rn", F.row_number().over(in_run))
            .where(F.col("_rn") % every == 0)
        )
        cuts = checkpointed(
            cut_rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order))).alias("_cuts"))
        )
        size = cuts.agg(F.sum(F.size("_cuts")).alias("total"), F.max(F.size("_cuts")).alias("longest")).first()
        cut = RunLayout(
            self.keys, self.order, self.max_rows, self.gappy, self.negative,
            cuts, None, size["total"] or 0, size["longest"] or 0, self.rows,
        )
        if cut.n_cuts == 0:
            return self
        so_far = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        chunks = checkpointed(
            cut.attach(df.select(*keys, *order))
            .where(F.col(CHUNK).isNotNull())
            .groupBy(*keys, CHUNK)
            .agg(F.count(F.lit(1)).alias("_n"))
            .withColumn("_offset", F.coalesce(F.sum("_n").over(so_far), F.lit(0)))
        )
        return RunLayout(
            self.keys, self.order, self.max_rows, self.gappy, self.negative,
            cuts, chunks, cut.n_cuts, cut.longest_cut_list, self.rows,
        )

    @property
    def chunked(self) -> bool:
        return self.cuts is not None

    @property
    def partition(self) -> tuple[str, ...]:
        return (*self.keys, CHUNK) if self.chunked else self.keys

    def attach(self, df: DataFrame) -> DataFrame:
        """Add the chunk number (NULL for runs that stay whole)."""
        if not self.chunked or CHUNK in df.columns:
            return df
        cuts = F.broadcast(self.cuts) if self.n_cuts <= BROADCAST_CUTS else self.cuts
        steps = [1 << b for b in reversed(range(self.longest_cut_list.bit_length()))]

        def search(lower: Column, step: Column) -> Column:
            probe = F.get(F.col("_cuts"), lower + step - 1)
            return F.when(probe <= F.struct(*self.order), lower + step).otherwise(lower)

        chunk = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), search)
        return (
            df.join(cuts, list(self.keys), "left")
            .withColumn(CHUNK, F.when(F.col("_cuts").isNotNull(), chunk))
            .drop("_cuts")
        )

    def detach(self, df: DataFrame) -> DataFrame:
        return df.drop(CHUNK)

    # -- windows ---------------------------------------------------------------------------

    def dealt(self, df: DataFrame) -> DataFrame:
        """Rows dealt out for windows, in a number of parts that follows from their count. Adaptive execution would
        join parts by the bytes of the narrow input, about one for each core; what is made of it is many times wider,
        and a core that gets a second part doubles the time."""
        least = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), self.rows // LEAST_DEALT)
        return df.repartition(max(2, least, -(-self.rows // MOST_DEALT)), *self.partition)

    def window(self, reverse: bool = False) -> WindowSpec:
        order = [F.col(c).desc() if reverse else F.col(c).asc() for c in self.order]
        return Window.partitionBy(*self.partition).orderBy(*order)

    def over(self, before: int | None = 0, after: int | None = -1) -> str:
        """The window as SQL text; frame bounds in rows, None for unbounded, none given for no frame."""
        keys = ", ".join(f"`{c}`" for c in self.partition)
        order = ", ".join(f"`{c}`" for c in self.order)
        if (before, after) == (0, -1):
            return f"OVER (PARTITION BY {keys} ORDER BY {order})"
        low = "UNBOUNDED PRECEDING" if before is None else f"{before} PRECEDING"
        high = "UNBOUNDED FOLLOWING" if after is None else f"{after} FOLLOWING"
        return f"OVER (PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN {low} AND {high})"

    def with_halo(self, df: DataFrame, before: int, after: int) -> DataFrame:
        """Add to every chunk copies of the ``before`` rows preceding it and the ``after`` rows
        following it, marked in ``_halo``. Row counts decide how many chunks a copy reaches, so
        chunks shorter than the halo are handled too."""
        if not self.chunked:
            return df.withColumn(HALO, F.lit(False))
        keys = list(self.keys)
        df = self.attach(df)
        inside = df.where(F.col(CHUNK).isNotNull())
        in_run = Window.partitionBy(*keys).orderBy(CHUNK)
        end = F.col("_offset") + F.col("_n")

        def copies(reach: int, forward: bool) -> DataFrame:
            # Every chunk has at least one row, so no copy reaches more than ``reach`` chunks.
            span = in_run.rowsBetween(1, reach) if forward else in_run.rowsBetween(-reach, -1)
            near = self.chunks.select(
                *keys, CHUNK, end.alias("_end"), F.col("_offset"),
                F.collect_list(F.struct(F.col(CHUNK).alias("chunk"), F.col("_offset").alias("start"), end.alias("end")))
                .over(span).alias("_near"),
            )
            rank = F.row_number().over(self.window(reverse=forward))
            gap = (lambda c: c["start"] - F.col("_end")) if forward else (lambda c: F.col("_offset") - c["end"])
            return (
                inside.withColumn("_rank", rank)
                .where(F.col("_rank") <= reach)
                .join(near, [*keys, CHUNK])
                .withColumn("_to", F.explode(F.filter("_near", lambda c: gap(c) + F.col("_rank") <= reach)))
                .withColumn(CHUNK, F.col("_to.chunk"))
                .select(*df.columns, F.lit(True).alias(HALO))
            )

        out = df.withColumn(HALO, F.lit(False))
        if before:
            out = out.unionByName(copies(before, forward=True))
        if after:
            out = out.unionByName(copies(after, forward=False))
        return out

    def running_total(self, df: DataFrame, weight: str, total: str, running: str) -> DataFrame:
        """Sum of ``weight`` up to and including each row, and over the whole run."""
        df = self.attach(df)
        w = self.window()
        df = df.select(
            "*",
            F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(running),
            F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(total),
        )
        if not self.chunked:
            return df
        on = [*self.keys, CHUNK]
        in_run = Window.partitionBy(*self.keys).orderBy(CHUNK)
        sums = (
            df.where(F.col(CHUNK).isNotNull())
            .groupBy(*on)
            .agg(F.sum(weight).alias("_sum"))
            .select(
                *on,
                F.sum("_sum").over(in_run.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
                F.sum("_sum")
                .over(in_run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
                .alias("_all"),
            )
        )
        return (
            df.join(sums, on, "left")
            .withColumn(running, F.col(running) + F.coalesce("_before", F.lit(0)))
            .withColumn(total, F.coalesce("_all", total))
            .drop("_before", "_all")
        )


def chunk_aware(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Let an operator take frames with or without the chunk column and give back the same."""

    @functools.wraps(operator)
    def wrapped(df: DataFrame, layout: RunLayout, *args, **kwargs) -> DataFrame:
        out = operator(layout.attach(df), layout, *args, **kwargs)
        return out if CHUNK in df.columns else layout.detach(out)

    return wrapped
