"""Joining a per-group table back to the rows of its groups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.session import checkpointed

# A per-group table is sent to every task only up to this many cells (rows x columns).
BROADCAST_CELLS = 2_000_000
SALTS = 32


def join_groups(
    df: DataFrame, groups: DataFrame, keys: Sequence[str], cells: int = BROADCAST_CELLS, width: int | None = None
) -> DataFrame:
    """Inner join of ``df`` with ``groups`` (one row per key), safe for groups of any size. NULL keys are groups too.

    ``groups`` is saved and its rows are counted. Up to the limit it is broadcast, so rows are not shuffled. Beyond,
    both sides are joined on the keys plus a salt taken from the row's own values, so that no group ends up in a
    single task.
    """
    keys = list(keys)
    groups = checkpointed(groups)
    few = groups.count() <= max(1, cells // (width or len(groups.columns)))
    known = groups.withColumnsRenamed({k: f"_key_{i}" for i, k in enumerate(keys)})
    same = reduce(and_, [F.col(f"`{k}`").eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)])
    extra = [f"_key_{i}" for i in range(len(keys))]
    order = [*keys, *[c for c in df.columns if c not in keys], *[c for c in groups.columns if c not in keys]]
    if few:
        return df.join(F.broadcast(known), same).drop(*extra).select(*[f"`{c}`" for c in order])
    salt = F.pmod(F.xxhash64(*[f"`{c}`" for c in df.columns]), F.lit(SALTS)).cast("int")
    copies = known.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = df.withColumn("_salt", salt).join(copies, same & (F.col("_salt") == F.col("_copy")))
    return salted.drop("_salt", "_copy", *extra).select(*[f"`{c}`" for c in order])
