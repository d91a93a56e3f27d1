"""Pieces of set-similarity joins over hashed token sets: prefixes, shared tokens, verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe.llm.common import BROADCAST_ROWS, small, written
from sensorframe.llm.tokens import mix


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def set_keys(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64 bits for each set of distinct values, whatever their order. An empty set has 0."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix(values ^ np.uint64(0x9E3779B97F4A7C15)), out=total[1:])
    sizes = np.diff(first).astype(np.uint64)
    return np.where(sizes > 0, mix(total[first[1:]] - total[first[:-1]] + sizes), np.uint64(0))


def ranges(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``first[i] ... first[i] + lengths[i] - 1`` of all i, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - lengths), lengths)


def list_array(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(values)))


def postings(sets: DataFrame) -> DataFrame:
    """The prefix tokens that two keys or more share, from ``sets`` (key, prefix array): a saved table of token, key
    and at, the token's place in the prefix, without repeats. Tokens are summed up before they are shuffled, and only
    those that turn out to be shared are looked up again."""
    tokens = sets.select("key", F.posexplode("prefix").alias("at", "token"))
    summed = tokens.groupBy("token").agg(F.min("key").alias("a"), F.max("key").alias("b"))
    shared = small(written(summed.filter("a <> b").select("token")), 1_000_000)
    return written(tokens.join(shared, "token", "left_semi").distinct())


def star_pairs(many: DataFrame, more_than: int) -> DataFrame:
    """A saved table of (a, b): each key of a token that more than so many keys share, with the star of those tokens
    that it shares most of them with, if these are as many as its ``matches``. A token's star is its key of the least
    hash, so similar sets have few."""
    groups = many.groupBy("token").agg(F.count(F.lit(1)).alias("keys"), F.min_by("key", F.xxhash64("key")).alias("star"))
    stars = small(written(groups.filter(f"keys > {more_than}").select("token", "star")))
    tried = many.join(stars, "token").filter(F.col("key") != F.col("star")).repartition("key")  # for both groupings
    each = tried.groupBy("key", "star").agg(F.count(F.lit(1)).alias("shared"), F.max("matches").alias("matches")).filter("shared >= matches")
    best = each.groupBy("key").agg(F.max_by("star", F.struct("shared", "star")).alias("star"))
    return written(best.select(F.col("key").alias("a"), F.col("star").alias("b")))


def deltas(members: DataFrame, percent: int) -> DataFrame:
    """``members`` (key, set, cluster) as (cluster, key, n, delta, excess): what sets a set apart from the tokens that
    most of its cluster has. The symmetric difference of two sets is that of their deltas, so two sets whose excesses
    sum up to 0 at most are similar for certain."""
    near, far = 100 - percent, 100 + percent
    members = members.dropDuplicates(["key"])  # a text that repeats under its doc_id brings its sets again
    uses = members.select("cluster", F.explode("set").alias("token")).groupBy("cluster", "token").agg(F.count(F.lit(1)).alias("uses"))
    sizes = small(written(members.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))))
    # There are at most twice as many such tokens as a member has on average.
    roots = uses.join(sizes, "cluster").filter("2 * uses > members").groupBy("cluster").agg(F.collect_list("token").alias("root"))
    root = F.coalesce("root", F.expr("cast(array() as array<bigint>)"))
    apart = members.join(written(roots), "cluster", "left").select(
        "cluster", "key", F.size("set").alias("n"), F.array_union(F.array_except("set", root), F.array_except(root, "set")).alias("delta")
    )
    return written(apart.withColumn("excess", far * F.size("delta") - near * F.col("n")))


def delta_pairs(apart: DataFrame, percent: int, skip: Column, *carried: str) -> DataFrame:
    """Similar pairs (a, b) within clusters, of ``apart`` (see ``deltas``) with ``carried`` columns, except those that
    are so for certain without a common token in their deltas and those that meet ``skip``, a condition on the
    carried columns and, by name with _2, those of the partner.

    A pair's first common token, by rarity within the cluster, is among the first t / 2 + 1 tokens of the shorter
    delta and the first t + 1 of the longer one, where t bounds the difference; and what follows it must suffice. So
    a large group of near copies is joined by its members' own changes, and not by what all of them have in common."""
    near, far = 100 - percent, 100 + percent
    tokens = apart.select("cluster", "key", F.explode("delta").alias("token"))
    rarity = tokens.groupBy("cluster", "token").agg(F.count(F.lit(1)).alias("uses")).filter("uses > 1")
    ranked = apart.select("cluster", "key", "n", *carried, F.explode("delta").alias("token")).join(small(written(rarity)), ["cluster", "token"], "left")
    ranked = ranked.groupBy("key").agg(
        *[F.first(c).alias(c) for c in ("cluster", "n", *carried)],
        F.array_sort(F.collect_list(F.struct(F.coalesce("uses", F.lit(1)).alias("uses"), "token"))).alias("delta"),
    )
    ranked = ranked.withColumn("most", F.floor(F.col("n") * near / percent).cast("int"))
    ranked = written(ranked.withColumn("delta", F.transform("delta", lambda d: d.token)).withColumn("size", F.size("delta")))
    heads = ranked.select("cluster", "key", "n", "size", "most", *carried, F.posexplode(F.slice("delta", 1, F.col("most") + 1)).alias("at", "token"))
    shorter = heads.filter("at <= most div 2")
    longer = heads.select("cluster", "token", *[F.col(c).alias(f"{c}_2") for c in ("key", "n", "size", "at", *carried)])
    left_over = F.least(F.col("size") - F.col("at"), F.col("size_2") - F.col("at_2"))
    met = shorter.join(
        longer,
        (shorter["cluster"] == longer["cluster"])
        & (shorter["token"] == longer["token"])
        & ~skip
        & ((F.col("size") < F.col("size_2")) | ((F.col("size") == F.col("size_2")) & (F.col("key") < F.col("key_2"))))
        & (2 * far * left_over >= far * (F.col("size") + F.col("size_2")) - near * (F.col("n") + F.col("n_2"))),
    )
    met = written(met.select(F.col("key").alias("a"), F.col("key_2").alias("b")).distinct())
    both = beside(met, ranked.select("key", "n", "delta"))
    apart_by = F.size("left.delta") + F.size("right.delta") - 2 * F.size(F.array_intersect("left.delta", "right.delta"))
    return both.filter(far * apart_by <= near * (F.col("left.n") + F.col("right.n"))).select("a", "b")


def cross_pairs(many: DataFrame, percent: int, skip: Column, *carried: str) -> DataFrame:
    """Candidates (a, b) of different clusters that share prefix tokens, from ``many`` (token, key, at, n,
    cluster, matches) with ``carried`` columns: by length, by what can follow their first common token, by sharing
    the smaller of their two matches, and not meeting ``skip`` (as in ``delta_pairs``). A token's largest cluster is paired with the others' keys only, never with itself."""
    sizes = many.groupBy("token", "cluster").agg(F.count(F.lit(1)).alias("keys"))
    major = sizes.groupBy("token").agg(F.max_by("cluster", F.struct("keys", "cluster")).alias("major"), F.count(F.lit(1)).alias("clusters"))
    major = small(written(major.filter("clusters > 1").select("token", "major")))
    open_ = many.join(major, "token")
    right = open_.select("token", *[F.col(c).alias(f"{c}_2") for c in ("key", "at", "n", "cluster", "matches", *carried)])
    met = open_.filter("cluster <> major").join(
        right,
        (open_["token"] == right["token"])
        & (F.col("cluster") != F.col("cluster_2"))
        & ((F.col("cluster_2") == F.col("major")) | (F.col("key") < F.col("key_2")))
        & ~skip
        & (100 * F.least("n", "n_2") >= percent * F.greatest("n", "n_2")),
    )
    follows = F.least(F.col("n") - F.col("at"), F.col("n_2") - F.col("at_2"))
    first = (100 + percent) * follows >= percent * (F.col("n") + F.col("n_2"))
    pairs = met.groupBy(F.least("key", "key_2").alias("a"), F.greatest("key", "key_2").alias("b")).agg(
        F.count(F.lit(1)).alias("shared"), F.max(first).alias("first"), F.max(F.least("matches", "matches_2")).alias("asked")
    )
    return pairs.filter("first and shared >= asked").select("a", "b")


def similar(a: Column, b: Column, percent: int) -> Column:
    """100 * intersection >= percent * union, of two arrays without repeats."""
    both = F.size(F.array_intersect(a, b))
    return 100 * both >= percent * (F.size(a) + F.size(b) - both)


def beside(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The saved ``pairs`` (a, b) with structs left and right: the rows of ``rows`` (key, ...) of a and of b. While
    pairs are few they go to the rows, which are then dealt by pair, so a key in many pairs is in no one's way."""
    values = F.struct(*[c for c in rows.columns if c != "key"])
    left = rows.select(F.col("key").alias("a"), values.alias("left"))
    right = rows.select(F.col("key").alias("b"), values.alias("right"))
    if pairs.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(pairs), "a").join(right.join(F.broadcast(pairs), "b"), ["a", "b"])
    return pairs.join(left, "a").join(right, "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows of the saved ``pairs`` (a, b) whose whole sets (key, set) are similar."""
    both = beside(pairs, sets.select("key", "set"))
    return both.filter(similar(F.col("left.set"), F.col("right.set"), percent)).select("a", "b")
