"""Connected components of large edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.llm.common import BROADCAST_ROWS, written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node it is connected with. A saved table.

    Alternates two steps until every node hangs on a root: every node hangs its larger neighbours, and then its
    smaller ones, on the smallest node that it knows. Both are an aggregation and a join by node, so a node of any
    degree is summed before it is shuffled; the join broadcasts the sums while nodes are few and is shuffled beyond,
    where adaptive execution can split a node's rows. Rounds grow with the logarithm of the longest path. Edges are
    saved after each round.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    few = 2 * now.count() <= BROADCAST_ROWS

    def hint(low: DataFrame) -> DataFrame:
        return F.broadcast(low) if few else low

    for _ in range(most_rounds):
        # Larger neighbours and the node's smallest one.
        around = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = written(around.filter("b > a").join(hint(low), "a").select(F.col("b").alias("a"), F.col("low").alias("b")))
        # Now a > b in every row: the smaller neighbours and the node itself hang on the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        hung = large.join(hint(low), "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        now = written(hung.unionAll(low.select("a", F.col("low").alias("b"))).distinct())
        # Done when no node hangs on two others or on one that hangs itself.
        roots = now.select("b").distinct()
        if now.groupBy("a").count().filter("count > 1").isEmpty() and now.select("a").join(hint(roots), F.col("a") == F.col("b"), "left_semi").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return written(now.toDF("node", "component").unionAll(roots.select(F.col("b").alias("node"), F.col("b").alias("component"))))
