"""A trie of the turns that conversations have in common, grouped by blocks of turns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorframe.llm.common import bare, written

WORD = r"[^\x20\x09-\x0D]+"

#: Blocks, or turns, of one conversation that one task sums.
STRETCH = 4096


def numbered(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) as a saved table (conv, at, h1, h2, words): their place in the conversation
    from 0, two hashes of role and text, and the words of the text.

    Turns are ordered by turn, null first, and then by role and text; a null role or text is empty. Repeated rows are
    turns of their own. Rows without a conv_id belong to no conversation and are left out. Rows are dealt by ranges of
    the whole order, so a conversation of any length is spread over tasks, which are joined by their counts.
    """
    own = bare(turns, "conv_id", "turn", "role", "text").filter("conv_id is not null")
    own = own.select(F.col("conv_id").alias("conv"), "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")], F.monotonically_increasing_id().alias("salt"))
    order = ["conv", "turn", "role", "text", "salt"]
    dealt = own.repartitionByRange(*order).sortWithinPartitions(*order)
    place = written(dealt.select(
        "conv", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("row"),
        F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit("again"), "role", "text").alias("h2"),
        F.size(F.regexp_extract_all("text", F.lit(WORD), 0)).cast("long").alias("words"),
    ))
    runs = place.groupBy("conv", "part").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("conv", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return written(place.join(runs, ["conv", "part"]).select("conv", (F.col("row") + F.col("shift")).alias("at"), "h1", "h2", "words"))


def shared_openings(turns: DataFrame, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt from ``numbered`` turns: (conv, len) of each and (conv, depth, h1, h2, words) of its turns.

    Conversation c opens with the first h turns of conversation c - c % family, all if it has fewer, none if it does not
    exist; its own turns after its first h follow. h is crc32 of c in decimal, modulo ``most``. % is that of SQL, with
    the sign of c.
    """
    convs = turns.groupBy(F.col("conv")).agg(F.count("*").alias("n"))
    convs = written(convs.withColumns({"h": F.crc32(F.col("conv").cast("string").cast("binary")) % most, "base": F.col("conv") - F.col("conv") % family}))
    bases = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("lent", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = written(convs.select("conv", "base", "h", "lent", (F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")))
    values = ["h1", "h2", "words"]
    heads = turns.filter(F.col("at") < most - 1).withColumnRenamed("conv", "base")
    heads = convs.filter("lent > 0").join(heads, "base").filter("at < lent").select("conv", (F.col("at") + 1).alias("depth"), *values)
    tails = turns.join(convs, "conv").filter("at >= h").select("conv", (F.col("lent") + F.col("at") - F.col("h") + 1).alias("depth"), *values)
    return convs.select("conv", "len"), heads.unionByName(tails)


def _before(df: DataFrame, key: str, at: str, values: list[str], add: Callable[[str], Column], both: Callable[[Column, Column], Column], stretch: int) -> DataFrame:
    """``df``, a saved table, with what ``add`` makes of each of ``values`` over the rows of ``key`` that come before in
    the order of ``at``, as ``before_<value>``. Stretches of ``at`` are summed by themselves; their sums are few."""
    df = df.withColumn("stretch", F.floor(F.col(at) / stretch))
    sums = df.groupBy(key, "stretch").agg(*[add(v).alias(v) for v in values])
    over = Window.partitionBy(key).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(key, "stretch", *[add(v).over(over).alias(f"sum_{v}") for v in values]).filter("stretch > 0")
    along = Window.partitionBy(key, "stretch").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({f"in_{v}": add(v).over(along) for v in values}).join(sums, [key, "stretch"], "left")
    zero = F.lit(0).cast("long")
    new = {f"before_{v}": both(F.coalesce(f"in_{v}", zero), F.coalesce(f"sum_{v}", zero)) for v in values}
    return df.withColumns(new).drop("stretch", *[f"in_{v}" for v in values], *[f"sum_{v}" for v in values])


def prefix_trie(convs: DataFrame, turns: DataFrame, block: int = 8, stretch: int = STRETCH) -> DataFrame:
    """The trie of the conversations ``convs`` (conv, len), with ``turns`` (conv, depth from 1, h1, h2, words).

    A node is a sequence of turns that some conversations begin with, its members; the root has no turn. One row per
    node: conv_id, its smallest member, which with depth names it; depth, parent_conv_id, n_convs, n_children, n_leaves
    (nodes without children below it or itself), saved_tokens (over all nodes below it and itself, words of their last
    turns times members but one) and ends_sha256 (of the conversations that end there, ascending, joined by commas).

    Blocks of ``block`` turns have digests; what stands before a block is known by the combined hashes of the
    blocks there, so blocks are grouped by it, in one aggregation for all depths. Where all conversations of such a group have the same
    block its turns have the same members, and one row says so. Only the blocks of groups that differ are gone through
    turn by turn. A node belongs to its smallest member, which owns all of its own deeper nodes, so each conversation
    owns a chain of nodes that hangs on another's. Sums over subtrees are then sums over members, of what each owns,
    less what the owner has above the node.

    Conversations without turns are members of the root only. No conversations give no row. Turns are equal if two
    64-bit hashes are. No task gets all turns of a conversation or all members of a node; only the digest of ends is in
    one, as a stream of prepared strings.
    """
    both = F.collect_list(F.struct("depth", "h1", "h2", "words"))
    blocks = turns.withColumn("j", F.floor((F.col("depth") - 1) / block)).groupBy("conv", "j").agg(F.sort_array(both).alias("turns"))
    h1, h2 = F.col("turns.h1"), F.col("turns.h2")
    blocks = blocks.withColumns({"b1": F.xxhash64(h1, h2), "b2": F.xxhash64(F.lit("again"), h1, h2)})
    blocks = written(blocks.withColumns({"v1": F.xxhash64("j", "b1", "b2"), "v2": F.xxhash64(F.lit("again"), "j", "b1", "b2")}))
    blocks = written(_before(blocks, "conv", "j", ["v1", "v2"], F.bit_xor, lambda a, b: a.bitwiseXOR(b), stretch))
    at = ["j", "before_v1", "before_v2"]
    groups = blocks.groupBy(*at).agg(F.count("*").alias("n"), F.min("conv").alias("owner"), *[f(b).alias(f"{f.__name__}_{b}") for f in (F.min, F.max) for b in ("b1", "b2")])
    groups = written(groups.filter("n > 1").select(*at, "n", "owner", F.expr("min_b1 = max_b1 and min_b2 = max_b2").alias("same")))
    blocks = written(blocks.join(groups, at, "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("owner", F.coalesce("owner", "conv")))

    # Blocks with the same members throughout, and blocks that are gone through.
    whole = blocks.filter("coalesce(same, true)")
    split = blocks.filter("not same").select("conv", *at, F.posexplode("turns").alias("i", "x"), "turns")
    part = [F.slice(h, F.lit(1), F.col("i") + 1) for h in (h1, h2)]
    split = split.select("conv", *at, "i", "x.depth", "x.words", F.xxhash64(*part).alias("p1"), F.xxhash64(F.lit("again"), *part).alias("p2"))
    split = written(split)
    by_turn = [*at, "i", "p1", "p2"]
    steps = written(split.groupBy(*by_turn).agg(F.count("*").alias("n"), F.min("conv").alias("owner"), F.first("depth").alias("depth"), F.first("words").alias("words")))
    low = convs.agg(F.min("conv").alias("owner"), F.count("*").alias("n")).filter("n > 0")
    first = (F.col("j") * block + 1).alias("first")
    nodes = whole.filter("conv = owner").select("owner", "n", first, F.explode("turns").alias("x")).select("owner", "x.depth", "first", "n", "x.words")
    nodes = nodes.unionByName(steps.select("owner", "depth", F.col("depth").alias("first"), "n", "words"))
    zero = [F.lit(0).cast("long").alias(c) for c in ("depth", "first")]
    nodes = written(nodes.unionByName(low.select("owner", *zero, "n", F.lit(0).cast("long").alias("words"))).withColumn("saved", (F.col("n") - 1) * F.col("words")))
    members = whole.filter("n > 1").select("owner", first, (F.col("j") * block + F.size("turns")).alias("last"), "conv")
    members = members.unionByName(split.join(steps.filter("n > 1").select(*by_turn, "owner"), by_turn).select("owner", F.col("depth").alias("first"), F.col("depth").alias("last"), "conv"))
    members = written(members.unionByName(convs.crossJoin(F.broadcast(low)).filter("n > 1").select("owner", F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("last"), "conv")))

    # Where each conversation's own chain begins, and what it owns.
    hung = members.filter("conv <> owner").groupBy("conv").agg(F.max(F.struct("last", "owner")).alias("x"))
    hung = hung.select("conv", F.col("x.last").alias("hung_at"), F.col("x.owner").alias("hung_on"))
    saved = nodes.groupBy(F.col("owner").alias("conv")).agg(F.sum("saved").alias("total"))
    own = convs.join(hung, "conv", "left").join(saved, "conv", "left")
    own = written(own.withColumn("owns", F.coalesce(F.col("len") > F.col("hung_at"), F.lit(True))))
    hanging = written(own.filter("owns and hung_on is not null").groupBy(F.col("hung_on").alias("owner"), F.col("hung_at").alias("depth")).agg(F.count("*").alias("hanging")))
    tips = own.join(hanging.select(F.col("owner").alias("conv"), F.col("depth").alias("len"), "hanging"), ["conv", "len"], "left")
    tips = tips.select("conv", F.coalesce("total", F.lit(0)).alias("total"), (F.col("owns") & F.col("hanging").isNull()).cast("long").alias("leaf"))
    sums = members.join(tips, "conv").groupBy("owner", "first").agg(F.sum("total").alias("total"), F.sum("leaf").alias("leaves"))
    above = _before(nodes, "owner", "depth", ["saved"], F.sum, lambda a, b: a + b, stretch)
    ends = _end_digests(own.select(F.when(F.col("owns"), F.col("conv")).otherwise(F.col("hung_on")).alias("owner"), F.col("len").alias("depth"), "conv"))
    out = above.join(sums, ["owner", "first"], "left").join(hanging, ["owner", "depth"], "left").join(ends, ["owner", "depth"], "left")
    out = out.join(own.select(F.col("conv").alias("owner"), "len", "hung_at", "hung_on"), "owner")
    return out.select(
        F.col("owner").alias("conv_id"), "depth",
        F.when(F.col("depth") == 0, F.lit(None)).when(F.col("depth") - 1 == F.col("hung_at"), F.col("hung_on")).otherwise(F.col("owner")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        (F.coalesce("hanging", F.lit(0)) + (F.col("len") > F.col("depth")).cast("long")).alias("n_children"),
        F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce(F.col("total") - F.col("before_saved"), F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("ends", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def _end_digests(ends: DataFrame) -> DataFrame:
    """(owner, depth, ends) of (owner, depth, conv): SHA-256 of the convs in order, in decimal, joined by commas. Stretches
    of the whole order become strings in tasks of their own; the strings of a node are then hashed one after the other."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, depth, conv = (c.to_numpy() for c in batch.columns)
            new = np.ones(len(owner), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (depth[1:] != depth[:-1])
            begin = np.flatnonzero(new)
            text = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(begin, np.append(begin[1:], len(owner)))]
            yield pa.record_batch([pa.array(owner[begin]), pa.array(depth[begin]), pa.array(conv[begin]), pa.array(text)], names=["owner", "depth", "conv", "text"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, hashlib.sha256()

        def row(found: list[tuple[tuple[int, int], str]]) -> pa.RecordBatch:
            columns = [[k[0] for k, _ in found], [k[1] for k, _ in found], [d for _, d in found]]
            return pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=["owner", "depth", "ends"])

        for batch in batches:
            found = []
            for *k, text in zip(*(c.to_pylist() for c in batch.columns)):
                if key == tuple(k):
                    held.update(b"," + text.encode())
                    continue
                if key is not None:
                    found.append((key, held.hexdigest()))
                key, held = tuple(k), hashlib.sha256(text.encode())
            yield row(found)
        if key is not None:
            yield row([(key, held.hexdigest())])

    order = ["owner", "depth", "conv"]
    strings = ends.repartitionByRange(*order).sortWithinPartitions(*order).select(*order).mapInArrow(join, "owner long, depth long, conv long, text string")
    return strings.repartition("owner", "depth").sortWithinPartitions(*order).select("owner", "depth", "text").mapInArrow(digest, "owner long, depth long, ends string")
