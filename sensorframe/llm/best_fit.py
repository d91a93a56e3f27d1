"""Best-fit packing of texts into bins of tokens, under conflicts of source and duplicates."""

from __future__ import annotations

import bisect
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.llm.common import bare, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
PLACED = "doc_id long, part long, start long, stop long, bin_id long, place long"


def best_fit(lengths: list[int], sources: list[int], clusters: list[int], capacity: int, per_source: int) -> list[tuple[int, int]]:
    """(bin, place in it) for items in the given order. Open bins are kept in order of their residual room. An item
    goes to the tightest bin that holds it and does not conflict: from the first bin with room enough, successors are
    tried until one is compatible; without one a bin is opened. A bin has a bitmap of its clusters and ``per_source``
    bitmaps of its sources, the k-th of those that it holds k times; a cluster number of -1 conflicts with none."""
    open_: list[tuple[int, int]] = []  # (residual, bin), rising
    cluster_bits: list[int] = []
    source_bits: list[list[int]] = []
    count: list[int] = []
    out = []
    for length, source, cluster in zip(lengths, sources, clusters):
        mark, twin = 1 << source, 1 << cluster if cluster >= 0 else 0
        at = bisect.bisect_left(open_, (length, -1))
        while at < len(open_) and (cluster_bits[open_[at][1]] & twin or source_bits[open_[at][1]][-1] & mark):
            at += 1
        if at < len(open_):
            room, bin_ = open_.pop(at)
        else:
            room, bin_ = capacity, len(count)
            cluster_bits.append(0)
            source_bits.append([0] * per_source)
            count.append(0)
        cluster_bits[bin_] |= twin
        for k, bits in enumerate(source_bits[bin_]):
            if not bits & mark:
                source_bits[bin_][k] |= mark
                break
        out.append((bin_, count[bin_]))
        count[bin_] += 1
        if room > length:
            bisect.insort(open_, (room - length, bin_))
    return out


def pack(items: DataFrame, capacity: int = 4096, per_source: int = 4, shard_rows: int = 8000) -> DataFrame:
    """Bins for ``items`` (doc_id, source, cluster, n_tokens): one row for each part of an item, with doc_id, part,
    start and stop (its tokens), bin_id and place.

    An item longer than ``capacity`` gives full parts, each a bin of its own, and a last part with what is left. Last
    parts are packed longest first; a bin holds at most ``per_source`` parts of one source and one of a cluster
    (items with one cluster value are duplicates of each other). Items are dealt by hash to shards of about
    ``shard_rows``, which are packed independently, so work is linear and no group meets in one task: a source or a
    group of copies that holds a third of all rows holds a third of every shard.

    Items without tokens give one row with a null bin. A null source is a source of its own, a null cluster conflicts
    with none, null doc_ids and repeated rows are packed like any other. An empty table gives an empty result.
    """
    own = bare(items, "doc_id", "source", "cluster", "n_tokens").withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0)))
    shards = max(1, -(-own.count() // shard_rows))
    # Equal rows are dealt by their number within the scan, or all copies of a row would meet in one shard.
    own = own.withColumn("salt", F.monotonically_increasing_id())
    own = own.withColumn("shard", F.pmod(F.xxhash64("salt"), F.lit(shards)))

    def of_shard(key: tuple[pa.Scalar], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("source", "ascending"), ("cluster", "ascending")])
        doc_ids, sources, clusters, lengths = (rows.column(c).to_pylist() for c in ("doc_id", "source", "cluster", "n_tokens"))
        numbers = {s: i for i, s in enumerate(dict.fromkeys(sources))}
        copies = Counter(c for c in clusters if c is not None)
        twins = {c: i for i, c in enumerate(c for c, n in copies.items() if n > 1)}
        rest = [n % capacity for n in lengths]
        order = sorted((i for i, r in enumerate(rest) if r), key=lambda i: -rest[i])
        bins = best_fit([rest[i] for i in order], [numbers[sources[i]] for i in order], [twins.get(clusters[i], -1) for i in order], capacity, per_source)
        placed = dict(zip(order, bins))
        used = 1 + max((b for b, _ in bins), default=-1)
        base, out = key[0].as_py() << 32, []
        for i, (doc_id, n) in enumerate(zip(doc_ids, lengths)):
            parts = n // capacity
            for part in range(parts):
                out.append((doc_id, part, part * capacity, (part + 1) * capacity, base + used, 0))
                used += 1
            if rest[i]:
                bin_, place = placed[i]
                out.append((doc_id, parts, parts * capacity, n, base + bin_, place))
            elif not parts:
                out.append((doc_id, 0, 0, 0, None, None))
        return pa.table([pa.array(c, pa.int64()) for c in zip(*out)], names=[c.split()[0] for c in PLACED.split(", ")])

    return own.drop("salt").groupBy("shard").applyInArrow(of_shard, PLACED)


def items_of(docs: DataFrame) -> DataFrame:
    """Texts as items: their words are the tokens, and texts that are equal but for white space one cluster. A null
    text has no words."""
    text = text_or_empty()
    return bare(docs, "doc_id", "source", "text").select(
        "doc_id",
        "source",
        F.xxhash64(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")).alias("cluster"),
        F.size(F.regexp_extract_all(text, F.lit(WORD), 0)).cast("long").alias("n_tokens"),
    )


def pack_documents(docs: DataFrame, capacity: int = 4096, per_source: int = 4) -> DataFrame:
    """``pack`` over ``items_of`` documents."""
    return pack(items_of(docs), capacity, per_source)
