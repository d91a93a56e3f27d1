"""N-gram Jaccard join of documents with adaptive multi-match prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.llm.common import BUCKET_BITS, Held, bare, bucket_counts, levels, small, text_or_empty, written
from sensorframe.llm.graph import components
from sensorframe.llm.setjoin import cross_pairs, delta_pairs, deltas, list_array, postings, ranges, set_keys, signed, star_pairs, verified
from sensorframe.llm.tokens import distinct, shingles, texts_of, words_of

#: A prefix asks for this many shared tokens at most, and a token that its bucket shows to be rare is still taken to
#: bring this many candidates.
MOST_MATCHES, RARE = 8, 0.2
#: Keys that share a token with more than STAR keys are first compared with one of them; those that are similar by
#: CLUSTER percent make clusters, within which links are found by what members do not have in common.
STAR, CLUSTER = 16, 50


def _sets(batch: pa.RecordBatch, column: int, width: int, rank: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for begin, end, words in words_of(texts_of(batch.column(column)), lower=True):
        yield begin, end, *distinct(*shingles(words.hashes(), words.first, width), rank)


def missing(n: np.ndarray, percent: int) -> np.ndarray:
    """How many tokens of a set of n a partner may lack."""
    return n - (n * percent + 99) // 100


def choose_matches(values: np.ndarray, first: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """For each set the number of shared prefix tokens to ask for, least in estimated cost: with m matches the prefix
    has m - 1 tokens more, whose rows all have to be read; of the rows met at most one in m can be a candidate,
    whose verification costs as its set is long. Rows are estimated by the tokens' bucket counts less their mean."""
    n = np.diff(first)
    base = missing(n, percent)
    mean = counts.sum() / len(counts)
    shift = np.uint64(64 - BUCKET_BITS)
    rows = np.maximum(counts[values >> shift].astype(float) - mean - 2 * np.sqrt(mean + 1), 0) + RARE
    total = np.zeros(len(rows) + 1)
    np.cumsum(rows, out=total[1:])
    best, chosen = np.full(len(n), np.inf), np.ones(len(n), np.int64)
    for m in range(1, MOST_MATCHES + 1):
        ends = np.minimum(first[:-1] + base + m, first[1:])
        read = total[ends] - total[first[:-1]]
        cost = np.where(n >= base + m, read * (1 + n / (8 * m)), np.inf)
        better = cost < best
        best, chosen = np.where(better, cost, best), np.where(better, m, chosen)
    return chosen


def ngram_join(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, class_id, n_copies.

    A text is lower-cased (A to Z) and cut into words; its set holds the distinct ``width``-word shingles, a shorter
    text as one. Texts link when 100 * intersection >= percent * union; component_id is the smallest doc_id that
    links reach. Texts of one set are one class (class_id, with n_copies rows) and are never paired with each other.

    Sets are ordered by how rare their shingles are (from a fixed-size table of counts over all texts) and then by
    hash. Partners share at least m tokens of the prefixes that leave out what a partner may lack, less m - 1; each
    class gets the m that costs least, and a pair counts as a candidate when it shares the smaller of its two m.
    Classes that share tokens with many others, as in a large group of near copies, are first gathered in clusters
    about a root, within which links are found by what sets the members apart from the root; all other pairs are
    formed between clusters only. No link between different components is lost.

    Null and empty texts, and those without words, have no shingles and are linked with nothing: each is its own
    component. A null doc_id links as any other but never names a component, unless all rows of it have none.
    Repeated rows are copies. An empty table gives an empty result. Other columns are not read.
    """
    sets, named = _joined(docs, width, percent)
    joined = sets.select("doc_id", "n", "key").join(small(named).withColumn("found", F.lit(True)), "key", "left")
    return joined.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("found"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("found"), F.col("low")).otherwise(F.col("doc_id")).alias("class_id"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
    )


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the near duplicates that ``ngram_join`` finds: of each component the row of the smallest doc_id
    stays (nulls last; of several texts under it, that of the smallest hash), with all its columns, whatever their
    names. Rows without words all stay."""
    sets, named = _joined(docs, width, percent)
    order = F.struct(F.col("low").isNull(), "low", "text_key", "key")
    first = named.groupBy("component").agg(F.min_by("key", order).alias("key")).select("key", F.lit(True).alias("first"))
    several = written(named.join(first, "key", "left").select("key", "low", "text_key", "first"))
    rows = sets.filter("n > 0").select("doc_id", F.col("text_key").alias("own_key"), "key").join(small(several), "key")
    stays = F.coalesce("first", F.lit(False)) & F.col("doc_id").eqNullSafe(F.col("low")) & (F.col("own_key") == F.col("text_key"))
    found = rows.groupBy(F.col("doc_id").alias("gone_id"), F.col("own_key").alias("gone_key")).agg(F.max(stays).alias("stays"), F.count(F.lit(1)).alias("rows"))
    found = written(found.filter("not stays or rows > 1"))

    held = Held(docs)
    text, doc_id = F.col(held.name("text")), F.col(held.name("doc_id"))
    same = doc_id.eqNullSafe(F.col("gone_id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("gone_key"))
    left = held.df.join(small(found), same, "left_anti")
    repeated = found.filter("stays")
    if not repeated.isEmpty():  # rows that repeat the one that stays
        left = left.unionByName(held.df.join(small(repeated), same).dropDuplicates(["gone_id", "gone_key"]).select(*held.own))
    return held.named(left)


def _joined(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(sets, named): saved tables of each row's set (doc_id, text_key, n, key, ...), and of the classes that have
    several rows or a link (key, low, text_key, n_copies, component, component_id)."""
    own = bare(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text"))
    counts = bucket_counts(own.select("text"), lambda batch: (v for _, _, v, _ in _sets(batch, 0, width)))
    rank = levels(counts)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, values, first in _sets(batch, 2, width, rank):
                n = np.diff(first)
                matches = choose_matches(values, first, counts, percent)
                length = np.minimum(missing(n, percent) + matches, n)
                yield pa.record_batch(
                    [
                        batch.column(0).slice(begin, end - begin),
                        batch.column(1).slice(begin, end - begin),
                        pa.array(n.astype(np.int64)),
                        pa.array(signed(set_keys(values, first))),
                        pa.array(matches.astype(np.int32)),
                        list_array(values[ranges(first[:-1], length)], length),
                    ],
                    names=["doc_id", "text_key", "n", "key", "matches", "prefix"],
                )

    schema = "doc_id long, text_key long, n long, key long, matches int, prefix array<long>"
    sets = written(own.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(prefixes, schema))
    classes = written(
        sets.filter("n > 0")
        .groupBy("key")
        .agg(
            F.first("n").alias("n"),
            F.first("matches").alias("matches"),
            F.min("doc_id").alias("low"),
            F.count(F.lit(1)).alias("n_copies"),
            F.min_by("text_key", F.coalesce("doc_id", F.lit((1 << 63) - 1))).alias("text_key"),
        )
    )
    return sets, _named(classes, _links(own, sets, classes, width, percent))


def _links(own: DataFrame, sets: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame | None:
    """(node, component) of the classes that link with another one; None if none do."""
    many = postings(sets.select("key", "prefix"))
    many = written(many.join(classes.select("key", "n", "matches"), "key"))
    labels, clusters = None, None
    best = star_pairs(many, STAR)
    if not best.isEmpty():
        whole = _whole_sets(best, own, classes, width)
        near = written(verified(best, whole, CLUSTER))
        if not near.isEmpty():
            clusters = components(near)
            apart = deltas(whole.join(small(clusters.toDF("key", "cluster")), "key"), percent)
            found = written(_cluster_links(apart, percent))
            if not found.isEmpty():
                labels = components(found)

    rows = many
    for known, name in ((clusters, "cluster"), (labels, "component")):
        if known is None:
            rows = rows.withColumn(name, F.col("key"))
        else:  # keys that are in none stand for themselves
            rows = rows.join(small(known.toDF("known", name)), F.col("key") == F.col("known"), "left").withColumn(name, F.coalesce(name, "key")).drop("known")
    rows = written(rows)
    candidates = written(cross_pairs(rows, percent, F.col("component") == F.col("component_2"), "component"))
    links = written(verified(candidates, _whole_sets(candidates, own, classes, width), percent))
    if labels is not None:
        links = links.unionAll(labels.toDF("a", "b"))
    return None if links.isEmpty() else components(links)


def _cluster_links(apart: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect what links within each cluster connect. Sets that are similar to another one for
    certain are so to the member of the least excess; of these, no more pairs are formed."""
    centres = apart.groupBy("cluster").agg(F.min_by("key", F.struct("excess", "key")).alias("centre"), F.min("excess").alias("least"))
    apart = written(apart.join(small(written(centres)), "cluster").withColumn("close", F.col("excess") + F.col("least") <= 0))
    certain = apart.filter(F.col("close") & (F.col("key") != F.col("centre"))).select(F.col("key").alias("a"), F.col("centre").alias("b"))
    return certain.unionAll(delta_pairs(apart.drop("centre", "least", "excess"), percent, F.col("close") & F.col("close_2"), "close"))


def _whole_sets(pairs: DataFrame, own: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(key, set) of the classes in the saved ``pairs`` (a, b). Only one text of each is read again."""
    keys = small(written(pairs.select(F.col("a").alias("key")).unionAll(pairs.select(F.col("b").alias("key"))).distinct()))
    wanted = small(written(classes.join(keys, "key").select("key", F.col("low").alias("own_id"), F.col("text_key").alias("own_key"))))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, values, first in _sets(batch, 1, width):
                n = np.diff(first)
                yield pa.record_batch([batch.column(0).slice(begin, end - begin), list_array(values, n)], names=["key", "set"])

    texts = own.join(wanted, own["doc_id"].eqNullSafe(wanted["own_id"]) & (F.xxhash64("text") == wanted["own_key"]))
    return written(texts.select("key", "text").mapInArrow(whole, "key long, set array<long>"))


def _named(classes: DataFrame, links: DataFrame | None) -> DataFrame:
    if links is None:
        linked = classes.filter("n_copies > 1").withColumns({"component": F.col("key"), "component_id": F.col("low")})
    else:
        linked = classes.join(small(links), F.col("key") == F.col("node"), "left").filter("node is not null or n_copies > 1")
        linked = linked.withColumn("component", F.coalesce("component", "key"))
        lows = written(linked.groupBy("component").agg(F.min("low").alias("component_id")))
        linked = linked.join(small(lows), "component")
    return written(linked.select("key", "low", "text_key", "n_copies", "component", "component_id"))
