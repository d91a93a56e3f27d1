"""Line dedup: an exact set-similarity join of lines that removes later matches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorframe.llm.common import Held, bare, bucket_counts, levels, small, text_or_empty, written
from sensorframe.llm.graph import components
from sensorframe.llm.setjoin import beside, cross_pairs, delta_pairs, deltas, list_array, postings, ranges, set_keys, signed, star_pairs, verified
from sensorframe.llm.tokens import distinct, pieces, raw, shingles, split, texts_of

#: As in the n-gram join: what makes a token common, and a cluster.
STAR, CLUSTER = 16, 50


def line_sets(column: pa.Array, width: int, rank: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Piece by piece: the text that each line is of, its number there, its distinct tokens and where they begin."""
    texts = texts_of(column)
    for begin, end in pieces(texts):
        data, offsets = raw(texts.slice(begin, end - begin))
        newline = np.flatnonzero(data == 10) + 1
        starts = np.concatenate([offsets[:-1], newline])
        owner = np.concatenate([np.arange(end - begin), np.searchsorted(offsets, newline - 1, side="right") - 1])
        order = np.lexsort((starts, owner))
        starts, owner = starts[order], owner[order]
        number = np.arange(len(owner)) - np.searchsorted(owner, owner)
        words = split(data, np.append(starts, len(data)))
        yield owner + begin, number, *distinct(*shingles(words.hashes(), words.first, width), rank)


def matched_lines(docs: DataFrame, width: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(texts, gone): the texts with what names them (doc_id, text_key, text), and a saved table of the lines to
    remove (doc_id, text_key, lines array)."""
    own = bare(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text"))
    own = own.withColumn("text_key", F.xxhash64("text"))
    rank = levels(bucket_counts(own.select("text"), lambda batch: (v for _, _, v, _ in line_sets(batch.column(0), width))))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for owner, number, values, first in line_sets(batch.column(2), width, rank):
                n = np.diff(first)
                keys = set_keys(values, first)
                full = n > 0
                length = np.where(full, n - (n * percent + 99) // 100 + 1, 0)
                # Of the lines of a text that have one set, the first brings the prefix.
                at = np.lexsort((number, keys, owner))
                again = np.zeros(len(at), bool)
                again[at[1:]] = (keys[at[1:]] == keys[at[:-1]]) & (owner[at[1:]] == owner[at[:-1]])
                length = np.where(again, 0, length)
                out = pa.record_batch(
                    [
                        batch.column(0).take(pa.array(owner)), batch.column(1).take(pa.array(owner)), pa.array(number.astype(np.int32)),
                        pa.array(n.astype(np.int32)), pa.array(signed(keys)), list_array(values[ranges(first[:-1], length)], length),
                    ],
                    names=["doc_id", "text_key", "line", "n", "key", "prefix"],
                )
                yield out.filter(pa.array(full))

    schema = "doc_id long, text_key long, line int, n int, key long, prefix array<long>"
    lines = written(own.select("doc_id", "text_key", "text").mapInArrow(prefixes, schema))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key", "line")
    classes = written(lines.groupBy("key").agg(F.first("n").alias("n"), F.min(place).alias("place"), F.count(F.lit(1)).alias("copies")))
    late = _late(own, lines, classes, width, percent)

    # What goes: every line of a late class, and of any other class all but the first.
    several = classes.filter("copies > 1").select("key", "place").withColumn("late", F.lit(False))
    if late is not None:
        several = classes.select("key", "place", "copies").join(late.withColumn("late", F.lit(True)), "key", "left")
        several = several.withColumn("late", F.coalesce("late", F.lit(False))).filter("copies > 1 or late").drop("copies")
    found = lines.drop("prefix").join(small(written(several)), "key").filter(F.col("late") | (place != F.col("place")))
    # Rows that repeat a text under one doc_id are in the same place: their lines stay or go together.
    gone = found.groupBy("doc_id", "text_key").agg(F.collect_set("line").alias("lines"))
    return own, written(gone)


def _late(own: DataFrame, lines: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame | None:
    """The keys of classes that are similar to one whose first line comes earlier; a saved table, or None."""
    ranked = classes.select("key", "place", "n")
    many = written(postings(lines.select("key", "prefix")).join(ranked, "key").withColumn("matches", F.lit(1)))
    clusters, late = None, []
    best = star_pairs(many, STAR)
    if not best.isEmpty():
        whole = _whole_lines(best, own, classes, width)
        near = written(verified(best, whole, CLUSTER))
        if not near.isEmpty():
            clusters = small(components(near).toDF("key", "cluster"))
            apart = written(deltas(whole.join(clusters, "key"), percent).join(classes.select("key", "place"), "key"))
            # Similar for certain, if the excesses sum up to 0 at most: by the first place of each excess.
            firsts = apart.groupBy("cluster", "excess").agg(F.min("place").alias("place"))
            asked = firsts.select("cluster", (-F.col("excess")).alias("excess"), F.lit(True).alias("asks")).unionByName(
                firsts.withColumn("asks", F.lit(False)), allowMissingColumns=True
            )
            upto = Window.partitionBy("cluster").orderBy("excess", "asks").rowsBetween(Window.unboundedPreceding, 0)
            earliest = asked.withColumn("earliest", F.min("place").over(upto)).filter("asks").select("cluster", (-F.col("excess")).alias("excess"), "earliest")
            apart = apart.join(written(earliest), ["cluster", "excess"]).withColumn("sure", F.coalesce(F.col("earliest") < F.col("place"), F.lit(False)))
            apart = written(apart.drop("earliest", "excess"))
            late.append(written(apart.filter("sure").select("key")))
            known = F.when(F.col("place") < F.col("place_2"), F.col("sure_2")).otherwise(F.col("sure"))
            late.append(_later(delta_pairs(apart, percent, known, "place", "sure"), ranked))

    rows = many
    if clusters is not None:
        rows = rows.join(clusters, "key", "left").withColumn("cluster", F.coalesce("cluster", "key"))
    else:
        rows = rows.withColumn("cluster", F.col("key"))
    if late:
        rows = rows.join(small(late[0]).withColumn("sure", F.lit(True)), "key", "left").withColumn("sure", F.coalesce("sure", F.lit(False)))
    else:
        rows = rows.withColumn("sure", F.lit(False))
    known = F.when(F.col("place") < F.col("place_2"), F.col("sure_2")).otherwise(F.col("sure"))
    candidates = written(cross_pairs(written(rows), percent, known, "place", "sure"))
    if not candidates.isEmpty():
        late.append(_later(verified(candidates, _whole_lines(candidates, own, classes, width), percent), ranked))
    if not late:
        return None
    out = late[0]
    for more in late[1:]:
        out = out.unionAll(more)
    return written(out.distinct())


def _later(pairs: DataFrame, ranked: DataFrame) -> DataFrame:
    """Of each pair the key whose first line comes later."""
    both = beside(written(pairs), ranked.select("key", "place"))
    return written(both.select(F.when(F.col("left.place") < F.col("right.place"), F.col("b")).otherwise(F.col("a")).alias("key")).distinct())


def _whole_lines(pairs: DataFrame, own: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(key, set) of the classes in the saved ``pairs`` (a, b), from the texts of their first lines."""
    keys = small(written(pairs.select(F.col("a").alias("key")).unionAll(pairs.select(F.col("b").alias("key"))).distinct()))
    places = classes.join(keys, "key").select(F.col("place.doc_id").alias("own_id"), F.col("place.text_key").alias("own_key"), F.col("place.line").alias("line"))
    wanted = small(written(places.groupBy("own_id", "own_key").agg(F.collect_set("line").alias("wanted"))))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted_lines = batch.column(0).to_pylist()
            for owner, number, values, first in line_sets(batch.column(1), width):
                sets = [set(wanted_lines[i]) for i in range(int(owner[0]), int(owner[-1]) + 1)] if len(owner) else []
                keep = np.array([k in sets[o - owner[0]] for o, k in zip(owner.tolist(), number.tolist())], bool)
                n = np.where(keep, np.diff(first), 0)
                out = pa.record_batch([pa.array(signed(set_keys(values, first))), list_array(values[ranges(first[:-1], n)], n)], names=["key", "set"])
                yield out.filter(pa.array(keep))

    texts = own.join(wanted, own["doc_id"].eqNullSafe(wanted["own_id"]) & (own["text_key"] == wanted["own_key"]))
    return written(texts.select("wanted", "text").mapInArrow(whole, "key long, set array<long>"))


def remove_lines(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with the lines of their texts that match an earlier line removed; all columns as they were.

    A line (between newlines) is the set of its distinct ``width``-word shingles (with 1: of its words), or of its whole
    sequence of words if it has fewer. Two lines match when 100 * intersection >= percent * union. A line goes if any line before it,
    by doc_id and then by number, matches it, whether that one stays or not; lines without words always stay, and
    what stays keeps its order. Prefixes are ordered by rarity, candidates filtered by prefix, length and position,
    and every match is verified on whole sets.

    A null text stays null and has no lines. Null doc_ids come last. Rows that share a doc_id are ordered by a hash
    of their text; exact repeats of a row are in one place, so they lose the same lines. An empty table gives an
    empty result. Columns are told apart by position, so names that clash with the operator's own do no harm.
    """
    held, marked, new = _marked(docs, width, percent)
    return held.named(marked, text=new)


def _marked(docs: DataFrame, width: int, percent: int) -> tuple[Held, DataFrame, Column]:
    """``docs`` held, the same with ``gone_lines``, and the text that is left."""
    _, gone = matched_lines(docs, width, percent)
    held = Held(docs)
    text, doc_id = F.col(held.name("text")), F.col(held.name("doc_id"))
    gone = small(gone).toDF("gone_id", "gone_key", "gone_lines")
    joined = held.df.join(gone, doc_id.eqNullSafe(F.col("gone_id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("gone_key")), "left")
    kept = F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains("gone_lines", i))
    return held, joined, F.when(F.col("gone_lines").isNull(), text).otherwise(F.array_join(kept, "\n"))


def dedup_report(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_removed, text (see ``remove_lines``; null counts as empty)."""
    own = bare(docs, "doc_id", "text").withColumn("text", text_or_empty())
    held, marked, new = _marked(own, width, percent)
    return marked.select(
        F.col(held.name("doc_id")).alias("doc_id"),
        F.size(F.split(held.name("text"), "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone_lines"), F.lit(0)).cast("long").alias("n_removed"),
        new.alias("text"),
    )
