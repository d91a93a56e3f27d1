"""Quality classifier: importance resampling by hashed n-gram models of target and raw text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe.llm.common import bare, bucket_counts, small, text_or_empty, written
from sensorframe.llm.tokens import distinct, shingles, texts_of, words_of

#: Buckets of each table of counts, and the tables: words, word pairs, and words once a text; of all texts and of
#: target ones. Six tables in one array of 2^21 counts (16 MB), whatever the corpus.
TABLE_BITS, KINDS = 18, 3
#: Standard errors by which a log ratio is drawn towards 0, and the share of the words-once model in the score.
SHRINK, ONCE = 2.0, 0.4
STEPS_PER_UNIT = 4000


def _grams(column: pa.Array) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """Piece by piece, for each kind: bucket numbers and where each text's begin."""
    shift = np.uint64(64 - TABLE_BITS)
    for begin, end, words in words_of(texts_of(column), lower=True):
        hashes = words.hashes()
        found = [(hashes, words.first), shingles(hashes, words.first, 2), distinct(hashes, words.first)]
        yield begin, end, [((h >> shift).astype(np.int64), first) for h, first in found]


def fit_weights(marked: DataFrame) -> np.ndarray:
    """Log ratios (kind, bucket) of the target model and the raw one, from ``marked`` (text, target boolean). The raw
    model counts every text. Ratios are drawn towards 0 by their standard error, so grams too rare to tell say nothing."""

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        target = np.array(batch.column(1).fill_null(False))
        for begin, end, kinds in _grams(batch.column(0)):
            for kind, (buckets, first) in enumerate(kinds):
                table = buckets.astype(np.uint64) << np.uint64(64 - 3 - TABLE_BITS)
                yield table | np.uint64(kind << 61)
                yield table[np.repeat(target[begin:end], np.diff(first))] | np.uint64((kind + KINDS) << 61)

    counts = bucket_counts(marked, hashes, TABLE_BITS + 3).reshape(8, -1).astype(float)
    raw, target = counts[:KINDS], counts[KINDS : 2 * KINDS]
    expected = raw * (target.sum(axis=1) / np.maximum(raw.sum(axis=1), 1))[:, None]
    ratio = np.log((target + 1) / (expected + 1))
    error = np.sqrt(1 / (target + 1) + 1 / (expected + 1))
    return np.sign(ratio) * np.maximum(0, np.abs(ratio) - SHRINK * error)


def score_texts(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, n_words, log_weight) of ``docs`` (doc_id, text): the mean log ratio of its words and word pairs and,
    over the root of their number, that of its distinct words. Null for texts without words."""
    weights = weights.astype(np.float32)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, kinds in _grams(batch.column(1)):
                sums = [np.bincount(np.repeat(np.arange(end - begin), np.diff(first)), weights[kind][buckets], end - begin) for kind, (buckets, first) in enumerate(kinds)]
                n, once = np.diff(kinds[0][1]), np.diff(kinds[2][1])
                value = (sums[0] + sums[1]) / np.maximum(n, 1) + ONCE * sums[2] / np.sqrt(np.maximum(once, 1))
                yield pa.record_batch(
                    [batch.column(0).slice(begin, end - begin), pa.array(n.astype(np.int64)), pa.array(np.round(value, 9), mask=n == 0)],
                    names=["doc_id", "n_words", "log_weight"],
                )

    return docs.mapInArrow(score, "doc_id long, n_words long, log_weight double")


def _fold() -> Column:
    """Half of the labelled rows fit the target model, the other half set how many rows are drawn."""
    return F.xxhash64("doc_id", F.lit(11)) % 2 == 0


def calibrate(scored: DataFrame, labels: DataFrame, spare: float) -> float | None:
    """The log weight that best parts target rows from others among labelled rows held out from the model, of those
    that leave out at most ``spare`` of the target. Counts per grid step are summed in Spark. None if a kind lacks."""
    rows = scored.filter("log_weight is not null").join(labels.filter(~_fold()), "doc_id")
    found = rows.groupBy(F.floor(F.col("log_weight") * STEPS_PER_UNIT).cast("long").alias("step"), "target").count().collect()
    total = {t: sum(r["count"] for r in found if r.target == t) for t in (True, False)}
    if not total[True] or not total[False]:
        return None
    best, limit, out, before = -1, None, {True: 0, False: 0}, None
    for r in sorted(found, key=lambda r: r.step):
        if r.step != before and out[True] <= spare * total[True] and out[False] - out[True] > best:
            best, limit = out[False] - out[True], r.step / STEPS_PER_UNIT
        out[r.target] += r["count"]
        before = r.step
    return limit


def cutoff(keys: DataFrame, k: int, few: int = 2000) -> float | None:
    """The k-th largest of column ``key``, by counting in ever narrower ranges until few values are left; None for
    k < 1. At most 1024 counts or ``few`` values come to the driver at a time."""
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if k < 1 or not n:
        return None
    k = min(k, n)
    while True:
        own = keys.filter((F.col("key") >= low) & (F.col("key") <= high))
        if n <= few or low == high:
            return low if low == high else sorted((r.key for r in own.select("key").collect()), reverse=True)[k - 1]
        width = (high - low) / 1024
        bin_ = F.least(F.lit(1023), F.floor((F.col("key") - low) / width))
        counts = own.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
        for r in sorted(counts, key=lambda r: -r.bin):
            if k <= r.n:
                low, high, n = r.low, r.high, r.n
                break
            k -= r.n


def importance_resample(docs: DataFrame, labels: DataFrame, draw: int | None = None, sharpness: float = 300.0, spare: float = 0.01, seed: int = 1) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, log_weight, key, kept.

    The target is the labelled rows of good quality that are not toxic. Hashed n-gram models of target and of all
    text give each row a log weight, and a sample without replacement, in proportion to the ``sharpness``-th power of
    the weights, is the ``draw`` rows of greatest ``sharpness * log_weight`` plus Gumbel noise. By default as many are
    drawn as have a weight that on held-out labels tells target rows from others.

    Noise comes from a hash of seed, doc_id and the row's weight, so a repeated run draws the same; of repeated rows
    all or none are kept, and ties at the cutoff are all kept. Null and empty texts and those without words have no weight and
    are not kept; null doc_ids are kept or not like any other. Several labels of a doc_id count as target if all say so. With labels
    of one kind only, all rows with a weight are drawn. Other columns are not read.
    """
    known = bare(labels, "doc_id", "quality", "toxic").filter("doc_id is not null and quality is not null")
    target = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    known = written(known.groupBy("doc_id").agg(F.min(target).alias("target")))
    own = bare(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text"))
    marked = own.join(small(known.filter(_fold() & F.col("target"))), "doc_id", "left").select("text", "target")
    scored = written(score_texts(own, fit_weights(marked)))
    if draw is None:
        limit = calibrate(scored, known, spare)
        draw = scored.filter("log_weight is not null" if limit is None else F.col("log_weight") >= limit).count()
    uniform = (F.xxhash64(F.lit(seed), "doc_id", "n_words", "log_weight").bitwiseAND(F.lit((1 << 53) - 1)) + F.lit(0.5)) / F.lit(float(1 << 53))
    keyed = scored.withColumn("key", F.lit(sharpness) * F.col("log_weight") - F.log(-F.log(uniform)))
    least = cutoff(keyed, draw)
    return keyed.withColumn("kept", F.coalesce(F.col("key") >= F.lit(least), F.lit(False)) if least is not None else F.lit(False))
