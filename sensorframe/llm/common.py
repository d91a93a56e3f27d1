"""Helpers shared by the operators: tables, guarded broadcasts, fixed-size counters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe.session import locate, written

__all__ = ["table", "written", "small", "bare", "Held", "text_or_empty", "bucket_counts", "levels", "BROADCAST_ROWS"]

BATCH_ROWS, BATCH_BYTES = 1000, "16m"

#: A side is broadcast only when this many narrow rows (keys of a few dozen bytes) were counted at most.
BROADCAST_ROWS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(locate(spark)).read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> SparkSession:
    """Texts go to Python in batches of at most BATCH_ROWS rows and about BATCH_BYTES: long ones would fill a worker's
    memory otherwise."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= BATCH_ROWS:
        spark.conf.set(setting, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a saved narrow table, with a broadcast hint if its counted rows are few; else the smaller side of a
    shuffled hash join, so that the other side needs no sort."""
    return F.broadcast(df) if df.count() <= limit else df.hint("shuffle_hash")


class Held:
    """A frame under positional names, so that no name of its columns can clash with an operator's own."""

    def __init__(self, df: DataFrame) -> None:
        self.names = df.columns
        self.own = [f"own_{i}" for i in range(len(self.names))]
        self.df = df.toDF(*self.own)

    def name(self, column: str) -> str:
        """The positional name of the first column of exactly this name."""
        return self.own[self.names.index(column)]

    def named(self, df: DataFrame, **changed: Column) -> DataFrame:
        """``df``, which still has the positional columns, under their old names, with some of them changed."""
        new = [changed.get(c, F.col(own)) for c, own in zip(self.names, self.own)]
        return df.select(*[value.alias(c) for c, value in zip(self.names, new)])


def bare(df: DataFrame, *columns: str) -> DataFrame:
    """Only ``columns``, whatever else there is."""
    held = Held(df)
    return held.df.select(*[F.col(held.name(c)).alias(c) for c in columns])


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


BUCKET_BITS = 20
_BLOCK, _SALTS = 1 << 9, 32  # of 4 KB, so that a batch of them is small


def bucket_counts(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int = BUCKET_BITS) -> np.ndarray:
    """How many hashes of all rows fall into each of 2^bits buckets of their top bits.

    Each task counts into one array and sends on the blocks of it that are not all zero. They are summed block by
    block as a stream, first in ``_SALTS`` parts, so a task holds one block, however many tasks there were. The result has a
    fixed size (8 MB) whatever the input.
    """
    size, shift = 1 << bits, np.uint64(64 - bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n = np.zeros(size, np.int64), [], 0

        def add_held() -> None:
            nonlocal held, n
            if n:
                total[:] += np.bincount(np.concatenate(held), minlength=size)
            held, n = [], 0

        for batch in batches:
            for values in hashes(batch):
                held.append((values >> shift).astype(np.int32))
                n += len(values)
                if n >= size:
                    add_held()
        add_held()
        blocks = total.reshape(size // _BLOCK, -1)
        used = np.flatnonzero(blocks.any(axis=1))
        salt = np.full(len(used), TaskContext.get().partitionId() % _SALTS, np.int32)
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(salt), pa.array([blocks[i].tobytes() for i in used], pa.binary())], names=["block", "salt", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, np.zeros(_BLOCK, np.int64)

        def row() -> pa.RecordBatch:
            return pa.record_batch([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([total.tobytes()])], names=["block", "salt", "counts"])

        for batch in batches:
            for block, salt, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if key != (block, salt):
                    if key is not None:
                        yield row()
                    key, total = (block, salt), np.zeros(_BLOCK, np.int64)
                total += np.frombuffer(counts.as_buffer(), np.int64)
        if key is not None:
            yield row()

    schema = "block int, salt int, counts binary"
    rows = df.mapInArrow(count, schema)
    for keys in (["block", "salt"], ["block"]):
        rows = rows.repartition(*keys).sortWithinPartitions("block", "salt").mapInArrow(add, schema)
        rows = rows.withColumn("salt", F.lit(0)).select("block", "salt", "counts")
    out = np.zeros(size, np.uint64)
    for row in rows.collect():
        out[row.block * _BLOCK : (row.block + 1) * _BLOCK] = np.frombuffer(row.counts, np.uint64)
    return out


def levels(counts: np.ndarray) -> np.ndarray:
    """Counts on a logarithmic scale of 8 bits, in the same order."""
    return np.minimum(255, np.round(6 * np.log2(1.0 + counts))).astype(np.uint8)
