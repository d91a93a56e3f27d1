"""Runs from CSV files, one file per run."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorframe.functions import strict_number
from sensorframe.operators.features import GAS_CHANNELS, TEXT_CHANNELS
from sensorframe.session import written

# Column names of the time axis and the label in the input files.
HOUR = "Hour"
LABEL = "Hours Left to Rot"

_ROW_BITS = (1 << 33) - 1


def read_runs(
    spark: SparkSession,
    path: str | list[str],
    numeric: Sequence[str] = (HOUR, *GAS_CHANNELS, LABEL),
    text: Sequence[str] = TEXT_CHANNELS,
) -> DataFrame:
    """Scan CSV files with a header each. Adds ``run_id`` (the file's full path), ``run_name`` (its short name) and
    ``seq``, which numbers the rows in file order.

    Columns are aligned by name: files may order them differently or lack some, which are NULL there. ``numeric``
    columns must hold numbers or missing-value texts: other text raises, as it would spoil every window it enters.
    ``text`` columns stay text for ``repair_channels``; any further column is carried along as text.

    Headers are found in a pass over the lines that keeps one per file; files are then read once, in one scan for
    each kind of header.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), _place().alias("at"), "value")
    first = written(lines.groupBy("file").agg(F.min_by("value", "at").alias("header")))
    kinds = first.groupBy("header").agg(F.count(F.lit(1)).alias("files")).collect()  # kinds of header, not files
    parts = []
    for kind in kinds:
        if len(kinds) == 1:
            files = path
        else:
            files = [r["file"] for r in first.where(F.col("header").eqNullSafe(kind["header"])).select("file").toLocalIterator()]
        header = next(csv.reader([kind["header"].removeprefix("\ufeff")]))
        schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
        rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(files)
        values = [strict_number(F.col(f"`{c}`")).alias(c) if c in numeric else F.col(f"`{c}`") for c in header]
        parts.append(rows.select(F.col("_metadata.file_path").alias("run_id"), F.col("_metadata.file_name").alias("run_name"), _place().alias("seq"), *values))
    return stack_runs(parts)


def _place() -> Column:
    """Start of the split plus the row's number in its task: rises with file order, also where a big file is read in
    several splits."""
    return F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS))


def stack_runs(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack frames vertically; a column that a frame lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
