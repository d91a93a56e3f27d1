"""The training-data pipeline: documents through filtering, deduplication, masking and packing.

Counted as part of ``sensorframe.llm``; each stage calls one of its operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe.llm.best_fit import pack_documents
from sensorframe.llm.common import table, written
from sensorframe.llm.line_dedup import remove_lines
from sensorframe.llm.ngram_join import keep_first
from sensorframe.llm.quality_rules import drop_poor
from sensorframe.llm.secret_scan import redact


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars of what the text is now."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the calibrated forest go, those without a text among them; an empty table
    stays empty."""
    return drop_poor(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line of the corpus in their five-word shingles go; documents stay, if with an empty
    text. Null texts stay null, texts may be of any length, an empty table stays empty."""
    return _counted(remove_lines(docs, width=5))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a similarity of 0.8 or more in five-word shingles, the first stays. Documents without
    words are linked with nothing and stay; an empty table stays empty."""
    return keep_first(docs, width=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in texts of any length; null texts stay null, an empty table stays empty."""
    return _counted(redact(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each part of each document goes: doc_id, part, start, stop, bin_id, place. A text longer than a bin gives
    several parts, one without words a row with a null bin; an empty table gives an empty result."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Isolation forests and packing are not for SQL; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``STAGES`` over documents; what a stage returns is written as Parquet and read again as the next one's docs."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
