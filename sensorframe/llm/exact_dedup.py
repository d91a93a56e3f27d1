"""Exact deduplication by content-defined chunk recipes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorframe.llm.common import bare, small, text_or_empty, written

SPACE = r"[\x20\x09-\x0D]+"
#: A chunk ends after a letter pair that comes again two characters on, at the earliest after the least and at the
#: latest after the most characters. The rule looks at nothing but nearby text and knows no alphabet.
LEAST, MOST = 512, 8192
CHUNK = rf"(?s).{{{LEAST},{MOST}}}?(?:(\S)(\S).\1\2|\z)|.{{1,{MOST}}}"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, " ")


def _fingerprint(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def exact_dedup(docs: DataFrame, fingerprint: Callable[[Column], Column] = _fingerprint) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Texts are normalised (runs of white space become one space) and cut into content-defined chunks. A dictionary
    of all chunks, grouped by their text, verifies the chunks' 64-bit fingerprints: where two chunks share one,
    they get different variants of it. Equal texts are those whose lists of verified identifiers are equal. Whole
    texts move once, for the dictionary, after map-side deduplication; all else moves identifiers.

    A null text counts as empty. Empty texts are equal to each other. A null doc_id comes after all others; a group
    of only such rows has a null keep_id. Of repeated rows of one doc_id and text exactly one stays. An empty table
    gives an empty result. Columns other than doc_id and text are not read.
    """
    chunked = (
        bare(docs, "doc_id", "text")
        .select("doc_id", normalised(text_or_empty()).alias("norm"))
        .withColumn("chunks", F.regexp_extract_all("norm", F.lit(CHUNK), 0))
    )
    recipes = written(
        chunked.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.sha2("norm", 256).alias("text_sha256"),
            F.transform("chunks", fingerprint).alias("recipe"),
            F.size("chunks").cast("long").alias("n_chunks"),
        )
    )
    clashes = _clashes(chunked, fingerprint)
    if clashes is not None:
        recipes = _with_variants(recipes, chunked, clashes, fingerprint)

    groups = recipes.groupBy("recipe").agg(
        F.min("doc_id").alias("keep_id"),
        F.min_by("row", F.coalesce("doc_id", F.lit((1 << 63) - 1))).alias("first"),
        F.count(F.lit(1)).alias("group_size"),
    )
    groups = small(written(groups.filter("group_size > 1")), 50_000)
    return recipes.join(groups, "recipe", "left").select(
        "doc_id",
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("first") == F.col("row"), F.lit(True)).alias("kept"),
        "text_sha256",
        "n_chunks",
    )


def _clashes(chunked: DataFrame, fingerprint: Callable[[Column], Column]) -> DataFrame | None:
    """Chunks that share a fingerprint with a different chunk: (fp, chunk, variant from 0). None if there are none."""
    dictionary = (
        chunked.select(F.explode("chunks").alias("chunk"))
        .select(fingerprint(F.col("chunk")).alias("fp"), "chunk")
        .groupBy("fp", "chunk")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    shared = written(dictionary.groupBy("fp").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("fp"))
    if shared.isEmpty():
        return None
    within = Window.partitionBy("fp").orderBy("chunk")
    return written(
        dictionary.join(small(shared), "fp", "left_semi").select(
            "fp", "chunk", F.row_number().over(within).cast("long").alias("variant")
        )
    )


def _with_variants(recipes: DataFrame, chunked: DataFrame, clashes: DataFrame, fingerprint: Callable[[Column], Column]) -> DataFrame:
    """Recipes with the fingerprints of clashing chunks told apart by their variant."""
    own = chunked.select(F.monotonically_increasing_id().alias("row"), "chunks")  # numbered before the explosion
    own = own.select("row", F.posexplode("chunks").alias("at", "chunk"))
    own = own.withColumn("fp", fingerprint(F.col("chunk"))).join(clashes, ["fp", "chunk"])
    marks = own.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("at", "variant"))).alias("variants"))
    return written(
        recipes.join(marks, "row", "left").withColumn(
            "recipe",
            F.when(F.col("variants").isNull(), F.flatten(F.transform("recipe", lambda fp: F.array(fp, F.lit(0).cast("long"))))).otherwise(
                F.flatten(
                    F.transform(
                        "recipe",
                        lambda fp, at: F.array(fp, F.coalesce(F.try_element_at("variants", at), F.lit(0).cast("long"))),
                    )
                )
            ),
        ).drop("variants")
    )
