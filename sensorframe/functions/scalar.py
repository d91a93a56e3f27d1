"""Column expressions for single values. Missing is NULL everywhere, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The texts a number may have. Spark's cast alone also takes "1d" and "1f".
NUMERIC_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

# CSV texts that stand for a missing entry (the public pandas default list).
MISSING_TEXT = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)


def to_number(text: Column) -> Column:
    """Text to double; anything that is not a finite number becomes NULL."""
    value = F.when(text.rlike(NUMERIC_TEXT), F.trim(text).try_cast("double"))
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def missing_text_to_null(text: Column) -> Column:
    return F.when(~text.isin(*MISSING_TEXT), text)


def strict_number(text: Column) -> Column:
    """Text to double. A missing-value text becomes NULL; any other text that is not a number, "1d" included, raises."""
    known = missing_text_to_null(text)
    message = F.concat(F.lit("not a number: "), known)
    return F.when(known.rlike(NUMERIC_TEXT), F.trim(known).cast("double")).when(known.isNotNull(), F.raise_error(message).cast("double"))


def nan_to_null(value: Column) -> Column:
    return F.nanvl(value, F.lit(None).cast("double"))


def round_half_even(value: Column, decimals: int = 1) -> Column:
    return F.bround(value, decimals)


def guarded_ratio(numerator: Column, denominator: Column, eps: float = 1e-6) -> Column:
    """``numerator / (denominator + eps)``; NULL where that denominator is exactly 0."""
    return F.try_divide(numerator, denominator + F.lit(eps))


def clip_negative(prediction: Column) -> Column:
    """Missing stays missing."""
    return F.when(prediction < 0, F.lit(0.0)).otherwise(prediction)


def residual(actual: Column, predicted: Column) -> Column:
    return actual - predicted
