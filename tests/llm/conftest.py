from __future__ import annotations

import pytest

from sensorframe.session import locate

#: Columns whose names the operators use for themselves, or that differ from others by case only.
CLASHING = ("key", "n", "row", "kind", "text_key", "prefix", "own_0", "cluster", "Text", "score", "n_words", "n_lines")
LONG = " ".join(f"word{i % 911} of{i % 17}" for i in range(30_000))


@pytest.fixture(scope="session", autouse=True)
def located(spark):
    locate(spark)


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text) rows, with every column and further ones of clashing names."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        full = [(i, t, None if k % 3 == 0 else "en", None if k % 5 == 0 else f"src{k % 2}", None if t is None else len(t)) for k, (i, t) in enumerate(rows)]
        df = spark.createDataFrame(full, schema)
        return df.toDF(*df.columns).selectExpr("*", *[f"'x{c}' as `{c}`" for c in CLASHING])

    return make
