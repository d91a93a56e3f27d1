"""Every query with SQL against DuckDB; the others for rows, bounds and repeatability."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_point
from sensorframe.queries import all_queries, all_sql
from tests.oracle import check, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_matches_sql(spark, con, sf_dir, name):
    problem, _, _, _ = check(spark, con, name, all_queries()[name], all_sql()[name], sf_dir)
    assert problem is None


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(all_sql())))
def test_runs(spark, sf_dir, name):
    df = all_queries()[name](spark, sf_dir)
    rows = df.collect()
    assert rows
    if "predicted" in df.columns:
        assert all(r["predicted"] >= 0 for r in rows)
        assert len({(r["run_id"], r["event_id"]) for r in rows}) == len(rows)


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
