"""The pipeline against brute force, stage by stage, each on its own input."""

from __future__ import annotations

import os
import sys

import pytest

import corpus_pipeline
from sensorframe.llm.common import written
from sensorframe.llm.queries import QUERIES, SQL
from tests.llm.test_joins import component_of, shingles
from tests.llm.test_secret_scan import base
from tests.oracle import check, connect

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], sf_dir)))
    return out


def test_columns(stages):
    assert all(s.columns == stages[0].columns and s.dtypes == stages[0].dtypes for s in stages[:-1])


def test_rejected_documents_go(stages, spark, sf_dir):
    verdict = {r.doc_id: r for r in QUERIES["op9_quality_rules"](spark, sf_dir).collect()}
    assert {r.doc_id for r in stages[1].collect()} == {i for i, r in verdict.items() if r.kept}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    clean = [i for i, q in labels.items() if q == 1 and not verdict[i].base_failed]
    assert sum(verdict[i].kept for i in clean) >= 0.97 * len(clean)


def test_lines_go(stages):
    before, after = ({r.doc_id: r for r in s.collect()} for s in stages[1:3])
    assert before.keys() == after.keys()
    seen: set[str] = set()
    for i in sorted(before):
        left = iter(after[i].text.split("\n"))
        at = next(left)
        for line in before[i].text.split("\n"):
            if line == at:
                assert line not in seen or not line.split()
                at = next(left, None)
            seen.add(line)
        assert at is None or after[i].text == ""
        assert after[i].n_chars == len(after[i].text)


def test_one_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    _, root = component_of([(i, t) for i, t in rows], 5, 80)
    want = {min(i for (i, _), own in zip(rows, root) if own == r) for r in set(root)}
    want |= {i for i, t in rows if not shingles(t, 5)}
    assert {r.doc_id for r in stages[3].collect()} == want


def test_secrets_are_masked(stages):
    before, after = ({r.doc_id: r for r in s.collect()} for s in stages[3:5])
    assert before.keys() == after.keys()
    assert not any(base(r.text) for r in after.values())
    for i, r in before.items():
        assert (after[i].text == r.text) or "[SECRET]" in after[i].text


def test_packing_holds_every_word(stages):
    words = {r.doc_id: len((r.text or "").encode().split()) for r in stages[4].collect()}
    got: dict[int, int] = {}
    for r in stages[5].collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.stop - r.start
    assert got == words


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_match_sql(spark, sf_dir, name):
    problem, _, _, _ = check(spark, connect(sf_dir), name, QUERIES[name], SQL[name], sf_dir)
    assert problem is None


def test_run(spark, sf_dir, stages):
    assert sorted(corpus_pipeline.run(spark, sf_dir).select("doc_id", "part").collect()) == sorted(stages[5].select("doc_id", "part").collect())
