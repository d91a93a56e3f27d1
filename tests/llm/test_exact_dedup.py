from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from sensorframe.llm.exact_dedup import exact_dedup
from tests.llm.conftest import LONG

ROWS = [(5, "a b"), (3, "a \t b"), (9, "a\u00a0b"), (4, None), (2, ""), (7, " "), (8, "\n"), (None, "a b"), (None, "zz"), (None, "zz"),
        (1, LONG), (6, LONG + "x"), (10, LONG.replace(" ", "\n", 5)), (3, "a b"), (11, "é" * 9000), (12, "é" * 9000)]


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for text, ids in groups.items():
        low = min((i for i in ids if i is not None), default=None)
        out += [(i, low, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("fingerprint", [None, lambda c: F.length(c).cast("long") % F.lit(3)])
def test_matches_brute_force(docs_of, fingerprint):
    """Also with a fingerprint under which most chunks clash."""
    got = exact_dedup(docs_of(ROWS), **({"fingerprint": fingerprint} if fingerprint else {})).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == brute(ROWS)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_empty(docs_of):
    assert exact_dedup(docs_of(ROWS).limit(0)).collect() == []
