from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from sensorframe.llm.best_fit import best_fit, pack, pack_documents
from tests.llm.conftest import LONG

rng = random.Random(2)


def brute(lengths, sources, clusters, capacity, per_source):
    """The tightest compatible bin by looking at all; of equally tight ones the oldest."""
    bins, out = [], []
    for length, source, cluster in zip(lengths, sources, clusters):
        fits = [
            (b["room"], i) for i, b in enumerate(bins)
            if b["room"] >= length and b["room"] > 0 and b["sources"][source] < per_source and (cluster < 0 or cluster not in b["clusters"])
        ]
        if fits:
            i = min(fits)[1]
        else:
            i = len(bins)
            bins.append({"room": capacity, "sources": Counter(), "clusters": set(), "n": 0})
        out.append((i, bins[i]["n"]))
        bins[i]["room"] -= length
        bins[i]["sources"][source] += 1
        bins[i]["clusters"].add(cluster)
        bins[i]["n"] += 1
    return out


@pytest.mark.parametrize("per_source", [1, 3])
def test_finds_the_tightest_bin(per_source):
    n = 600
    lengths = [rng.randrange(1, 100) for _ in range(n)]
    sources = [0 if rng.random() < 0.4 else rng.randrange(1, 20) for _ in range(n)]
    clusters = [rng.choice([-1, -1, 0, 1, 2]) for _ in range(n)]
    assert best_fit(lengths, sources, clusters, 100, per_source) == brute(lengths, sources, clusters, 100, per_source)


def test_pack(spark):
    items = [(k if k % 50 else None, rng.choice(["hot", "hot", "s1", "s2", None]), rng.choice([None, 1, 2, 1000 + k]), rng.randrange(0, 260)) for k in range(900)]
    items += [items[5]] * 3
    df = spark.createDataFrame(items, "doc_id long, source string, cluster long, n_tokens long").selectExpr("*", "1 as shard", "2 as salt", "3 as SOURCE")
    got = pack(df, capacity=100, per_source=2, shard_rows=200).collect()
    assert Counter(r.doc_id for r in got if r.part == 0)[items[5][0]] == 4
    total = Counter()
    for r in got:
        total[r.doc_id] += r.stop - r.start
    want = Counter()
    for i, _, _, n in items:
        want[i] += n
    assert total == want
    bins = defaultdict(list)
    for r in got:
        assert (r.bin_id is None) == (r.start == r.stop)
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
    known = {i: (s, c) for i, s, c, _ in items if i is not None}
    for rows in bins.values():
        assert sum(r.stop - r.start for r in rows) <= 100
        assert sorted(r.place for r in rows) == list(range(len(rows)))
        ids = [known[r.doc_id] for r in rows if r.doc_id is not None]
        assert max(Counter(s for s, _ in ids).values(), default=0) <= 2
        assert max(Counter(c for _, c in ids if c is not None).values(), default=0) <= 1
    full = sum(r.stop - r.start for rows in bins.values() for r in rows) / (100 * len(bins))
    assert full > 0.6
    assert pack(df.limit(0), 100).collect() == []


def test_documents(docs_of):
    rows = [(1, "a b c"), (2, "a  b\nc"), (3, None), (4, ""), (5, LONG), (6, "x " * 10), (6, "x " * 10), (None, "q")]
    got = pack_documents(docs_of(rows), capacity=50).collect()
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
    assert len(by_id[5]) == len(LONG.split()) / 50 and by_id[3][0].bin_id is None and len(by_id[6]) == 2
    assert by_id[1][0].bin_id != by_id[2][0].bin_id  # they repeat each other
    assert by_id[6][0].bin_id != by_id[6][1].bin_id


def test_large_ids_beside_nulls(spark):
    big = (1 << 53) + 1
    rows = [(big, "a", big, 5), (None, "a", None, 3), (big + 2, None, big + 2, 4), (big + 2, "b", big, 2), (7, "c", 1, None)]
    got = pack(spark.createDataFrame(rows, "doc_id long, source string, cluster long, n_tokens long"), 64).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    bins = {(r.doc_id, r.stop): r.bin_id for r in got}
    assert bins[big, 5] != bins[big + 2, 2] and bins[big, 5] == bins[big + 2, 4]  # clusters differ by 2 only
