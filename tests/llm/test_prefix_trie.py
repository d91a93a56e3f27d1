from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from sensorframe.llm.prefix_trie import numbered, prefix_trie, shared_openings
from tests.llm.conftest import LONG

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = own.get(base, [])[:h] + turns[h:]
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, of in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(of) - 1) * words
    return sorted(
        ((min(of), len(node), min(members[node[:-1]]) if node else None, len(of), children[node], leaves[node], saved[node], hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()) for node, of in members.items()),
        key=str,
    )


def got(spark, rows, block, stretch, columns="*"):
    turns = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as conv", "2 as depth", "3 as part", "4 as owner")
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    out = prefix_trie(*shared_openings(numbered(turns)), block, stretch)
    assert sorted(out.columns) == sorted(names)
    return sorted((tuple(r[c] for c in names) for r in out.collect()), key=str)


def rows_of(seed):
    r = random.Random(seed)
    rows = [(None, 0, "user", "no conversation"), (-7, 0, "user", "a"), (-7, None, None, None), (-27, 1, "x", "y z"), ((1 << 53) + 1, 0, "user", "a b")]
    for c in range(0, 130):
        if c % 40 != 20:
            rows += [(c, None if d == 0 and c % 9 == 0 else d, r.choice(["user", "assistant", None]), r.choice(["a", "b c", None, "d"])) for d in range(r.randrange(1, 7))]
    long = [("user", f"w{i} x") for i in range(60)]
    for c in range(200, 240):  # conversations that part late, or not at all
        turns = long[: r.choice([60, 60, 31, 24, 17])] + ([("assistant", f"end {r.randrange(3)}")] if c % 3 else [])
        rows += [(c, i, *turn) for i, turn in enumerate(turns)]
    return rows + rows[3:9] + [(300, 5, "user", "same")] * 9 + [(301, 0, "user", LONG), (302, 0, "user", LONG)]


@pytest.mark.parametrize("seed,block,stretch", [(1, 8, 4096), (2, 3, 2), (3, 1, 5)])
def test_matches_brute_force(spark, seed, block, stretch):
    rows = rows_of(seed)
    assert got(spark, rows, block, stretch) == brute(rows)


def test_few(spark):
    assert got(spark, [], 8, 4096) == []
    for rows in ([(3, 0, "user", "a")], [(3, 0, "user", "a"), (4, 0, "user", "a")], [(None, 0, "user", "a")]):
        assert got(spark, rows, 8, 4096) == brute(rows)
