from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sensorframe.llm.suffix_dedup import _contexts, _texts, maximal_repeats, remove_repeats, repeat_groups
from tests.llm.conftest import LONG


def brute(rows, length):
    where = defaultdict(list)
    for k, (_, t) in enumerate(rows):
        data = (t or "").encode()
        for i in range(len(data) - length + 1):
            where[data[i : i + length]].append((k, i))
    gone = [set() for _ in rows]
    for places in where.values():
        if len(places) > 1:
            for k, i in places:
                gone[k].update(range(i, i + length))
    out = []
    for (doc_id, t), off in zip(rows, gone):
        data = (t or "").encode()
        spans = sum(i in off and i - 1 not in off for i in range(len(data)))
        out.append((doc_id, len(data), len(off), spans, bytes(b for i, b in enumerate(data) if i not in off)))
    return sorted(out, key=str)


def random_rows(seed):
    r = random.Random(seed)
    parts = ["".join(r.choice("abé") for _ in range(r.randrange(3, 60))) for _ in range(12)]
    rows = [(None, None), (7, ""), (7, "short"), (8, "a" * 150), (9, "ab" * 70), (10, "x" + "a" * 30)]
    rows += [(k, "".join(r.choice([r.choice(parts), r.choice(parts)[5:], r.choice("abcdefgh")]) for _ in range(r.randrange(1, 14)))) for k in range(60)]
    return rows + rows[-3:] + [(None, rows[-1][1])] * 4


def got(df):
    return sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect()], key=str)


@pytest.mark.parametrize("seed,length,gram,group", [(1, 20, 6, 1000), (2, 24, 24, 1000), (3, 16, 3, 2), (4, 33, 9, 3)])
def test_matches_brute_force(docs_of, seed, length, gram, group):
    """Also with groups so small that most anchor strings are cut in halves."""
    rows = random_rows(seed)
    assert got(remove_repeats(docs_of(rows), length, gram, group)) == brute(rows, length)


def test_production_parameters(docs_of):
    r = random.Random(5)
    words = [LONG[i : i + 450] for i in range(0, 20_000, 450)]

    def fresh(n):
        return "".join(r.choice("abcdefghij klmnop\n") for _ in range(n))

    rows = [(k, fresh(r.randrange(600)) + words[k % 7] + fresh(300) + words[k % 5][:399]) for k in range(40)]
    rows += [(100, LONG), (101, fresh(50) + LONG[700:1500]), (102, LONG[:399]), (103, "a" * 1200), (104, fresh(5000))]
    assert got(remove_repeats(docs_of(rows))) == brute(rows, 400)


@pytest.mark.parametrize("group", [1000, 2])
def test_groups_list_all_occurrences(docs_of, group):
    rows = [(k, t) for k, (_, t) in enumerate(random_rows(6))]
    groups, covered = defaultdict(set), defaultdict(set)
    for r in repeat_groups(docs_of(rows), 20, 6, group).collect():
        groups[r.grp].add((r.doc_id, r.start, r.stop))
        covered[r.doc_id].update(range(r.start, r.stop))
    whole = " ".join(t or "" for _, t in rows).encode()
    for places in groups.values():
        (string,) = {(rows[i][1] or "").encode()[start:stop] for i, start, stop in places}
        assert len(string) >= 20 and len(places) >= 2
        assert len(places) == sum(whole.startswith(string, i) for i in range(len(whole)))
    assert {i: len(c) for i, c in covered.items()} == {i: n for i, _, n, _, _ in brute(rows, 20) if n}


@pytest.fixture
def hot(spark):
    """Joins are sorted ones, and those of more than 4 KB a partition are split where one is larger than others."""
    skew = "spark.sql.adaptive.skewJoin.skewedPartition"
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16", f"{skew}ThresholdInBytes": "4k", f"{skew}Factor": "1.5"}
    was = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in was.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_copies_of_a_text_are_read_by_several_tasks(docs_of, hot):
    """The rows of one text are most of the input; both joins with the texts split them."""
    r = random.Random(8)
    copy = "".join(r.choice("abcdefgh ") for _ in range(600))
    rows = [(k, copy if k % 10 else "".join(r.choice("abcdefgh ") for _ in range(600))) for k in range(3000)]
    docs = docs_of(rows).repartition(12)
    out = remove_repeats(docs).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((x.doc_id, x.n_removed) for x in out) == [(k, 600 if k % 10 else 0) for k, _ in rows]
    assert len({x.task for x in out if x.n_removed}) > 1
    texts = _texts(docs)
    place = {"key": "1L", "ctx": "2L", "cls": "3L", "size": "2L", "known": "false", "at": "100", "low": "50", "high": "150"}
    places = texts.select("t1", "t2").distinct().selectExpr("*", *[f"{v} as {k}" for k, v in place.items()])
    read = _contexts(texts, places, 400).filter(F.concat("head", "tail") == F.lit(copy[50:550].encode()))
    assert {tuple(x) for x in read.select(F.length("head"), F.length("tail")).collect()} == {(50, 450)}
    assert read.select(F.spark_partition_id()).distinct().count() > 1


def test_maximal_repeats():
    """Every pair's common string is in a group with all that share it, and no group can be extended."""
    r = random.Random(3)
    heads = [bytes(r.choice(b"ab") for _ in range(r.randrange(12))) for _ in range(40)]
    tails = [b"gram" + bytes(r.choice(b"ab") for _ in range(r.randrange(12))) for _ in range(40)]
    found = {(back, ahead, tuple(sorted(members))) for back, ahead, members in maximal_repeats(heads, tails, 16, 4)}

    def common(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    want = set()
    for i in range(40):
        for j in range(i):
            back, ahead = common(heads[i][::-1], heads[j][::-1]), common(tails[i], tails[j])
            if back + ahead >= 16:
                all_ = [k for k in range(40) if heads[k][len(heads[k]) - back :] == heads[i][len(heads[i]) - back :] and len(heads[k]) >= back and tails[k][:ahead] == tails[i][:ahead]]
                want.add((back, ahead, tuple(all_)))
    assert found == want


def test_empty(docs_of):
    assert remove_repeats(docs_of([(1, "a")]).limit(0)).collect() == []
    assert repeat_groups(docs_of([(1, "a")])).collect() == []
