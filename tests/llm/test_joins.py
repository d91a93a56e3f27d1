from __future__ import annotations

import random
import re

import pytest

from sensorframe.llm.graph import components
from sensorframe.llm.line_dedup import dedup_report, remove_lines
from sensorframe.llm.ngram_join import keep_first, ngram_join
from tests.llm.conftest import LONG

rng = random.Random(5)
WORDS = [f"w{i}" for i in range(400)]


def near(words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


#: A large group of near copies at all distances, a chain, and texts that share a passage only.
BASE = [rng.choice(WORDS) for _ in range(90)]
PASSAGE = " ".join(rng.choice(WORDS) for _ in range(30))
TEXTS = [near(BASE, rng.randrange(0, 7)) for _ in range(120)]
TEXTS += [PASSAGE + " " + " ".join(rng.choice(WORDS) for _ in range(rng.choice([2, 20, 60]))) for _ in range(60)]
TEXTS += [" ".join(BASE[:k] + ["v"] * 0) for k in range(60, 90, 2)]
TEXTS += [None, "", " \n ", "one", "ONE", "one two", "a a a a a a", "é ü", LONG, LONG + " tail", LONG]
ROWS = [(rng.randrange(10**6) if k % 29 else None, t) for k, t in enumerate(TEXTS)]
ROWS += [ROWS[3], ROWS[3], (ROWS[3][0], "another text of that id")]


def shingles(text, width):
    words = re.sub("[A-Z]", lambda m: m.group().lower(), text or "").encode().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def component_of(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * 100 >= percent * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    parent[find(a)] = find(b)
    return sets, [find(i) for i in range(len(rows))]


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_ngram_join(docs_of, width, percent):
    sets, root = component_of(ROWS, width, percent)
    low = {r: min((i for (i, _), own in zip(ROWS, root) if own == r and i is not None), default=None) for r in root}
    want = sorted([(i, len(s), low[r]) for (i, _), s, r in zip(ROWS, sets, root)], key=str)
    got = ngram_join(docs_of(ROWS), width, percent).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=str) == want


def test_keep_first(docs_of):
    docs = docs_of(ROWS)
    sets, root = component_of(ROWS, 5, 80)
    got = keep_first(docs)
    assert got.columns == docs.columns
    rows = [(r[0], r[1]) for r in got.collect()]
    wordless = [(i, t) for (i, t), s in zip(ROWS, sets) if not s]
    kept = [r for r in rows if shingles(r[1], 5)]
    assert sorted([r for r in rows if not shingles(r[1], 5)], key=str) == sorted(wordless, key=str)
    by_row = {row: r for row, r, s in zip(ROWS, root, sets) if s}
    assert len(kept) == len({by_row[r] for r in kept}) == len({r for r, s in zip(root, sets) if s})
    for i, t in kept:
        ids = [j for (j, _), r in zip(ROWS, root) if r == by_row[i, t] and j is not None]
        assert i == min(ids, default=None)


def lines_left(rows, width=5, percent=80):
    """Brute force, with rows of one doc_id in the order that the operator gives them."""
    lines = [(i is None, i, key, no, row, line) for row, (i, t, key) in enumerate(rows) for no, line in enumerate((t or "").split("\n"))]
    sets = [{tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if (w := x[5].encode().split()) else set() for x in lines]
    gone = set()
    for a, sa in zip(lines, sets):
        for b, sb in zip(lines, sets):
            if sa and sb and (b[0], b[1] or 0, b[2], b[3]) < (a[0], a[1] or 0, a[2], a[3]):
                both = len(sa & sb)
                if 100 * both >= percent * (len(sa) + len(sb) - both):
                    gone.add((a[4], a[3]))
                    break
    return [
        (i, len((t or "").split("\n")), sum(r == row for r, _ in gone), "\n".join(x for no, x in enumerate((t or "").split("\n")) if (row, no) not in gone))
        for row, (i, t, _) in enumerate(rows)
    ]


LINES = [near(BASE[:40], rng.randrange(0, 6)) for _ in range(110)] + [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 30))) for _ in range(40)]
LINES += ["Same short line."] * 25 + ["a b c d e", "a b c d", "\t", "", " ", "a b c d e"]
LINE_ROWS = [(k if k % 13 else None, "\n".join(rng.sample(LINES, rng.randrange(0, 6)))) for k in range(70)]
LINE_ROWS += [(5, "Same short line.\nfive again here it is"), LINE_ROWS[7], (200, None), (201, ""), (202, "\n\n"), (203, "x y z v w u\nx y z v w u\n" + LONG[:3000])]


@pytest.mark.parametrize("width", [1, 5])
def test_line_dedup(spark, docs_of, width):
    keys = {t: k for t, k in spark.createDataFrame([(t or "",) for _, t in LINE_ROWS], "t string").selectExpr("t", "xxhash64(t)").collect()}
    want = lines_left([(i, t, keys[t or ""]) for i, t in LINE_ROWS], width)
    docs = docs_of(LINE_ROWS)
    got = dedup_report(docs, width).collect()
    assert sorted([tuple(r) for r in got], key=str) == sorted(want, key=str)
    left = remove_lines(docs, width)
    assert left.columns == docs.columns
    texts = sorted([(r[0], r[1]) for r in left.collect()], key=str)
    assert texts == sorted([(i, None if t is None else w[3]) for (i, t), w in zip(LINE_ROWS, want)], key=str)


def test_one_changed_word(docs_of):
    """With words as tokens, lines of 10 to 40 words match when one in their middle is changed, those of 4 or 8 do not."""
    rows = []
    for k, n in enumerate([4, 8, *range(10, 41, 5)]):
        words = [f"x{n}y{i}" for i in range(n)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[: n // 2], "other", *words[n // 2 + 1 :]]))]
    got = {r.doc_id: r.n_removed for r in dedup_report(docs_of(rows), width=1).collect()}
    assert [got[i] for i, _ in rows] == [0, 0, 0, 0] + [0, 1] * 7


def test_empty(docs_of):
    nothing = docs_of(ROWS).limit(0)
    for rows in (ngram_join(nothing), keep_first(nothing), dedup_report(nothing), remove_lines(nothing)):
        assert rows.collect() == []


def test_components(spark):
    edges = [(a, a + 1) for a in range(100, 160)] + [(7, 7), (500, 3), (3, 501), (501, 502)] + [(1000, 2000 + k) for k in range(300)]
    edges += [(rng.randrange(5000, 5200), rng.randrange(5000, 5200)) for _ in range(120)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near_ = {}
    for a, b in edges:
        if a != b:
            near_.setdefault(a, set()).add(b)
            near_.setdefault(b, set()).add(a)
    want = {}
    for node in sorted(near_):
        if node not in want:
            todo = [node]
            while todo:
                x = todo.pop()
                if x not in want:
                    want[x] = node
                    todo += near_[x]
    assert got == want
