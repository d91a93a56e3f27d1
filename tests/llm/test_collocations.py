from __future__ import annotations

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from sensorframe.llm import collocations as module
from sensorframe.llm import quotient_filter as qf
from sensorframe.llm.collocations import collocations
from tests.llm.conftest import LONG


def brute(rows, least, keep, share):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {}
    for (lang, w), a in f.items():
        if len(w) > 1 and a >= least:
            cuts = [(1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            found[lang, w] = (a, f[lang, w[:k]], f[lang, w[k:]], score)
    drop = {(lang, part) for (lang, w), x in found.items() if len(w) == 3 for part in (w[:2], w[1:]) if (lang, part) in found and 100 * x[0] >= share * found[lang, part][0]}
    out = []
    for lang in {lang for lang, _ in found}:
        own = [(-x[3], -x[0], " ".join(w).encode(), x) for (g, w), x in found.items() if g == lang and (g, w) not in drop]
        for rank, (_, _, phrase, (a, left, right, score)) in enumerate(sorted(own)[:keep], 1):
            out.append((lang, rank, phrase.decode(), a, left, right, n[lang], score))
    return sorted(out)


def rows_of(seed):
    r = random.Random(seed)
    words = ["a", "B", "b", "é", "É", "z z", "x-y", "日本", "c", "d"]

    def text():
        return "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", ". ", "\n", ",", "  "]) for _ in range(r.randrange(60)))

    rows = [(i, text(), r.choice(["en", "en", "de", None, "und"])) for i in range(150)]
    return rows + [(None, None, "en"), (1, "", None), (2, " .,\n", "fr"), (3, LONG, "en"), (4, "A b c " * 30, "en")] + rows[:2]


def got(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def test_memory_of_a_shard_is_bounded():
    """Words of a shard and its counted n-grams, in bytes that a worker holds at once."""
    data = np.frombuffer((b"some words of a text, " * (module.SHARD // 20))[: module.SHARD], np.uint8)
    tracemalloc.start()
    module.encode(data, np.array([0, len(data)]))
    _, shard = tracemalloc.get_traced_memory()
    hi, lo = (np.random.default_rng(k).integers(0, 1 << 27, 2 * module.HELD, dtype=np.uint64) for k in (0, 1))
    tracemalloc.reset_peak()
    begin = tracemalloc.get_traced_memory()[0]
    qf.tally(*qf.permute(hi, lo, 27), 27, np.ones(len(hi), np.int64))
    _, grams = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert shard < 100 << 20 and grams - begin < 40 << 20


@pytest.mark.parametrize("least,keep,share", [(10, 2000, 50), (2, 7, 90), (1, 40, 50)])
def test_matches_brute_force(spark, docs_of, monkeypatch, least, keep, share):
    """With shards of 500 bytes, so that a task has many of them, and many ranges."""
    for name, value in {"SHARD": 500, "HELD": 300, "RANGE": 1 << 9, "SLICE": 50}.items():
        monkeypatch.setattr(module, name, value)
    rows = rows_of(least)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' as shard", "1 as f", "2 as n", "'y' as Lang_")
    assert got(collocations(docs, least, keep, share)) == brute(rows, least, keep, share)


def test_empty(docs_of):
    assert collocations(docs_of([(1, "a b")]).limit(0)).collect() == []
    assert collocations(docs_of([(1, "a b c"), (2, None)])).collect() == []


@pytest.mark.parametrize("width,range_bits", [(6, 0), (27, 3), (32, 5), (33, 2), (63, 4)])
def test_filters_merge_without_loss(width, range_bits):
    rng = np.random.default_rng(width)
    keys = [rng.integers(0, 1 << min(width, 62), (2, 4000), dtype=np.uint64) for _ in range(3)]
    keys = [np.concatenate([k, keys[0][:, :500], np.repeat(keys[0][:, :1], 700, axis=1)], axis=1) for k in keys]
    want, filters = Counter(), {}
    for hi, lo in keys:
        want.update(zip(hi.tolist(), lo.tolist()))
        h, low, n = qf.tally(*qf.permute(hi, lo, width), width)
        of = (h >> np.uint64(width - range_bits)).astype(int)
        for r in np.unique(of):
            filters.setdefault(r, []).append(qf.build(h[of == r], low[of == r], n[of == r], width, range_bits))
    found = Counter()
    for r, parts in filters.items():
        hi, lo, n = qf.merge(parts, width, range_bits, int(r))
        assert (np.diff(hi.astype(object)) >= 0).all()
        hi, lo = qf.restore(hi, lo, width)
        found.update(dict(zip(zip(hi.tolist(), lo.tolist()), n.tolist())))
    assert found == want


def test_scores_past_64_bits(spark):
    df = spark.createDataFrame([(9 * 10**13, 10**14, 10**14 - 1), (1, 3, 1)], "a long, l long, r long")
    score = module._score(df.a, df.l, df.r)
    assert [r[0] for r in df.select(score).collect()] == [10**6 * (9 * 10**13) ** 2 // (10**14 * (10**14 - 1)), 333333]
