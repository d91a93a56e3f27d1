from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sensorframe.llm.importance import KINDS, SHRINK, TABLE_BITS, cutoff, fit_weights, importance_resample
from sensorframe.llm.quality_rules import COUNTS, count_texts, drop_poor, fit_forest, quality_rules
from sensorframe.llm.tokens import pieces, raw, shingles, span_hashes, texts_of
from tests.llm.conftest import LONG

TEXTS = ["", None, "\n", "a\na\n\na", " a b c a b c", "\n\n", "a b", "é ü x\né ü x\n", "", " x", "x\n", "\nx\nx", "A#B $c! a?|<>%", "a a a a", LONG, "é" * 500]


def brute(text):
    words = text.encode().split()
    triples = list(zip(words, words[1:], words[2:]))
    uses, covered, seen, dup = Counter(triples), set(), set(), 0
    for i, t in enumerate(triples):
        if uses[t] > 1:
            covered |= {i, i + 1, i + 2}
    for line in text.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return [len(words), sum(len(w.decode()) for w in words), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(re.findall("[A-Z]", text)),
            len(re.findall("[!?]", text)), max(Counter(words).values(), default=0)]


def test_counts():
    column = texts_of(pa.array(TEXTS))
    parts = [count_texts(*raw(column.slice(b, e - b))) for b, e in pieces(column)]
    got = [np.concatenate([p[i] for p in parts]).tolist() for i in range(len(COUNTS))]
    assert [list(x) for x in zip(*got)] == [brute(t or "") for t in TEXTS]


def test_forest_sets_outliers_apart():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (2000, 3)), rng.normal(9, 0.1, (20, 3))])
    scores = fit_forest(x, trees=100).scores(x)
    assert scores[2000:].min() > np.quantile(scores[:2000], 0.99)
    assert set(fit_forest(np.zeros((5, 2)), trees=3).scores(np.zeros((4, 2)))) == {fit_forest(np.zeros((5, 2)), trees=3).scores(np.zeros((1, 2)))[0]}


def test_forest_follows_its_definition():
    """Scores from paths that are walked node by node, and every split parts what came to its node."""
    rng = np.random.default_rng(4)
    sample, rows = np.round(rng.normal(0, 1, (300, 4)), 1), np.round(rng.normal(0, 2, (50, 4)), 1)
    forest = fit_forest(sample, trees=7, subsample=64, seed=3)

    def path(x, node, depth=0):
        if forest.column[node] < 0:
            return depth, forest.length[node]
        return path(x, forest.left[node] + int(x[forest.column[node]] >= forest.value[node]), depth + 1)

    def harmonic(n):  # the mean path in a search tree of n keys
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    sizes = {harmonic(n) for n in range(65)}
    for x, score in zip(rows, forest.scores(rows)):
        paths = [path(x, root) for root in forest.roots]
        assert all(d <= 6 and min(abs(length - d - s) for s in sizes) < 1e-9 for d, length in paths)
        assert score == pytest.approx(2 ** (-np.mean([length for _, length in paths]) / harmonic(64)))


def test_repetition_below_the_base_rule_reaches_the_forest(spark):
    """Ordinary texts differ in all words; some have two lines twice, which no other statistic shows."""
    rng = np.random.default_rng(5)

    def text(k):
        words = [f"{''.join(rng.choice(list('abcdefghij'), 5))}" for _ in range(120)]
        lines = [" ".join(words[i : i + 10]) for i in range(0, 120, 10)]
        return "\n".join(lines[:10] + lines[:2] if k % 20 == 0 else lines)

    rows = [(k, text(k)) for k in range(800)]
    labels = spark.createDataFrame([(k, int(k % 20 != 0), 0) for k in range(0, 800, 5)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    assert not any(r.base_failed for r in got.values())
    poor, good = [got[k].kept for k in range(0, 800, 20)], [got[k].kept for k in range(800) if k % 20]
    assert sum(poor) <= 0.1 * len(poor) and sum(good) >= 0.97 * len(good)


@pytest.fixture(scope="module")
def tables(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
    return read("documents"), read("labels")


def test_rules_against_labels(spark):
    """Half of the labels calibrate, the other half must agree."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality_rules(docs, labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    bad, good = [r for r in got if r.quality == 0], [r for r in got if r.quality == 1 and not r.base_failed]
    assert sum(not r.kept for r in bad) >= 0.95 * len(bad)
    assert sum(r.kept for r in good) >= 0.97 * len(good)


def test_rules_at_the_edges(spark, docs_of, tables):
    fine = "plain words of an ordinary text that goes on for a while and then ends here, as it must. "
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, " ".join(f"{fine}{i}" for i in range(9)) + str(k)) for k in range(3)] + [(50, "z " * 100)]
    labels = tables[1].limit(0)
    got = quality_rules(docs_of(rows), labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed)  # without labels the base rules decide alone
    kept = drop_poor(docs_of(rows), labels)
    assert kept.columns == docs_of(rows).columns
    assert sorted(str(r[0]) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.kept)
    assert quality_rules(docs_of(rows).limit(0), labels).collect() == []
    assert drop_poor(docs_of(rows).limit(0), labels).collect() == []


def test_resampling_against_labels(spark):
    """On labels that neither fit nor calibrate the model."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = importance_resample(docs, labels.filter("doc_id % 3 > 0")).join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()
    good = [r.kept for r in got if r.quality == 1 and r.toxic == 0 and r.n_words]
    assert np.mean(good) > 0.97
    assert np.mean([r.kept for r in got if r.quality == 0]) < 0.1
    assert np.mean([r.kept for r in got if r.toxic == 1]) < 0.5  # a few hundred labelled rows only show the commoner words


def test_resampling_at_the_edges(spark, docs_of, tables):
    docs = docs_of([(k, t) for k, t in enumerate(TEXTS)] + [(None, "a b"), (3, "a\na\n\na")])
    none = tables[1].limit(0)
    got = importance_resample(docs, none).collect()
    assert len(got) == len(TEXTS) + 2 and all(r.kept == (r.n_words > 0) for r in got)
    again = importance_resample(docs, none, draw=5)
    assert 5 <= again.filter("kept").count() <= 6 and again.filter("kept").exceptAll(importance_resample(docs, none, draw=5)).count() == 0
    assert importance_resample(docs, none, draw=0).filter("kept").count() == 0
    assert importance_resample(docs.limit(0), none).collect() == []


def test_cutoff(spark):
    rng = np.random.default_rng(3)
    values = np.round(rng.normal(0, 1, 5000), 2).tolist()
    df = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 17, 2500, 5000, 9999):
        assert cutoff(df, k, few=50) == sorted(values, reverse=True)[min(k, 5000) - 1]


def test_weights_follow_their_definition(spark):
    """Counts of words, pairs and words once a text, gram by gram, against the tables of counts."""
    rng = np.random.default_rng(1)
    texts = [(" ".join(rng.choice(["Ab", "ab", "c", "d", "e e", "f\n"], rng.integers(0, 40))), bool(k % 3 == 0)) for k in range(40)] + [(None, True), ("", False)]

    def bucket(grams):
        return int(grams >> np.uint64(64 - TABLE_BITS))

    def one(word):
        data = np.frombuffer(word.encode(), np.uint8)
        return span_hashes(data, np.array([0]), np.array([len(data)]))

    raw, target = (np.zeros((KINDS, 1 << TABLE_BITS)) for _ in range(2))
    for text, wanted in texts:
        words = (text or "").lower().split()
        hashes = [one(w) for w in words]
        pairs = [shingles(np.concatenate(hashes[i : i + 2]), np.array([0, 2]), 2)[0][0] for i in range(len(words) - 1)]
        if len(words) == 1:
            pairs = [shingles(hashes[0], np.array([0, 1]), 2)[0][0]]
        for kind, grams in enumerate(([h[0] for h in hashes], pairs, [one(w)[0] for w in set(words)])):
            for g in grams:
                raw[kind, bucket(g)] += 1
                target[kind, bucket(g)] += wanted
    expected = raw * (target.sum(axis=1) / raw.sum(axis=1))[:, None]
    ratio, error = np.log((target + 1) / (expected + 1)), np.sqrt(1 / (target + 1) + 1 / (expected + 1))
    want = np.sign(ratio) * np.maximum(0, abs(ratio) - SHRINK * error)
    got = fit_weights(spark.createDataFrame(texts, "text string, target boolean"))
    np.testing.assert_allclose(got, want, atol=1e-12)


def test_draws_follow_the_weights(spark):
    """Of three kinds of rows as many are drawn as by Gumbel top-k over their weights, simulated."""
    kinds = ["good words of a target text", "words that any text has", "bad junk words"]
    rows = [(k, " ".join([kinds[k % 3]] * (3 + k % 3))) for k in range(3000)]
    labels = spark.createDataFrame([(k, int(k % 3 == 0), 0) for k in range(0, 3000, 2)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = importance_resample(docs, labels, draw=900, sharpness=1.0).toPandas()
    assert got.kept.sum() == 900
    rng, weights = np.random.default_rng(2), got.log_weight.to_numpy()
    drawn = np.mean([np.bincount(got.doc_id[np.argsort(weights + rng.gumbel(size=len(weights)))[-900:]] % 3, minlength=3) for _ in range(50)], axis=0)
    rates = np.bincount(got.doc_id[got.kept] % 3, minlength=3)
    assert drawn[0] > 1.5 * drawn[2] and (abs(rates - drawn) < 60).all()
