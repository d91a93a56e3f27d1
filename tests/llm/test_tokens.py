from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa

from sensorframe.llm import tokens
from sensorframe.llm.tokens import distinct, pieces, raw, shingles, span_hashes, split, texts_of, words_of

rng = random.Random(4)
TEXTS = [None, "", " a", "a ", "é ü x", "\x0b\x0c", "A b", "a", "b"] + ["".join(rng.choice("ab \n\té") for _ in range(rng.randrange(60))) for _ in range(300)]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_words_are_those_of_the_pattern():
    column = texts_of(pa.array(TEXTS)).slice(3)
    w = split(*raw(column))
    got = [[bytes(w.data[a:b]).decode() for a, b in zip(w.starts[i:j], w.ends[i:j])] for i, j in zip(w.first, w.first[1:])]
    assert got == [words(t) for t in TEXTS[3:]]


def test_hashes_follow_the_words():
    """Equal words have one hash in whatever text and piece, different ones different hashes; lower case on request."""
    seen: dict = {}
    for begin, end, w in words_of(texts_of(pa.array(TEXTS + ["x " * 400_000 + "a b é"] * 2)), lower=True):
        flat = [x for t in (TEXTS + ["x " * 400_000 + "a b é"] * 2)[begin:end] for x in words(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))]
        for word, h in zip(flat, w.hashes().tolist(), strict=True):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_shingles_and_sets():
    column = texts_of(pa.array(TEXTS))
    w = split(*raw(column))
    for width in (1, 3, 5):
        values, first = shingles(w.hashes(), w.first, width)
        sets, at = distinct(values, first)
        ranked, at2 = distinct(values, first, np.array([rng.randrange(200) for _ in range(1 << 10)], np.uint8))
        for i, text in enumerate(TEXTS):
            own = words(text)
            want = [tuple(own[k : k + width]) for k in range(max(1, len(own) - width + 1))] if own else []
            assert first[i + 1] - first[i] == len(want)
            assert at[i + 1] - at[i] == at2[i + 1] - at2[i] == len(set(want))
            assert sorted(sets[at[i] : at[i + 1]].tolist()) == sets[at[i] : at[i + 1]].tolist() == sorted(ranked[at2[i] : at2[i + 1]].tolist())


def test_order_is_the_same_in_every_text():
    rank = np.array([rng.randrange(5) for _ in range(16)], np.uint8)
    values = np.array([rng.randrange(1 << 64) for _ in range(40)], np.uint64)
    values = np.concatenate([values, values[:20] ^ np.uint64(1)])  # alike but for the last bit
    whole, _ = distinct(values, np.array([0, 60]), rank)
    place = {v: k for k, v in enumerate(whole.tolist())}
    part, _ = distinct(values[::-1][:45], np.array([0, 45]), rank)
    assert [place[v] for v in part.tolist()] == sorted(place[v] for v in part.tolist())
    many = np.zeros((1 << 20) + 3, np.int64)  # more texts than the fast key has room for
    many[-2:] = 45, 60
    many[-3] = 0
    sets, first = distinct(values, many, rank)
    assert len(sets) == 60 and first[-1] == 60


def test_pieces(monkeypatch):
    monkeypatch.setattr(tokens, "PIECE", 64)
    column = texts_of(pa.array(TEXTS))
    parts = list(pieces(column))
    assert [p[0] for p in parts[1:]] == [p[1] for p in parts[:-1]] and parts[-1][1] == len(TEXTS)
    assert list(pieces(texts_of(pa.array([], pa.string())))) == []


def test_spans():
    data, offsets = raw(texts_of(pa.array(["ab", "", "ab", "ba"])))
    h = span_hashes(data, offsets[:-1], offsets[1:])
    assert h[0] == h[2] and len(set(h.tolist())) == 3
