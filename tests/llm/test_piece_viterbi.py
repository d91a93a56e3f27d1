from __future__ import annotations

import hashlib
import random

import pytest

from sensorframe.llm import piece_viterbi
from sensorframe.llm.piece_viterbi import SPACE, Vocabulary, decode_ids, encode_texts, round_trip

rng = random.Random(1)
TEXTS = ["", "a", " ", "  a  b", "▁x▁ y", "\n\n a\tb\r\n", "日本語テキスト😀 é", "m², ²x", "x" * 3000, "ab" * 2000, " " * 500, "=-" * 900, "The quick brown fox; jumps!",
         "".join(rng.choice("abcdefg hij\n▁é%") for _ in range(6000)), "Wörter%%% und*** Sätze### mit&&& Müll$$$ " * 50]


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.load()


def brute(v, text):
    """Viterbi over the whole text at once."""
    if not text:
        return []
    text = SPACE + text.replace(SPACE, piece_viterbi._LITERAL).replace(" ", SPACE)
    ready, n = v.ready(), len(text)
    best, came = [0.0] + [float("-inf")] * n, [None] * (n + 1)
    for i in range(n):
        for j in range(i + 1, min(n, i + ready["longest"]) + 1):
            hit = ready["table"].get(text[i:j])
            if hit and best[i] + hit[0] > best[j]:
                best[j], came[j] = best[i] + hit[0], (i, [hit[1]])
        if text[i] not in ready["table"] and best[i] + ready["unknown"] > best[i + 1]:
            best[i + 1], came[i + 1] = best[i] + ready["unknown"], (i, v._bytes(text[i]))
    out, at = [], n
    while at:
        at, ids = came[at]
        out = ids + out
    return out


@pytest.mark.parametrize("k", range(len(TEXTS)))
def test_best_path(vocabulary, k):
    ids = vocabulary.encode(TEXTS[k])
    assert ids == brute(vocabulary, TEXTS[k])
    assert vocabulary.decode(ids) == TEXTS[k]


def test_streams_long_segments():
    """Without any safe cut paths still meet, and ids are the same as of the whole search."""
    pieces = ["a", "b", "ab", "ba", "aab", "bba", "abab", SPACE, SPACE + "a", "a" + SPACE]
    v = Vocabulary(["<unk>", *pieces], [0.0, *[round(-rng.random() * 5 * 2**20) / 2**20 for _ in pieces]], [False] + [True] * len(pieces), [], 0)
    text = "".join(rng.choice("ab ") for _ in range(4000))
    assert v.encode(text) == brute(v, text)
    assert v.search(SPACE + text.replace(" ", SPACE)) == brute(v, text)


def test_as_the_library_does(vocabulary, tmp_path):
    """The library's own unigram search over these pieces and scores."""
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece

    model = pb.ModelProto.FromString(open(piece_viterbi.MODEL, "rb").read())
    model.trainer_spec.model_type = 1
    for piece, score in zip(model.pieces, vocabulary.scores):
        if piece.type == 1:
            piece.score = score
    path = tmp_path / "unigram.model"
    path.write_bytes(model.SerializeToString())
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    worse = 0
    for text in TEXTS[6:]:
        if SPACE in text:
            continue
        mine, theirs = vocabulary.encode(text), library.encode(text)
        total = lambda ids: sum(vocabulary.scores[i] for i in ids if vocabulary.plain[i])
        worse += total(mine) < total(theirs) - 1e-3  # single floats may break a tie another way
    assert worse == 0


def test_table(spark, docs_of, vocabulary):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "a"), (3, None), (4, TEXTS[4]), (4, TEXTS[4])]
    encoded = encode_texts(docs_of(rows), vocabulary)
    got = decode_ids(encoded, vocabulary).collect()
    assert [(r.doc_id, r.text) for r in got] == [(i, t or "") for i, t in rows]
    assert all(r.n_tokens == len(r.ids) for r in got)
    hashed = round_trip(docs_of(rows)).collect()
    assert [r.decoded_sha256 for r in hashed] == [hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows]
    assert encode_texts(docs_of(rows).limit(0), vocabulary).collect() == []
