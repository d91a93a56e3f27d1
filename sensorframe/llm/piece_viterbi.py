"""SentencePiece encoding by streaming Viterbi search, and decoding."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.llm.common import bare, text_or_empty

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The sign for a space, and how much worse than the worst piece an unknown character scores.
SPACE, UNKNOWN_PENALTY = "▁", 10.0
#: Stands for a SPACE sign that is in the text itself; no valid text holds a lone surrogate.
_LITERAL = "\udc81"
#: Segments up to this length are remembered in each worker, in two generations of up to so many: when the younger
#: is full it takes the place of the elder.
MEMO_CHARS, MEMO_SIZE = 48, 250_000


_READY: dict[int, dict] = {}


@dataclass
class Vocabulary:
    """Pieces by id, their scores, and the ids of the 256 byte pieces (empty without them)."""

    pieces: list[str]
    scores: list[float]
    plain: list[bool]
    byte_ids: list[int]
    unknown: int
    _ready: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_ready": {}}

    @staticmethod
    def load(path: str = MODEL) -> Vocabulary:
        """Read on the driver and sent along with the tasks, so executors need no file. Scores of a unigram model are
        log-probabilities and taken as they are; a merge model has ranks in their place (0, -1, -2, ...), which become
        log-probabilities by Zipf's law."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        scores = [model.get_score(i) for i in range(n)]
        plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)]
        own = [s for s, p in zip(scores, plain) if p]
        if all(s == int(s) for s in own) and min(own, default=0) < -1000:
            scores = [float(-np.log(2.0 - s)) for s in scores]
        scores = [round(s * 2**20) / 2**20 for s in scores]  # sums are then exact, and ties the same in any order
        by_byte = {pieces[i]: i for i in range(n) if model.is_byte(i)}
        return Vocabulary(pieces, scores, plain, [by_byte[f"<0x{b:02X}>"] for b in range(256)] if by_byte else [], model.unk_id())

    def ready(self) -> dict:
        """Lookups and remembered segments, one set in each worker for all tasks with this vocabulary."""
        if not self._ready:
            key = hash((tuple(self.pieces), tuple(self.scores), tuple(self.plain), tuple(self.byte_ids)))
            if key in _READY:
                self._ready = _READY[key]
                return self._ready
            table = {p: (s, i) for i, (p, s, ok) in enumerate(zip(self.pieces, self.scores, self.plain)) if ok}
            trie: dict = {}  # character -> (the same for the next one, score, id or -1)
            for p, (score, i) in sorted(table.items(), key=lambda item: len(item[0])):
                node = trie
                for char in p[:-1]:
                    node = node.setdefault(char, ({}, 0.0, -1))[0]
                node[p[-1]] = ({}, score, i) if p[-1] not in node else (node[p[-1]][0], score, i)
            # Between these two characters no piece runs on, so every path has a boundary there.
            joined = {p[k : k + 2] for p in table for k in range(len(p) - 1)}
            # If none runs from any character into a space, or between letters and others, words are segments.
            apart = not any(b == SPACE and a != SPACE for a, b in joined)
            signs = "".join(sorted({c for pair in joined for c in pair if re.match(r"[^\W\d_]", c) and not c.isalpha()}))
            letter = rf"[^\W\d_{signs}]"
            is_letter = re.compile(letter).match
            by_kind = apart and not any(a != SPACE and bool(is_letter(a)) != bool(is_letter(b)) for a, b in joined)
            other = rf"(?:(?!{SPACE})[\W\d_{signs}])"
            split = re.compile(rf"{SPACE}*{letter}+|{SPACE}+{other}*|{other}+" if by_kind else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if apart else r"[\s\S]+")
            of_byte = {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
            back = [of_byte.get(i, p.replace(SPACE, " ").encode() if ok else b"") for i, (p, ok) in enumerate(zip(self.pieces, self.plain))]
            self._ready = {
                "table": table, "trie": trie, "split": split, "joined": joined, "back": back, "memo": {}, "elder": {},
                "longest": max(map(len, table), default=1),
                "unknown": min((s for s, _ in table.values()), default=0.0) - UNKNOWN_PENALTY,
            }
            _READY.clear()
            _READY[key] = self._ready
        return self._ready

    def _bytes(self, char: str) -> list[int]:
        if not self.byte_ids:
            return [self.unknown]
        return [self.byte_ids[b] for b in (SPACE if char == _LITERAL else char).encode("utf-8", "surrogatepass")]

    def search(self, text: str) -> list[int]:
        """The ids of the best path through ``text`` (spaces already replaced). States are kept for the window that
        pieces can still start from; ids are committed, and everything before them dropped, as soon as the paths back
        from all states of the window meet in one boundary. Of equally good paths the one with the longer last piece
        wins."""
        ready = self.ready()
        trie, unknown, longest = ready["trie"], ready["unknown"], ready["longest"]
        n, none = len(text), float("-inf")
        out: list[int] = []
        # Of boundary base + k: the best score, the boundary before it and the id between (-1: an unknown character).
        base, reach, check = 0, 0, 4 * longest
        room = min(n, 2 * longest) + 1
        best, before, piece = [none] * room, [0] * room, [-1] * room
        best[0] = 0.0

        def commit(to: int) -> None:
            nonlocal base
            path, at = [], to
            while at > base:
                path.append(at - base)
                at = before[at - base]
            for k in reversed(path):
                if piece[k] >= 0:
                    out.append(piece[k])
                else:
                    out.extend(self._bytes(text[before[k]]))
            if to < n:
                del best[: to - base], before[: to - base], piece[: to - base]
                base = to

        for i in range(n):
            if i == reach:
                if i > base:
                    commit(i)
            elif i - base >= check:
                live = {k for k in range(i, min(n, base + len(best) - 1) + 1) if best[k - base] > none}
                while len(live) > 1:
                    at = max(live)
                    live.discard(at)
                    live.add(before[at - base])
                at = live.pop()
                if at > base:
                    commit(at)
                check = max(4 * longest, i - base + longest)
            k = i - base
            score = best[k]
            if score == none:
                continue
            if len(best) <= k + longest:
                more = [none] * (2 * longest)
                best += more
                before += more
                piece += more
            node, alone = trie, False
            for char in text[i : i + longest]:
                k += 1
                entry = node.get(char)
                if entry is None:
                    break
                node, gain, found = entry
                if found >= 0:
                    alone = alone or k == i + 1 - base
                    if score + gain > best[k]:
                        best[k], before[k], piece[k] = score + gain, i, found
                    if k + base > reach:
                        reach = k + base
            if not alone:
                k = i + 1 - base
                if score + unknown > best[k]:
                    best[k], before[k], piece[k] = score + unknown, i, -1
                if i >= reach:
                    reach = i + 1
        commit(n)
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of ``text``. An empty text has none; any other gets a space in front."""
        if not text:
            return []
        ready = self.ready()
        if SPACE in text:
            text = text.replace(SPACE, _LITERAL)
        text = SPACE + text.replace(" ", SPACE)
        out: list[int] = []
        get, extend, found = ready["memo"].get, out.extend, self._found
        for segment in ready["split"].findall(text):
            ids = get(segment)
            if ids is None:
                ids = found(segment)
                get = ready["memo"].get
            extend(ids)
        return out

    def _found(self, segment: str) -> list[int]:
        """The ids of a segment that is not remembered, put together from its parts where no piece can run on."""
        ready = self.ready()
        ids = ready["elder"].get(segment)
        if ids is None:
            joined = ready["joined"]
            cuts = [k for k in range(1, len(segment)) if segment[k - 1 : k + 1] not in joined]
            if not cuts:
                ids = self.search(segment)
            else:
                ids, get = [], ready["memo"].get
                for a, b in zip([0, *cuts], [*cuts, len(segment)]):
                    part = segment[a:b]
                    ids += get(part) or self._found(part)
        if len(segment) <= MEMO_CHARS:
            if len(ready["memo"]) >= MEMO_SIZE:
                ready["elder"], ready["memo"] = ready["memo"], {}
            ready["memo"][segment] = ids
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``, without the space that encoding puts in front."""
        back = self.ready()["back"]
        return b"".join(map(back.__getitem__, ids)).decode("utf-8", "replace")[1:]


def encode_texts(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids. A null text counts as empty and has no ids; null doc_ids
    and repeated rows are kept. Texts of any length are searched with a bounded window. With byte pieces in the
    vocabulary every text can be decoded exactly, whatever its characters. Other columns are not read."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 200):
                part = batch.slice(begin, 200)
                lists = [np.array(vocabulary.encode(t.as_py()), np.int32) for t in part.column(1)]
                counts = np.array([len(x) for x in lists], np.int64)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists)))
                yield pa.record_batch([part.column(0), pa.array(counts), ids], names=["doc_id", "n_tokens", "ids"])

    own = bare(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text"))
    return own.mapInArrow(encode, "doc_id long, n_tokens long, ids array<int>")


def decode_ids(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``encoded`` (doc_id, n_tokens, ids) with ``text``. Null ids count as none."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 200):
                part = batch.slice(begin, 200)
                texts = [vocabulary.decode(ids.values.to_numpy().tolist() if ids.is_valid else []) for ids in part.column(2)]
                yield pa.record_batch([*part.columns, pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids", "text"])

    return bare(encoded, "doc_id", "n_tokens", "ids").mapInArrow(decode, "doc_id long, n_tokens long, ids array<int>, text string")


def round_trip(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """Encoded texts with the SHA-256 of what their ids decode to: doc_id, n_tokens, ids, decoded_sha256."""
    vocabulary = Vocabulary.load(path)
    decoded = decode_ids(encode_texts(docs, vocabulary), vocabulary)
    return decoded.select("doc_id", "n_tokens", "ids", F.sha2("text", 256).alias("decoded_sha256"))
