"""Words of whole text columns, split and hashed with numpy.

Runs inside Spark tasks on Arrow batches. A word is a maximal run of bytes other than the six ASCII white space
characters, the same as ``[^\\x20\\x09-\\x0D]+`` on code points. Hashes have 64 bits; two different words,
shingles or sets count as equal only if their hashes meet (about n^2 / 2^65 for n distinct items).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time; a longer text makes a piece of its own.
PIECE = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_ODD = np.uint64(0xD6E8FEB86659FD95)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= _ODD
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9E6C63D0676A9A99)
    x ^= x >> np.uint64(32)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _base_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and their inverses, kept for as many bytes as were asked for."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        base = 0x5851F42D4C957F2D
        n = max(n, PIECE)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers = (both[0], both[1])
    return _powers


@dataclass
class Words:
    """Words of ``n`` texts: byte offsets into ``data``, and where each text's words begin."""

    data: np.ndarray
    offsets: np.ndarray  # of texts in data, n + 1
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # of the words of each text, n + 1

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def hashes(self) -> np.ndarray:
        """64 bits for each word."""
        return span_hashes(self.data, self.starts, self.ends)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits for the bytes of each span ``[start, end)``."""
    if not len(starts) or not len(data):
        return mix((ends - starts).astype(np.uint64))
    power, inverse = _base_powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.multiply(_BYTE[data], power[: len(data)], out=total[1:])
    np.cumsum(total, out=total)
    out = total[ends] - total[starts]
    out *= inverse[starts]
    out += (ends - starts).astype(np.uint64)
    return mix(out)


def texts_of(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """As one large_string array; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    return pc.fill_null(column.cast(pa.large_string()), "")


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of what ``texts_of`` gives."""
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``PIECE`` bytes each, so that work arrays stay small."""
    _, offsets = raw(column)
    begin, n = 0, len(column)
    while begin < n:
        end = int(np.searchsorted(offsets, offsets[begin] + PIECE, side="right")) - 1
        end = min(n, max(end, begin + 1), begin + PIECE // 2)
        yield begin, end
        begin = end


def split(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    if lower:
        data = _LOWER[data]
    n = len(data)
    inside = ~_SPACE[data]
    before = np.empty(n + 1, bool)
    before[0] = False
    before[1:] = inside
    edges = offsets[:-1][offsets[:-1] < n]
    before[edges] = False  # a text starts a word, whatever the text before it ended with
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.empty(n + 1, bool)
    after[:-1] = inside
    after[n] = False
    after[offsets[1:]] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def words_of(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    """The words of ``column[begin:end]``, piece by piece."""
    for begin, end in pieces(column):
        yield begin, end, split(*raw(column.slice(begin, end - begin)), lower=lower)


_SHINGLE = mix(np.arange(1001, 1065, dtype=np.uint64)) | np.uint64(1)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``width``-word shingles of each text, with repeats, and where each text's begin. A text with
    fewer words has its whole sequence as one shingle; one without words has none."""
    counts = np.diff(first)
    n = len(hashes)
    sums = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        sums += hashes[k : k + len(sums)] * _SHINGLE[k]
    full = np.maximum(counts - width + 1, 0)
    out_first = np.zeros(len(first), np.int64)
    short = (counts > 0) & (counts < width)
    np.cumsum(np.where(short, 1, full), out=out_first[1:])
    out = np.empty(out_first[-1], np.uint64)
    at = np.repeat(first[:-1] - out_first[:-1], np.where(short, 0, full))
    whole = np.ones(len(out), bool)
    whole[out_first[:-1][short]] = False
    where = np.flatnonzero(whole)
    out[where] = sums[where + at] if len(where) else sums[:0]
    for i in np.flatnonzero(short):
        part = hashes[first[i] : first[i + 1]]
        out[out_first[i]] = (part * _SHINGLE[: len(part)]).sum(dtype=np.uint64) + np.uint64(len(part))
    return mix(out), out_first


def distinct(values: np.ndarray, first: np.ndarray, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each text's values without repeats, ordered by (rank of the value's top bits, value). ``rank`` has 2^k
    entries of 8 bits, for the values' top k bits; without it, the order is that of the values."""
    group = np.repeat(np.arange(len(first) - 1), np.diff(first))
    shift = np.uint64(64 - (len(rank) - 1).bit_length()) if rank is not None else np.uint64(0)
    level = rank[values >> shift].astype(np.uint64) if rank is not None else np.zeros(len(values), np.uint64)
    # Group, level and the values' top bits in one key, which sorts fast; in full where that can't tell them apart.
    key = (group.astype(np.uint64) << np.uint64(44)) | (level << np.uint64(36)) | (values >> np.uint64(28))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    if len(first) > 1 << 20 or (same & (values[order][1:] != values[order][:-1])).any():
        order = np.lexsort((values, level, group))
    values, group = values[order], group[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (group[1:] != group[:-1])
    return values[new], np.searchsorted(group[new], np.arange(len(first)))
