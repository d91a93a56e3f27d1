"""Counting quotient filters over permuted keys: compact sorted multisets that merge without loss.

A key has two halves of ``width`` bits. ``permute`` maps keys one to one onto keys that look random. Of a permuted
key, leading bits select a range, the bits after these are its quotient, and all others its remainder, which is
kept in full: the key can be read back, and counts are exact. A filter holds one range: how many remainders each
quotient has (in unary code, as the run ends of a quotient filter), the remainders in order, and counts of one byte
with a list of those that do not fit.
"""

from __future__ import annotations

import numpy as np

from sensorframe.llm.tokens import mix

_ROUNDS = mix(np.arange(7001, 7005, dtype=np.uint64))


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def _feistel(hi: np.ndarray, lo: np.ndarray, width: int, rounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    for k in rounds:
        hi, lo = lo, hi ^ (mix(lo + k) & _mask(width))
    return hi, lo


def permute(hi: np.ndarray, lo: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A bijection on keys of two ``width``-bit halves (``width`` up to 63)."""
    return _feistel(hi, lo, width, _ROUNDS)


def restore(hi: np.ndarray, lo: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of ``permute``."""
    lo, hi = _feistel(lo, hi, width, _ROUNDS[::-1])
    return hi, lo


def tally(hi: np.ndarray, lo: np.ndarray, width: int, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order and their summed counts (each 1 by default)."""
    if not len(hi):
        return hi, lo, np.zeros(0, np.int64)
    if 2 * width <= 64:
        key = (hi << np.uint64(width)) | lo
        if counts is None:
            key.sort()
        else:
            order = np.argsort(key, kind="stable")  # sorted stretches are merged
            key, counts = key[order], counts[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        hi, lo = key[new] >> np.uint64(width), key[new] & _mask(width)
        n = len(key)
    else:
        order = np.lexsort((lo, hi))
        hi, lo, n = hi[order], lo[order], len(hi)
        new = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]))
        hi, lo = hi[new], lo[new]
        counts = None if counts is None else counts[order]
    return hi, lo, np.diff(np.append(new, n)) if counts is None else np.add.reduceat(counts, new)


def _planes(values: np.ndarray, bits: int) -> bytes:
    """The ``bits`` low bits of each value, as planes of whole bytes."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, : -(-bits // 8)].T).tobytes()


def _from_planes(data: bytes, at: int, n: int, bits: int) -> tuple[np.ndarray, int]:
    size = -(-bits // 8)
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T
    return out.view(np.uint64).reshape(n), at + n * size


def build(hi: np.ndarray, lo: np.ndarray, counts: np.ndarray, width: int, range_bits: int) -> bytes:
    """A filter of distinct permuted keys in order, all of one range (the ``range_bits`` top bits of ``hi``)."""
    n, own = len(hi), width - range_bits
    q = min(own, n.bit_length())
    rest = own - q
    quotient = (hi & _mask(own)) >> np.uint64(rest)
    ends = np.zeros((1 << q) + n, bool)
    ends[quotient.astype(np.int64) + np.arange(n)] = True
    large = counts >= 255
    head = np.array([n, q, large.sum()], np.uint64).tobytes()
    return b"".join([
        head, np.packbits(ends).tobytes(), _planes(np.ascontiguousarray(hi & _mask(rest)), rest), _planes(np.ascontiguousarray(lo), width),
        np.minimum(counts, 255).astype(np.uint8).tobytes(), counts[large].astype(np.uint64).tobytes(),
    ])


def read(data: bytes, width: int, range_bits: int, range_: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and counts of a filter, in order."""
    n, q, n_large = (int(x) for x in np.frombuffer(data, np.uint64, 3))
    own = width - range_bits
    rest, at = own - q, 24
    size = -(-((1 << q) + n) // 8)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=(1 << q) + n))
    quotient = (ends - np.arange(n)).astype(np.uint64)
    high, at = _from_planes(data, at + size, n, rest)
    lo, at = _from_planes(data, at, n, width)
    counts = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data[at + n : at + n + 8 * n_large], np.uint64)
    return (np.uint64(range_) << np.uint64(own)) | (quotient << np.uint64(rest)) | high, lo, counts


def merge(filters: list[bytes], width: int, range_bits: int, range_: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of several filters of one range, in order, with their counts summed."""
    parts = [read(f, width, range_bits, range_) for f in filters]
    hi, lo, counts = (np.concatenate(x) for x in zip(*parts))
    return tally(hi, lo, width, counts)
