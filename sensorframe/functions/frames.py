"""Row-frame bounds of rolling windows."""

from __future__ import annotations


def centred_bounds(size: int) -> tuple[int, int]:
    """Rows before and after the current one: 5 -> (2, 2), 10 -> (5, 4), 20 -> (10, 9)."""
    return size // 2, (size - 1) // 2


def trailing_bounds(size: int) -> tuple[int, int]:
    """A causal window: the current row and the ``size - 1`` rows before it."""
    return size - 1, 0
