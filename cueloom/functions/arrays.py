"""Texts as arrays of code points, for the kernels that describe every offset of a text at once."""

from __future__ import annotations

import numpy as np

from cueloom.functions.charsets import WS_CODES

_HIGHEST_BLANK = max(WS_CODES)
_BLANK = np.zeros(_HIGHEST_BLANK + 1, dtype=bool)
_BLANK[list(WS_CODES)] = True


def codes(text: str) -> np.ndarray:
    """The code points of ``text``."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)


def blank(points: np.ndarray) -> np.ndarray:
    """Whether each code point is white space."""
    return _BLANK[np.minimum(points, _HIGHEST_BLANK)] & (points <= _HIGHEST_BLANK)


def visible_before(points: np.ndarray) -> np.ndarray:
    """The visible characters before each of the n + 1 offsets."""
    return np.concatenate([[0], np.cumsum(~blank(points))])


def visible_beside(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the n + 1 offsets the place of the visible character before it (-1 without one) and from it on (n without one)."""
    n, index, there = len(points), np.arange(len(points)), ~blank(points)
    before = np.concatenate([[-1], np.maximum.accumulate(np.where(there, index, -1))]) if n else np.array([-1])
    after = np.concatenate([np.minimum.accumulate(np.where(there, index, n)[::-1])[::-1], [n]]) if n else np.array([0])
    return before, after
