"""A script's tokens as arrays: columns of times, offsets and confidence, with sorted views and nearest-token lookups."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np

from cueloom.plans.script import Token


class Timeline:
    """Tokens in their given order. Offsets are -1 and confidence is NaN where there is none; all views keep ties in order."""

    def __init__(self, text, start, end, a, b, confidence):
        self.text = np.asarray(text, dtype=object)
        self.start, self.end, self.confidence = (np.asarray(x, dtype=np.float64) for x in (start, end, confidence))
        self.a, self.b = (np.asarray(x, dtype=np.int64) for x in (a, b))

    @classmethod
    def of(cls, tokens: Timeline | Iterable[Token]) -> Timeline:
        if isinstance(tokens, Timeline):
            return tokens
        rows = [(t.text, t.start, t.end, -1 if t.a is None else t.a, -1 if t.b is None else t.b, np.nan if t.confidence is None else t.confidence) for t in tokens]
        return cls(*(list(zip(*rows, strict=True)) or [()] * 6))

    @classmethod
    def joined(cls, *parts: Timeline) -> Timeline:
        return cls(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("text", "start", "end", "a", "b", "confidence")))

    def take(self, which: np.ndarray) -> Timeline:
        """The tokens of an index or mask, in its order."""
        return Timeline(self.text[which], self.start[which], self.end[which], self.a[which], self.b[which], self.confidence[which])

    def shifted(self, chars: int, seconds: float = 0.0) -> Timeline:
        return Timeline(self.text, self.start + seconds, self.end + seconds, self.a + chars, self.b + chars, self.confidence)

    def __len__(self) -> int:
        return len(self.start)

    def __getitem__(self, at):
        if isinstance(at, slice):
            return [self[i] for i in range(*at.indices(len(self)))]
        a, b, c = int(self.a[at]), int(self.b[at]), float(self.confidence[at])
        return Token(self.text[at], float(self.start[at]), float(self.end[at]), None if a < 0 else a, None if b < 0 else b, None if np.isnan(c) else c)

    def __iter__(self) -> Iterator[Token]:
        return (self[i] for i in range(len(self)))

    @cached_property
    def mapped(self) -> np.ndarray:
        return (self.a >= 0) & (self.b >= 0)

    def by(self, *columns: str) -> Timeline:
        """The mapped tokens sorted by columns."""
        at = np.flatnonzero(self.mapped)
        return self.take(at[np.lexsort([getattr(self, c)[at] for c in reversed(columns)])])

    @cached_property
    def trusted(self) -> np.ndarray:
        return self.mapped & ~(self.confidence < 0.2)

    @cached_property
    def furthest(self) -> np.ndarray:
        """The greatest last offset among the tokens up to each; rises on a timeline that is ordered by place."""
        return np.maximum.accumulate(np.maximum(self.a, self.b - 1))

    @cached_property
    def _edges(self) -> tuple[np.ndarray, ...]:
        at = np.flatnonzero(self.mapped)
        ends, begins = at[np.argsort(self.b[at], kind="stable")], at[np.argsort(self.a[at], kind="stable")]
        return ends, self.b[ends], begins, self.a[begins]

    def before(self, at: int, among: np.ndarray | None = None) -> int:
        """The first of the mapped tokens with the greatest end offset up to ``at``; -1 without any."""
        if among is not None:
            found = np.flatnonzero(among & self.mapped & (self.b <= at))
            return int(found[self.b[found].argmax()]) if len(found) else -1
        ends, offsets, _, _ = self._edges
        i = int(np.searchsorted(offsets, at, side="right")) - 1
        return int(ends[np.searchsorted(offsets, offsets[i], side="left")]) if i >= 0 else -1

    def after(self, at: int, among: np.ndarray | None = None) -> int:
        """The first of the mapped tokens with the least start offset from ``at`` on; -1 without any."""
        if among is not None:
            found = np.flatnonzero(among & self.mapped & (self.a >= at))
            return int(found[self.a[found].argmin()]) if len(found) else -1
        _, _, begins, offsets = self._edges
        i = int(np.searchsorted(offsets, at, side="left"))
        return int(begins[i]) if i < len(begins) else -1

    def overlaps(self, a: int, b: int) -> np.ndarray:
        """Whether each token is mapped into [a, b)."""
        return self.mapped & (self.b > a) & (self.a < b)

    def replaced(self, a: int, b: int, new: Timeline) -> Timeline:
        """Without the tokens that overlap [a, b), and with ``new`` behind the rest."""
        return Timeline.joined(self.take(~self.overlaps(a, b)), new)

    def rows(self) -> list[dict]:
        """The tokens as plain values."""
        lists = (self.text.tolist(), self.start.tolist(), self.end.tolist(), self.a.tolist(), self.b.tolist(), self.confidence.tolist())
        return [
            {"text": t, "start": s, "end": e, "start_char": a if a >= 0 else None, "end_char": b if b >= 0 else None, "confidence": c if c == c else None}
            for t, s, e, a, b, c in zip(*lists, strict=True)
        ]
