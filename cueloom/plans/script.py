"""One script inside a grouped-map kernel: arrays over its offsets, so that every boundary question is a lookup.

``Script`` describes all n + 1 offsets at once with numpy: visible characters before each, the visible characters around it, whether
a cue may end there and how good that is. The sequential kernels in ``splitting`` then only slice these arrays.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np

from cueloom.functions import charsets as C
from cueloom.functions.arrays import blank, visible_before, visible_beside
from cueloom.functions.arrays import codes as codes_of
from cueloom.functions.profiles import language_group


@dataclass
class Token:
    """A timed piece of text; offsets are None until it is mapped."""

    text: str
    start: float
    end: float
    a: int | None = None
    b: int | None = None
    confidence: float | None = None

    @property
    def mapped(self) -> bool:
        return self.a is not None and self.b is not None


@dataclass
class Cue:
    """A subtitle: times in seconds, and the span [a, b) of the script that it covers."""

    start: float
    end: float
    text: str
    a: int
    b: int
    warnings: list[str] = field(default_factory=list)

    @property
    def duration(self) -> float:
        return max(0.0, self.end - self.start)

    @cached_property
    def chars(self) -> int:
        return len("".join(self.text.split()))

    @property
    def cps(self) -> float:
        return self.chars / max(self.duration, 0.1)

    def but(self, **changes) -> Cue:
        return Cue(**({"start": self.start, "end": self.end, "text": self.text, "a": self.a, "b": self.b, "warnings": self.warnings} | changes))

    def at(self, start: float, end: float) -> Cue:
        """The same text at other times."""
        moved = Cue(start, end, self.text, self.a, self.b, self.warnings)
        moved.__dict__["chars"] = self.chars
        return moved


@lru_cache(maxsize=64)
def _table(chars: str) -> np.ndarray:
    """For each code point up to one beyond those of ``chars`` whether it is one of them."""
    own = codes_of(chars)
    table = np.zeros(int(own.max(initial=0)) + 2, dtype=bool)
    table[own] = True
    return table


def _among(codes: np.ndarray, chars: str) -> np.ndarray:
    table = _table(chars)
    return table[np.minimum(codes, len(table) - 1)]


def _within(codes: np.ndarray, ranges: tuple[tuple[int, int], ...]) -> np.ndarray:
    return np.logical_or.reduce([(codes >= a) & (codes <= b) for a, b in ranges])


def compare_form(text: str) -> str:
    kept = text.translate(dict.fromkeys(map(ord, C.ZERO_WIDTH)))
    return "".join(unicodedata.normalize("NFC", kept).split())


class Script:
    """The display text of one script in one language."""

    def __init__(self, text: str, language: str):
        self.text, self.language, self.group, self.n = text, language, language_group(language), len(text)
        codes = codes_of(text)
        self.visible = visible_before(codes)
        before, after = visible_beside(codes)
        padded = np.concatenate([codes, [0]])
        self.before = before
        self.prev = np.where(before >= 0, padded[before], 0)
        self.nxt = np.where(after < self.n, padded[np.minimum(after, self.n)], 0)
        left = np.concatenate([[0], codes])
        right = padded
        self.edge = (self.prev == 0) | (self.nxt == 0)
        space = blank(left) | blank(right)
        change = np.concatenate([[0], np.cumsum(_among(codes, C.OPEN_QUOTES).astype(int) - _among(codes, C.CLOSE_QUOTES))])
        quoted = change - np.minimum(0, np.minimum.accumulate(change)) > 0
        self._describe(left, right, space, quoted)

    def _describe(self, left: np.ndarray, right: np.ndarray, space: np.ndarray, quoted: np.ndarray) -> None:
        p, n, edge = self.prev, self.nxt, self.edge
        closing, mid, strong = _among(p, C.CLOSE_QUOTES), _among(p, C.MID), _among(p, C.STRONG)
        opening, quote = _among(p, C.OPEN_QUOTES), _among(p, C.OPEN_QUOTES) | _among(n, C.CLOSE_QUOTES)
        clear = closing | mid | strong
        worth = np.where(strong | closing, 18.0, np.where(mid, 10.0, 0.0))
        worth -= 18.0 * _among(n, C.STRONG + C.MID + C.CLOSE_QUOTES) + 55.0 * opening
        moved = np.where(strong | closing, 90.0, np.where(mid, 45.0, 0.0))
        if self.group == "en":
            word = lambda c: ((c < 128) & (((c >= 48) & (c <= 57)) | ((c >= 65) & (c <= 90)) | ((c >= 97) & (c <= 122)))) | _among(c, "'-’")
            inside = word(left) & word(right) & ~space
            own = 34.0 * space - 90.0 * inside
            extra, risk = own, inside & ~clear
        elif self.group == "cjk":
            cjk_p, cjk_n, follower = _within(p, C.CJK), _within(n, C.CJK), _among(n, C.ZH_QUOTE_FOLLOWERS)
            quiet = edge | _among(n, C.STRONG + C.MID)
            begins, ends = opening | _among(p, C.STRAIGHT_QUOTES), _among(n, C.CLOSE_QUOTES + C.STRAIGHT_QUOTES)
            ended = closing | _among(p, C.STRAIGHT_QUOTES)
            risk = ~quiet & np.select([begins, ends, ended], [cjk_n | follower, cjk_p, follower], False)
            edges = 24.0 * _among(p, C.ZH_EDGES) + 8.0 * _among(n, C.ZH_EDGES)
            own = np.where(risk, -95.0, -edges - 6.0 * (cjk_p & cjk_n))
            extra = -edges - 90.0 * risk
        elif self.group == "ko":
            pair = _within(p, C.HANGUL) & _within(n, C.HANGUL) & ~space
            own = 34.0 * space - 74.0 * pair - 55.0 * quote
            extra = 24.0 * space - 70.0 * pair - 6.0 * quoted
            risk = ~clear & (quote | pair)
        else:
            kata, kanji, hira = (lambda c, r=r: _within(c, r) for r in (C.KATAKANA, C.KANJI, C.HIRAGANA))
            particle_p, particle_n = _among(p, C.JA_EDGES), _among(n, C.JA_EDGES)
            number_p, number_n, counter_p, counter_n = (_among(c, s) for s in (C.JA_NUMERALS, C.JA_COUNTERS) for c in (p, n))
            kept = np.select(
                [
                    (kata(p) & kata(n)) | (kanji(p) & kanji(n)),
                    (kanji(p) & hira(n) & ~particle_n) | (hira(p) & kanji(n) & ~particle_p),
                    hira(p) & hira(n),
                    (number_p & (number_n | counter_n)) | (counter_p & number_n),
                    _among(p, C.JA_LONG_MARKS) | _among(n, C.JA_SMALL_KANA),
                ],
                [-78.0, -68.0, np.where(particle_p, 0.0, -48.0), -78.0, -78.0],
                0.0,
            )
            own = kept - 28.0 * (quoted & ~clear)
            extra = 12.0 * particle_p - 38.0 * particle_n - 6.0 * quoted
            risk = ~clear & (quote | (kept <= -48))
        #: Whether a cue must not end at an offset.
        self.risk = risk & ~edge
        #: The worth of a cue end at an offset, and of moving one there (without the distance).
        self.score = np.where(edge, 0.0, worth + own)
        self.move_score = self.score + moved + extra

    def count(self, a: int, b: int) -> int:
        """Visible characters in [a, b)."""
        a, b = max(0, min(a, self.n)), max(0, min(b, self.n))
        return int(self.visible[b] - self.visible[a]) if b > a else 0

    def render(self, a: int, b: int) -> str:
        return " ".join(self.text[a:b].split())

    def after_count(self, a: int, b: int, count: int) -> int:
        """The offset after the ``count``-th visible character of [a, b); b if there are fewer."""
        target = self.visible[a] + max(1, count)
        at = int(np.searchsorted(self.visible, target, side="left"))
        return at if a < at <= b else b

    @cached_property
    def _sentence_ends(self) -> np.ndarray:
        return np.flatnonzero(_among(codes_of(self.text), C.SENTENCE_ENDS)) + 1

    def sentence_before(self, at: int, limit: int) -> int:
        lower = max(0, at - limit)
        i = int(np.searchsorted(self._sentence_ends, at, side="right")) - 1
        return int(self._sentence_ends[i]) if i >= 0 and self._sentence_ends[i] > lower else lower

    def sentence_after(self, at: int, limit: int) -> int:
        upper = min(self.n, at + limit)
        i = int(np.searchsorted(self._sentence_ends, max(0, at), side="right"))
        return int(self._sentence_ends[i]) if i < len(self._sentence_ends) and self._sentence_ends[i] <= upper else upper

    def trim(self, a: int, b: int) -> tuple[int, int]:
        part = self.text[a:b]
        if not part.strip():
            return b, b
        return a + len(part) - len(part.lstrip()), b - len(part) + len(part.rstrip())

    @cached_property
    def _last_words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each offset the last word character before it, where its word begins, and whether the word up to there is an English edge word."""
        codes = codes_of(self.text)
        folded = np.where((codes >= 65) & (codes <= 90), codes + 32, codes)
        word = ((folded >= 97) & (folded <= 122)) | (codes == ord("'"))
        index = np.arange(self.n)
        begins = np.maximum.accumulate(np.where(word & ~np.concatenate([[False], word[:-1]]), index, -1)) if self.n else index
        is_edge = np.zeros(self.n, dtype=bool)
        for edge in C.EN_EDGES:
            size = len(edge)
            hit = word & (index - begins == size - 1)
            for back, ch in enumerate(reversed(edge)):
                hit &= np.concatenate([np.zeros(min(back, self.n), np.int64), folded])[: self.n] == ord(ch)
            is_edge |= hit
        last = np.concatenate([[-1], np.maximum.accumulate(np.where(word, index, -1))]) if self.n else np.array([-1])
        return last, np.where(last >= 0, np.append(begins, 0)[last], 0), np.append(is_edge, False)[last]

    def edges(self, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """What ``bad_edges`` has to know of the offsets ``at``: the last word character or visible one before each, whether a line must not end there, and in English where the word begins."""
        if self.group == "en":
            last, begins, is_edge = (x[at] for x in self._last_words)
            return last, is_edge, begins
        edges = {"ja": C.JA_EDGES, "cjk": C.ZH_EDGES + C.OPEN_QUOTES + C.STRAIGHT_QUOTES, "ko": C.OPEN_QUOTES + C.STRAIGHT_QUOTES}[self.group]
        return self.before[at], _among(self.prev[at], edges)

    def bad_edges(self, a: int, last: np.ndarray, is_edge: np.ndarray, begins: np.ndarray | None = None) -> np.ndarray:
        """Whether the lines from ``a`` to each of the offsets of these ``edges`` end in what a line must not end in."""
        there = last >= a
        bad = there & is_edge
        if begins is not None:
            for i in np.flatnonzero(there & (begins < a)):  # the line begins inside its only word
                bad[i] = self.text[a : last[i] + 1].lower() in C.EN_EDGES
        return bad

    @cached_property
    def pause_worth(self) -> np.ndarray:
        """70 after an offset's strong punctuation, 35 after weaker, else 0."""
        return np.where(_among(self.prev, C.STRONG), 70.0, np.where(_among(self.prev, C.MID), 35.0, 0.0))

    def covered_by(self, cues: list[Cue]) -> bool:
        """Whether the cues' text is the script's, white space aside."""
        return compare_form("".join(c.text for c in cues)) == compare_form(self.text)
