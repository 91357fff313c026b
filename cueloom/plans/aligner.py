"""The aligner plug-in surface, script cleaning, and placing an aligner's tokens in the script."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from typing import Protocol

import numpy as np

from cueloom.functions import charsets as C
from cueloom.functions.arrays import blank, codes
from cueloom.plans.script import Token
from cueloom.plans.timeline import Timeline


@dataclass
class Clean:
    """A cleaned script: what is shown, what is aligned, and where each aligned character comes from."""

    display: str
    align: str
    origin: list[int]


class Aligner(Protocol):
    """What a forced aligner offers. ``realign`` is optional: without it nothing can be repaired locally.

    ``align`` gets the cleaned script, the engine's name of its language and where its audio is, and returns tokens with times, the
    audio's duration and, if it likes, its own result as a dictionary for the alignment file; ``realign`` returns tokens for a
    fragment between two times, with times that count from the first. Tokens are a list or a ``Timeline``.
    """

    def align(self, script: Clean, language: str, audio: str | None) -> tuple[Timeline | list[Token], float | None] | tuple[Timeline | list[Token], float | None, dict]: ...


def engine_language(language: str) -> str:
    """What aligners call a language: they know one written Chinese."""
    return "zh" if language == "zh-TW" else language


def clean(text: str | None, keep_punctuation: bool = True) -> Clean | None:
    """The cleaned script; None where nothing is left."""
    shown = unicodedata.normalize("NFC", re.sub("\r\n?", "\n", text or "").translate(dict.fromkeys(map(ord, C.ZERO_WIDTH)))).strip()
    points = codes(shown)
    keep = ~np.isin(points, codes(C.MARKDOWN_NOISE))
    if not keep_punctuation:
        marks = [point for point in np.unique(points).tolist() if unicodedata.category(chr(point))[0] == "P"]
        keep &= ~np.isin(points, marks)
    at = np.flatnonzero(keep)
    gap = blank(points[at])
    once = ~(gap & np.append(True, gap[:-1])) if len(at) else np.zeros(0, dtype=bool)  # of a run of blanks the first, none in front
    at, gap = at[once], gap[once]
    if len(gap) and gap[-1]:
        at, gap = at[:-1], gap[:-1]
    align = np.where(gap, ord(" "), points[at]).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return Clean(shown, align, at.tolist()) if align else None


def normalized(text: str) -> str:
    kept = text.translate(dict.fromkeys(map(ord, C.ZERO_WIDTH + C.MARKDOWN_NOISE)))
    return " ".join(unicodedata.normalize("NFC", kept).split())


def mapped(tokens: Timeline | list[Token], script: Clean) -> Timeline:
    """Tokens with offsets: found in order in the aligned text, else in the shown text, else placed at the cursor."""
    line = Timeline.of(tokens)
    if line.mapped.all():
        return line
    kept, places, aligned, shown = [], [], 0, 0
    for i, text in enumerate(line.text):
        key = normalized(text)
        if not key:
            continue
        at = script.align.find(key, aligned)
        if at >= 0:
            aligned = at + len(key)
            a, b = int(script.origin[at]), int(script.origin[aligned - 1]) + 1
        else:
            raw = text.strip()
            found = script.display.find(raw, shown)
            a = shown if found < 0 else found
            b = min(len(script.display), a + len(raw))
            aligned = min(len(script.align), aligned + len(key))
        shown = max(shown, b)
        kept.append(i)
        places.append((a, b))
    line = line.take(np.array(kept, dtype=np.int64))
    a, b = np.array(places, dtype=np.int64).reshape(-1, 2).T
    return Timeline(line.text, np.maximum(0.0, line.start), np.maximum(line.start, line.end), a, b, line.confidence)


class SteadyAligner:
    """A synthetic aligner: one token per visible character, ``step`` seconds each, as tests and demos need it.

    ``drift`` shifts the tokens from the share ``drift_from`` of the script on, without any sign of it in their
    confidence; ``realign`` then returns the true times.
    """

    def __init__(self, step: float = 0.2, confidence: float = 0.9, drift: float = 0.0, drift_from: float = 1.0, can_realign: bool = True, fails: bool = False):
        self.step, self.confidence, self.drift, self.drift_from, self.fails = step, confidence, drift, drift_from, fails
        self.truth: str = ""
        if not can_realign:
            self.realign = None

    def _steady(self, text: str, first: int) -> Timeline:
        """A token for each visible character of ``text``, from the ``first`` step on."""
        chars = np.array(list(text), dtype=object)
        places = np.flatnonzero(~blank(codes(text)))
        start = (first + np.arange(len(places))) * self.step
        return Timeline(chars[places], start, start + self.step * 0.8, places, places + 1, np.full(len(places), self.confidence))

    def align(self, script: Clean, language: str, audio: str | None) -> tuple[Timeline, float | None]:
        self.truth = "".join(script.display.split())
        line = self._steady(script.display, 0)
        late = np.where(np.arange(len(line)) >= len(line) * self.drift_from, self.drift, 0.0)
        line.start, line.end = line.start + late, line.end + late
        return line, len(line) * self.step + max(0.0, self.drift)

    def realign(self, script: Clean, language: str, audio_start: float, audio_end: float) -> Timeline:
        if self.fails:
            raise RuntimeError("realignment failed")
        wanted = "".join(script.display.split())
        spots, at = [], self.truth.find(wanted)
        while at >= 0:
            spots.append(at)
            at = self.truth.find(wanted, at + 1)
        first = min(spots, key=lambda s: abs(s * self.step - audio_start - 4.0), default=0)
        return self._steady(script.display, first).shifted(0, -audio_start)
