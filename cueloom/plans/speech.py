"""An aligner around a speech model: any object with ``align(path, text, language=...)`` whose result has segments of timed words.

The model is loaded where it is first used, once in each Python worker, and never travels; what travels is the function that loads
it. A script's ``audio`` is a path that the executors see.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from pathlib import Path
from typing import Any

from cueloom.functions.profiles import InputError
from cueloom.plans.aligner import Clean
from cueloom.plans.script import Token
from cueloom.plans.timeline import Timeline
from cueloom.sources import audio as tools

_loaded: dict[Any, Any] = {}


def _value(part: Any, *names: str, default: Any = None) -> Any:
    """The first of a part's attributes or keys that says anything."""
    found = (part.get(n) if isinstance(part, dict) else getattr(part, n, None) for n in names)
    return next((v for v in found if v not in (None, "")), default)


def _number(value: Any, default: float | None) -> float | None:
    try:
        return float(value)
    except (TypeError, ValueError):
        return default


def words(result: Any) -> list[Token]:
    """The words of all segments, or a segment itself where it has none; without text or with an end before their start they go."""
    parts = [part for segment in _value(result, "segments", default=()) for part in (_value(segment, "words") or (segment,))]
    made = [(str(_value(p, "word", "text", default="")), _number(_value(p, "start"), 0.0), p) for p in parts]
    tokens = [Token(text, start, _number(_value(p, "end"), start), confidence=_number(_value(p, "probability"), None)) for text, start, p in made]
    return [t for t in tokens if t.text and t.end >= t.start]


class SpeechAligner:
    """``load`` gives the model; ``seconds`` and ``clip`` are the audio tools, which tests replace."""

    def __init__(self, load: Callable[[], Any], seconds: Callable[[str], float] = tools.seconds_of, clip: Callable[[str, str, float, float], str] = tools.clip):
        self.load, self.seconds, self.clip = load, seconds, clip

    def _asked(self, path: str, script: Clean, language: str) -> tuple[list[Token], Any]:
        if self.load not in _loaded:
            _loaded[self.load] = self.load()
        result = _loaded[self.load].align(path, script.align, language=language)
        tokens = words(result)
        if not tokens:
            raise InputError("the model gave no times")
        return tokens, result

    def align(self, script: Clean, language: str, audio: str | None) -> tuple[Timeline, float | None, dict]:
        if not audio:
            raise InputError("the script has no audio")
        self.audio = audio
        tokens, result = self._asked(audio, script, language)
        duration = _number(_value(result, "duration"), None)
        shown = {"engine": type(_loaded[self.load]).__name__, "duration": duration, "segment_count": len(_value(result, "segments", default=())), "language": language}
        return Timeline.of(tokens), self.seconds(audio) if duration is None else duration, shown

    def realign(self, script: Clean, language: str, audio_start: float, audio_end: float) -> Timeline:
        with tempfile.TemporaryDirectory() as folder:
            part = self.clip(self.audio, str(Path(folder, "part.wav")), audio_start, audio_end)
            return Timeline.of(self._asked(part, script, language)[0])
