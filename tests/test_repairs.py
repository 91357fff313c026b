"""What repairs record: one test for each rule of the bookkeeping, with the aligner's answers made up."""

from dataclasses import replace

import numpy as np
import pytest

from cueloom.functions.profiles import resolve
from cueloom.plans import repair
from cueloom.plans.aligner import SteadyAligner
from cueloom.plans.repair import Job, Range
from cueloom.plans.script import Cue, Script
from cueloom.plans.timeline import Timeline

TEXT = "他说这是一个很长的故事我们慢慢地听下去吧。" * 60
P = resolve("youtube_long", "zh")


def line(a, b, step=0.2, late=0.0):
    at = np.arange(a, b)
    return Timeline(list(TEXT[a:b]), at * step + late, at * step + 0.16 + late, at, at + 1, np.full(b - a, 0.9))


def job():
    return Job(Script(TEXT, "zh"), line(0, len(TEXT)), len(TEXT) * 0.2, P, SteadyAligner())


def drift(a, b, severity="high"):
    stats = {"checkpoint_count": 1, "median_drift": 2.0, "p95_drift": 2.0, "max_drift": 2.0, "signed_median_drift": 2.0}
    return Range(a, b, (a * 0.2, b * 0.2), ["checkpoint_drift"], severity, 1, stats)


def micro(a, b, severity):
    stats = {"cue_start_index": 1, "cue_end_index": 2, "sample_count": 9, "visible_chars": b - a, "median_drift": 0.9, "p75_drift": 1.1, "max_drift": 1.2, "signed_median_drift": 0.9, "source": "cue_shape"}
    return Range(a, b, (a * 0.2, b * 0.2), ["micro_drift"], severity, 0, stats)


def probing(monkeypatch, own, ranges, answer):
    """A job whose micro candidates, their probes' drift and the aligner's answer are given."""
    shown = iter(ranges)
    monkeypatch.setattr(repair, "micro_candidates", lambda *a, **k: [Range(r.a, r.b, r.audio, ["x"], "high", 0, {"first_cue": 1, "last_cue": 2}) for r in ranges])
    monkeypatch.setattr(repair, "micro_range", lambda *a, **k: next(shown))
    monkeypatch.setattr(own, "ask", lambda r, paddings=(): answer(r))
    return own.repair_micro([])


@pytest.mark.parametrize("severity", ["medium", "high"])
def test_only_high_micro_drift_stays_open(monkeypatch, severity):
    own = job()
    assert not probing(monkeypatch, own, [micro(40, 80, severity)], lambda r: line(40, 80, late=50.0))
    s = own.summary
    assert s.micro_drift_run_count == 1 and not s.micro_drift_repaired_ranges
    assert (len(s.micro_drift_unresolved_ranges), len(s.low_confidence_ranges)) == ((1, 1) if severity == "high" else (0, 0))
    assert s.status == ("needs_review" if severity == "high" else "ok")
    assert [x["mode"] for x in s.micro_drift_unresolved_ranges] == (["overlap_next"] if severity == "high" else [])


def test_repaired_micro_drift_counts_among_all_repairs_and_once(monkeypatch):
    own = job()
    assert probing(monkeypatch, own, [micro(40, 80, "high")] * 2, lambda r: line(40, 80))
    s = own.summary
    assert len(s.micro_drift_ranges) == s.micro_drift_run_count == 1
    assert s.repaired_ranges == s.micro_drift_repaired_ranges and s.repaired_ranges[0]["mode"] == "micro_drift_local_realign"
    assert own.tokens.a.tolist() == sorted(own.tokens.a.tolist()) and len(own.tokens) == len(TEXT)


def test_a_repair_must_be_good_or_better_by_enough():
    assert repair.improves(0.7, 0.6) and repair.improves(2.0, 0.9) and not repair.improves(1.0, 0.7) and not repair.improves(0.0, 0.7)


def checked(monkeypatch, own, found, again, answer):
    states = iter([found, again])
    monkeypatch.setattr(own, "_drifted", lambda probes: next(states))
    monkeypatch.setattr(own, "ask", lambda r, paddings=(): answer(r))
    return own.repair_checkpoints()


def test_drift_beyond_the_sixth_range_is_no_review_case(monkeypatch):
    own = job()
    assert not checked(monkeypatch, own, [drift(i * 50, i * 50 + 40) for i in range(9)], [], lambda r: None)
    assert len(own.summary.drift_suspect_ranges) == 9
    assert len(own.summary.unresolved_drift_ranges) == len(own.summary.low_confidence_ranges) == 6


def test_repaired_drift_is_a_repair_and_what_still_drifts_says_so(monkeypatch):
    own = job()
    assert checked(monkeypatch, own, [drift(50, 90)], [drift(300, 340), drift(400, 440, "medium")], lambda r: line(r.a, r.b))
    s = own.summary
    assert s.repaired_ranges == s.drift_repaired_ranges and len(s.repaired_ranges) == 1
    assert [(x["start_char"], x["mode"]) for x in s.unresolved_drift_ranges] == [(300, "post_repair_drift")]
    assert "post_repair_drift" in s.unresolved_drift_ranges[0]["reasons"] and "post_repair_drift" in s.low_confidence_ranges[0]["reasons"]


def test_spans_that_were_repaired_are_not_unresolved_later(monkeypatch):
    own = job()
    checked(monkeypatch, own, [drift(50, 90)], [], lambda r: line(r.a, r.b))
    risk = drift(50, 90)
    monkeypatch.setattr(repair, "cue_risks", lambda *a, **k: [risk, replace(risk, a=51)])
    own.register_unresolved([Cue(0.0, 1.0, "x", 0, 1)])
    assert [x["start_char"] for x in own.summary.low_confidence_ranges] == [51]


def test_nothing_is_sorted_or_recorded_without_a_repair():
    own = job()
    own.tokens = own.tokens.take(np.arange(len(TEXT))[::-1])
    own.can_ask = False
    assert not own.repair_suspects() and own.tokens.a[0] == len(TEXT) - 1
    assert not own.repair_checkpoints() and not own.repair_micro([]) and own.summary.micro_drift_candidate_count == 0


def test_timelines_find_the_nearest_tokens():
    mixed = Timeline.of([*line(0, 3), *line(5, 9), *Timeline(["?"], [0.0], [0.0], [-1], [-1], [np.nan])])
    assert (mixed.before(5), mixed.before(0), mixed.after(3), mixed.after(9)) == (2, -1, 3, -1)
    assert (mixed.before(7), mixed.after(6), int(mixed.overlaps(2, 6).sum()), len(mixed.replaced(0, 9, line(0, 1)))) == (4, 4, 2, 2)
    assert mixed[len(mixed) - 1].a is None and mixed.rows()[-1]["confidence"] is None and mixed.by("a").text.tolist() == list(TEXT[0:3] + TEXT[5:9])


class Model:
    """Words of 0.5 s each, from the first one that the text begins with."""

    asked: list = []

    def align(self, path, text, language):
        self.asked.append((path, text, language))
        made = [{"word": w, "start": i * 0.5, "end": i * 0.5 + 0.4, "probability": 0.9} for i, w in enumerate(text.split())]
        return {"segments": [{"words": made}, {"text": "", "start": "x"}, {"text": "late", "start": 9.0, "end": 1.0}]}


def test_speech_models_align_scripts_and_clips():
    from cueloom.plans.aligner import clean, engine_language
    from cueloom.plans.speech import SpeechAligner, words

    cut = []
    own = SpeechAligner(Model, seconds=lambda path: 12.5, clip=lambda *args: cut.append(args) or args[1])
    line, duration, shown = own.align(clean("one *two* three"), engine_language("zh-TW"), "/audio/a.wav")
    assert (line.text.tolist(), duration, shown["segment_count"], shown["engine"]) == (["one", "two", "three"], 12.5, 3, "Model")
    assert Model.asked == [("/audio/a.wav", "one two three", "zh")]
    assert len(own.realign(clean("two three"), "en", 3.0, 8.0)) == 2 and cut[0][0] == "/audio/a.wav" and cut[0][2:] == (3.0, 8.0)
    assert [t.confidence for t in words({"segments": [{"text": "all", "start": 1, "end": 2}]})] == [None]
    with pytest.raises(ValueError):
        own.align(clean("x"), "en", None)
