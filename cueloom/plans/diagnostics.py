"""The state of one script's tokens and cues, as the alignment file reports it."""

from __future__ import annotations

import numpy as np

from cueloom.functions import charsets as C
from cueloom.functions.profiles import Profile
from cueloom.plans.repair import cue_risks, rules
from cueloom.plans.script import Cue, Script
from cueloom.plans.timeline import Timeline


def token_state(script: Script, tokens: Timeline, duration: float | None, p: Profile) -> dict:
    """Counts, coverage, gaps and end collapse of a token timeline."""
    line = tokens.by("a", "b", "start")
    counts = ("time_reversal_count", "zero_duration_count", "low_confidence_token_count", "timestamp_jump_count", "cps_spike_count")
    state = {"token_count": len(tokens), "mapped_token_count": len(line), "text_coverage_ratio": 0.0, **dict.fromkeys(counts, 0), "max_token_gap_seconds": 0.0, "end_collapse_visible_chars": 0}
    if not len(line):
        return state
    a, b = np.clip(line.a, 0, script.n), np.clip(line.b, 0, script.n)
    seen = np.maximum(0, script.visible[b] - script.visible[a])
    depth = np.zeros(script.n + 1, dtype=np.int64)
    np.add.at(depth, a, 1)
    np.add.at(depth, np.maximum(a, b), -1)
    covered = int(np.diff(script.visible)[np.cumsum(depth)[:-1] > 0].sum())
    low = line.confidence < 0.12
    broken = rules(script, line, p)
    late = np.flatnonzero(line.start >= duration - 0.5) if duration else ()
    return state | {
        "first_token_time": round(float(line.start[0]), 3),
        "last_token_time": round(float(line.end[-1]), 3),
        "text_coverage_ratio": round(covered / max(1, int(script.visible[-1])), 6),
        "time_reversal_count": int(broken["time_reversal"].sum()),
        "zero_duration_count": int((np.maximum(0.0, line.end - line.start) <= 0.02).sum()),
        "low_confidence_token_count": int(low.sum()),
        "low_confidence_visible_chars": int(seen[low].sum()),
        "timestamp_jump_count": int(broken["timestamp_jump"].sum()),
        "cps_spike_count": int(broken["cps_spike"].sum()),
        "max_token_gap_seconds": round(max(0.0, float(broken["seconds"].max(initial=0.0))), 3),
        "end_collapse_visible_chars": int(script.visible[-1] - script.visible[a[late[0]]]) if len(late) else 0,
    }


def cue_state(script: Script, cues: list[Cue], p: Profile) -> dict:
    """Counts and extremes of cues, and their risks."""
    gaps = np.array([y.start - x.end for x, y in zip(cues, cues[1:], strict=False)])
    risks = [r.payload() for r in cue_risks(cues, script, None, p)]
    own = {name: risks if p.lang_group == group else [] for name, group in (("zh", "cjk"), ("ko", "ko"))}
    return {
        "cue_count": len(cues),
        "max_gap_seconds": round(float(gaps.max()), 3) if len(gaps) else 0.0,
        "large_gap_count": int((gaps > C.LARGE_GAP).sum()),
        "max_chars_per_second": round(max((c.cps for c in cues), default=0.0), 3),
        "max_chars_per_cue": max((c.chars for c in cues), default=0),
        "overlap_count": int((gaps < 0).sum()),
        "cue_timeline_risk_count": len(risks),
        "cue_timeline_risks": risks,
        **{f"{name}_timeline_risk_count": len(found) for name, found in own.items()},
        **{f"{name}_timeline_risks": found for name, found in own.items()},
    }
