"""The files of a job: what they hold, one set for each script."""

import json
import math

from cueloom.functions.profiles import profiles
from cueloom.plans.aligner import SteadyAligner
from cueloom.plans.job import align_scripts, cue_rows, reports
from cueloom.sources import sinks


class Telling(SteadyAligner):
    def align(self, script, language, audio):
        return (*super().align(script, language, audio), {"engine": "steady", "language": language})


def test_files_of_each_script(spark, tmp_path):
    rows = [(1, "en", "standard", "One **two** three. Four five six seven, eight nine."), (2, "zh-TW", "standard", "他说“好”。" * 12), (3, "fr", "standard", "non")]
    done = align_scripts(spark.createDataFrame(rows, "script_id long, language string, profile string, script_text string"), Telling(step=0.1)).cache()
    sinks.write_outputs(done, cue_rows(done), reports(done, profiles(spark)), str(tmp_path), files=True)
    folder = tmp_path / "scripts"
    assert sorted(p.name for p in folder.iterdir()) == ["1", "2"]
    assert sorted(p.name for p in (folder / "1").iterdir()) == ["alignment.json", "output.srt", "output.vtt", "quality_report.json"]
    assert (folder / "1" / "output.srt").read_text(encoding="utf-8").startswith("1\n00:00:00,000 --> ")
    assert (folder / "2" / "output.vtt").read_text(encoding="utf-8").startswith("WEBVTT\n\n")

    one, two = (json.loads((folder / s / "alignment.json").read_text(encoding="utf-8")) for s in "12")
    keys = {"language", "subtitle_profile", "audio_duration", "display_text_length", "align_text_length", "timeline_diagnostics", "token_diagnostics", "cue_diagnostics", "engine_result", "tokens", "cues"}
    assert set(one) == keys and set(two) == keys
    assert (one["display_text_length"], one["align_text_length"], len(one["tokens"])) == (51, 47, 43) and two["engine_result"] == {"engine": "steady", "language": "zh"}
    assert set(one["tokens"][0]) == {"text", "start", "end", "start_char", "end_char", "confidence"} and one["tokens"][0]["confidence"] == 0.9
    for states in (one["token_diagnostics"], one["cue_diagnostics"]):
        assert set(states) == {"before_repair", "after_repair"}
    assert one["token_diagnostics"]["after_repair"]["text_coverage_ratio"] == 1.0 and one["cue_diagnostics"]["after_repair"]["cue_count"] == len(one["cues"])
    assert [c["index"] for c in two["cues"]] == list(range(1, len(two["cues"]) + 1))

    report = json.loads((folder / "2" / "quality_report.json").read_text(encoding="utf-8"))
    numbers = [v for k, v in report.items() if isinstance(v, float) and k != "audio_duration"]
    assert numbers and all(math.isclose(v, round(v, 3), abs_tol=1e-12) for v in numbers)
