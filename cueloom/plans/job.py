"""From a table of scripts to cues, reports and repairs: one grouped kernel per script, everything around it in DataFrames."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueloom.functions import charsets as C
from cueloom.functions.profiles import InputError, Profile, resolve
from cueloom.functions.text import normalize_compare
from cueloom.operators.cues import quality, with_profile
from cueloom.plans.aligner import Aligner, clean, engine_language, mapped
from cueloom.plans.diagnostics import cue_state, token_state
from cueloom.plans.repair import Job, Summary, cue_risks
from cueloom.plans.script import Cue, Script
from cueloom.plans.splitting import finalize, split
from cueloom.plans.tail import repair_tail
from cueloom.plans.timeline import Timeline

_CUE = {"idx": pa.int32(), "start": pa.float64(), "end": pa.float64(), "text": pa.string(), "start_char": pa.int32(), "end_char": pa.int32(), "warnings": pa.list_(pa.string())}
_TOKEN = {"text": pa.string(), "start": pa.float64(), "end": pa.float64(), "start_char": pa.int32(), "end_char": pa.int32(), "confidence": pa.float64()}
_RESULT = {
    "script_id": pa.int64(), "language": pa.string(), "profile": pa.string(), "display_text": pa.string(), "align_text_length": pa.int32(), "audio_duration": pa.float64(),
    "error_class": pa.string(), "error": pa.string(), "cues": pa.list_(pa.struct(list(_CUE.items()))), "timeline": pa.string(), "tail_repair": pa.string(),
    "timeline_status": pa.string(), "timeline_score": pa.int32(), "token_diagnostics": pa.string(), "cue_diagnostics": pa.string(), "engine_result": pa.string(),
    "tokens": pa.list_(pa.struct(list(_TOKEN.items()))),
}


def _ddl(kind: pa.DataType) -> str:
    """The name of an Arrow type in a Spark schema."""
    if pa.types.is_list(kind):
        return f"array<{_ddl(kind.value_type)}>"
    if pa.types.is_struct(kind):
        return f"struct<{', '.join(f'{f.name}: {_ddl(f.type)}' for f in kind)}>"
    return {pa.int64(): "long", pa.int32(): "int", pa.float64(): "double", pa.string(): "string"}[kind]


CUE_ROW = {"script_id": pa.int64(), "language": pa.string(), "profile": pa.string()} | _CUE
CUE = ", ".join(f"{name} {_ddl(kind)}" for name, kind in CUE_ROW.items())
RESULT = ", ".join(f"{name} {_ddl(kind)}" for name, kind in _RESULT.items())


@dataclass
class Done:
    """One script's cues after all repairs, and what was done and seen on the way."""

    cues: list[Cue]
    tokens: Timeline
    summary: Summary
    tail: dict | None
    token_states: dict
    cue_states: dict

    def __iter__(self):
        return iter((self.cues, self.tokens, self.summary, self.tail))


def repaired(script: Script, tokens: Timeline, duration: float | None, p: Profile, aligner: Aligner) -> Done:
    """Cues of one script after all repairs that its language has."""
    job = Job(script, tokens, duration, p, aligner)
    before = token_state(script, job.tokens, duration, p)
    changed = job.repair_suspects()
    changed |= job.repair_checkpoints()
    cues = split(script, job.tokens, p)
    cues_before = cue_state(script, cues, p)
    for _ in range(3):
        if not any(r.severity == "high" for r in cue_risks(cues, script, duration, p)) or not job.repair_cue_risks(cues):
            break
        cues, changed = split(script, job.tokens, p), True
    if job.repair_micro(cues):
        cues, changed = split(script, job.tokens, p), True
    cues, tail = repair_tail(cues, script, job.tokens, duration, p)
    cues = finalize(cues, script, p)
    if tail:
        job.summary.low_confidence_ranges.append(tail | {"mode": tail["mode"], "confidence": "low"})
        job.summary.forced_review = True
    job.register_unresolved(cues)
    after = token_state(script, job.tokens, duration, p) if changed else before
    return Done(cues, job.tokens, job.summary, tail, {"before_repair": before, "after_repair": after}, {"before_repair": cues_before, "after_repair": cue_state(script, cues, p)})


def align_scripts(scripts: DataFrame, aligner: Aligner, keep_punctuation: bool = True, limits: dict | None = None, with_tokens: bool = True) -> DataFrame:
    """One row per script (script_id, language, profile, script_text[, audio]): cues, tokens, timeline, diagnostics and error.

    ``limits`` overrides min_duration, max_duration and line_chars of the profile; ``keep_punctuation`` only changes the text that is aligned.
    Without ``with_tokens`` the tokens stay in the workers, for results that do not write them.

    A script that fails gives a row with its error and no cues; it never fails the batch.
    """
    text = F.col("script_text").cast("string").alias("script_text")
    own = scripts.select(F.col("script_id").cast("long").alias("script_id"), "language", "profile", text, *(["audio"] if "audio" in scripts.columns else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 16):
                done = [_one(row, aligner, keep_punctuation, limits or {}) for row in batch.slice(at, 16).to_pylist()]
                lines = [row.pop("tokens") if with_tokens else None for row in done]
                columns = [pa.array([row.get(c) for row in done], kind) for c, kind in _RESULT.items() if c != "tokens"]
                yield pa.RecordBatch.from_arrays([*columns, _token_lists(lines)], schema=pa.schema(list(_RESULT.items())))

    return own.mapInArrow(run, RESULT)


def _token_lists(lines: list[Timeline | None]) -> pa.Array:
    """A list of token structs for each timeline; null for none."""
    there = [line for line in lines if line is not None]
    whole = Timeline.joined(*there) if there else Timeline.of([])
    offsets = np.append(0, np.cumsum([0 if line is None else len(line) for line in lines]))
    place = lambda x: pa.array(x.astype(np.int32), mask=x < 0)
    values = [pa.array(whole.text, pa.string()), pa.array(whole.start), pa.array(whole.end), place(whole.a), place(whole.b), pa.array(whole.confidence, mask=np.isnan(whole.confidence))]
    starts = pa.array(offsets, pa.int32(), mask=np.append([line is None for line in lines], False).astype(bool))
    return pa.ListArray.from_arrays(starts, pa.StructArray.from_arrays(values, fields=list(pa.struct(list(_TOKEN.items())))))


def _one(row: dict, aligner: Aligner, keep_punctuation: bool, limits: dict) -> dict:
    out = {k: row[k] for k in ("script_id", "language", "profile")} | {"cues": [], "tokens": None}
    try:
        p = resolve(row["profile"], row["language"], **limits)
        text = clean(row["script_text"], keep_punctuation)
        if text is None:
            raise InputError("the script is blank")
        tokens, duration, *raw = aligner.align(text, engine_language(p.language), row.get("audio"))
        script = Script(text.display, p.language)
        done = repaired(script, mapped(tokens, text), duration, p, aligner)
        plain = lambda x: json.dumps(x, ensure_ascii=False)
        shown = [{"idx": i, "start": c.start, "end": c.end, "text": c.text, "start_char": c.a, "end_char": c.b, "warnings": c.warnings} for i, c in enumerate(done.cues, 1)]
        out |= {"display_text": text.display, "align_text_length": len(text.align), "audio_duration": duration, "cues": shown, "tokens": done.tokens}
        out |= {"timeline": plain(done.summary.payload()), "tail_repair": plain(done.tail) if done.tail else None, "engine_result": plain(raw[0]) if raw else None}
        out |= {"token_diagnostics": plain(done.token_states), "cue_diagnostics": plain(done.cue_states), "timeline_status": done.summary.status, "timeline_score": done.summary.score}
    except Exception as error:  # kept in the row, so that one script never fails the batch
        out |= {"error_class": type(error).__name__, "error": str(error)}
    return out


def cue_batch(found: list[tuple[dict, list[Cue]]]) -> pa.RecordBatch:
    """CUE rows of scripts (with script_id, language and profile) and their cues."""
    rows = [(own["script_id"], own["language"], own["profile"], i, c.start, c.end, c.text, c.a, c.b, c.warnings) for own, cues in found for i, c in enumerate(cues, 1)]
    columns = list(zip(*rows, strict=True)) or [()] * len(CUE_ROW)
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, CUE_ROW.values(), strict=True)], names=list(CUE_ROW))


def split_table(scripts: DataFrame, tokens: DataFrame) -> DataFrame:
    """CUE rows for scripts (script_id, language, profile, display_text) and their mapped tokens: one kernel per script.

    A script's tokens travel as one array for each column, which the kernel reads without making a token object.
    """
    fields = ("start", "end", "start_char", "end_char", "confidence")
    ordered = F.array_sort(F.collect_list(F.struct("ord", *fields)))
    gathered = tokens.groupBy("script_id").agg(ordered.alias("t")).select("script_id", *[F.col(f"t.{c}").alias(f"token_{c}") for c in fields])
    joined = scripts.select("script_id", "language", "profile", "display_text").join(gathered, "script_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                found = []
                for r, own in enumerate(part.select(["script_id", "language", "profile", "display_text"]).to_pylist()):
                    start, end, a, b, confidence = (part.column(f"token_{c}")[r].values.to_numpy(zero_copy_only=False) for c in fields)
                    line = Timeline(np.full(len(start), "", dtype=object), start, end, a, b, confidence)
                    found.append((own, split(Script(own["display_text"], own["language"]), line, resolve(own["profile"], own["language"]))))
                yield cue_batch(found)

    return joined.mapInArrow(run, CUE)


def cue_rows(results: DataFrame) -> DataFrame:
    """CUE rows of ``align_scripts``'s result."""
    return results.select("script_id", "language", "profile", F.explode("cues").alias("c")).select("script_id", "language", "profile", "c.*")


def reports(results: DataFrame, profiles: DataFrame) -> DataFrame:
    """The quality report of each script with the timeline's verdict applied: a capped score and its warnings; seconds, speeds and ratios have 3 decimals."""
    scripts = results.where("error_class IS NULL").select("script_id", "display_text", "audio_duration", "timeline", "tail_repair", "timeline_status", "timeline_score")
    scripts = scripts.withColumn("compare_text", normalize_compare(F.col("display_text")))
    report = quality(with_profile(cue_rows(results), profiles), scripts).join(scripts.drop("compare_text", "display_text"), "script_id")
    listed = lambda name: F.size(F.from_json(F.get_json_object("timeline", f"$.{name}"), "array<string>")) > 0
    review = F.array_compact(F.array(
        F.when(listed("unresolved_drift_ranges"), C.REVIEW_WARNINGS["drift"]),
        F.when(listed("micro_drift_unresolved_ranges"), C.REVIEW_WARNINGS["micro"]),
        F.when(listed("low_confidence_ranges"), C.REVIEW_WARNINGS["low"]),
    ))
    drifted = F.get_json_object("timeline", "$.checkpoint_drift_count").cast("int") > 0
    status = F.col("timeline_status")
    cap = F.when(status == "needs_review", 75).when(status == "repaired", 95).when(drifted, 90).otherwise(100)
    report = report.withColumns({c: F.bround(c, 3) for c, kind in report.dtypes if kind == "double" and c != "audio_duration"})
    return report.withColumn("quality_score", F.least("quality_score", cap)).withColumn("warnings", F.when(status == "needs_review", F.array_union("warnings", review)).otherwise(F.col("warnings")))
