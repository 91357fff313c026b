"""Token operators: generators, mapping, anomalies, runs, suspects, diagnostics, checkpoints.

TOKEN rows: script_id, ord, text, start, end, start_char, end_char, confidence. Scripts: script_id, display_text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.functions import charsets as C
from cueloom.functions.arrays import blank, codes, visible_before
from cueloom.functions.text import next_sentence_boundary, previous_sentence_boundary, visible_len
from cueloom.functions.timing import middle, nearest_rank, ranked
from cueloom.operators.intervals import highest, merge, union_of

LOW_CONFIDENCE, ZERO_SECONDS = 0.12, 0.02


def _w():
    """The rows of a script in order."""
    return Window.partitionBy("script_id").orderBy("start_char", "end_char", "start", "ord")


def _visible_chars(scripts: DataFrame, text: str = "display_text") -> DataFrame:
    """A row for each visible character: char_index (offset), ch, place (0, 1, ... among visible ones) and visible (how many there are)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for script_id, value in zip(batch.column("script_id").to_pylist(), batch.column("text"), strict=True):
                text_ = value.as_py() or ""
                there = np.flatnonzero(~blank(codes(text_)))
                for at in range(0, len(there), 8192):
                    own = there[at : at + 8192]
                    chars = pa.array([text_[i] for i in own], pa.string())
                    ids, all_ = pa.array([script_id] * len(own), pa.int64()), pa.array(np.full(len(own), len(there), np.int64))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(own.astype(np.int32)), chars, pa.array(np.arange(at, at + len(own), dtype=np.int32)), all_], names=["script_id", "char_index", "ch", "place", "visible"])

    plain = scripts.select(F.col("script_id").cast("long").alias("script_id"), F.col(text).cast("string").alias("text"))
    return plain.mapInArrow(run, "script_id long, char_index int, ch string, place int, visible long")


def synthetic(scripts: DataFrame) -> DataFrame:
    """One token per visible character of ``display_text``, evenly from start_time to end_time."""
    chars = _visible_chars(scripts).join(scripts.select("script_id", "start_time", "end_time"), "script_id")
    step = F.greatest(F.lit(0.1), F.col("end_time") - F.col("start_time")) / F.col("visible")
    return chars.select(
        "script_id",
        F.col("place").alias("ord"),
        F.col("ch").alias("text"),
        (F.col("start_time") + F.col("place") * step).alias("start"),
        (F.col("start_time") + (F.col("place") + 1) * step).alias("end"),
        F.col("char_index").alias("start_char"),
        (F.col("char_index") + 1).alias("end_char"),
        F.lit(None).cast("double").alias("confidence"),
    )


def interpolated(scripts: DataFrame, anchors: DataFrame) -> DataFrame:
    """One token per visible character, evenly between anchors (script_id, at, time), which rise in both."""
    w = Window.partitionBy("script_id").orderBy("at")
    segments = anchors.select("script_id", F.col("at").alias("seg"), "time", F.lead("at").over(w).alias("next_at"), F.lead("time").over(w).alias("next_time")).where("next_at IS NOT NULL")
    chars = _visible_chars(scripts)
    # The segment of a character is the last one that begins at or before it: a sorted union, no range join.
    both = chars.select("script_id", "char_index", "ch", F.lit(None).cast("struct<seg:int,time:double,next_at:int,next_time:double>").alias("s")).unionByName(
        segments.select("script_id", F.col("seg").cast("int").alias("char_index"), F.lit(None).cast("string").alias("ch"), F.struct(F.col("seg").cast("int").alias("seg"), "time", F.col("next_at").cast("int").alias("next_at"), "next_time").alias("s"))
    )
    order = Window.partitionBy("script_id").orderBy("char_index", F.col("ch").isNotNull().cast("int"))
    placed = both.withColumn("s", F.last("s", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("ch IS NOT NULL AND char_index < s.next_at")
    own = Window.partitionBy("script_id", "s.seg")
    i = F.row_number().over(own.orderBy("char_index")) - 1
    step = F.greatest(F.lit(0.1), F.col("s.next_time") - F.col("s.time")) / F.count("*").over(own)
    return placed.select("script_id", F.col("char_index").alias("start_char"), (F.col("char_index") + 1).alias("end_char"), F.col("ch").alias("text"), (F.col("s.time") + i * step).alias("start"), (F.col("s.time") + (i + 1) * step).alias("end"))


def map_concatenated(tokens: DataFrame) -> DataFrame:
    """Offsets of tokens whose texts, in order, make up the script without anything between them."""
    before = Window.partitionBy("script_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))
    return tokens.withColumn("start_char", start.cast("int")).withColumn("end_char", (start + F.length("text")).cast("int"))


def needs_mapping(tokens: DataFrame) -> DataFrame:
    """script_id and whether any of its tokens lacks an offset."""
    return tokens.groupBy("script_id").agg(F.bool_or(F.col("start_char").isNull() | F.col("end_char").isNull()).alias("needs_mapping"))


def align_map(scripts: DataFrame, text: str = "display_text") -> DataFrame:
    """The kept characters of the alignment text and where they come from: script_id, align_pos, ch, at."""
    chars = scripts.select("script_id", F.posexplode(F.split(F.col(text), "")).alias("at", "ch")).where((F.col("ch") != "") & ~F.col("ch").rlike(f"^{C.one_of(C.MARKDOWN_NOISE)}$"))
    w = Window.partitionBy("script_id").orderBy("at")
    blank = F.col("ch").rlike(f"^{C.WS}$")
    kept = chars.withColumn("blank", blank).withColumn("before", F.lag("blank").over(w)).where("NOT blank OR NOT before")
    last = F.max(F.when(~F.col("blank"), F.col("at"))).over(Window.partitionBy("script_id"))
    kept = kept.withColumn("last", last).where("at <= last")
    return kept.select("script_id", (F.row_number().over(w) - 1).alias("align_pos"), F.when(F.col("blank"), " ").otherwise(F.col("ch")).alias("ch"), "at")


def _span(text: str, start: Column, end: Column) -> Column:
    return visible_len(F.substring(F.col(text), start + 1, F.greatest(end - start, F.lit(0))))


STEP = {
    "script_id": pa.int64(), "ord": pa.int64(), "place": pa.int32(), "start": pa.float64(), "end": pa.float64(), "start_char": pa.int32(), "end_char": pa.int32(), "confidence": pa.float64(),
    "vis_start": pa.int32(), "vis_end": pa.int32(), "vis_total": pa.int32(), "text_length": pa.int32(), "audio_duration": pa.float64(), "prev_end_char": pa.int32(),
    "step_chars": pa.int32(), "step_seconds": pa.float64(), "reversal": pa.bool_(), "jump": pa.bool_(), "spike": pa.bool_(),
}
_DDL = {pa.int64(): "long", pa.int32(): "int", pa.float64(): "double", pa.bool_(): "boolean"}


def steps(tokens: DataFrame, scripts: DataFrame) -> DataFrame:
    """Mapped tokens in order with their step from the one before: visible chars, seconds, and which rules they break.

    A script's tokens meet its text once, as arrays, and come back as rows: no row for each character, and no window. The first token's
    step is null and breaks no rule.
    """
    fields = ("start_char", "end_char", "start", "ord", "end", "confidence")
    there = tokens.where("start_char IS NOT NULL AND end_char IS NOT NULL")
    gathered = there.groupBy("script_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("t")).select("script_id", *[F.col(f"t.{c}").alias(c) for c in fields])
    duration = "audio_duration" if "audio_duration" in scripts.columns else F.lit(None).cast("double").alias("audio_duration")
    joined = gathered.join(scripts.select("script_id", "display_text", "max_cps", duration), "script_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                one = batch.slice(r, 1)
                own = {c: one.column(c)[0].values.to_numpy(zero_copy_only=False) for c in fields}
                text, cps = one.column("display_text")[0].as_py(), one.column("max_cps")[0].as_py()
                seen = visible_before(codes(text))
                a, b = (np.minimum(own[c], len(text)) for c in ("start_char", "end_char"))
                start, end, n = own["start"], own["end"], len(a)
                chars = np.maximum(0, np.diff(seen[b]))
                seconds = start[1:] - np.maximum(end[:-1], start[:-1])
                speed = chars / np.maximum(seconds, 0.02)
                first = np.arange(n) == 0
                later = lambda x, fill=0: np.append(np.array([fill], dtype=x.dtype), x)
                columns = {
                    "script_id": np.full(n, one.column("script_id")[0].as_py()), "place": np.arange(1, n + 1), **own,
                    "vis_start": seen[a], "vis_end": seen[b], "vis_total": np.full(n, seen[-1]), "text_length": np.full(n, len(text)),
                    "reversal": later((start[1:] < start[:-1] - 0.12) | (end[1:] < end[:-1] - 0.12)),
                    "jump": later((chars > 0) & (seconds > 6.0) & ((chars <= 24) | (speed < 1.25))),
                    "spike": later((chars >= 8) & (speed > max(cps * 2.8, 28.0))),
                }
                only_later = {"prev_end_char": later(own["end_char"][:-1]), "step_chars": later(chars), "step_seconds": later(seconds)}
                for at in range(0, n, 8192):
                    cut = slice(at, at + 8192)
                    whole = {c: pa.array(x[cut], STEP[c], from_pandas=c == "confidence") for c, x in columns.items()}
                    whole |= {c: pa.array(x[cut], STEP[c], mask=first[cut]) for c, x in only_later.items()}
                    whole["audio_duration"] = pa.array([one.column("audio_duration")[0].as_py()] * len(whole["place"]), pa.float64())
                    yield pa.RecordBatch.from_arrays([whole[c] for c in STEP], names=list(STEP))

    return joined.mapInArrow(run, ", ".join(f"{c} {_DDL[kind]}" for c, kind in STEP.items()))


def _advancing(tokens: DataFrame, scripts: DataFrame) -> DataFrame:
    """The steps that go on in the script, by script: what suspects are found in."""
    return steps(tokens, scripts).where("end_char > prev_end_char")


def anomalies(tokens: DataFrame, scripts: DataFrame) -> DataFrame:
    """Raw suspect spans of pairs of tokens: reversals, jumps, spikes. Pairs that don't advance are passed over."""
    return _anomalies(_advancing(tokens, scripts))


def _anomalies(s: DataFrame) -> DataFrame:
    reason = F.when(F.col("reversal"), "time_reversal").when(F.col("jump"), "timestamp_jump").when(F.col("spike"), "cps_spike")
    start = F.when(F.col("reversal"), F.greatest(F.lit(0), F.col("prev_end_char") - 1)).otherwise(F.col("prev_end_char"))
    found = s.withColumn("reason", reason).where("reason IS NOT NULL")
    return found.select("script_id", "place", start.alias("start_char"), "end_char", "reason", F.when(F.col("reason") == "cps_spike", "medium").otherwise("high").alias("severity"))


def _run_rules() -> dict[str, tuple[Column, int]]:
    """The test of each kind of run, and how many visible characters it must have."""
    return {
        "low_confidence_run": (F.col("confidence") < LOW_CONFIDENCE, 18),
        "zero_duration_run": (F.greatest(F.lit(0.0), F.col("end") - F.col("start")) <= ZERO_SECONDS, 20),
    }


def runs(tokens: DataFrame, scripts: DataFrame, kind: str) -> DataFrame:
    """Runs of "low_confidence_run" or "zero_duration_run" tokens that are long enough; the first token of a script is in none."""
    return _runs(_advancing(tokens, scripts), kind)


def _runs(s: DataFrame, kind: str) -> DataFrame:
    test, least = _run_rules()[kind]
    test = F.coalesce(test, F.lit(False))
    w = Window.partitionBy("script_id").orderBy("place")
    islands = s.withColumn("hit", test).withColumn("island", F.sum((~F.col("hit")).cast("int")).over(w)).where("hit")
    size = (F.max("vis_end") - F.min("vis_start")).alias("size")
    spans = islands.groupBy("script_id", "island").agg(F.min("place").alias("place"), F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char"), size)
    return spans.where(F.col("size") >= least).select("script_id", "place", "start_char", "end_char", F.lit(kind).alias("reason"), F.lit("medium").alias("severity"))


def _collapses() -> Column:
    """Whether a token starts at the audio's end with 80 or more visible characters left."""
    return (F.col("start") >= F.col("audio_duration") - 0.5) & (F.col("vis_total") - F.col("vis_start") >= 80)


def end_collapse(tokens: DataFrame, scripts: DataFrame) -> DataFrame:
    """The first token that starts at the audio's end with 80 or more visible characters left, and its place."""
    late = _advancing(tokens, scripts).where(_collapses())
    first = late.groupBy("script_id").agg(F.min_by(F.struct("place", "start_char", F.col("text_length").alias("end_char")), "place").alias("f"))
    return first.select("script_id", "f.place", "f.start_char", "f.end_char", F.lit("end_collapse").alias("reason"), F.lit("high").alias("severity"))


def raw_suspects(tokens: DataFrame, scripts: DataFrame) -> DataFrame:
    """All raw suspect spans; nothing that begins after an end collapse. Every rule reads the same steps in one pass.

    A step gives an entry for each rule that it breaks; those of a run share the number of steps outside it so far, by which they
    are put together, and single ones have their place.
    """
    w = Window.partitionBy("script_id").orderBy("place")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    seen = _advancing(tokens, scripts).withColumn("stop", F.min(F.when(_collapses(), F.col("place"))).over(so_far)).where("stop IS NULL OR place <= stop")
    tests = {kind: F.coalesce(test, F.lit(False)) for kind, (test, _) in _run_rules().items()}
    named = seen.withColumns({kind: test for kind, test in tests.items()})
    numbered = named.withColumns({f"{kind}_number": F.sum((~F.col(kind)).cast("int")).over(w) for kind in tests})

    def entry(reason: Column, key: Column, start: Column, end: Column, severity: Column) -> Column:
        return F.struct(reason.alias("reason"), key.cast("long").alias("key"), start.cast("int").alias("start_char"), end.cast("int").alias("end_char"), severity.alias("severity"))

    step = F.when(F.col("reversal"), "time_reversal").when(F.col("jump"), "timestamp_jump").when(F.col("spike"), "cps_spike")
    begins = F.when(F.col("reversal"), F.greatest(F.lit(0), F.col("prev_end_char") - 1)).otherwise(F.col("prev_end_char"))
    found = [
        F.when(step.isNotNull(), entry(step, F.col("place"), begins, F.col("end_char"), F.when(F.col("reversal") | F.col("jump"), "high").otherwise("medium"))),
        F.when(F.col("place") == F.col("stop"), entry(F.lit("end_collapse"), F.col("place"), F.col("start_char"), F.col("text_length"), F.lit("high"))),
        *[F.when(F.col(kind), entry(F.lit(kind), F.col(f"{kind}_number"), F.col("start_char"), F.col("end_char"), F.lit("medium"))) for kind in tests],
    ]
    entries = numbered.select("script_id", "place", "vis_start", "vis_end", F.explode(F.array_compact(F.array(*found))).alias("e")).select("script_id", "place", "vis_start", "vis_end", "e.*")
    spans = entries.groupBy("script_id", "reason", "key").agg(
        F.min("place").alias("place"), F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char"), F.max("severity").alias("severity"), (F.max("vis_end") - F.min("vis_start")).alias("size")
    )
    least = reduce(lambda done, kind: done.when(F.col("reason") == kind, _run_rules()[kind][1]), tests, F).otherwise(-(1 << 30))
    return spans.where(F.col("size") >= least).select("script_id", "place", "start_char", "end_char", "reason", "severity")


def suspects(tokens: DataFrame, scripts: DataFrame) -> DataFrame:
    """Raw suspects grown to sentences and merged where at most 240 characters lie between."""
    text = F.col("display_text")
    grown = raw_suspects(tokens, scripts).where("end_char > start_char").join(scripts.select("script_id", "display_text"), "script_id")
    grown = grown.select(
        "script_id",
        previous_sentence_boundary(text, F.col("start_char"), F.lit(90)).alias("start_char"),
        next_sentence_boundary(text, F.col("end_char"), F.lit(140)).alias("end_char"),
        F.array("reason").alias("reasons"),
        "severity",
    )
    return merge(
        grown, "start_char", "end_char", 240,
        [F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char"), union_of("reasons").alias("reasons"), highest("severity").alias("severity")],
        ["end_char"],
    )


def diagnostics(tokens: DataFrame, scripts: DataFrame) -> DataFrame:
    """The state of each script's token timeline: counts, coverage, gaps and end collapse, unrounded."""
    s = steps(tokens, scripts)
    rest = F.col("vis_total") - F.col("vis_start")
    own = F.greatest(F.lit(0), F.col("vis_end") - F.col("vis_start"))
    low = F.coalesce(F.col("confidence") < LOW_CONFIDENCE, F.lit(False))
    sums = s.groupBy("script_id").agg(
        F.count("*").alias("mapped_token_count"),
        F.min_by("start", "place").alias("first_token_time"),
        F.max_by("end", "place").alias("last_token_time"),
        F.count_if("reversal").alias("time_reversal_count"),
        F.count_if(F.greatest(F.lit(0.0), F.col("end") - F.col("start")) <= ZERO_SECONDS).alias("zero_duration_count"),
        F.count_if(low).alias("low_confidence_token_count"),
        F.sum(F.when(low, own).otherwise(0)).alias("low_confidence_visible_chars"),
        F.count_if("jump").alias("timestamp_jump_count"),
        F.count_if(F.col("spike")).alias("cps_spike_count"),
        F.greatest(F.lit(0.0), F.coalesce(F.max("step_seconds"), F.lit(0.0))).alias("max_token_gap_seconds"),
        F.coalesce(F.min_by(F.when(F.col("start") >= F.col("audio_duration") - 0.5, rest), F.when(F.col("start") >= F.col("audio_duration") - 0.5, F.col("place"))), F.lit(0)).alias("end_collapse_visible_chars"),
    )
    # Coverage: merged spans count each position once.
    total = F.max("vis_total").alias("total")
    spans = merge(
        s.withColumn("from_char", F.col("start_char")), "from_char", "end_char", 0,
        [(F.max("vis_end") - F.min("vis_start")).alias("seen"), total], ["end_char"],
    )
    covered = spans.groupBy("script_id").agg((F.sum("seen") / F.greatest(F.lit(1), F.max("total"))).alias("text_coverage_ratio"))
    counts = tokens.groupBy("script_id").agg(F.count("*").alias("token_count"))
    joined = counts.join(sums, "script_id", "left").join(covered, "script_id", "left")
    return joined.withColumn("text_coverage_ratio", F.coalesce("text_coverage_ratio", F.lit(0.0))).fillna(0, ["mapped_token_count", "time_reversal_count"])


def drift_runs(samples: DataFrame, scripts: DataFrame) -> DataFrame:
    """The strongest run of drifting samples (script_id, start_char, end_char, signed_drift) of each script.

    A run goes on while samples drift by 0.65 s or more, with one sign, and begin at most 4 characters after the
    greatest end of accepted samples so far.
    """
    w = Window.partitionBy("script_id").orderBy("start_char", "end_char")
    accepted = F.abs("signed_drift") >= 0.65
    sign = F.when(F.col("signed_drift") >= 0, 1).otherwise(-1)
    so_far = F.max(F.when(F.col("hit"), F.col("end_char"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    breaks = F.coalesce(~F.lag("hit").over(w) | (F.lag("sign").over(w) != F.col("sign")) | (F.col("start_char") > so_far + 4), F.lit(True))
    marked = samples.withColumn("hit", accepted).withColumn("sign", sign).withColumn("_new", breaks.cast("int"))
    grouped = marked.withColumn("run", F.sum("_new").over(w)).where("hit").groupBy("script_id", "run")
    size = F.abs("signed_drift")
    stats = grouped.agg(
        F.min("start_char").alias("start_char"),
        F.max("end_char").alias("end_char"),
        F.count("*").alias("sample_count"),
        F.median(size).alias("median_drift"),
        nearest_rank(F.collect_list(size), 0.75).alias("p75_drift"),
        F.max(size).alias("max_drift"),
        F.median("signed_drift").alias("signed_median_drift"),
    ).join(scripts.select("script_id", "display_text"), "script_id")
    stats = stats.withColumn("visible_chars", _span("display_text", F.col("start_char"), F.col("end_char"))).drop("display_text")
    stats = stats.where("sample_count >= 6 AND visible_chars >= 12 AND (median_drift >= 0.75 OR p75_drift >= 1.05)")
    score = F.col("median_drift") * 2 + F.col("p75_drift") + F.least(F.lit(2.0), F.col("visible_chars") / 24)
    best = Window.partitionBy("script_id").orderBy(F.round("score", 9).desc(), "start_char", "run")
    return stats.withColumn("score", score).withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r", "run")


def checkpoint_severity(median: Column, p95: Column) -> Column:
    return (
        F.when((median >= 1.0) | ((p95 >= 1.5) & (median >= 0.35)), "high")
        .when((median >= 0.75) | ((p95 >= 1.25) & (median >= 0.25)), "medium")
        .otherwise("ok")
    )


def checkpoint_stats(samples: DataFrame, by: str = "checkpoint") -> DataFrame:
    """Drift statistics of each checkpoint with at least 4 samples, and its severity.

    All of them come from one sorted list of the samples; the list of signed ones is only made where its median is asked for.
    """
    stats = samples.groupBy("script_id", by).agg(
        F.count("*").alias("sample_count"),
        F.sort_array(F.collect_list("abs_drift")).alias("_sizes"),
        F.sort_array(F.collect_list("signed_drift")).alias("_signed"),
    )
    stats = stats.select(
        "script_id", by, "sample_count",
        middle("_sizes").alias("median_drift"),
        ranked("_sizes", 0.95).alias("p95_drift"),
        F.element_at("_sizes", -1).alias("max_drift"),
        middle("_signed").alias("signed_median_drift"),
    )
    kept = stats.where("sample_count >= 4")
    return kept.withColumn("severity", checkpoint_severity(F.col("median_drift"), F.col("p95_drift"))).withColumn("direction", F.when(F.col("signed_median_drift") >= 0, 1).otherwise(-1))


def checkpoint_summary(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.groupBy("script_id").agg(
        F.count("*").alias("verified_checkpoint_count"),
        F.count_if(F.col("severity") != "ok").alias("checkpoint_drift_count"),
        F.max("max_drift").alias("max_checkpoint_drift_seconds"),
        nearest_rank(F.collect_list("max_drift"), 0.95).alias("p95_checkpoint_drift_seconds"),
    )


def flatten_result(results: DataFrame) -> DataFrame:
    """TOKEN rows of aligner results (script_id, segments): words, or the segment itself where it has none."""
    segments = results.select("script_id", F.posexplode("segments").alias("seg", "s"))
    word = F.struct(F.col("s.text").alias("word"), F.lit(None).cast("string").alias("text"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.lit(None).cast("double").alias("probability"))
    words = F.when(F.size(F.coalesce("s.words", F.array())) > 0, F.col("s.words")).otherwise(F.array(word))
    flat = segments.select("script_id", "seg", F.posexplode(words).alias("pos", "w"))
    text = F.coalesce(F.when(F.col("w.word") != "", F.col("w.word")), F.col("w.text"), F.lit(""))
    start, end = F.coalesce(F.col("w.start").cast("double"), F.lit(0.0)), F.coalesce(F.col("w.end").cast("double"), F.lit(0.0))
    kept = flat.select("script_id", "seg", "pos", text.alias("text"), start.alias("start"), end.alias("end"), F.col("w.probability").cast("double").alias("confidence"))
    kept = kept.where((F.regexp_replace("text", f"{C.WS}+", "") != "") & (F.col("end") >= F.col("start")))
    order = Window.partitionBy("script_id").orderBy("seg", "pos")
    return kept.select("script_id", (F.row_number().over(order) - 1).alias("ord"), "text", "start", "end", "confidence")
