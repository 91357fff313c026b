"""Cue operators: diagnostics, risks, warnings, breaks and quality over a CUE table with its profile's columns.

Input rows: script_id, idx (1-based), start, end, text, start_char, end_char, and the columns of the profile dimension
(see ``with_profile``). Windows run by script in idx order; a neighbour is a lag or lead, never a self-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.functions import charsets as C
from cueloom.functions.boundary import high_risk
from cueloom.functions.text import has_natural_boundary, next_visible, previous_visible, visible_len
from cueloom.functions.timing import chars_per_second, nearest_rank
from cueloom.operators.intervals import highest, merge, union_of



def _w():
    """The rows of a script in order."""
    return Window.partitionBy("script_id").orderBy("idx")


def with_profile(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """``rows`` (with language and profile) and their limits; the dimension has 20 rows."""
    return rows.join(F.broadcast(profiles), ["language", "profile"])


def measured(cues: DataFrame) -> DataFrame:
    """Cues with duration, visible chars, cps, gaps to both neighbours and whether they are near the longest duration."""
    duration = F.greatest(F.lit(0.0), F.col("end") - F.col("start"))
    with_own = cues.withColumn("duration", duration).withColumn("chars", visible_len(F.col("text")))
    return (
        with_own.withColumn("cps", chars_per_second(F.col("chars"), F.col("duration")))
        .withColumn("gap_before", F.col("start") - F.lag("end").over(_w()))
        .withColumn("gap_after", F.lead("start").over(_w()) - F.col("end"))
        .withColumn("near_max", F.col("duration") >= F.col("max_duration") - C.NEAR_MAX)
    )


def unsafe_ends(cues: DataFrame, scripts: DataFrame) -> DataFrame:
    """Cues with ``unsafe_end``: a risky boundary at end_char of the script's ``display_text``; false for the last cue."""
    text, at = F.col("display_text"), F.col("end_char")
    # An exchange, so that the text's own expressions are not evaluated again for each cue; and the characters as columns
    # below the window, so that they are looked up once and not in each rule.
    joined = cues.join(scripts.select("script_id", "display_text").repartition("script_id"), "script_id")
    seen = joined.select(
        *cues.columns,
        previous_visible(text, at).alias("_prev"),
        next_visible(text, at).alias("_nxt"),
        F.when(at > 0, F.substring(text, at, F.lit(1))).otherwise("").alias("_left"),
        F.substring(text, at + 1, F.lit(1)).alias("_right"),
    )
    more = seen.withColumn("_more", F.lead("idx").over(_w()).isNotNull())
    risk = high_risk(F.col("lang_group"), F.col("_prev"), F.col("_nxt"), F.col("_left"), F.col("_right"))
    return more.withColumn("unsafe_end", risk & F.col("_more")).drop("_prev", "_nxt", "_left", "_right", "_more")


def warnings(cues: DataFrame) -> DataFrame:
    """Cues with their array of warnings, made anew."""
    m = measured(cues)
    made = F.array(
        F.when(F.col("duration") < F.col("min_duration"), "too_short"),
        F.when(F.col("duration") > F.col("timing_max") + C.EPSILON, "too_long"),
        F.when(F.col("cps") > F.col("max_cps"), "fast_reading"),
        F.when(F.col("chars") > F.col("total_chars"), "cue_too_long"),
        F.when(F.col("gap_before") < 0, "overlap"),
    )
    return m.withColumn("warnings", F.array_compact(made))


def clamp_timing(cues: DataFrame) -> DataFrame:
    """Starts at 0 or later, at least 0.1 s, ends before the next start less the gap where there is room, else at it."""
    start = F.greatest(F.lit(0.0), F.col("start"))
    end = F.greatest(start + 0.1, F.col("end"))
    following = F.lead("start").over(_w())
    wanted = following - F.col("gap_seconds")
    fixed = F.when((end > wanted) & (wanted > start + 0.1), wanted).when(end > following, following).otherwise(end)
    return cues.select(*[c for c in cues.columns if c not in ("start", "end")], start.alias("start"), fixed.alias("end"))


def severe(m: Column | None = None) -> Column:
    """A cue that can't be timed as it is."""
    crowded = F.col("chars") > F.col("total_chars")
    return (
        (F.col("duration") > F.col("severe_duration"))
        | (crowded & (F.col("duration") <= 0.5))
        | (crowded & (F.col("cps") > F.greatest(F.col("max_cps") * 4, F.lit(45.0))))
    )


def timeline_breaks(cues: DataFrame) -> DataFrame:
    """script_id, break_idx, start_idx and reason of the first break of each script that has one."""
    m = measured(cues)
    sparse = F.col("near_max") & (F.col("chars") < F.col("total_chars") * 0.65)
    before = F.coalesce(F.lag(sparse).over(_w()), F.lit(False))
    gap = F.col("gap_before")
    suspicious = F.coalesce((gap > F.greatest(F.lit(2.0), F.col("max_duration") * 0.45)) & (sparse | before), F.lit(False))
    large = F.coalesce(gap > F.col("severe_gap"), F.lit(False))
    overlap = F.coalesce(F.col("start") < F.lag("end").over(_w()) - 0.1, F.lit(False))
    text = lambda form, value: F.format_string(form, value)
    reason = (
        F.when(F.col("duration") > F.col("severe_duration"), text("cue_too_long:%.3fs", F.col("duration")))
        .when((F.col("chars") > F.col("total_chars")) & (F.col("duration") <= 0.5), text("cue_too_fast:%.3fcps", F.col("cps")))
        .when(severe(), text("cue_cps_spike:%.3fcps", F.col("cps")))
        .when(suspicious, text("suspicious_gap:%.3fs", gap))
        .when(large, text("large_gap:%.3fs", gap))
        .when(overlap, "overlap")
    )
    stretched = F.col("near_max") & (F.col("chars") < F.col("total_chars") * 0.75)
    weak = F.coalesce(stretched | (F.col("gap_after") > 0.8), F.lit(False))
    back = [F.coalesce(F.lag(weak, n).over(_w()), F.lit(False)) for n in (1, 2, 3)]
    steps = F.when(~back[0], 0).when(~back[1], 1).when(~back[2], 2).otherwise(3)
    flagged = m.withColumn("reason", reason).withColumn("start_idx", F.col("idx") - steps).withColumn("_n", F.count("*").over(Window.partitionBy("script_id")))
    broken = flagged.where("_n > 1 AND reason IS NOT NULL")
    first = F.min_by(F.struct("idx", "start_idx", "reason"), "idx")
    return broken.groupBy("script_id").agg(first.alias("b")).select("script_id", F.col("b.idx").alias("break_idx"), "b.start_idx", "b.reason")


def _risk_limit(place: int) -> Column:
    return F.when(F.col("lang_group") == "ko", C.RISK_LIMITS["ko"][place]).when(F.col("lang_group") == "en", C.RISK_LIMITS["en"][place]).otherwise(C.RISK_LIMITS["cjk"][place])


def cue_risks(cues: DataFrame, scripts: DataFrame) -> DataFrame:
    """Each risky cue's reasons and severity, and the window of cues around it; Japanese has none."""
    m = unsafe_ends(measured(cues), scripts)
    long_, cluster, fast, severe_fast = map(_risk_limit, range(4))
    prefix = F.when(F.col("lang_group") == "ko", "ko").when(F.col("lang_group") == "en", "en").otherwise("zh")
    three = _w().rowsBetween(0, 2)
    dense = (F.count("*").over(three) == 3) & (F.min(F.col("near_max").cast("int")).over(three) == 1) & (F.avg("chars").over(three) > cluster)
    gap = F.col("gap_after")
    wide = F.coalesce(gap > 1.5, F.lit(False))
    after_long = F.coalesce((gap > C.LARGE_GAP) & (F.col("near_max") | (F.col("chars") > long_)), F.lit(False))
    rushed = F.col("cps") > severe_fast
    reasons = F.array(
        F.when(wide, F.concat(prefix, F.lit("_severe_gap"))),
        F.when(after_long, F.concat(prefix, F.lit("_long_cue_gap"))),
        F.when(rushed | ((F.col("cps") > fast) & (F.col("chars") > 18)), F.concat(prefix, F.lit("_fast_cue"))),
        F.when(F.col("unsafe_end"), F.when(F.col("lang_group") == "cjk", "zh_quote_boundary").when(F.col("lang_group") == "ko", "ko_unsafe_boundary").otherwise("en_word_boundary")),
        F.when(dense, F.concat(prefix, F.lit("_maxed_duration_cluster"))),
    )
    last = F.max("idx").over(Window.partitionBy("script_id"))
    return (
        m.withColumn("reasons", F.array_sort(F.array_compact(reasons)))
        .withColumn("severity", F.when(wide | after_long | rushed, "high").otherwise("medium"))
        .withColumn("first_idx", F.greatest(F.lit(1), F.col("idx") - 1))
        .withColumn("_last", last)
        .withColumn("last_idx", F.least("_last", F.col("idx") + 1))
        .where((F.size("reasons") > 0) & (F.col("_last") > 1) & (F.col("lang_group") != "ja"))
        .select("script_id", "idx", "first_idx", "last_idx", "reasons", "severity")
    )


def merged_cue_risks(cues: DataFrame, scripts: DataFrame, keep: int | None = 4) -> DataFrame:
    """Risky cue windows joined where they touch, the most severe first; ``keep`` of each script."""
    groups = merge(
        cue_risks(cues, scripts),
        "first_idx",
        "last_idx",
        1,
        [F.min("first_idx").alias("first_idx"), F.max("last_idx").alias("last_idx"), union_of("reasons").alias("reasons"), highest("severity").alias("severity")],
        ["idx"],
    ).drop("group_index")
    spans = cues.select("script_id", "idx", "start", "end", "start_char", "end_char")
    first = spans.select("script_id", F.col("idx").alias("first_idx"), "start_char", F.greatest(F.lit(0.0), "start").alias("audio_start"))
    last = spans.select("script_id", F.col("idx").alias("last_idx"), "end_char", F.col("end").alias("audio_end"))
    most = cues.groupBy("script_id").agg(F.max("end").alias("_most"))
    placed = groups.join(first, ["script_id", "first_idx"]).join(last, ["script_id", "last_idx"]).join(most, "script_id")
    placed = placed.withColumn("audio_end", F.least("_most", F.greatest(F.col("audio_end"), F.col("audio_start") + 0.5))).drop("_most")
    order = Window.partitionBy("script_id").orderBy((F.col("severity") != "high").cast("int"), "audio_start", "first_idx")
    ranked = placed.withColumn("index", F.row_number().over(order))
    return ranked if keep is None else ranked.where(F.col("index") <= keep)


def micro_candidates(cues: DataFrame) -> DataFrame:
    """Cues whose shape hints at silent drift: reasons, severity, score and the window of cues to probe."""
    m = measured(cues)
    sparse = F.greatest(F.lit(18), (F.col("total_chars") * 0.65).cast("int"))
    short = F.greatest(F.col("min_duration") + 1.4, F.least(F.lit(3.4), F.col("max_duration") * 0.55))
    near = F.col("near_max")
    before, after = F.coalesce(F.lag("near_max").over(_w()), F.lit(False)), F.coalesce(F.lead("near_max").over(_w()), F.lit(False))
    next_short = F.coalesce(F.lead("duration").over(_w()) <= short, F.lit(False))
    own_short = F.col("duration") <= short
    gap_after, gap_before = F.coalesce("gap_after", F.lit(0.0)), F.coalesce("gap_before", F.lit(0.0))
    tests = (
        (near & (F.col("chars") <= sparse), "micro_sparse_maxed_cue", 4.0 + (sparse - F.col("chars")) / F.greatest(F.lit(1), sparse)),
        (near & (before | after), "micro_consecutive_maxed_cues", F.lit(3.0)),
        (near & next_short & (F.coalesce(F.lead("chars").over(_w()), F.lit(0)) >= 12), "micro_maxed_then_short_cue", F.lit(2.4)),
        (before & own_short & (F.col("chars") >= 12), "micro_short_after_maxed_cue", F.lit(2.2)),
        (near & (gap_after > 0.35), "micro_gap_after_maxed_cue", F.least(F.lit(2.0), gap_after)),
        (before & (gap_before > 0.35), "micro_gap_before_after_maxed_cue", F.least(F.lit(1.6), gap_before)),
        ((F.col("duration") >= F.col("max_duration") - 0.25) & (F.col("chars") >= 28) & (F.col("cps") < 5.0), "micro_low_cps_long_cue", F.lit(1.2)),
    )
    score = F.lit(0.0)
    for test, _, worth in tests:
        score = score + F.when(test, worth).otherwise(0.0)
    last = F.max("idx").over(Window.partitionBy("script_id"))
    return (
        m.withColumn("reasons", F.array_sort(F.array_compact(F.array(*[F.when(t, name) for t, name, _ in tests]))))
        .withColumn("severity", F.when(tests[0][0] | tests[1][0], "high").otherwise("medium"))
        .withColumn("score", score)
        .withColumn("first_idx", F.greatest(F.lit(1), F.col("idx") - F.when(before & own_short, 2).otherwise(1)))
        .withColumn("_last", last)
        .withColumn("last_idx", F.least("_last", F.col("idx") + F.when(near & next_short, 2).otherwise(1)))
        .where((F.size("reasons") > 0) & (F.col("_last") > 1))
        .select("script_id", "idx", "first_idx", "last_idx", "reasons", "severity", "score")
    )


def merged_micro_candidates(cues: DataFrame, scripts: DataFrame, keep: int = 16) -> DataFrame:
    """Candidate windows grown to sentences and joined over at most 40 characters, the most telling first."""
    from cueloom.functions.text import next_sentence_boundary, previous_sentence_boundary, trim_range

    spans = cues.select("script_id", "idx", "start", "end", "start_char", "end_char")
    found = micro_candidates(cues)
    found = found.join(spans.select("script_id", F.col("idx").alias("first_idx"), "start_char", F.col("start").alias("first_start")), ["script_id", "first_idx"])
    found = found.join(spans.select("script_id", F.col("idx").alias("last_idx"), "end_char", F.col("end").alias("last_end")), ["script_id", "last_idx"])
    text = F.col("display_text")
    grown = found.join(scripts.select("script_id", "display_text"), "script_id")
    grown = grown.withColumn("start_char", previous_sentence_boundary(text, F.col("start_char"), F.lit(90))).withColumn("end_char", next_sentence_boundary(text, F.col("end_char"), F.lit(120)))
    a, b = trim_range(text, F.col("start_char"), F.col("end_char"))
    grown = grown.withColumn("a", a).withColumn("b", b).where("b > a").withColumn("start_char", F.col("a")).withColumn("end_char", F.col("b"))
    merged = merge(
        grown, "start_char", "end_char", 40,
        [
            F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char"), F.min("first_idx").alias("first_idx"), F.max("last_idx").alias("last_idx"),
            F.max("score").alias("score"), union_of("reasons").alias("reasons"), highest("severity").alias("severity"),
            F.min(F.greatest(F.lit(0.0), "first_start")).alias("audio_start"), F.max(F.greatest("last_end", F.col("first_start") + 0.5)).alias("audio_end"),
        ],
        ["end_char", "idx"],
    ).drop("group_index")
    order = Window.partitionBy("script_id").orderBy((F.col("severity") != "high").cast("int"), F.desc("score"), "start_char")
    return merged.withColumn("index", F.row_number().over(order)).where(F.col("index") <= keep)


def quality(cues: DataFrame, scripts: DataFrame) -> DataFrame:
    """The quality report of each script, unrounded, with score and warnings.

    ``scripts`` has display_text and compare_text (its comparison form). One window pass and one aggregation.
    """
    m = unsafe_ends(measured(cues), scripts)
    dense = lambda group: F.col("lang_group") == group
    n = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    gap, chars, cps = F.col("gap_after"), F.col("chars"), F.col("cps")
    long_or_maxed = lambda limit: (chars > limit) | F.col("near_max")
    both_sums = lambda a, b: F.coalesce(a, F.lit(False)).cast("int") + F.coalesce(b, F.lit(False)).cast("int")
    zh_gap = (gap > C.LARGE_GAP) & long_or_maxed(34)
    zh_risk = both_sums(F.col("unsafe_end"), zh_gap | (gap > 1.5)) + (cps > 9.5).cast("int")
    ko_risk = both_sums(F.col("unsafe_end"), ((gap > C.LARGE_GAP) & long_or_maxed(38)) | (gap > 1.5)) + (cps > 10.5).cast("int")
    unnatural = ~has_natural_boundary(F.col("text"))
    weak = F.when(dense("cjk"), F.col("unsafe_end").cast("int") + unnatural.cast("int")).when(dense("en"), unnatural.cast("int")).otherwise(F.col("unsafe_end").cast("int"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda c: c["text"]), "")
    grouped = m.groupBy("script_id").agg(
        F.count("*").alias("subtitle_count"),
        F.avg("duration").alias("avg_subtitle_duration"),
        F.min("duration").alias("min_subtitle_duration"),
        F.max("duration").alias("max_subtitle_duration"),
        F.avg("cps").alias("avg_chars_per_second"),
        F.max("cps").alias("max_chars_per_second"),
        nearest_rank(F.collect_list("cps"), 0.95).alias("p95_chars_per_second"),
        F.max("chars").alias("max_chars_per_cue"),
        n(gap > C.LARGE_GAP).alias("large_gap_count"),
        F.coalesce(F.max(gap), F.lit(0.0)).alias("max_gap_seconds"),
        F.sum(weak).alias("weak_boundary_count"),
        n(gap < 0).alias("overlap_count"),
        n(F.col("duration") < F.col("min_duration")).alias("too_short_count"),
        n(F.col("duration") > F.col("timing_max") + C.EPSILON).alias("too_long_count"),
        n(F.col("chars") == 0).alias("empty_subtitle_count"),
        n(dense("cjk") & (chars > 34)).alias("zh_long_cue_count"),
        n(dense("cjk") & (cps > 8.5)).alias("zh_fast_cue_count"),
        n(dense("cjk") & F.col("unsafe_end")).alias("zh_unsafe_boundary_count"),
        n(dense("cjk") & zh_gap).alias("zh_large_gap_after_long_cue_count"),
        F.sum(F.when(dense("cjk"), zh_risk).otherwise(0)).alias("zh_timeline_risk_count"),
        n(dense("ko") & (chars > 38)).alias("ko_long_cue_count"),
        n(dense("ko") & (cps > 9.5)).alias("ko_fast_cue_count"),
        n(dense("ko") & F.col("unsafe_end")).alias("ko_unsafe_boundary_count"),
        F.sum(F.when(dense("ko"), ko_risk).otherwise(0)).alias("ko_timeline_risk_count"),
        n(cps > F.col("max_cps")).alias("_fast"),
        n(chars > F.col("total_chars")).alias("_crowded"),
        F.regexp_replace(ordered, f"{C.WS}+", "").alias("_actual"),
    )
    expected = F.col("compare_text")
    ratio = F.when(F.coalesce(expected, F.lit("")) == "", 1.0).when(F.col("_actual") == expected, 0.0).otherwise(F.least(F.lit(1.0), F.abs(F.length(expected) - F.length("_actual")) / F.length(expected)))
    report = grouped.join(scripts.select("script_id", "compare_text"), "script_id").withColumn("unaligned_text_ratio", ratio).withColumn("suspicious_gap_count", F.col("large_gap_count"))
    penalties = {
        "overlap_count": 18, "too_short_count": 6, "too_long_count": 6, "empty_subtitle_count": 12, "_fast": 4, "_crowded": 3, "large_gap_count": 4, "weak_boundary_count": 2,
        "zh_fast_cue_count": 4, "zh_large_gap_after_long_cue_count": 6, "zh_unsafe_boundary_count": 5, "zh_timeline_risk_count": 6, "ko_fast_cue_count": 4, "ko_unsafe_boundary_count": 5, "ko_timeline_risk_count": 6,
    }
    lost = (F.col("unaligned_text_ratio") * 60).cast("long")
    for column, each in penalties.items():
        lost = lost + F.col(column) * each
    flags = (
        F.col("overlap_count") > 0, F.col("too_short_count") > 0, F.col("too_long_count") > 0, F.col("unaligned_text_ratio") > 0, F.col("_fast") > 0, F.col("_crowded") > 0, F.col("large_gap_count") > 0,
        F.col("zh_unsafe_boundary_count") > 0, F.col("zh_timeline_risk_count") > 0, F.col("ko_unsafe_boundary_count") > 0, F.col("ko_timeline_risk_count") > 0,
    )
    return (
        report.withColumn("quality_score", F.greatest(F.lit(0), F.least(F.lit(100), 100 - lost)).cast("int"))
        .withColumn("warnings", F.array_compact(F.array(*[F.when(test, text) for test, text in zip(flags, C.REPORT_WARNINGS, strict=True)])))
        .drop("_fast", "_crowded", "_actual", "compare_text")
    )


def quality_rollup(report: DataFrame) -> DataFrame:
    """What a dashboard shows of a report: errors, coverage in percent, and whether it passes."""
    return report.select(
        "script_id",
        (F.col("too_long_count") + F.col("too_short_count") + F.col("overlap_count")).alias("error_count"),
        F.greatest(F.lit(0.0), (1 - F.col("unaligned_text_ratio")) * 100).alias("coverage_percent"),
        ((F.size("warnings") == 0) & (F.col("quality_score") >= 90)).alias("passed"),
    )


def cue_diagnostics(cues: DataFrame, scripts: DataFrame) -> DataFrame:
    """Counts and extremes of each script's cues, and its cue risks."""
    m = measured(cues)
    sums = m.groupBy("script_id").agg(
        F.count("*").alias("cue_count"),
        F.coalesce(F.max("gap_after"), F.lit(0.0)).alias("max_gap_seconds"),
        F.count_if(F.col("gap_after") > C.LARGE_GAP).alias("large_gap_count"),
        F.max("cps").alias("max_chars_per_second"),
        F.max("chars").alias("max_chars_per_cue"),
        F.count_if(F.col("gap_after") < 0).alias("overlap_count"),
    )
    risk = F.struct("index", "first_idx", "last_idx", "reasons", "severity", "start_char", "end_char", "audio_start", "audio_end")
    risks = merged_cue_risks(cues, scripts).groupBy("script_id").agg(F.array_sort(F.collect_list(risk)).alias("cue_timeline_risks"))
    return sums.join(risks, "script_id", "left").withColumn("cue_timeline_risk_count", F.greatest(F.lit(0), F.coalesce(F.size("cue_timeline_risks"), F.lit(0))))


def preview(cues: DataFrame) -> DataFrame:
    """index, start, end, text, duration and joined warnings of each cue, as shown in a table."""
    from cueloom.functions.timing import vtt_timestamp

    return cues.select(
        "script_id",
        "idx",
        vtt_timestamp(F.col("start")).alias("start_text"),
        vtt_timestamp(F.col("end")).alias("end_text"),
        "text",
        F.round(F.greatest(F.lit(0.0), F.col("end") - F.col("start")), 3).alias("duration_seconds"),
        F.array_join("warnings", " / ").alias("warnings_text"),
    )
