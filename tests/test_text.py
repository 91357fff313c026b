"""Text, time and boundary expressions against the kernel's own forms."""

import random

from pyspark.sql import functions as F

from cueloom.functions import boundary, text, timing
from cueloom.functions.profiles import InputError, profiles, resolve
from cueloom.plans.aligner import clean, normalized
from cueloom.plans.script import Script, compare_form

PARTS = ["a", "Zz", " ", "\n", "　", "\x1c", "​", "﻿", "#", "*", "。", "！", ".", ",", "“", "”", "「", "」", "'", '"', "-", "’", "漢", "字", "的", "が", "カ", "ー", "っ", "１", "円", "한", "글", "é", "😀", "\r\n", "\r", "("]


def samples(n, seed, length=24):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randrange(length))) for _ in range(n)]


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, t string")


def test_cleaning_matches_the_kernel(spark):
    texts = samples(400, 1)
    t = F.col("t")
    shown = text.clean_display(t)
    got = table(spark, texts).select("id", shown.alias("d"), text.clean_align(shown).alias("a"), text.normalize_token(t).alias("n"), text.normalize_compare(t).alias("c"), text.visible_len(t).alias("v")).collect()
    for r in got:
        own, want = texts[r["id"]], clean(texts[r["id"]])
        assert r["a"] == (want.align if want else None)
        assert r["d"] == (want.display if want else r["d"]) and r["n"] == normalized(own) and r["c"] == compare_form(own) and r["v"] == len("".join(own.split()))


def test_align_map_matches_the_kernel(spark):
    from cueloom.operators.tokens import align_map

    shown = [c for t in samples(80, 2) if (c := clean(t))]
    found = align_map(spark.createDataFrame([(i, c.display) for i, c in enumerate(shown)], "script_id long, display_text string")).orderBy("script_id", "align_pos").collect()
    for i, c in enumerate(shown):
        own = [r for r in found if r["script_id"] == i]
        assert "".join(r["ch"] for r in own) == c.align and [r["at"] for r in own] == c.origin


def test_offsets_and_sentences_match_the_kernel(spark):
    rng = random.Random(3)
    rows = [(t, a, rng.randrange(a, len(t) + 1), rng.randrange(1, 12)) for t in samples(300, 4, 60) for a in [rng.randrange(len(t) + 1)]]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, t string, a int, b int, k int")
    t, a, b, k = (F.col(c) for c in "tabk")
    lo, hi = text.trim_range(t, a, b)
    got = df.select("id", text.previous_sentence_boundary(t, a, k).alias("p"), text.next_sentence_boundary(t, a, k).alias("n"), text.char_after_visible(t, a, b, k).alias("c"), lo.alias("lo"), hi.alias("hi"), text.previous_visible(t, a).alias("pv"), text.next_visible(t, a).alias("nv")).collect()
    for r in got:
        t, a, b, k = rows[r["id"]]
        s = Script(t, "zh")
        assert (r["p"], r["n"]) == (s.sentence_before(a, k), s.sentence_after(a, k))
        assert r["c"] == s.after_count(a, b, k) and (r["lo"], r["hi"]) == s.trim(a, b)
        assert (ord(r["pv"]) if r["pv"] else 0, ord(r["nv"]) if r["nv"] else 0) == (s.prev[a], s.nxt[a])


def test_boundaries_match_the_kernel_in_all_languages(spark):
    texts = [t for t in samples(120, 5, 30) if t and "\r" not in t]
    b = boundary.boundaries(spark.createDataFrame(list(enumerate(texts)), "script_id long, text string"))
    for language, group in (("en", "en"), ("zh", "cjk"), ("ja", "ja"), ("ko", "ko")):
        scripts = [Script(t, language) for t in texts]
        args = [F.lit(group), F.col("prev"), F.col("nxt"), F.col("left"), F.col("right")]
        got = b.select("script_id", "at", "visible", boundary.high_risk(*args).alias("risk"), boundary.score(*args, F.col("quoted")).alias("score"), boundary.repair_score(*args, F.col("quoted"), F.lit(0)).alias("move")).collect()
        assert len(got) == sum(len(t) + 1 for t in texts)
        for r in got:
            s, at = scripts[r["script_id"]], r["at"]
            assert (r["visible"], r["risk"], r["score"], r["move"]) == (s.visible[at], s.risk[at], s.score[at], s.move_score[at]), (language, s.text, at)


def test_timestamps_and_punctuation(spark):
    df = spark.createDataFrame([(65.432, "Done。」\nyes, (no)! "), (-1.0, "a.b"), (360000.0005, "  ")], "s double, t string")
    got = df.select(timing.srt_timestamp(F.col("s")).alias("srt"), timing.vtt_timestamp(F.col("s")).alias("vtt"), text.strip_trailing_punctuation(F.col("t")).alias("p")).collect()
    assert [tuple(r) for r in got] == [("00:01:05,432", "00:01:05.432", "Done\nyes, (no"), ("00:00:00,000", "00:00:00.000", "a.b"), ("100:00:00,000", "100:00:00.000", "")]


def test_profiles(spark):
    rows = {(r["profile"], r["language"]): r for r in profiles(spark).collect()}
    assert len(rows) == 20
    zh, ko = rows["youtube_long", "zh-TW"], rows["short", "ko"]
    assert (zh["line_chars"], zh["total_chars"], zh["max_cps"], zh["soft_chars"]) == (18, 34, 8.5, 38)
    assert (ko["timing_max"], ko["ideal_min"], ko["total_chars"]) == (5.8, 1.4, 29)
    assert resolve("standard", "en", line_chars=100).total_chars == 100
    for bad in (dict(profile="none", language="en"), dict(profile="standard", language="fr"), dict(profile="standard", language="en", min_duration=9.0)):
        try:
            resolve(**bad)
        except InputError:
            continue
        raise AssertionError(bad)


def test_numbers_that_cannot_be_read(spark):
    got = spark.createDataFrame([("1.5",), ("x",), (None,)], "v string").select(timing.as_float(F.col("v")).alias("f"), timing.as_optional_float(F.col("v")).alias("o")).collect()
    assert [tuple(r) for r in got] == [(1.5, 1.5), (0.0, None), (0.0, None)]
