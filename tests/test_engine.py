"""Window and join operators against folds, and whole jobs by their properties."""

import random

import pytest
from pyspark.sql import functions as F

from cueloom.functions.profiles import profiles, resolve
from cueloom.operators import cues as cue_ops
from cueloom.operators import intervals as iv
from cueloom.operators import tokens as tok
from cueloom.plans import repair
from cueloom.plans.aligner import SteadyAligner, clean, mapped
from cueloom.plans.job import align_scripts, cue_rows, repaired, reports
from cueloom.plans.script import Cue, Script, Token
from cueloom.plans.splitting import AlignmentError, finalize, rebalance, segment, split
from cueloom.plans.tail import find_break, repair_start, repair_tail, rising
from cueloom.sources import sinks

TOKEN = "script_id long, ord int, text string, start double, end double, start_char int, end_char int, confidence double"
TEXTS = {
    "zh": '他把门"咔"地一声关上，然后说：“我明天再来。”' * 4,
    "ja": "駅前のコーヒー店で、友だちを二十分ほど待っていました。" * 4,
    "ko": "할머니는 창가에 앉아 조용히 책을 읽고 있었습니다. " * 5,
    "en": "It's a well-known story, and she doesn't mind. " * 8,
}


def chars(text, step=0.2):
    return [Token(text[i], k * step, (k + 0.8) * step, i, i + 1, 0.9) for k, i in enumerate(i for i, c in enumerate(text) if not c.isspace())]


def noisy(rng, text):
    out = []
    for k, i in enumerate(i for i, c in enumerate(text) if not c.isspace()):
        start = k * 0.2 + rng.choice((0, 0, 0, 0, -1.0, 7.5))
        out.append(Token(text[i], start, start + rng.choice((0.16, 0.0, 0.16)), i, i + 1, rng.choice((0.9, 0.9, 0.05, None))))
    return out


def token_table(spark, by_script):
    rows = [(s, k, t.text, t.start, t.end, t.a, t.b, t.confidence) for s, own in by_script.items() for k, t in enumerate(own)]
    return spark.createDataFrame(rows, TOKEN)


@pytest.fixture(scope="module")
def noisy_scripts(spark):
    rng = random.Random(5)
    texts = {s: " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) + rng.choice(("", "", "!", "。")) for _ in range(rng.randrange(3, 90))) for s in range(40)}
    own = {s: noisy(rng, t) for s, t in texts.items()}
    scripts = spark.createDataFrame([(s, "en", "standard", t, 0.2 * sum(c != " " for c in t)) for s, t in texts.items()], "script_id long, language string, profile string, display_text string, audio_duration double")
    return texts, own, cue_ops.with_profile(scripts, profiles(spark)), token_table(spark, own)


@pytest.mark.parametrize("language", TEXTS)
def test_split_covers_the_script_without_unsafe_ends(language):
    text = TEXTS[language].strip()
    script, p = Script(text, language), resolve("youtube_long", language)
    cues = split(script, chars(text), p)
    assert script.covered_by(cues) and cues[0].a == 0 and cues[-1].b == len(text)
    assert all(x.b == y.a and x.end <= y.start + 1e-9 for x, y in zip(cues, cues[1:], strict=False))
    assert not any(script.risk[c.b] for c in cues[:-1])
    assert max(y.start - x.end for x, y in zip(cues, cues[1:], strict=False)) <= 0.201


def test_dense_chinese_is_split_and_segments_match_a_plain_scan():
    text = "这是一个没有任何标点的很长的句子它会一直继续下去直到必须被切开为止我们来看看结果如何" * 3
    p = resolve("youtube_long", "zh")
    assert all(c.chars <= 38 for c in split(Script(text, "zh"), chars(text, 0.1), p))
    with pytest.raises(AlignmentError):
        split(Script(text, "zh"), [], p)
    assert len(segment(Script(text, "zh"), chars(text, 0.1), p)) >= 3


def test_korean_pauses_are_barriers_and_fast_runs_are_balanced():
    text = "오늘 아침 시장에 사람이 아주 많았다 우리는 천천히 걸어서 집으로 돌아왔다"
    p, script, cut = resolve("youtube_long", "ko"), Script(text, "ko"), text.index("우리는")
    fast = [Cue(0.0, 1.2, script.render(0, cut), 0, cut), Cue(1.28, 6.5, script.render(cut, len(text)), cut, len(text))]
    done = rebalance(fast, script, p)
    assert max(c.cps for c in done) <= 9.5 and (done[0].start, done[-1].end) == (0.0, 6.5)
    apart = [fast[0], fast[1].but(start=1.9)]
    assert rebalance(apart, script, p) == apart
    assert script.covered_by(finalize(fast, script, p))


def test_suspects_match_the_kernel(spark, noisy_scripts):
    texts, own, scripts, tokens = noisy_scripts
    p = resolve("standard", "en")
    found = {}
    for r in tok.suspects(tokens, scripts).collect():
        found.setdefault(r["script_id"], set()).add((r["start_char"], r["end_char"], tuple(r["reasons"]), r["severity"]))
    for s, text in texts.items():
        script = Script(text, "en")
        raw = repair._raw_suspects(script, sorted(own[s], key=lambda t: (t.a, t.b)), 0.2 * script.count(0, script.n), p)
        grown = [(script.sentence_before(a, 90), script.sentence_after(b, 140), {why}, sev) for a, b, why, sev in raw if b > a]
        assert found.get(s, set()) == {(a, b, tuple(sorted(why)), sev) for a, b, why, sev in repair._merged(grown, 240)}, s


def test_diagnostics(spark, noisy_scripts):
    texts, own, scripts, tokens = noisy_scripts
    for r in tok.diagnostics(tokens, scripts).collect():
        mine = own[r["script_id"]]
        assert r["token_count"] == r["mapped_token_count"] == len(mine) and r["text_coverage_ratio"] == 1.0
        assert r["zero_duration_count"] == sum(t.end - t.start <= 0.02 for t in mine) and r["low_confidence_token_count"] == sum(t.confidence == 0.05 for t in mine)
        assert r["time_reversal_count"] == sum(b.start < a.start - 0.12 or b.end < a.end - 0.12 for a, b in zip(mine, mine[1:], strict=False))


def test_merge_and_as_of_match_folds(spark):
    rng = random.Random(6)
    spans = [(s, a, a + rng.randrange(1, 60)) for s in range(30) for a in (rng.randrange(900) for _ in range(rng.randrange(1, 12)))]
    df = spark.createDataFrame(spans, "script_id long, a int, b int")
    got = {tuple(r) for r in iv.merge(df, "a", "b", 20, [F.min("a").alias("x"), F.max("b").alias("y")], ["b"]).select("script_id", "x", "y").collect()}
    want = {(s, x, y) for s in range(30) for x, y, *_ in repair._merged([(a, b, set(), "medium") for q, a, b in spans if q == s], 20)}
    assert got == want
    points = spark.createDataFrame([(s, i, rng.randrange(1000)) for s in range(30) for i in range(8)], "script_id long, i int, at int")
    back = iv.as_of(points, df, "at", "b", ["a"]).collect()
    for r in back:
        near = [(b, -a) for s, a, b in spans if s == r["script_id"] and b <= r["at"]]
        assert r["near_a"] == (-max(near)[1] if near else None)


def test_time_at_char_and_replacement(spark, noisy_scripts):
    texts, own, scripts, tokens = noisy_scripts
    rng = random.Random(8)
    thin = {s: [t for t in ts if t.a % 9 < 4] for s, ts in own.items()}
    points = [(s, i, rng.randrange(len(t))) for s, t in texts.items() for i in range(15)]
    got = iv.time_at_char(spark.createDataFrame(points, "script_id long, point_id int, char_pos int"), token_table(spark, thin)).collect()
    assert len(got) == len(points)
    for r in got:
        want = repair.time_at(repair._by_place(thin[r["script_id"]]), r["char_pos"])
        assert (r["time_at"] is None) == (want is None) and (want is None or abs(want - r["time_at"]) < 1e-9)
    ranges = spark.createDataFrame([(s, 5, 25) for s in texts], "script_id long, start_char int, end_char int")
    new = spark.createDataFrame([(s, -1, "x", 0.0, 1.0, 5, 25, 0.5) for s in texts], TOKEN)
    left = iv.replace_in_ranges(tokens, ranges, new).groupBy("script_id").count().collect()
    assert {r["script_id"]: r["count"] for r in left} == {s: len(repair.replace_span(ts, 5, 25, [ts[0]])) for s, ts in own.items()}


def test_drift_runs_match_the_kernel(spark):
    rng = random.Random(9)
    text = "abcdefghij" * 30
    samples = {s: sorted((a, a + 3, rng.choice((1.2, 1.4, 0.9, -1.1, 0.1)) if rng.random() < 0.3 else (1.0 if s % 2 else -1.3)) for a in rng.sample(range(290), 60)) for s in range(25)}
    df = spark.createDataFrame([(s, *x) for s, xs in samples.items() for x in xs], "script_id long, start_char int, end_char int, signed_drift double")
    scripts = spark.createDataFrame([(s, text) for s in samples], "script_id long, display_text string")
    got = {r["script_id"]: (r["start_char"], r["end_char"], r["sample_count"]) for r in tok.drift_runs(df, scripts).collect()}
    want = {s: (b["a"], b["b"], b["sample_count"]) for s, xs in samples.items() if (b := repair.strongest_run(Script(text, "zh"), xs))}
    assert got == want


def test_drift_merge_keeps_directions_apart():
    make = lambda a, b, d: repair.Range(a, b, (0.0, 1.0), ["x"], "high", 0, {"checkpoint_count": 1, "median_drift": abs(d), "p95_drift": abs(d), "max_drift": abs(d), "signed_median_drift": d})
    out = repair.merge_drift([make(0, 100, 1.0), make(200, 300, 2.0), make(310, 400, -1.0), make(420, 500, -3.0), make(900, 950, -1.0)])
    assert [(r.a, r.b, r.stats["checkpoint_count"], r.stats["signed_median_drift"]) for r in out] == [(0, 300, 2, 2.0), (310, 500, 2, -3.0), (900, 950, 1, -1.0)]


def test_severities(spark):
    rows = [(0.01, 0.2), (0.2, 1.8), (0.8, 1.2), (1.1, 1.2)]
    got = spark.createDataFrame(rows, "m double, p double").select(tok.checkpoint_severity(F.col("m"), F.col("p")).alias("s")).collect()
    assert [r["s"] for r in got] == ["ok", "ok", "medium", "high"] == [repair.checkpoint_severity(*r) for r in rows]


def test_breaks_match_the_kernel_and_tails_are_rebuilt(spark):
    rng, p = random.Random(10), resolve("youtube_long", "ja")
    scripts = {}
    for s in range(40):
        at, own = 0.0, []
        for i in range(10):
            lasts = rng.choice((2.0, 3.0, 6.5, 0.4, 2.0, 13.0 if rng.random() < 0.3 else 2.0))
            own.append(Cue(at, at + lasts, "あ" * rng.choice((6, 12, 40)), i * 12, i * 12 + 12))
            at += lasts + rng.choice((0.08, 0.08, 0.9, 3.5, 31.0 if rng.random() < 0.3 else 0.1))
        scripts[s] = own
    rows = [(s, i, c.start, c.end, c.text, c.a, c.b, "ja", "youtube_long") for s, own in scripts.items() for i, c in enumerate(own, 1)]
    cues = cue_ops.with_profile(spark.createDataFrame(rows, "script_id long, idx int, start double, end double, text string, start_char int, end_char int, language string, profile string"), profiles(spark))
    got = {r["script_id"]: (r["break_idx"], r["start_idx"], r["reason"]) for r in cue_ops.timeline_breaks(cues).collect()}
    want = {s: (f[0] + 1, repair_start(own, f[0], p) + 1, f[1]) for s, own in scripts.items() if (f := find_break(own, p))}
    assert got == want
    text = TEXTS["ja"]
    broken = split(Script(text, "ja"), chars(text, 0.18), p)
    late = [*broken[:2], *[c.but(start=c.start + 200, end=c.end + 200) for c in broken[2:]]]
    done, info = repair_tail(late, Script(text, "ja"), chars(text, 0.18), 80.0, p)
    assert info["detected_index"] == 3 and info["confidence"] == "low" and Script(text, "ja").covered_by(done) and done[-1].end <= 80.01
    assert rising([(5, 3.0), (2, 4.0), (9, 2.0)], 0, 10) == [(0, 4.0), (2, 4.0), (10, 4.1)]


def numbered(n=90):
    return "".join(f"第{i}句话说的是{'甲乙丙丁戊己庚辛壬癸'[i % 10]}在第{i * 7}天走过了{i * 13}里路。" for i in range(n))


@pytest.mark.parametrize("aligner", [SteadyAligner(), SteadyAligner(drift=3.0, drift_from=1 / 3), SteadyAligner(drift=3.0, drift_from=1 / 3, fails=True), SteadyAligner(drift=3.0, drift_from=1 / 3, can_realign=False)])
def test_repairs_by_the_aligner(aligner):
    text, p = clean(numbered()), resolve("youtube_long", "zh")
    tokens, duration = aligner.align(text, "zh", None)
    script = Script(text.display, "zh")
    cues, _, summary, _ = repaired(script, mapped(tokens, text), duration, p, aligner)
    assert script.covered_by(cues)
    if not aligner.drift:
        assert summary.checkpoint_drift_count == 0 and not summary.drift_suspect_ranges
    elif aligner.fails:
        assert all(a["status"] == "failed" for a in summary.local_realign_attempts)
    elif aligner.realign:
        assert summary.drift_repaired_ranges and summary.max_checkpoint_drift_seconds < 3.0


def test_mapping_finds_repeats_in_order():
    script = clean("# **one** two\none three")
    out = mapped([Token("one", 0, 1), Token("two", 1, 2), Token("one", 2, 3), Token("zzz", 3, 2.5)], script)
    assert [(t.a, t.b) for t in out[:3]] == [(4, 7), (10, 13), (14, 17)] and out[3].end == 3


def test_jobs_are_isolated_and_write_outputs(spark, tmp_path):
    rows = [(1, "en", "standard", TEXTS["en"]), (2, "fr", "standard", "texte"), (3, "zh", "short", TEXTS["zh"]), (4, "en", "none", "x y"), (5, "ko", "standard", TEXTS["ko"]), (6, "en", "standard", "  "), (7, "ja", "slow_elder", TEXTS["ja"])]
    schema = "script_id long, language string, profile string, script_text string"
    done = align_scripts(spark.createDataFrame(rows, schema), SteadyAligner(step=0.1)).cache()
    assert {r["script_id"]: r["error_class"] for r in done.collect()} == {1: None, 2: "InputError", 3: None, 4: "InputError", 5: None, 6: "InputError", 7: None}
    for row in rows[::2]:
        alone = align_scripts(spark.createDataFrame([row], schema), SteadyAligner(step=0.1)).collect()[0]
        assert alone["cues"] == done.where(F.col("script_id") == row[0]).collect()[0]["cues"]
    report = reports(done, profiles(spark))
    assert report.count() == 4 and report.where("unaligned_text_ratio > 0").count() == 0
    sinks.write_outputs(done, cue_rows(done), report, str(tmp_path))
    srt = {r["script_id"]: r["srt"] for r in spark.read.parquet(f"{tmp_path}/output_srt").collect()}
    assert set(srt) == {1, 3, 5, 7} and srt[1].startswith("1\n00:00:00,000 --> ")
    assert spark.read.parquet(f"{tmp_path}/quality_report").count() == 4


def test_quality_of_dense_cues_matches_counts(spark):
    text = "他说“好”。" + "很" * 60 + "他们走了很远的路程"
    cuts = [(0, 3, 0.0, 2.0), (3, 66, 2.1, 8.1), (66, len(text), 10.0, 10.5)]
    rows = [(1, i, s, e, text[a:b], a, b, "zh", "youtube_long") for i, (a, b, s, e) in enumerate(cuts, 1)]
    cues = cue_ops.with_profile(spark.createDataFrame(rows, "script_id long, idx int, start double, end double, text string, start_char int, end_char int, language string, profile string"), profiles(spark))
    scripts = spark.createDataFrame([(1, text, text)], "script_id long, display_text string, compare_text string")
    r = cue_ops.quality(cues, scripts).collect()[0]
    assert (r["zh_long_cue_count"], r["zh_fast_cue_count"], r["zh_unsafe_boundary_count"], r["zh_large_gap_after_long_cue_count"]) == (1, 2, 1, 1)
    assert r["quality_score"] == 28 and r["unaligned_text_ratio"] == 0.0 and len(r["warnings"]) == 6


def test_flatten_results(spark):
    schema = "script_id long, segments array<struct<text:string,start:double,end:double,words:array<struct<word:string,text:string,start:double,end:double,probability:double>>>>"
    rows = [(1, [("seg", 0.0, 1.0, []), ("x", 1.0, 2.0, [("a", None, 1.0, 1.5, 0.9), (" ", None, 1.5, 1.6, 0.1), ("", "b", 1.6, 1.7, None), ("late", None, 3.0, 2.0, 0.5)])])]
    got = tok.flatten_result(spark.createDataFrame(rows, schema)).orderBy("ord").collect()
    assert [(r["text"], r["confidence"]) for r in got] == [("seg", None), ("a", 0.9), ("b", None)]


def test_streamed_scripts_and_command_line(spark, tmp_path):
    from cueloom.__main__ import main
    from cueloom.streaming.scripts import watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"script_id": 1, "language": "en", "profile": "standard", "script_text": "One two. Three four five."}\n')
    watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), SteadyAligner()).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out/batch=0/output_vtt").collect()[0]["vtt"].startswith("WEBVTT\n\n00:00")
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "one.txt").write_text("﻿Hello there, this is a script.", encoding="utf-8")
    assert main(["--scripts", f"{tmp_path}/s", "--language", "en", "--out", f"{tmp_path}/cli"], spark) == 0
    assert spark.read.parquet(f"{tmp_path}/cli/output_srt").collect()[0]["srt"].endswith("this is a script\n")
    assert main(["--scripts", "x", "--language", "en", "--min-duration", "9"], spark) == 2


def test_requests_and_job_states(spark):
    from cueloom.operators import jobs
    from cueloom.sources.audio import banner_seconds, clip_command
    from cueloom.sources.scripts import chosen_text

    schema = "audio string, profile string, min_duration double, max_duration double, line_chars int, script_text string, language string"
    good = ("a.mp3", "short", 1.0, 2.0, 18, "x", "ja")
    rows = [good, (None, *good[1:]), (*good[:1], "odd", *good[2:]), (*good[:2], 0.0, *good[3:]), (*good[:3], 1.0, *good[4:]), (*good[:5], "  ", "ja"), (*good[:6], None)]
    assert [r["fault"] is None for r in jobs.checked(spark.createDataFrame(rows, schema)).collect()] == [True] + [False] * 6
    events = spark.createDataFrame([(1, 1, "running", "split", "a", None), (1, 2, None, "write", "b", None), (1, 3, "succeeded", None, None, None)], "job_id long, seq int, status string, stage string, log string, error string")
    table = spark.createDataFrame([(1, "x/talk.mp3", ["srt", "alignment"]), (2, ".mp3", ["srt"])], "job_id long, audio_name string, kinds array<string>")
    state = jobs.advanced(table, events)
    assert {r["job_id"]: (r["status"], r["stage"], r["logs"]) for r in state.collect()} == {1: ("succeeded", "write", ["a", "b"]), 2: ("queued", None, None)}
    assert [tuple(r) for r in jobs.downloads(state).collect()] == [(1, "srt", "talk.srt")]
    got = spark.createDataFrame([("Duration: 01:02:03.50, start", None, " ", "p")], "b string, u string, blank string, p string").select(banner_seconds(F.col("b")).alias("s"), chosen_text(F.col("u"), F.col("blank")).alias("n"), chosen_text(F.col("u"), F.col("p")).alias("t"), jobs.file_of(F.lit("vtt")).alias("f")).collect()[0]
    assert tuple(got) == (3723.5, None, "p", "output.vtt")
    with pytest.raises(ValueError):
        clip_command("a", "b", 2.0, 1.0)
