"""Registered queries over the driver's tables, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueloom.functions import charsets as C
from cueloom.functions.boundary import boundaries, high_risk, repair_score, score
from cueloom.functions.profiles import profiles
from cueloom.functions.text import (
    clean_align,
    clean_display,
    has_natural_boundary,
    next_sentence_boundary,
    normalize_compare,
    previous_sentence_boundary,
    render_segment,
    strip_trailing_punctuation,
    visible_len,
)
from cueloom.functions.timing import nearest_rank, rounded, srt_timestamp, vtt_timestamp
from cueloom.operators import cues as cue_ops
from cueloom.operators import intervals as iv
from cueloom.operators import tokens as tok
from cueloom.plans import drift
from cueloom.plans.job import split_table
from cueloom.plans.timeline import Timeline
from cueloom.sources import corpora, sinks
from cueloom.sources.tables import table
from cueloom.sources.workspace import bounded_batches, written

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
WS = C.WS


def query(sql: str | None = None):
    """Register a query under its function's name, with its oracle."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# --- Shared oracle fragments -----------------------------------------------------------------------------------

def _strip(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^{WS}+', ''), '{WS}+$', '')"


def _vis(text: str) -> str:
    return f"length(regexp_replace({text}, '{WS}+', '', 'g'))"


def _span(a: str, b: str) -> str:
    return _vis(f"substr(display_text, CAST({a} + 1 AS BIGINT), CAST(greatest({b} - {a}, 0) AS BIGINT))")


EN = f"""
    en AS (SELECT doc_id AS script_id, {_strip("regexp_replace(text, chr(13) || chr(10) || '|' || chr(13), chr(10), 'g')")} AS display_text
           FROM documents WHERE lang = 'en'),
"""
TOKENS = (
    EN
    + """
    words AS (SELECT script_id, w AS text, i - 1 AS pos FROM (
        SELECT script_id, string_split_regex(display_text, '[ \\n]') AS ws FROM en WHERE display_text <> ''), LATERAL (SELECT unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i)),
    placed AS (SELECT *, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY script_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start_char FROM words),
    timed AS (SELECT *, row_number() OVER (PARTITION BY script_id ORDER BY pos) - 1 AS ord,
        coalesce(sum(length(text)) OVER (PARTITION BY script_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM placed WHERE text <> ''),
    begun AS (SELECT *, greatest(0, CAST(seen AS BIGINT) * 60 + 7000 * (ord // 211) - CASE WHEN ord % 127 = 126 THEN 500 ELSE 0 END) AS begin_ms,
        CASE WHEN (ord // 8) % 13 = 5 THEN 0 ELSE length(text) * 60 - 10 END AS lasts FROM timed),
    tokens AS (SELECT script_id, ord, text, begin_ms / 1000.0::DOUBLE AS start, (begin_ms + lasts) / 1000.0::DOUBLE AS "end", start_char,
        CAST(start_char + length(text) AS INTEGER) AS end_char,
        CASE WHEN ord % 29 = 0 THEN NULL WHEN (ord // 6) % 11 = 3 THEN 0.05::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM begun),
"""
)


def _place(values: tuple[int, ...]) -> str:
    return f"([{', '.join(map(str, values))}])[CAST(idx % {len(values)} + 1 AS BIGINT)]"


CUES = f"""
    pieces AS (SELECT script_id, turn, w AS text, i AS pos FROM (
        SELECT conv_id AS script_id, turn, string_split_regex(text, '[.,\\n]+ *') AS ws FROM conversations), LATERAL (SELECT unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i)),
    numbered AS (SELECT *, row_number() OVER w AS idx, CAST(coalesce(sum(length(text) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start_char
        FROM pieces WINDOW w AS (PARTITION BY script_id ORDER BY turn, pos)),
    ruled AS (SELECT *, {_place(corpora.DURATIONS)} AS lasts, {_place(corpora.GAPS)} AS gap FROM numbered),
    begun AS (SELECT *, coalesce(sum(lasts + gap) OVER (PARTITION BY script_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin_ms FROM ruled),
    cues AS (SELECT script_id, idx, begin_ms / 1000.0::DOUBLE AS start, (begin_ms + lasts) / 1000.0::DOUBLE AS "end", text, start_char, CAST(start_char + length(text) AS INTEGER) AS end_char,
        1.2::DOUBLE AS min_duration, 6.0::DOUBLE AS max_duration, 42 AS line_chars, 84 AS total_chars, 20.0::DOUBLE AS max_cps, 0.08::DOUBLE AS gap_seconds FROM begun),
    m AS (SELECT *, greatest(0.0::DOUBLE, "end" - start) AS duration, {_vis("text")} AS chars, {_vis("text")} / greatest("end" - start, 0.1::DOUBLE) AS cps,
        start - lag("end") OVER w AS gap_before, lead(start) OVER w - "end" AS gap_after, greatest(0.0::DOUBLE, "end" - start) >= max_duration - 0.05::DOUBLE AS near_max
        FROM cues WINDOW w AS (PARTITION BY script_id ORDER BY idx)),
"""
NATURAL = C.one_of(C.NATURAL_ENDS)


def _cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cue_ops.with_profile(corpora.conversation_cues(spark, sf_dir), profiles(spark))


def _scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.with_duration(cue_ops.with_profile(corpora.english_scripts(spark, sf_dir), profiles(spark)))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.word_tokens(corpora.english_scripts(spark, sf_dir))


# --- Text ------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, nullif({_strip(chr(34) + 'text' + chr(34))}, '') AS display_text FROM documents")
def clean_display_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", clean_display(F.col("text")).alias("display_text"))


_ALIGN = _strip(f"regexp_replace(regexp_replace(text, '{C.one_of(C.MARKDOWN_NOISE)}', '', 'g'), '{WS}+', ' ', 'g')")


@query(f"SELECT doc_id, nullif({_ALIGN}, '') AS align_text FROM documents")
def clean_align_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", clean_align(clean_display(F.col("text"))).alias("align_text"))


@query(f"SELECT page_id, regexp_replace(html, '{WS}+', '', 'g') AS compare_text, {_strip(f'''regexp_replace(html, '{WS}+', ' ', 'g')''')} AS rendered, {_vis('html')} AS visible FROM pages")
def normalize_and_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", normalize_compare(html).alias("compare_text"), render_segment(html).alias("rendered"), visible_len(html).alias("visible"))


@query(f"""SELECT doc_id, list_reduce(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, '(\\p{{P}}|{WS})+$', '')), lambda a, b: a || chr(10) || b) AS stripped FROM documents""")
def trailing_punctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", strip_trailing_punctuation(F.col("text")).alias("stripped"))


@query(f"""SELECT doc_id, coalesce(regexp_extract(text, '(?s)([^{WS[1:-1]}]){WS}*$', 1), '') AS last_char,
    regexp_extract(text, '(?s)([^{WS[1:-1]}]){WS}*$', 1) = '' OR regexp_matches(regexp_extract(text, '(?s)([^{WS[1:-1]}]){WS}*$', 1), '^{NATURAL}$') AS natural_end FROM documents""")
def natural_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cueloom.functions.text import last_char

    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", last_char(text).alias("last_char"), has_natural_boundary(text).alias("natural_end"))


@query(f"""
    WITH {EN} c AS (SELECT script_id, unnest(string_split(display_text, '')) AS ch, unnest(range(length(display_text))) AS ix FROM en WHERE display_text <> ''),
    k AS (SELECT *, regexp_matches(ch, '^{WS}$') AS blank, lag(regexp_matches(ch, '^{WS}$')) OVER (PARTITION BY script_id ORDER BY ix) AS before FROM c WHERE NOT regexp_matches(ch, '^{C.one_of(C.MARKDOWN_NOISE)}$')),
    l AS (SELECT *, max(CASE WHEN NOT blank THEN ix END) OVER (PARTITION BY script_id) AS last FROM k WHERE NOT blank OR NOT before)
    SELECT script_id, count(*) AS n, CAST(sum(ix) AS BIGINT) AS sum_at, CAST(max(ix) AS INTEGER) AS max_at, string_agg(CASE WHEN blank THEN ' ' ELSE ch END, '' ORDER BY ix) AS align_text
    FROM l WHERE ix <= last GROUP BY script_id
""")
def align_position_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = tok.align_map(corpora.english_scripts(spark, sf_dir))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("align_pos", "ch"))), lambda c: c["ch"]), "")
    return kept.groupBy("script_id").agg(F.count("*").alias("n"), F.sum("at").alias("sum_at"), F.max("at").alias("max_at"), text.alias("align_text"))


_ENDS = C.one_of(C.SENTENCE_ENDS)


@query(f"""
    WITH d AS (SELECT doc_id, text, length(text) // 2 AS ix FROM documents), s AS (SELECT *, greatest(0, ix - 90) AS lo, least(length(text), ix + 140) AS hi FROM d)
    SELECT doc_id, CAST(lo + length(regexp_extract(substr(text, CAST(lo + 1 AS BIGINT), CAST(ix - lo AS BIGINT)), '(?s)^(.*{_ENDS})', 1)) AS INTEGER) AS sentence_start,
        CAST(CASE WHEN regexp_matches(substr(text, CAST(ix + 1 AS BIGINT), CAST(hi - ix AS BIGINT)), '{_ENDS}')
            THEN ix + length(regexp_extract(substr(text, CAST(ix + 1 AS BIGINT), CAST(hi - ix AS BIGINT)), '(?s)^([^{_ENDS[1:-1]}]*{_ENDS})', 1)) ELSE hi END AS INTEGER) AS sentence_end FROM s
""")
def sentence_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("at", F.floor(F.length("text") / 2).cast("int"))
    text, at = F.col("text"), F.col("at")
    return docs.select("doc_id", previous_sentence_boundary(text, at, F.lit(90)).alias("sentence_start"), next_sentence_boundary(text, at, F.lit(140)).alias("sentence_end"))


# --- Time and profiles -----------------------------------------------------------------------------------------

_MS = "CAST(greatest(0, round_even(value * 1000, 0)) AS BIGINT)"


@query(f"""SELECT event_id, printf('%02d:%02d:%02d,%03d', {_MS} // 3600000, {_MS} // 60000 % 60, {_MS} // 1000 % 60, {_MS} % 1000) AS srt,
    printf('%02d:%02d:%02d.%03d', {_MS} // 3600000, {_MS} // 60000 % 60, {_MS} // 1000 % 60, {_MS} % 1000) AS vtt FROM events""")
def timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", srt_timestamp(value).alias("srt"), vtt_timestamp(value).alias("vtt"))


@query("""
    WITH b(language, lang_group, bl, bt, cps) AS (VALUES ('zh', 'cjk', 18, 34, 8.5::DOUBLE), ('zh-TW', 'cjk', 18, 34, 8.5), ('ja', 'ja', 17, 34, 12.0), ('ko', 'ko', 20, 38, 10.5), ('en', 'en', 42, 84, 20.0)),
    p(profile, lx, tx, cx, mn, mx) AS (VALUES ('youtube_long', 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE, 1.2::DOUBLE, 6.5::DOUBLE), ('standard', 1.0, 1.0, 1.0, 1.2, 6.0), ('short', 0.82, 0.78, 1.0, 1.0, 4.2), ('slow_elder', 0.9, 0.86, 0.85, 1.5, 7.0)),
    l AS (SELECT *, CASE WHEN lx = 1 THEN bl ELSE greatest(10, CAST(trunc(bl * lx) AS INTEGER)) END AS line_chars FROM b, p),
    t AS (SELECT *, greatest(line_chars, CAST(trunc(bt * tx) AS INTEGER)) AS total_chars, cps * cx AS max_cps FROM l)
    SELECT profile, language, lang_group, mn AS min_duration, mx AS max_duration, greatest(1.0::DOUBLE, mn + 0.4::DOUBLE) AS ideal_min, least(mx, greatest(mn + 0.8::DOUBLE, 4.8::DOUBLE)) AS ideal_max, line_chars, total_chars, max_cps,
        CASE lang_group WHEN 'cjk' THEN 38 WHEN 'ko' THEN 44 ELSE total_chars + greatest(8, CAST(trunc(line_chars * 0.6::DOUBLE) AS INTEGER)) END AS soft_chars,
        CASE lang_group WHEN 'cjk' THEN least(total_chars, 30) WHEN 'ko' THEN least(total_chars, 34) ELSE total_chars * 0.72::DOUBLE END AS ideal_chars,
        least(max_cps, CASE lang_group WHEN 'ko' THEN 9.5::DOUBLE WHEN 'en' THEN 18.0::DOUBLE ELSE 8.5::DOUBLE END) AS target_cps,
        CASE WHEN lang_group = 'ko' AND mx < 5.8 THEN least(5.8::DOUBLE, mx + 1.8::DOUBLE) ELSE mx END AS timing_max,
        greatest(12.0::DOUBLE, mx * 1.8::DOUBLE) AS severe_duration, greatest(30.0::DOUBLE, mx * 4.0::DOUBLE) AS severe_gap FROM t
""")
def profile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(spark).drop("label", "gap_seconds", "long_chars", "force_chars", "comfort_cps")


@query("""SELECT profile, language, min_duration, CASE WHEN language = 'en' THEN 6.0::DOUBLE ELSE 6.5::DOUBLE END AS max_duration, line_chars FROM (VALUES
    ('youtube_long', 'zh', 1.2::DOUBLE, 18), ('youtube_long', 'zh-TW', 1.2, 18), ('youtube_long', 'ja', 1.2, 17), ('youtube_long', 'ko', 1.2, 20), ('youtube_long', 'en', 1.2, 42)) v(profile, language, min_duration, line_chars)""")
def job_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The defaults that a job form offers for each language."""
    most = F.when(F.col("language") == "en", 6.0).otherwise(F.col("max_duration"))
    return profiles(spark).where("profile = 'youtube_long'").select("profile", "language", "min_duration", most.alias("max_duration"), "line_chars")


@query("SELECT doc_id, lang, CASE WHEN lang IN ('zh', 'zh-TW') THEN 'cjk' WHEN lang IN ('ja', 'ko', 'en') THEN lang END AS lang_group, CASE WHEN lang NOT IN ('zh', 'zh-TW', 'ja', 'ko', 'en') THEN 'InputError' END AS error_class FROM documents")
def language_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = profiles(spark).where("profile = 'standard'").select(F.col("language").alias("lang"), "lang_group")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang").join(F.broadcast(groups), "lang", "left")
    return docs.select("doc_id", "lang", "lang_group", F.when(F.col("lang_group").isNull(), "InputError").alias("error_class"))


@query("""SELECT user_id, list_sort(list(value))[CAST(round_even((count(*) - 1) * 0.95, 0) AS BIGINT) + 1] AS p95, list_sort(list(value))[CAST(round_even((count(*) - 1) * 0.75, 0) AS BIGINT) + 1] AS p75, median(value) AS middle FROM events GROUP BY user_id""")
def nearest_rank_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.collect_list("value")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(nearest_rank(values, 0.95).alias("p95"), nearest_rank(values, 0.75).alias("p75"), F.median("value").alias("middle"))


# --- Boundaries ------------------------------------------------------------------------------------------------

_EN_WORD = r"^[0-9A-Za-z''\x{2019}-]$"
_OFFSETS = f"""
    ch AS (SELECT script_id, unnest(string_split(display_text, '')) AS c, unnest(range(length(display_text))) AS ix FROM scripts WHERE display_text <> ''),
    b AS (SELECT script_id, c AS r, ix, lag(c) OVER w AS l, last_value(CASE WHEN NOT regexp_matches(c, '^{WS}$') THEN c END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
        first_value(CASE WHEN NOT regexp_matches(c, '^{WS}$') THEN c END IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n,
        sum(CASE WHEN regexp_matches(c, '^{C.one_of(C.OPEN_QUOTES)}$') THEN 1 WHEN regexp_matches(c, '^{C.one_of(C.CLOSE_QUOTES)}$') THEN -1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s
        FROM ch WINDOW w AS (PARTITION BY script_id ORDER BY ix)),
    q AS (SELECT *, coalesce(s, 0) - least(0, min(coalesce(s, 0)) OVER (PARTITION BY script_id ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) > 0 AS quoted,
        coalesce(regexp_matches(l, '^{WS}$'), false) OR regexp_matches(r, '^{WS}$') AS space, coalesce(regexp_matches(l, '{_EN_WORD}'), false) AND regexp_matches(r, '{_EN_WORD}') AS inside FROM b),
    f AS (SELECT *, coalesce(regexp_matches(p, '^{C.one_of(C.STRONG + C.CLOSE_QUOTES)}$'), false) AS hard, coalesce(regexp_matches(p, '^{C.one_of(C.MID)}$'), false) AS soft FROM q),
"""
_BOUNDARIES = f"""WITH {EN} scripts AS (SELECT * FROM en), {_OFFSETS}
    z AS (SELECT *, CASE WHEN p IS NULL OR n IS NULL THEN 0.0::DOUBLE ELSE CASE WHEN hard THEN 18 WHEN soft THEN 10 ELSE 0 END - CASE WHEN regexp_matches(n, '^{C.one_of(C.STRONG + C.MID + C.CLOSE_QUOTES)}$') THEN 18 ELSE 0 END
        - CASE WHEN regexp_matches(p, '^{C.one_of(C.OPEN_QUOTES)}$') THEN 55 ELSE 0 END + CASE WHEN space THEN 34 ELSE 0 END - CASE WHEN inside THEN 90 ELSE 0 END END AS score FROM f)
"""


@query(
    _BOUNDARIES
    + """SELECT script_id, count(*) AS offsets, count(*) FILTER (p IS NOT NULL AND n IS NOT NULL AND NOT hard AND NOT soft AND inside) AS risky, count(*) FILTER (quoted) AS quoted,
        CAST(sum(score) AS DOUBLE) AS total_score, CAST(sum(score + CASE WHEN hard THEN 90 WHEN soft THEN 45 ELSE 0 END + CASE WHEN space THEN 34 ELSE 0 END - CASE WHEN inside THEN 90 ELSE 0 END) AS DOUBLE) AS total_move FROM z GROUP BY script_id"""
)
def boundary_scores_en(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every offset of every English script, scored; summed up by script."""
    b = boundaries(corpora.english_scripts(spark, sf_dir), "display_text").where("right <> ''")
    args = [F.lit("en"), F.col("prev"), F.col("nxt"), F.col("left"), F.col("right")]
    move = repair_score(*args, F.col("quoted"), F.lit(0))
    return b.groupBy("script_id").agg(
        F.count("*").alias("offsets"),
        F.count_if(high_risk(*args)).alias("risky"),
        F.count_if("quoted").alias("quoted"),
        F.sum(score(*args, F.col("quoted"))).alias("total_score"),
        F.sum(move).alias("total_move"),
    )


def _is(char: str, chars: str) -> str:
    return f"coalesce(regexp_matches({char}, '^{C.one_of(chars)}$'), false)"


def _of(char: str, *ranges: tuple[int, int]) -> str:
    return f"coalesce(regexp_matches({char}, '^{C.in_ranges(*ranges)}$'), false)"


def _translated(text: str, language: str) -> str:
    quoted = (corpora.DENSE_LETTERS[language] * 2).replace("'", "''")
    return f"translate({text}, '{corpora.LETTERS + corpora.LETTERS.upper()}', '{quoted}')"


_ZH_RISK = f"""CASE WHEN {_is("n", C.STRONG + C.MID)} THEN false WHEN {_is("p", C.OPEN_QUOTES)} OR p IN ('"', chr(39)) THEN {_of("n", *C.CJK)} OR {_is("n", C.ZH_QUOTE_FOLLOWERS)}
    WHEN {_is("n", C.CLOSE_QUOTES)} OR n IN ('"', chr(39)) THEN {_of("p", *C.CJK)} WHEN {_is("p", C.CLOSE_QUOTES)} OR p IN ('"', chr(39)) THEN {_is("n", C.ZH_QUOTE_FOLLOWERS)} ELSE false END"""
_JA_SCORE = f"""CASE WHEN {_of("p", *C.KATAKANA)} AND {_of("n", *C.KATAKANA)} OR {_of("p", *C.KANJI)} AND {_of("n", *C.KANJI)} THEN -78
    WHEN {_of("p", *C.KANJI)} AND {_of("n", *C.HIRAGANA)} AND NOT {_is("n", C.JA_EDGES)} OR {_of("p", *C.HIRAGANA)} AND {_of("n", *C.KANJI)} AND NOT {_is("p", C.JA_EDGES)} THEN -68
    WHEN {_of("p", *C.HIRAGANA)} AND {_of("n", *C.HIRAGANA)} THEN CASE WHEN {_is("p", C.JA_EDGES)} THEN 0 ELSE -48 END
    WHEN {_is("p", C.JA_NUMERALS)} AND ({_is("n", C.JA_NUMERALS)} OR {_is("n", C.JA_COUNTERS)}) OR {_is("p", C.JA_COUNTERS)} AND {_is("n", C.JA_NUMERALS)} THEN -78
    WHEN {_is("p", C.JA_LONG_MARKS)} OR {_is("n", C.JA_SMALL_KANA)} THEN -78 ELSE 0 END"""
_DENSE = f"""dense AS (SELECT doc_id AS script_id, CASE lang {" ".join(f"WHEN '{own}' THEN '{to}'" for own, to in corpora.DENSE_LANGUAGES.items())} END AS language,
        CASE lang {" ".join(f"WHEN '{own}' THEN {_translated('shown', to)}" for own, to in corpora.DENSE_LANGUAGES.items())} END AS display_text
        FROM (SELECT *, {_strip("regexp_replace(text, chr(13) || chr(10) || '|' || chr(13), chr(10), 'g')")} AS shown FROM documents WHERE lang IN ({", ".join(f"'{x}'" for x in corpora.DENSE_LANGUAGES)}))),"""


@query(f"""WITH {_DENSE} scripts AS (SELECT * FROM dense), {_OFFSETS}
    k AS (SELECT f.*, language, {_ZH_RISK} AS zh_risk, {_JA_SCORE} AS ja, {_of("p", *C.HANGUL)} AND {_of("n", *C.HANGUL)} AND NOT space AS pair, {_is("p", C.OPEN_QUOTES)} OR {_is("n", C.CLOSE_QUOTES)} AS beside
        FROM f JOIN dense USING (script_id)),
    s AS (SELECT *, CASE WHEN p IS NULL OR n IS NULL THEN 0 ELSE CASE WHEN hard THEN 18 WHEN soft THEN 10 ELSE 0 END - CASE WHEN {_is("n", C.STRONG + C.MID + C.CLOSE_QUOTES)} THEN 18 ELSE 0 END - CASE WHEN {_is("p", C.OPEN_QUOTES)} THEN 55 ELSE 0 END
            + CASE language WHEN 'zh' THEN CASE WHEN zh_risk THEN -95 ELSE -24 * {_is("p", C.ZH_EDGES)}::INT - 8 * {_is("n", C.ZH_EDGES)}::INT - 6 * ({_of("p", *C.CJK)} AND {_of("n", *C.CJK)})::INT END
                WHEN 'ko' THEN 34 * space::INT - 74 * pair::INT - 55 * beside::INT ELSE ja - CASE WHEN quoted AND NOT hard AND NOT soft THEN 28 ELSE 0 END END END AS score,
        CASE WHEN p IS NULL OR n IS NULL THEN false WHEN language = 'zh' THEN zh_risk WHEN hard OR soft THEN false WHEN language = 'ko' THEN beside OR pair ELSE beside OR ja <= -48 END AS risk,
        CASE language WHEN 'zh' THEN -24 * {_is("p", C.ZH_EDGES)}::INT - 8 * {_is("n", C.ZH_EDGES)}::INT - 90 * (p IS NOT NULL AND n IS NOT NULL AND zh_risk)::INT
            WHEN 'ko' THEN -70 * pair::INT + 24 * space::INT - 6 * quoted::INT ELSE 12 * {_is("p", C.JA_EDGES)}::INT - 38 * {_is("n", C.JA_EDGES)}::INT - 6 * quoted::INT END + CASE WHEN hard THEN 90 WHEN soft THEN 45 ELSE 0 END AS extra FROM k)
    SELECT script_id, language, count(*) AS offsets, count(*) FILTER (risk) AS risky, count(*) FILTER (quoted) AS quoted, CAST(sum(score) AS DOUBLE) AS total_score, CAST(sum(score + extra) AS DOUBLE) AS total_move FROM s GROUP BY script_id, language""")
def boundary_scores_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every offset of made Chinese, Korean and Japanese scripts, scored; summed up by script."""
    scripts = corpora.dense_scripts(spark, sf_dir)
    b = boundaries(scripts, "display_text").where("right <> ''").join(scripts.select("script_id", "language"), "script_id")
    group = F.when(F.col("language") == "zh", "cjk").otherwise(F.col("language"))
    args = [group, F.col("prev"), F.col("nxt"), F.col("left"), F.col("right")]
    return b.groupBy("script_id", "language").agg(
        F.count("*").alias("offsets"),
        F.count_if(high_risk(*args)).alias("risky"),
        F.count_if("quoted").alias("quoted"),
        F.sum(score(*args, F.col("quoted"))).alias("total_score"),
        F.sum(repair_score(*args, F.col("quoted"), F.lit(0))).alias("total_move"),
    )


# --- Tokens ----------------------------------------------------------------------------------------------------


@query(f"WITH {TOKENS} last AS (SELECT 1) SELECT script_id, ord, start, \"end\", start_char, end_char, confidence FROM tokens")
def word_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir).drop("text")


@query(f"""
    WITH {EN} c AS (SELECT script_id, unnest(string_split(display_text, '')) AS ch, unnest(range(length(display_text))) AS ix FROM en WHERE display_text <> ''),
    v AS (SELECT *, row_number() OVER (PARTITION BY script_id ORDER BY ix) - 1 AS place, count(*) OVER (PARTITION BY script_id) AS n FROM c WHERE NOT regexp_matches(ch, '^{WS}$'))
    SELECT script_id, count(*) AS tokens, max(10.0::DOUBLE + (place + 1) * (greatest(0.1::DOUBLE, 70.0::DOUBLE - 10.0::DOUBLE) / n)) AS last_end, CAST(sum(ix) AS BIGINT) AS sum_chars FROM v GROUP BY script_id
""")
def synthetic_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    scripts = corpora.english_scripts(spark, sf_dir).withColumn("start_time", F.lit(10.0)).withColumn("end_time", F.lit(70.0))
    return tok.synthetic(scripts).groupBy("script_id").agg(F.count("*").alias("tokens"), F.max("end").alias("last_end"), F.sum("start_char").alias("sum_chars"))


@query(f"""
    WITH {EN} c AS (SELECT script_id, unnest(string_split(display_text, '')) AS ch, unnest(range(length(display_text))) AS ix, length(display_text) AS n FROM en WHERE length(display_text) >= 8),
    v AS (SELECT *, CASE WHEN ix < n // 4 THEN 0 WHEN ix < n // 2 THEN 1 ELSE 2 END AS seg FROM c WHERE NOT regexp_matches(ch, '^{WS}$')),
    r AS (SELECT *, row_number() OVER (PARTITION BY script_id, seg ORDER BY ix) - 1 AS i, count(*) OVER (PARTITION BY script_id, seg) AS k FROM v),
    t AS (SELECT script_id, ix, ([0.0, 10.0, 15.0])[seg + 1]::DOUBLE + (i + 1) * (([10.0, 5.0, 25.0])[seg + 1]::DOUBLE / k) AS e FROM r)
    SELECT script_id, count(*) AS tokens, max(e) AS last_end, min(e) AS first_end FROM t GROUP BY script_id
""")
def interpolated_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters between anchors at a quarter and at half of each script."""
    scripts = corpora.english_scripts(spark, sf_dir).where("length(display_text) >= 8")
    n = F.length("display_text")
    at = F.array(*[F.struct(place.cast("int").alias("at"), F.lit(time).alias("time")) for place, time in ((F.lit(0), 0.0), (F.floor(n / 4), 10.0), (F.floor(n / 2), 15.0), (n, 40.0))])
    anchors = scripts.select("script_id", F.inline(at))
    return tok.interpolated(scripts, anchors).groupBy("script_id").agg(F.count("*").alias("tokens"), F.max("end").alias("last_end"), F.min("end").alias("first_end"))


STEPS = f"""{TOKENS}
    scripts AS (SELECT script_id, display_text, {_vis("display_text")} * 60 / 1000.0::DOUBLE AS audio_duration FROM en WHERE display_text <> ''),
    lagged AS (SELECT t.*, display_text, audio_duration, lag(end_char) OVER w AS pe, lag(start) OVER w AS ps, lag("end") OVER w AS pt, row_number() OVER w AS place
        FROM tokens t JOIN scripts USING (script_id) WINDOW w AS (PARTITION BY script_id ORDER BY start_char, end_char, start, ord)),
    stepped AS (SELECT *, CASE WHEN pe IS NOT NULL THEN {_span("pe", "end_char")} END AS step_chars, start - greatest(pt, ps) AS step_seconds FROM lagged),
    rated AS (SELECT *, step_chars / greatest(step_seconds, 0.02::DOUBLE) AS step_cps FROM stepped),
    ruled AS (SELECT *, start < ps - 0.12::DOUBLE OR "end" < pt - 0.12::DOUBLE AS reversal, step_chars > 0 AND step_seconds > 6 AND (step_chars <= 24 OR step_cps < 1.25) AS jump,
        step_chars >= 8 AND step_cps > 56.0::DOUBLE AS spike FROM rated),
    pairs AS (SELECT * FROM ruled WHERE end_char > pe),
"""
ANOMALIES = (
    STEPS
    + """
    anomalies AS (SELECT script_id, place, CASE WHEN reversal THEN greatest(0, pe - 1) ELSE pe END AS start_char, end_char,
        CASE WHEN reversal THEN 'time_reversal' WHEN jump THEN 'timestamp_jump' WHEN spike THEN 'cps_spike' END AS reason,
        CASE WHEN reversal OR jump THEN 'high' ELSE 'medium' END AS severity FROM pairs WHERE reversal OR jump OR spike),
"""
)


@query(f"WITH {ANOMALIES} last AS (SELECT 1) SELECT * FROM anomalies")
def token_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tok.anomalies(_tokens(spark, sf_dir), _scripts(spark, sf_dir))


def _runs_sql(test: str, least: int, kind: str, source: str = "pairs") -> str:
    return f"""SELECT script_id, min(place) AS place, min(start_char) AS start_char, max(end_char) AS end_char, '{kind}' AS reason, 'medium' AS severity FROM (
        SELECT *, sum(CASE WHEN {test} THEN 0 ELSE 1 END) OVER (PARTITION BY script_id ORDER BY place) AS island FROM {source}) WHERE {test}
        GROUP BY script_id, island, display_text HAVING {_span("min(start_char)", "max(end_char)")} >= {least}"""


_LOW, _ZERO = "coalesce(confidence < 0.12, false)", '("end" - start <= 0.02::DOUBLE)'


@query(f"WITH {STEPS} last AS (SELECT 1) {_runs_sql(_LOW, 18, 'low_confidence_run')}")
def low_confidence_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tok.runs(_tokens(spark, sf_dir), _scripts(spark, sf_dir), "low_confidence_run")


@query(f"WITH {STEPS} last AS (SELECT 1) {_runs_sql(_ZERO, 20, 'zero_duration_run')}")
def zero_duration_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tok.runs(_tokens(spark, sf_dir), _scripts(spark, sf_dir), "zero_duration_run")


_COLLAPSE = f"""collapse AS (SELECT script_id, place, start_char, length(display_text) AS end_char, 'end_collapse' AS reason, 'high' AS severity FROM (
        SELECT *, row_number() OVER (PARTITION BY script_id ORDER BY place) AS k FROM pairs WHERE start >= audio_duration - 0.5::DOUBLE AND {_span("start_char", "length(display_text)")} >= 80) WHERE k = 1),"""


@query(f"WITH {STEPS} {_COLLAPSE} last AS (SELECT 1) SELECT * FROM collapse")
def end_collapses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tok.end_collapse(_tokens(spark, sf_dir), _scripts(spark, sf_dir))


_SENTENCE = f"""grown AS (SELECT script_id, lo + length(regexp_extract(substr(display_text, CAST(lo + 1 AS BIGINT), CAST(start_char - lo AS BIGINT)), '(?s)^(.*{_ENDS})', 1)) AS start_char,
        CASE WHEN regexp_matches(substr(display_text, CAST(end_char + 1 AS BIGINT), CAST(hi - end_char AS BIGINT)), '{_ENDS}') THEN end_char + length(regexp_extract(substr(display_text, CAST(end_char + 1 AS BIGINT), CAST(hi - end_char AS BIGINT)), '(?s)^([^{_ENDS[1:-1]}]*{_ENDS})', 1)) ELSE hi END AS end_char, reason, severity
        FROM (SELECT *, greatest(0, start_char - 90) AS lo, least(length(display_text), end_char + 140) AS hi FROM raw JOIN scripts USING (script_id) WHERE end_char > start_char)),
    marked AS (SELECT *, CASE WHEN start_char > max(end_char) OVER (PARTITION BY script_id ORDER BY start_char, end_char ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 240 THEN 1 ELSE 0 END AS new FROM grown),
    grouped AS (SELECT *, sum(new) OVER (PARTITION BY script_id ORDER BY start_char, end_char ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM marked)"""


@query(f"""WITH {ANOMALIES} {_COLLAPSE}
    limited AS (SELECT p.* FROM pairs p LEFT JOIN (SELECT script_id, place AS stop FROM collapse) USING (script_id) WHERE stop IS NULL OR p.place <= stop),
    raw AS (SELECT a.* FROM anomalies a LEFT JOIN (SELECT script_id, place AS stop FROM collapse) USING (script_id) WHERE stop IS NULL OR a.place <= stop
        UNION ALL {_runs_sql(_LOW, 18, 'low_confidence_run', 'limited')} UNION ALL {_runs_sql(_ZERO, 20, 'zero_duration_run', 'limited')} UNION ALL SELECT * FROM collapse),
    {_SENTENCE}
    SELECT script_id, CAST(min(start_char) AS INTEGER) AS start_char, CAST(max(end_char) AS INTEGER) AS end_char, array_to_string(list_sort(list_distinct(list(reason))), ',') AS reasons, CASE WHEN bool_or(severity = 'high') THEN 'high' ELSE 'medium' END AS severity
    FROM grouped GROUP BY script_id, g""")
def suspect_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tok.suspects(_tokens(spark, sf_dir), _scripts(spark, sf_dir))
    return found.select("script_id", F.col("start_char").cast("int"), F.col("end_char").cast("int"), F.array_join("reasons", ",").alias("reasons"), "severity")


@query(f"""WITH {STEPS} d AS (SELECT script_id, count(*) AS mapped_token_count, min_by(start, place) AS first_token_time, max_by("end", place) AS last_token_time, count(*) FILTER (reversal) AS time_reversal_count,
        count(*) FILTER ("end" - start <= 0.02::DOUBLE) AS zero_duration_count, count(*) FILTER ({_LOW}) AS low_confidence_token_count, CAST(coalesce(sum(length(text)) FILTER ({_LOW}), 0) AS BIGINT) AS low_confidence_visible_chars,
        count(*) FILTER (jump) AS timestamp_jump_count, count(*) FILTER (spike) AS cps_spike_count, greatest(0.0::DOUBLE, coalesce(max(step_seconds), 0)) AS max_token_gap_seconds,
        coalesce(min_by({_span("start_char", "length(display_text)")}, place) FILTER (start >= audio_duration - 0.5::DOUBLE), 0) AS end_collapse_visible_chars, sum(length(text)) / max({_vis("display_text")}) AS text_coverage_ratio FROM ruled GROUP BY script_id)
    SELECT *, mapped_token_count AS token_count FROM d""")
def token_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tok.diagnostics(_tokens(spark, sf_dir), _scripts(spark, sf_dir))


# --- As-of, overlap and drift ----------------------------------------------------------------------------------


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges at every hundredth character of each script, 40 characters long."""
    scripts = _scripts(spark, sf_dir)
    starts = F.sequence(F.lit(0), F.length("display_text") - 1, F.lit(100))
    ranges = scripts.select("script_id", "audio_duration", F.length("display_text").alias("n"), F.posexplode(starts).alias("range_id", "start_char"))
    return ranges.withColumn("end_char", F.least("n", F.col("start_char") + 40)).drop("n")


_RANGES = "ranges AS (SELECT script_id, audio_duration, start_char // 100 AS range_id, start_char, least(length(display_text), start_char + 40) AS end_char FROM (SELECT *, unnest(range(0, length(display_text), 100)) AS start_char FROM scripts)),"


@query(f"""WITH {STEPS} {_RANGES}
    cover AS (SELECT r.script_id, r.range_id, min(t.start) AS f, max(t."end") AS e FROM ranges r JOIN tokens t ON r.script_id = t.script_id AND t.end_char > r.start_char AND t.start_char < r.end_char GROUP BY ALL)
    SELECT r.script_id, r.range_id, greatest(0.0::DOUBLE, coalesce(f, 0)) AS audio_start, least(r.audio_duration, e) AS audio_end FROM ranges r JOIN cover USING (script_id, range_id)""")
def audio_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audio window of each range that tokens overlap."""
    ranges, tokens = written(_points(spark, sf_dir), "ranges"), written(_tokens(spark, sf_dir), "tokens")  # read three times each
    covered = iv.overlapping(ranges, tokens).select("script_id", "range_id").distinct()
    return iv.audio_window(ranges, tokens).join(covered, ["script_id", "range_id"], "left_semi").select("script_id", "range_id", "audio_start", "audio_end")


@query(f"""WITH {STEPS} {_RANGES} b AS (SELECT r.script_id, r.range_id, max_by(t."end", t.end_char) AS before_end FROM ranges r JOIN tokens t ON r.script_id = t.script_id AND t.end_char <= r.start_char AND (confidence IS NULL OR confidence >= 0.2) GROUP BY ALL),
    a AS (SELECT r.script_id, r.range_id, min_by(t.start, t.start_char) AS after_start FROM ranges r JOIN tokens t ON r.script_id = t.script_id AND t.start_char >= r.end_char AND (confidence IS NULL OR confidence >= 0.2) GROUP BY ALL)
    SELECT r.script_id, r.range_id, before_end, after_start FROM ranges r LEFT JOIN b USING (script_id, range_id) LEFT JOIN a USING (script_id, range_id)""")
def nearest_trusted_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = _tokens(spark, sf_dir).where("confidence IS NULL OR confidence >= 0.2")
    before = iv.as_of(_points(spark, sf_dir), trusted, "start_char", "end_char", ["end"])
    both = iv.as_of(before, trusted, "end_char", "start_char", ["start"], forward=True)
    return both.select("script_id", "range_id", F.col("near_end").alias("before_end"), F.col("near_start").alias("after_start"))


@query(f"""WITH {STEPS} {_RANGES} kept AS (SELECT t.* FROM tokens t WHERE NOT EXISTS (SELECT 1 FROM ranges r WHERE r.script_id = t.script_id AND r.range_id % 3 = 1 AND t.end_char > r.start_char AND t.start_char < r.end_char))
    SELECT script_id, count(*) AS kept, CAST(sum(ord) AS BIGINT) AS sum_ord FROM (SELECT script_id, ord FROM kept UNION ALL SELECT script_id, -1 FROM ranges WHERE range_id % 3 = 1) GROUP BY script_id""")
def replaced_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens with every third range replaced by one token."""
    tokens = _tokens(spark, sf_dir)
    ranges = _points(spark, sf_dir).where("range_id % 3 = 1")
    new = ranges.select("script_id", F.lit(-1).alias("ord"), F.lit("x").alias("text"), F.lit(0.0).alias("start"), F.lit(0.1).alias("end"), "start_char", "end_char", F.lit(0.9).alias("confidence"))
    return iv.replace_in_ranges(tokens, ranges, new).groupBy("script_id").agg(F.count("*").alias("kept"), F.sum("ord").cast("long").alias("sum_ord"))


_SAMPLES = """samples AS (SELECT script_id, ord, ord // 50 AS checkpoint, start_char, end_char,
        (round_even(start * 1000, 0) + 400 * (ord // 50 % 5)) / 1000.0::DOUBLE + 0.1::DOUBLE
        - (start + ("end" - start) * ((greatest(start_char, least(end_char - 1, (start_char + end_char - 1) // 2)) + 0.5::DOUBLE - start_char) / (end_char - start_char))) AS signed_drift FROM tokens),"""


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift of every word's second timing, late by a rule, against the timeline."""
    bounded_batches(spark)
    return drift.samples(corpora.english_scripts(spark, sf_dir), _late_middle)


def _late_middle(line: Timeline) -> np.ndarray:
    return (np.rint(line.start * 1000) + 400 * (np.arange(len(line)) // 50 % 5)) / 1000.0 + 0.1


@query(f"""WITH {TOKENS} {_SAMPLES} last AS (SELECT 1) SELECT script_id, ord, round(signed_drift, 6) AS signed_drift FROM samples""")
def drift_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(spark, sf_dir).select("script_id", "ord", rounded(F.col("signed_drift"), 6).alias("signed_drift"))


@query(f"""WITH {TOKENS} {_SAMPLES} s AS (SELECT script_id, checkpoint, count(*) AS sample_count, round(median(abs(signed_drift)), 9) AS median_drift, round(list_sort(list(abs(signed_drift)))[CAST(round_even((count(*) - 1) * 0.95, 0) AS BIGINT) + 1], 9) AS p95_drift, round(max(abs(signed_drift)), 9) AS max_drift FROM samples GROUP BY ALL HAVING count(*) >= 4)
    SELECT *, CASE WHEN median_drift >= 1 OR p95_drift >= 1.5 AND median_drift >= 0.35 THEN 'high' WHEN median_drift >= 0.75 OR p95_drift >= 1.25 AND median_drift >= 0.25 THEN 'medium' ELSE 'ok' END AS severity FROM s""")
def checkpoint_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = tok.checkpoint_stats(_samples(spark, sf_dir))
    return stats.select("script_id", "checkpoint", "sample_count", *[rounded(F.col(c), 9).alias(c) for c in ("median_drift", "p95_drift", "max_drift")], "severity")


@query(f"""WITH {TOKENS} {_SAMPLES} h AS (SELECT *, abs(signed_drift) >= 0.65::DOUBLE AS hit, CASE WHEN signed_drift >= 0 THEN 1 ELSE -1 END AS sign FROM samples),
    x AS (SELECT *, lag(hit) OVER w AS lh, lag(sign) OVER w AS ls, max(CASE WHEN hit THEN end_char END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM h WINDOW w AS (PARTITION BY script_id ORDER BY start_char, end_char)),
    r AS (SELECT *, sum(CASE WHEN coalesce(NOT lh OR ls <> sign OR start_char > reach + 40, true) THEN 1 ELSE 0 END) OVER (PARTITION BY script_id ORDER BY start_char, end_char) AS run FROM x)
    SELECT script_id, min(start_char) AS start_char, max(end_char) AS end_char, count(*) AS sample_count FROM r WHERE hit GROUP BY script_id, run HAVING count(*) >= 2""")
def drift_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of drifting samples with one sign and at most 40 characters between."""
    w = Window.partitionBy("script_id").orderBy("start_char", "end_char")
    s = _samples(spark, sf_dir).withColumn("hit", F.abs("signed_drift") >= 0.65).withColumn("sign", F.when(F.col("signed_drift") >= 0, 1).otherwise(-1))
    reach = F.max(F.when(F.col("hit"), F.col("end_char"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(~F.lag("hit").over(w) | (F.lag("sign").over(w) != F.col("sign")) | (F.col("start_char") > reach + 40), F.lit(True))
    runs = s.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(w)).where("hit").groupBy("script_id", "run")
    return runs.agg(F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char"), F.count("*").alias("sample_count")).where("sample_count >= 2").drop("run")


@query(f"""WITH {TOKENS} late AS (SELECT *, start + 0.9::DOUBLE * (ord // 40 % 3) AS ls FROM tokens),
    x AS (SELECT script_id, start_char, end_char, (ls + (ls + 0.2::DOUBLE)) / 2
        - (start + ("end" - start) * ((greatest(start_char, least(end_char - 1, (start_char + end_char - 1) // 2)) + 0.5::DOUBLE - start_char) / (end_char - start_char))) AS d FROM late),
    h AS (SELECT *, abs(d) AS size, abs(d) >= 0.65::DOUBLE AS hit, d >= 0 AS later FROM x),
    g AS (SELECT *, lag(hit) OVER w AS lh, lag(later) OVER w AS ll, max(CASE WHEN hit THEN end_char END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM h WINDOW w AS (PARTITION BY script_id ORDER BY start_char, end_char)),
    r AS (SELECT *, sum(CASE WHEN coalesce(NOT lh OR ll <> later OR start_char > reach + 4, true) THEN 1 ELSE 0 END) OVER (PARTITION BY script_id ORDER BY start_char, end_char) AS run FROM g),
    t AS (SELECT script_id, run, min(start_char) AS start_char, max(end_char) AS end_char, count(*) AS sample_count, median(size) AS median_drift, list_sort(list(size))[CAST(round_even((count(*) - 1) * 0.75, 0) AS BIGINT) + 1] AS p75_drift,
        max(size) AS max_drift, median(d) AS signed_median_drift FROM r WHERE hit GROUP BY script_id, run HAVING count(*) >= 6),
    v AS (SELECT t.*, {_span("start_char", "end_char")} AS visible_chars FROM t JOIN en USING (script_id)),
    c AS (SELECT *, median_drift * 2 + p75_drift + least(2.0::DOUBLE, visible_chars / 24) AS score FROM v WHERE visible_chars >= 12 AND (median_drift >= 0.75 OR p75_drift >= 1.05)),
    best AS (SELECT *, row_number() OVER (PARTITION BY script_id ORDER BY round(score, 9) DESC, start_char, run) AS place FROM c)
    SELECT script_id, start_char, end_char, sample_count, visible_chars, round(median_drift, 6) AS median_drift, round(p75_drift, 6) AS p75_drift, round(max_drift, 6) AS max_drift, round(signed_median_drift, 6) AS signed_median_drift, round(score, 6) AS score FROM best WHERE place = 1""")
def strongest_drift_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest drift run of each script, over the timings of all words."""
    tokens = _tokens(spark, sf_dir)
    late = tokens.withColumn("start", F.col("start") + 0.9 * F.pmod(F.floor(F.col("ord") / 40), F.lit(3))).withColumn("end", F.col("start") + 0.2)
    found = tok.drift_runs(iv.drift_samples(late.select("script_id", "ord", "start", "end", "start_char", "end_char"), tokens), corpora.english_scripts(spark, sf_dir))
    measures = ("median_drift", "p75_drift", "max_drift", "signed_median_drift", "score")
    return found.select("script_id", "start_char", "end_char", "sample_count", "visible_chars", *[rounded(F.col(c), 6).alias(c) for c in measures])


# --- Cues ------------------------------------------------------------------------------------------------------


@query(f"WITH {CUES} last AS (SELECT 1) SELECT script_id, idx, duration, chars, cps, gap_before, gap_after, near_max FROM m")
def cue_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cue_ops.measured(_cues(spark, sf_dir)).select("script_id", "idx", "duration", "chars", "cps", "gap_before", "gap_after", "near_max")


@query(f"""WITH {CUES} last AS (SELECT 1) SELECT script_id, idx, array_to_string(list_filter([CASE WHEN duration < min_duration THEN 'too_short' END, CASE WHEN duration > max_duration + 0.001::DOUBLE THEN 'too_long' END,
    CASE WHEN cps > max_cps THEN 'fast_reading' END, CASE WHEN chars > total_chars THEN 'cue_too_long' END, CASE WHEN gap_before < 0 THEN 'overlap' END], lambda x: x IS NOT NULL), ',') AS warnings FROM m""")
def cue_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cue_ops.warnings(_cues(spark, sf_dir)).select("script_id", "idx", F.array_join("warnings", ",").alias("warnings"))


@query(f"""WITH {CUES} s AS (SELECT script_id, idx, greatest(0.0::DOUBLE, start) AS s, greatest(greatest(0.0::DOUBLE, start) + 0.1::DOUBLE, "end") AS e, lead(start) OVER (PARTITION BY script_id ORDER BY idx) AS nx FROM cues)
    SELECT script_id, idx, s AS start, CASE WHEN e > nx - 0.08::DOUBLE AND nx - 0.08::DOUBLE > s + 0.1::DOUBLE THEN nx - 0.08::DOUBLE WHEN e > nx THEN nx ELSE e END AS "end" FROM s""")
def clamped_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cue_ops.clamp_timing(_cues(spark, sf_dir)).select("script_id", "idx", "start", "end")


@query(f"""WITH {CUES} f AS (SELECT *, near_max AND chars < total_chars * 0.65::DOUBLE AS sparse, coalesce(lag(near_max AND chars < total_chars * 0.65::DOUBLE) OVER w, false) AS lsparse,
        coalesce(near_max AND chars < total_chars * 0.75::DOUBLE OR gap_after > 0.8::DOUBLE, false) AS weak, start - lag("end") OVER w AS g, count(*) OVER (PARTITION BY script_id) AS n FROM m WINDOW w AS (PARTITION BY script_id ORDER BY idx)),
    b AS (SELECT *, coalesce(lag(weak, 1) OVER w, false) AS w1, coalesce(lag(weak, 2) OVER w, false) AS w2, coalesce(lag(weak, 3) OVER w, false) AS w3,
        CASE WHEN duration > 12.0 THEN printf('cue_too_long:%.3fs', duration) WHEN chars > total_chars AND duration <= 0.5 THEN printf('cue_too_fast:%.3fcps', cps) WHEN chars > total_chars AND cps > 80 THEN printf('cue_cps_spike:%.3fcps', cps)
            WHEN g > 2.7::DOUBLE AND (sparse OR lsparse) THEN printf('suspicious_gap:%.3fs', g) WHEN g > 30 THEN printf('large_gap:%.3fs', g) WHEN g < -0.1::DOUBLE THEN 'overlap' END AS reason FROM f WINDOW w AS (PARTITION BY script_id ORDER BY idx))
    SELECT script_id, idx AS break_idx, idx - CASE WHEN NOT w1 THEN 0 WHEN NOT w2 THEN 1 WHEN NOT w3 THEN 2 ELSE 3 END AS start_idx, reason FROM b WHERE n > 1 AND reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY script_id ORDER BY idx) = 1""")
def timeline_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cue_ops.timeline_breaks(_cues(spark, sf_dir))


_TEXTS = "texts AS (SELECT script_id, string_agg(text, ' ' ORDER BY idx) AS display_text FROM cues GROUP BY script_id),"
_RISK = f"""{CUES} {_TEXTS} u AS (SELECT m.*, gap_after IS NOT NULL AND coalesce(regexp_matches(substr(display_text, end_char, 1), '{_EN_WORD}') AND regexp_matches(substr(display_text, end_char + 1, 1), '{_EN_WORD}'), false) AND end_char > 0 AS unsafe_end,
        count(*) OVER three = 3 AND bool_and(near_max) OVER three AND avg(chars) OVER three > 68 AS dense, max(idx) OVER (PARTITION BY script_id) AS last
        FROM m JOIN texts USING (script_id) WINDOW three AS (PARTITION BY script_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
    risks AS (SELECT script_id, idx, greatest(1, idx - 1) AS first_idx, least(last, idx + 1) AS last_idx, list_sort(list_filter([CASE WHEN gap_after > 1.5 THEN 'en_severe_gap' END, CASE WHEN gap_after > 0.8::DOUBLE AND (near_max OR chars > 84) THEN 'en_long_cue_gap' END,
        CASE WHEN cps > 28 OR cps > 20 AND chars > 18 THEN 'en_fast_cue' END, CASE WHEN unsafe_end THEN 'en_word_boundary' END, CASE WHEN dense THEN 'en_maxed_duration_cluster' END], lambda x: x IS NOT NULL)) AS reasons,
        CASE WHEN coalesce(gap_after > 1.5, false) OR coalesce(gap_after > 0.8::DOUBLE AND (near_max OR chars > 84), false) OR cps > 28 THEN 'high' ELSE 'medium' END AS severity FROM u WHERE last > 1),
    risky AS (SELECT * FROM risks WHERE len(reasons) > 0),"""


def _texts(cues: DataFrame) -> DataFrame:
    return corpora.conversation_scripts(cues)


@query(f"WITH {_RISK} last AS (SELECT 1) SELECT script_id, idx, first_idx, last_idx, array_to_string(reasons, ',') AS reasons, severity FROM risky")
def cue_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = _cues(spark, sf_dir)
    return cue_ops.cue_risks(cues, _texts(cues)).withColumn("reasons", F.array_join("reasons", ","))


_MERGED = f"""{_RISK} mk AS (SELECT *, CASE WHEN first_idx > max(last_idx) OVER (PARTITION BY script_id ORDER BY first_idx, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS new FROM risky),
    gr AS (SELECT *, sum(new) OVER (PARTITION BY script_id ORDER BY first_idx, idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM mk),
    mg AS (SELECT script_id, min(first_idx) AS first_idx, max(last_idx) AS last_idx, array_to_string(list_sort(list_distinct(flatten(list(reasons)))), ',') AS reasons, CASE WHEN bool_or(severity = 'high') THEN 'high' ELSE 'medium' END AS severity FROM gr GROUP BY script_id, g),
    pl AS (SELECT mg.*, a.start_char, b.end_char, greatest(0.0::DOUBLE, a.start) AS audio_start, least(t.most, greatest(b."end", greatest(0.0::DOUBLE, a.start) + 0.5::DOUBLE)) AS audio_end FROM mg
        JOIN cues a ON a.script_id = mg.script_id AND a.idx = first_idx JOIN cues b ON b.script_id = mg.script_id AND b.idx = last_idx JOIN (SELECT script_id, max("end") AS most FROM cues GROUP BY script_id) t ON t.script_id = mg.script_id),
    top AS (SELECT *, row_number() OVER (PARTITION BY script_id ORDER BY severity <> 'high', audio_start, first_idx) AS index FROM pl),"""


@query(f"WITH {_MERGED} last AS (SELECT 1) SELECT script_id, index, first_idx, last_idx, reasons, severity, start_char, end_char, audio_start, audio_end FROM top WHERE index <= 4")
def merged_cue_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = _cues(spark, sf_dir)
    found = cue_ops.merged_cue_risks(cues, _texts(cues))
    return found.withColumn("reasons", F.array_join("reasons", ",")).select("script_id", "index", "first_idx", "last_idx", "reasons", "severity", "start_char", "end_char", "audio_start", "audio_end")


@query(f"""WITH {_MERGED} last AS (SELECT 1) SELECT * EXCLUDE (fixed) FROM (SELECT script_id, index, first_idx, last_idx, (first_idx % 2 = 0) AS fixed FROM top WHERE severity = 'high') WHERE NOT fixed""")
def unresolved_cue_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High risks whose exact span isn't among the repaired ones (here: those that begin at an even cue)."""
    cues = _cues(spark, sf_dir)
    risks = cue_ops.merged_cue_risks(cues, _texts(cues), keep=None).where("severity = 'high'")
    done = risks.where("first_idx % 2 = 0").select("script_id", "start_char", "end_char")
    return risks.join(done, ["script_id", "start_char", "end_char"], "left_anti").select("script_id", "index", "first_idx", "last_idx")


_SCORE = """CASE WHEN near_max AND chars <= 54 THEN 4.0::DOUBLE + (54 - chars) / 54 ELSE 0 END + CASE WHEN near_max AND (pb OR nb) THEN 3.0::DOUBLE ELSE 0 END + CASE WHEN near_max AND ns AND nc >= 12 THEN 2.4::DOUBLE ELSE 0 END
    + CASE WHEN pb AND os AND chars >= 12 THEN 2.2::DOUBLE ELSE 0 END + CASE WHEN near_max AND ga > 0.35::DOUBLE THEN least(2.0::DOUBLE, ga) ELSE 0 END + CASE WHEN pb AND gb > 0.35::DOUBLE THEN least(1.6::DOUBLE, gb) ELSE 0 END
    + CASE WHEN duration >= 5.75 AND chars >= 28 AND cps < 5 THEN 1.2::DOUBLE ELSE 0 END"""
_MICRO = f"""WITH {CUES} x AS (SELECT *, coalesce(lag(near_max) OVER w, false) AS pb, coalesce(lead(near_max) OVER w, false) AS nb, coalesce(lead(duration) OVER w <= 3.3::DOUBLE, false) AS ns, coalesce(lead(chars) OVER w, 0) AS nc, coalesce(gap_after, 0) AS ga, coalesce(gap_before, 0) AS gb, max(idx) OVER (PARTITION BY script_id) AS last FROM m WINDOW w AS (PARTITION BY script_id ORDER BY idx)),
    r AS (SELECT *, duration <= least(3.4::DOUBLE, 6.0::DOUBLE * 0.55::DOUBLE) OR duration <= 1.2::DOUBLE + 1.4::DOUBLE AS os FROM x),
    s AS (SELECT script_id, idx, last, pb, os, ns, near_max, {_SCORE} AS score, list_sort(list_filter([CASE WHEN near_max AND chars <= 54 THEN 'micro_sparse_maxed_cue' END, CASE WHEN near_max AND (pb OR nb) THEN 'micro_consecutive_maxed_cues' END, CASE WHEN near_max AND ns AND nc >= 12 THEN 'micro_maxed_then_short_cue' END,
        CASE WHEN pb AND os AND chars >= 12 THEN 'micro_short_after_maxed_cue' END, CASE WHEN near_max AND ga > 0.35::DOUBLE THEN 'micro_gap_after_maxed_cue' END, CASE WHEN pb AND gb > 0.35::DOUBLE THEN 'micro_gap_before_after_maxed_cue' END,
        CASE WHEN duration >= 5.75 AND chars >= 28 AND cps < 5 THEN 'micro_low_cps_long_cue' END], lambda x: x IS NOT NULL)) AS reasons, CASE WHEN near_max AND (chars <= 54 OR pb OR nb) THEN 'high' ELSE 'medium' END AS severity FROM r),
    found AS (SELECT script_id, idx, greatest(1, idx - CASE WHEN pb AND os THEN 2 ELSE 1 END) AS first_idx, least(last, idx + CASE WHEN near_max AND ns THEN 2 ELSE 1 END) AS last_idx, reasons, severity, score FROM s WHERE len(reasons) > 0 AND last > 1)"""


@query(f"{_MICRO} SELECT script_id, idx, first_idx, last_idx, array_to_string(reasons, ',') AS reasons, severity, round(score, 6) AS score FROM found")
def micro_drift_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cue_ops.micro_candidates(_cues(spark, sf_dir)).withColumn("reasons", F.array_join("reasons", ",")).withColumn("score", F.round("score", 6))


@query(f"""{_MICRO},
    texts AS (SELECT script_id, string_agg(text, ' ' ORDER BY idx) AS display_text FROM cues GROUP BY script_id),
    c AS (SELECT s.script_id, s.idx, first_idx, last_idx, reasons, severity, score, a.start_char AS ac, a.start AS first_start, b.end_char AS bc, b."end" AS last_end, display_text
        FROM found s JOIN cues a ON a.script_id = s.script_id AND a.idx = s.first_idx JOIN cues b ON b.script_id = s.script_id AND b.idx = s.last_idx JOIN texts t ON t.script_id = s.script_id),
    lo AS (SELECT *, greatest(0, ac - 90) AS lo, least(length(display_text), bc + 120) AS hi FROM c),
    g AS (SELECT *, lo + length(regexp_extract(substr(display_text, CAST(lo + 1 AS BIGINT), CAST(ac - lo AS BIGINT)), '(?s)^(.*{_ENDS})', 1)) AS a,
        CASE WHEN regexp_matches(substr(display_text, CAST(bc + 1 AS BIGINT), CAST(hi - bc AS BIGINT)), '{_ENDS}') THEN bc + length(regexp_extract(substr(display_text, CAST(bc + 1 AS BIGINT), CAST(hi - bc AS BIGINT)), '(?s)^([^{_ENDS[1:-1]}]*{_ENDS})', 1)) ELSE hi END AS b FROM lo),
    part AS (SELECT *, substr(display_text, CAST(a + 1 AS BIGINT), CAST(greatest(b - a, 0) AS BIGINT)) AS part FROM g),
    trimmed AS (SELECT *, a + length(part) - length(regexp_replace(part, '^{WS}+', '')) AS start_char, b - length(part) + length(regexp_replace(part, '{WS}+$', '')) AS end_char FROM part WHERE regexp_replace(part, '{WS}+', '', 'g') <> ''),
    mk AS (SELECT *, CASE WHEN start_char > max(end_char) OVER (PARTITION BY script_id ORDER BY start_char, end_char, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 40 THEN 1 ELSE 0 END AS new FROM trimmed),
    gr AS (SELECT *, sum(new) OVER (PARTITION BY script_id ORDER BY start_char, end_char, idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM mk),
    mg AS (SELECT script_id, CAST(min(start_char) AS INTEGER) AS start_char, CAST(max(end_char) AS INTEGER) AS end_char, min(first_idx) AS first_idx, max(last_idx) AS last_idx, round(max(score), 6) AS score,
        array_to_string(list_sort(list_distinct(flatten(list(reasons)))), ',') AS reasons, CASE WHEN bool_or(severity = 'high') THEN 'high' ELSE 'medium' END AS severity, min(greatest(0.0::DOUBLE, first_start)) AS audio_start, max(greatest(last_end, first_start + 0.5::DOUBLE)) AS audio_end FROM gr GROUP BY script_id, grp),
    top AS (SELECT *, row_number() OVER (PARTITION BY script_id ORDER BY severity <> 'high', score DESC, start_char) AS index FROM mg)
    SELECT * FROM top WHERE index <= 16""")
def merged_micro_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = _cues(spark, sf_dir)
    found = cue_ops.merged_micro_candidates(cues, _texts(cues)).withColumn("reasons", F.array_join("reasons", ","))
    return found.withColumns({"score": F.round("score", 6), "start_char": F.col("start_char").cast("int"), "end_char": F.col("end_char").cast("int")})


_REPORT = f"""{_RISK} q AS (SELECT script_id, count(*) AS subtitle_count, avg(duration) AS avg_subtitle_duration, min(duration) AS min_subtitle_duration, max(duration) AS max_subtitle_duration, avg(cps) AS avg_chars_per_second, max(cps) AS max_chars_per_second,
        list_sort(list(cps))[CAST(round_even((count(*) - 1) * 0.95, 0) AS BIGINT) + 1] AS p95_chars_per_second, max(chars) AS max_chars_per_cue, count(*) FILTER (gap_after > 0.8::DOUBLE) AS large_gap_count, coalesce(max(gap_after), 0) AS max_gap_seconds,
        count(*) FILTER (NOT (chars = 0 OR regexp_matches(regexp_extract(text, '(?s)([^{WS[1:-1]}]){WS}*$', 1), '^{NATURAL}$'))) AS weak_boundary_count, count(*) FILTER (gap_after < 0) AS overlap_count, count(*) FILTER (duration < 1.2::DOUBLE) AS too_short_count,
        count(*) FILTER (duration > 6.0::DOUBLE + 0.001::DOUBLE) AS too_long_count, count(*) FILTER (chars = 0) AS empty_subtitle_count, count(*) FILTER (cps > 20) AS fast, count(*) FILTER (chars > 84) AS crowded FROM u GROUP BY script_id),
    scored AS (SELECT *, CAST(greatest(0, least(100, 100 - (overlap_count * 18 + too_short_count * 6 + too_long_count * 6 + empty_subtitle_count * 12 + fast * 4 + crowded * 3 + large_gap_count * 4 + weak_boundary_count * 2))) AS INTEGER) AS quality_score FROM q),"""


@query(f"WITH {_REPORT} last AS (SELECT 1) SELECT * EXCLUDE (fast, crowded), 0.0::DOUBLE AS unaligned_text_ratio, (overlap_count > 0)::INT + (too_short_count > 0)::INT + (too_long_count > 0)::INT + (fast > 0)::INT + (crowded > 0)::INT + (large_gap_count > 0)::INT AS warning_count FROM scored")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = _cues(spark, sf_dir)
    report = cue_ops.quality(cues, _texts(cues))
    dense = [c for c in report.columns if c.startswith(("zh_", "ko_"))]
    return report.withColumn("warning_count", F.size("warnings")).drop("warnings", "suspicious_gap_count", *dense)


_DENSE_CUES = CUES + f"""
    d AS (SELECT *, script_id % 2 = 0 AS zh, CASE WHEN script_id % 2 = 0 THEN {_translated("text", "zh")} ELSE {_translated("text", "ko")} END AS shown FROM m),
    texts AS (SELECT script_id, string_agg(shown, ' ' ORDER BY idx) AS display_text FROM d GROUP BY script_id),
    e AS (SELECT d.*, regexp_extract(substr(display_text, 1, end_char), '(?s)([^{WS[1:-1]}]){WS}*$', 1) AS p0, regexp_extract(substr(display_text, end_char + 1), '(?s)^{WS}*([^{WS[1:-1]}])', 1) AS n0,
        CASE WHEN end_char > 0 THEN substr(display_text, end_char, 1) ELSE '' END AS l, substr(display_text, end_char + 1, 1) AS r FROM d JOIN texts USING (script_id)),
    o AS (SELECT *, nullif(p0, '') AS p, nullif(n0, '') AS n, regexp_matches(l, '^{WS}$') OR regexp_matches(r, '^{WS}$') AS space FROM e),
    u AS (SELECT *, gap_after IS NOT NULL AND p IS NOT NULL AND n IS NOT NULL AND CASE WHEN zh THEN {_ZH_RISK} WHEN {_is("p", C.STRONG + C.MID + C.CLOSE_QUOTES)} THEN false
            ELSE {_is("p", C.OPEN_QUOTES)} OR {_is("n", C.CLOSE_QUOTES)} OR ({_of("p", *C.HANGUL)} AND {_of("n", *C.HANGUL)} AND NOT space) END AS unsafe,
        NOT (regexp_extract(shown, '(?s)([^{WS[1:-1]}]){WS}*$', 1) = '' OR regexp_matches(regexp_extract(shown, '(?s)([^{WS[1:-1]}]){WS}*$', 1), '^{NATURAL}$')) AS unnatural,
        coalesce(gap_after > 0.8::DOUBLE AND (chars > CASE WHEN zh THEN 34 ELSE 38 END OR near_max), false) AS wide FROM o),"""


@query(f"""WITH {_DENSE_CUES} q AS (SELECT script_id, zh, count(*) FILTER (zh AND chars > 34) AS zh_long_cue_count, count(*) FILTER (zh AND cps > 8.5) AS zh_fast_cue_count, count(*) FILTER (zh AND unsafe) AS zh_unsafe_boundary_count,
        count(*) FILTER (zh AND wide) AS zh_large_gap_after_long_cue_count, CAST(sum(CASE WHEN zh THEN unsafe::INT + (wide OR coalesce(gap_after > 1.5, false))::INT + (cps > 9.5)::INT ELSE 0 END) AS BIGINT) AS zh_timeline_risk_count,
        count(*) FILTER (NOT zh AND chars > 38) AS ko_long_cue_count, count(*) FILTER (NOT zh AND cps > 9.5) AS ko_fast_cue_count, count(*) FILTER (NOT zh AND unsafe) AS ko_unsafe_boundary_count,
        CAST(sum(CASE WHEN zh THEN 0 ELSE unsafe::INT + (wide OR coalesce(gap_after > 1.5, false))::INT + (cps > 10.5)::INT END) AS BIGINT) AS ko_timeline_risk_count, CAST(sum(unsafe::INT + (zh AND unnatural)::INT) AS BIGINT) AS weak_boundary_count,
        count(*) FILTER (gap_after > 0.8::DOUBLE) AS gaps, count(*) FILTER (gap_after < 0) AS n_overlaps, count(*) FILTER (duration < 1.2::DOUBLE) AS n_shorts, count(*) FILTER (duration > 6.0::DOUBLE + 0.001::DOUBLE) AS n_longs, count(*) FILTER (chars = 0) AS n_empties,
        count(*) FILTER (cps > CASE WHEN zh THEN 8.5 ELSE 10.5 END) AS fast, count(*) FILTER (chars > CASE WHEN zh THEN 34 ELSE 38 END) AS n_crowded FROM u GROUP BY script_id, zh)
    SELECT * EXCLUDE (zh, gaps, n_overlaps, n_shorts, n_longs, n_empties, fast, n_crowded), CAST(greatest(0, least(100, 100 - (n_overlaps * 18 + n_shorts * 6 + n_longs * 6 + n_empties * 12 + fast * 4 + n_crowded * 3 + gaps * 4 + weak_boundary_count * 2 + zh_fast_cue_count * 4
            + zh_large_gap_after_long_cue_count * 6 + zh_unsafe_boundary_count * 5 + zh_timeline_risk_count * 6 + ko_fast_cue_count * 4 + ko_unsafe_boundary_count * 5 + ko_timeline_risk_count * 6))) AS INTEGER) AS quality_score,
        array_to_string(list_filter([{", ".join(f"CASE WHEN {test} THEN '{text}' END" for test, text in zip(("n_overlaps > 0", "n_shorts > 0", "n_longs > 0", "false", "fast > 0", "n_crowded > 0", "gaps > 0", "zh_unsafe_boundary_count > 0", "zh_timeline_risk_count > 0", "ko_unsafe_boundary_count > 0", "ko_timeline_risk_count > 0"), C.REPORT_WARNINGS, strict=True))}], lambda x: x IS NOT NULL), ' / ') AS warnings FROM q""")
def dense_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports of made Chinese and Korean cues: what only these languages have, the score and the warnings' texts."""
    cues = cue_ops.with_profile(corpora.dense_cues(spark, sf_dir), profiles(spark))
    report = cue_ops.quality(cues, _texts(cues))
    own = [c for c in report.columns if c.startswith(("zh_", "ko_"))]
    return report.select("script_id", *own, "weak_boundary_count", "quality_score", F.array_join("warnings", " / ").alias("warnings"))


@query(f"WITH {_REPORT} last AS (SELECT 1) SELECT script_id, too_long_count + too_short_count + overlap_count AS error_count, 100.0::DOUBLE AS coverage_percent, false AS passed FROM scored")
def quality_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = _cues(spark, sf_dir)
    return cue_ops.quality_rollup(cue_ops.quality(cues, _texts(cues)))


@query(f"""WITH {_MERGED} c AS (SELECT script_id, count(*) AS n FROM top WHERE index <= 4 GROUP BY script_id) SELECT m.script_id, count(*) AS cue_count, coalesce(max(gap_after), 0) AS max_gap_seconds, count(*) FILTER (gap_after > 0.8::DOUBLE) AS large_gap_count, max(cps) AS max_chars_per_second, max(chars) AS max_chars_per_cue,
    count(*) FILTER (gap_after < 0) AS overlap_count, coalesce(max(c.n), 0) AS cue_timeline_risk_count FROM m LEFT JOIN c ON c.script_id = m.script_id GROUP BY m.script_id""")
def cue_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = _cues(spark, sf_dir)
    return cue_ops.cue_diagnostics(cues, _texts(cues)).drop("cue_timeline_risks")


_CUE_MS = "CAST(greatest(0, round_even({0} * 1000, 0)) AS BIGINT)"


def _stamp(value: str, mark: str) -> str:
    ms = _CUE_MS.format(value)
    return f"printf('%02d:%02d:%02d{mark}%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


@query(f"""WITH {CUES} last AS (SELECT 1) SELECT script_id, string_agg(idx || chr(10) || {_stamp("start", ",")} || ' --> ' || {_stamp('"end"', ",")} || chr(10) || regexp_replace(text, '(\\p{{P}}|{WS})+$', ''), chr(10) || chr(10) ORDER BY idx) || chr(10) AS srt FROM cues GROUP BY script_id""")
def srt_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.srt(corpora.conversation_cues(spark, sf_dir))


@query(f"""WITH {CUES} last AS (SELECT 1) SELECT script_id, 'WEBVTT' || chr(10) || chr(10) || string_agg({_stamp("start", ".")} || ' --> ' || {_stamp('"end"', ".")} || chr(10) || text || chr(10), chr(10) ORDER BY idx) AS vtt FROM cues GROUP BY script_id""")
def vtt_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.vtt(corpora.conversation_cues(spark, sf_dir))


@query(f"""WITH {CUES} last AS (SELECT 1) SELECT script_id, idx, {_stamp("start", ".")} AS start_text, {_stamp('"end"', ".")} AS end_text, text, round(duration, 3) AS duration_seconds,
    array_to_string(list_filter([CASE WHEN duration < min_duration THEN 'too_short' END, CASE WHEN duration > max_duration + 0.001::DOUBLE THEN 'too_long' END, CASE WHEN cps > max_cps THEN 'fast_reading' END, CASE WHEN chars > total_chars THEN 'cue_too_long' END, CASE WHEN gap_before < 0 THEN 'overlap' END], lambda x: x IS NOT NULL), ' / ') AS warnings_text FROM m""")
def preview_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cue_ops.preview(cue_ops.warnings(_cues(spark, sf_dir)))


# --- Whole scripts ---------------------------------------------------------------------------------------------


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    scripts = corpora.english_scripts(spark, sf_dir)
    return split_table(scripts, corpora.word_tokens(scripts))


@query(f"WITH {EN} last AS (SELECT 1) SELECT script_id, regexp_replace(display_text, '{WS}+', '', 'g') AS cue_text FROM en WHERE display_text <> ''")
def split_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cues of each script, joined: the script's own text, white space aside."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda c: c["text"]), "")
    return _split(spark, sf_dir).groupBy("script_id").agg(F.regexp_replace(joined, f"{WS}+", "").alias("cue_text"))


@query(f"WITH {EN} last AS (SELECT 1) SELECT script_id, 0 AS first_char, length(display_text) AS last_char, 0 AS holes FROM en WHERE display_text <> ''")
def split_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cues' spans: from 0 to the script's end without a hole."""
    w = Window.partitionBy("script_id").orderBy("idx")
    spans = _split(spark, sf_dir).withColumn("hole", F.coalesce((F.lag("end_char").over(w) != F.col("start_char")).cast("int"), F.lit(0)))
    return spans.groupBy("script_id").agg(F.min("start_char").alias("first_char"), F.max("end_char").alias("last_char"), F.sum("hole").cast("int").alias("holes"))


@query()
def split_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).drop("warnings")


@query()
def subtitle_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to quality reports: word tokens, cues, one report per script."""
    scripts = corpora.english_scripts(spark, sf_dir)
    texts = scripts.select("script_id", "display_text", F.regexp_replace("display_text", f"{WS}+", "").alias("compare_text"))
    return cue_ops.quality(cue_ops.with_profile(split_table(scripts, corpora.word_tokens(scripts)), profiles(spark)), texts)


def _kernel(cues: DataFrame, scripts: DataFrame, work) -> DataFrame:
    """CUE rows after ``work(cues, script, profile)`` on each script's cues."""
    from cueloom.functions.profiles import resolve
    from cueloom.plans.job import CUE, cue_batch
    from cueloom.plans.script import Cue, Script

    one = F.struct("idx", "start", "end", "text", "start_char", "end_char")
    gathered = cues.groupBy("script_id", "language", "profile").agg(F.array_sort(F.collect_list(one)).alias("cues")).join(scripts.select("script_id", "display_text"), "script_id")

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 64):
                found = []
                for row in batch.slice(at, 64).to_pylist():
                    own = [Cue(c["start"], c["end"], c["text"], c["start_char"], c["end_char"]) for c in row["cues"]]
                    found.append((row, work(own, Script(row["display_text"], row["language"]), resolve(row["profile"], row["language"]))))
                yield cue_batch(found)

    return gathered.mapInArrow(run, CUE)


@query(f"""WITH RECURSIVE {CUES}
    firm AS (SELECT *, greatest(0.0::DOUBLE, start) AS s, greatest(greatest(0.0::DOUBLE, start) + 0.1::DOUBLE, "end") AS e0, lead(start) OVER (PARTITION BY script_id ORDER BY idx) AS nx FROM m),
    fixed AS (SELECT *, CASE WHEN nx IS NULL THEN e0 WHEN e0 > nx - 0.08::DOUBLE AND nx - 0.08::DOUBLE > s + 0.1::DOUBLE THEN nx - 0.08::DOUBLE ELSE least(e0, nx) END AS e FROM firm),
    need AS (SELECT script_id, idx, s, e, s - lag(e) OVER w AS gap, greatest(0.0::DOUBLE, 6.0::DOUBLE - greatest(0.0::DOUBLE, e - s)) AS room,
        greatest(0.0::DOUBLE, chars / 18.0::DOUBLE - greatest(greatest(0.0::DOUBLE, e - s), 0.1::DOUBLE)) AS hurry FROM fixed WINDOW w AS (PARTITION BY script_id ORDER BY idx)),
    wish AS (SELECT *, s - least(hurry, gap - 0.08::DOUBLE, room) AS readable FROM need),
    walk AS (SELECT script_id, idx, s, e FROM wish WHERE idx = 1 UNION ALL
        SELECT n.script_id, n.idx, CASE WHEN n.gap > 0.2 THEN greatest(least(n.readable, greatest(w.e, w.s + 6.0::DOUBLE) + 0.2::DOUBLE), least(n.readable, n.s - n.room)) ELSE n.s END, n.e
        FROM walk w JOIN wish n ON n.script_id = w.script_id AND n.idx = w.idx + 1),
    held AS (SELECT w.script_id, w.idx, w.s, CASE WHEN n.gap > 0.2 THEN greatest(w.e, least(n.readable - 0.2::DOUBLE, w.s + 6.0::DOUBLE)) ELSE w.e END AS e FROM walk w LEFT JOIN wish n ON n.script_id = w.script_id AND n.idx = w.idx + 1),
    cut AS (SELECT *, greatest(0.0::DOUBLE, s) AS b, lead(s) OVER (PARTITION BY script_id ORDER BY idx) AS nx FROM held)
    SELECT c.script_id, 'en' AS language, 'standard' AS profile, c.idx, b AS start, greatest(b + 0.1::DOUBLE, least(least(greatest(b + 0.1::DOUBLE, c.e), b + 6.0::DOUBLE), coalesce(c.nx - 0.08::DOUBLE, 'infinity'::DOUBLE))) AS "end",
        m.text, m.start_char, m.end_char FROM cut c JOIN m ON m.script_id = c.script_id AND m.idx = c.idx""")
def smoothed_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clamped and smoothed times of the conversations' cues."""
    from cueloom.plans.splitting import clamp

    cues = corpora.conversation_cues(spark, sf_dir)
    return _kernel(cues, _texts(cues), lambda own, script, p: clamp(own, p)).drop("warnings")


@query()
def repaired_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations' cues with risky ends moved and short ones merged."""
    from cueloom.plans.splitting import annotate, merge_short, repair_ends

    cues = corpora.conversation_cues(spark, sf_dir)
    return _kernel(cues, _texts(cues), lambda own, script, p: annotate(merge_short(repair_ends(own, script, p), script, p), p))


@query()
def rebuilt_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations' cues with everything after a timeline break rebuilt by characters."""
    from cueloom.plans.tail import repair_tail

    cues = corpora.conversation_cues(spark, sf_dir)
    return _kernel(cues, _texts(cues), lambda own, script, p: repair_tail(own, script, [], None, p)[0]).drop("warnings")


@query()
def drifting_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole jobs over the English documents with an aligner whose timeline jumps, and its repairs."""
    from cueloom.plans.aligner import SteadyAligner
    from cueloom.plans.job import align_scripts, reports

    docs = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("script_id"), F.col("lang").alias("language"), F.lit("standard").alias("profile"), F.col("text").alias("script_text"))
    done = written(align_scripts(docs, SteadyAligner(step=0.06, drift=9.0, drift_from=0.5), with_tokens=False), "drifting")
    report = reports(done, profiles(spark))
    return report.select("script_id", "quality_score", "timeline_status", F.get_json_object("timeline", "$.max_anchor_gap_seconds").cast("double").alias("max_anchor_gap_seconds"), F.size("warnings").alias("warnings"))


@query()
def aligned_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job over all documents with the synthetic aligner; languages without rules give an error row."""
    from cueloom.plans.aligner import SteadyAligner
    from cueloom.plans.job import align_scripts

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("script_id"), F.col("lang").alias("language"), F.lit("standard").alias("profile"), F.col("text").alias("script_text"))
    done = align_scripts(docs, SteadyAligner(step=0.06), with_tokens=False)
    return done.select("script_id", "language", "error_class", "audio_duration", F.size("cues").alias("cues"), "timeline_status", "timeline_score")
