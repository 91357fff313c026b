"""Character sets and limits that results depend on."""

from __future__ import annotations

#: What Python calls white space, as a regex class that Java and RE2 read alike.
WS = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WS_CODES = (*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
ZERO_WIDTH = "​‌‍﻿"
MARKDOWN_NOISE = "#>*_`~"

STRONG = "。！？!?…"
MID = "，、,;；:："
OPEN_QUOTES = "「『“‘（([【"
CLOSE_QUOTES = "」』”’）)]】"
STRAIGHT_QUOTES = "\"'"
SENTENCE_ENDS = "。！？!?；;」』”’"
NATURAL_ENDS = "。！？!?…、，,;；:：」』”’）)]】"

JA_EDGES = "はがをにでともの"
ZH_EDGES = "的地得把被和与跟在是就也都要会能很又还再"
ZH_QUOTE_FOLLOWERS = "的一声地了着过吗呢吧啊呀嘛她他它们"
EN_EDGES = ("a", "an", "the", "of", "to", "in", "on", "at", "for", "and", "or")
JA_SMALL_KANA = "っゃゅょぁぃぅぇぉッャュョァィゥェォー"
JA_LONG_MARKS = "っッー"

HIRAGANA = ((0x3040, 0x309F),)
KATAKANA = ((0x30A0, 0x30FF),)
KANJI = ((0x3400, 0x9FFF), (0x3005, 0x3005))
CJK = ((0x3400, 0x9FFF),)
HANGUL = ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7A3))
JA_NUMERALS = "0123456789０１２３４５６７８９一二三四五六七八九十百千万億兆"
JA_COUNTERS = "円年月日人個本枚台階歳才分秒"

#: language -> group
GROUPS = {"zh": "cjk", "zh-TW": "cjk", "ja": "ja", "ko": "ko", "en": "en"}
#: group -> line characters, total characters, characters per second
BASES = {"en": (42, 84, 20.0), "ja": (17, 34, 12.0), "ko": (20, 38, 10.5), "cjk": (18, 34, 8.5)}
#: profile -> line factor, total factor, cps factor, shortest and longest duration
PROFILES = {
    "youtube_long": (1.0, 1.0, 1.0, 1.2, 6.5),
    "standard": (1.0, 1.0, 1.0, 1.2, 6.0),
    "short": (0.82, 0.78, 1.0, 1.0, 4.2),
    "slow_elder": (0.9, 0.86, 0.85, 1.5, 7.0),
}
PROFILE_LABELS = {"youtube_long": "YouTube 长视频", "standard": "标准字幕", "short": "短字幕", "slow_elder": "老年频道慢节奏朗读字幕"}
GAP_SECONDS = 0.08
VISUAL_GAP = 0.20
EPSILON = 0.001
NEAR_MAX = 0.05
LARGE_GAP = 0.8
#: group -> long, forced characters, comfortable and severe characters per second of dense scripts
LONG_CHARS = {"ko": 38, "cjk": 34, "ja": 34, "en": 34}
FORCE_CHARS = {"ko": 44, "cjk": 38, "ja": 38, "en": 38}
COMFORT_CPS = {"ko": 9.5, "cjk": 8.5, "ja": 8.5, "en": 8.5}
TARGET_CPS = {"ja": 8.5, "cjk": 8.5, "ko": 9.5, "en": 18.0}
#: group -> long characters, cluster characters, fast and severe cps of cue risks
RISK_LIMITS = {"ko": (38, 34, 9.5, 10.5), "en": (84, 68, 20.0, 28.0), "cjk": (34, 30, 8.5, 9.5)}
SCAN_CHARS = {"cjk": 12, "ko": 16, "ja": 12, "en": 12}
RISK_PREFIX = {"ko": "ko", "en": "en", "cjk": "zh"}
RISK_BOUNDARY = {"cjk": "zh_quote_boundary", "ko": "ko_unsafe_boundary", "en": "en_word_boundary"}
REPORT_WARNINGS = (
    "存在字幕时间轴重叠",
    "存在过短字幕",
    "存在过长字幕",
    "字幕文本与原文未完全连续一致",
    "存在阅读速度过快的字幕",
    "存在单条字幕过长",
    "存在疑似异常长间隔",
    "存在中文不安全切段",
    "存在中文时间轴风险",
    "存在韩语不安全切段",
    "存在韩语时间轴风险",
)
REVIEW_WARNINGS = {
    "drift": "存在局部时间轴漂移，需检查时间轴",
    "micro": "存在局部短段时间轴漂移，需检查时间轴",
    "low": "存在低置信时间轴估算段，需人工检查时间轴",
}


def one_of(chars: str) -> str:
    """A regex class of ``chars`` that Java and RE2 read alike."""
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in chars) + "]"


def in_ranges(*ranges: tuple[int, int]) -> str:
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"
