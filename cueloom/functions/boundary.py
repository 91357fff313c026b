"""How good and how risky it is to end a cue at an offset, as expressions.

A boundary is described by ``prev`` and ``nxt``, the visible characters around it (empty at the text's edges), ``left`` and
``right``, the characters right beside it, and ``quoted``, whether a quote is open there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.functions import charsets as C
from cueloom.functions.arrays import codes, visible_before, visible_beside


def among(char: Column, chars: str) -> Column:
    return char.rlike(f"^{C.one_of(chars)}$")


def within(char: Column, *ranges: tuple[int, int]) -> Column:
    return char.rlike(f"^{C.in_ranges(*ranges)}$")


def hiragana(c: Column) -> Column:
    return within(c, *C.HIRAGANA)


def katakana(c: Column) -> Column:
    return within(c, *C.KATAKANA)


def kanji(c: Column) -> Column:
    return within(c, *C.KANJI)


def cjk(c: Column) -> Column:
    return within(c, *C.CJK)


def hangul(c: Column) -> Column:
    return within(c, *C.HANGUL)


def numeral(c: Column) -> Column:
    return among(c, C.JA_NUMERALS)


def space_beside(left: Column, right: Column) -> Column:
    return left.rlike(f"^{C.WS}$") | right.rlike(f"^{C.WS}$")


def inside_word(left: Column, right: Column) -> Column:
    """Between two word characters of an English word; never at the text's edges."""
    word = r"^[0-9A-Za-z'\x{2019}-]$"
    return left.rlike(word) & right.rlike(word)


def clear(prev: Column) -> Column:
    return among(prev, C.STRONG + C.MID + C.CLOSE_QUOTES)


def zh_quote_risk(prev: Column, nxt: Column) -> Column:
    straight_open, straight_close = C.OPEN_QUOTES + C.STRAIGHT_QUOTES, C.CLOSE_QUOTES + C.STRAIGHT_QUOTES
    return (
        F.when((prev == "") | (nxt == "") | among(nxt, C.STRONG + C.MID), False)
        .when(among(prev, straight_open), cjk(nxt) | among(nxt, C.ZH_QUOTE_FOLLOWERS))
        .when(among(nxt, straight_close), cjk(prev))
        .when(among(prev, straight_close), among(nxt, C.ZH_QUOTE_FOLLOWERS))
        .otherwise(False)
    )


def ja_score(prev: Column, nxt: Column) -> Column:
    edge_prev, edge_next = among(prev, C.JA_EDGES), among(nxt, C.JA_EDGES)
    counter = lambda c: among(c, C.JA_COUNTERS)
    return (
        F.when((katakana(prev) & katakana(nxt)) | (kanji(prev) & kanji(nxt)), -78.0)
        .when((kanji(prev) & hiragana(nxt) & ~edge_next) | (hiragana(prev) & kanji(nxt) & ~edge_prev), -68.0)
        .when(hiragana(prev) & hiragana(nxt), F.when(edge_prev, 0.0).otherwise(-48.0))
        .when((numeral(prev) & (numeral(nxt) | counter(nxt))) | (counter(prev) & numeral(nxt)), -78.0)
        .when(among(prev, C.JA_LONG_MARKS) | among(nxt, C.JA_SMALL_KANA), -78.0)
        .otherwise(0.0)
    )


def _sum(*terms: tuple[Column, float]) -> Column:
    return reduce(Column.__add__, (F.when(test, value).otherwise(0.0) for test, value in terms))


def zh_score(prev: Column, nxt: Column) -> Column:
    parts = _sum((among(prev, C.ZH_EDGES), -24.0), (among(nxt, C.ZH_EDGES), -8.0), (cjk(prev) & cjk(nxt), -6.0))
    return F.when(zh_quote_risk(prev, nxt), -95.0).otherwise(parts)


def ko_score(prev: Column, nxt: Column, space: Column) -> Column:
    return _sum((space, 34.0), (hangul(prev) & hangul(nxt) & ~space, -74.0), (among(prev, C.OPEN_QUOTES) | among(nxt, C.CLOSE_QUOTES), -55.0))


def high_risk(group: Column, prev: Column, nxt: Column, left: Column, right: Column) -> Column:
    """Whether a cue must not end here."""
    quote = among(prev, C.OPEN_QUOTES) | among(nxt, C.CLOSE_QUOTES)
    return (
        F.when((prev == "") | (nxt == ""), False)
        .when(group == "cjk", zh_quote_risk(prev, nxt))
        .when(clear(prev), False)
        .when(group == "ko", quote | (hangul(prev) & hangul(nxt) & ~space_beside(left, right)))
        .when(group == "en", inside_word(left, right))
        .when(group == "ja", quote | (ja_score(prev, nxt) <= -48))
        .otherwise(False)
    )


def score(group: Column, prev: Column, nxt: Column, left: Column, right: Column, quoted: Column) -> Column:
    """The worth of a cue end here: punctuation, quotes, spaces and what the language keeps together."""
    space = space_beside(left, right)
    common = F.when(among(prev, C.STRONG + C.CLOSE_QUOTES), 18.0).when(among(prev, C.MID), 10.0).otherwise(0.0) + _sum(
        (among(nxt, C.STRONG + C.MID + C.CLOSE_QUOTES), -18.0), (among(prev, C.OPEN_QUOTES), -55.0)
    )
    own = (
        F.when(group == "ja", ja_score(prev, nxt) + _sum((quoted & ~clear(prev), -28.0)))
        .when(group == "cjk", zh_score(prev, nxt))
        .when(group == "ko", ko_score(prev, nxt, space))
        .when(group == "en", _sum((space, 34.0), (inside_word(left, right), -90.0)))
        .otherwise(0.0)
    )
    return F.when((prev == "") | (nxt == ""), 0.0).otherwise(common + own)


def repair_score(group: Column, prev: Column, nxt: Column, left: Column, right: Column, quoted: Column, distance: Column) -> Column:
    """The worth of moving a cue end to here over ``distance`` characters."""
    space = space_beside(left, right)
    own = (
        F.when(group == "ja", _sum((among(prev, C.JA_EDGES), 12.0), (among(nxt, C.JA_EDGES), -38.0), (quoted, -6.0)))
        .when(group == "cjk", _sum((among(prev, C.ZH_EDGES), -24.0), (among(nxt, C.ZH_EDGES), -8.0), (zh_quote_risk(prev, nxt), -90.0)))
        .when(group == "ko", _sum((hangul(prev) & hangul(nxt) & ~space, -70.0), (space, 24.0), (quoted, -6.0)))
        .when(group == "en", _sum((space, 34.0), (inside_word(left, right), -90.0)))
        .otherwise(0.0)
    )
    punctuation = F.when(among(prev, C.STRONG + C.CLOSE_QUOTES), 90.0).when(among(prev, C.MID), 45.0).otherwise(0.0)
    return score(group, prev, nxt, left, right, quoted) + punctuation + own - F.abs(distance) * 0.6


def bad_line_edge(group: Column, text: Column, last: Column) -> Column:
    """Whether a line must not end like ``text``, whose last visible character is ``last``."""
    word = F.lower(F.regexp_extract(text, r"(?s)([A-Za-z']+)[^A-Za-z']*$", 1))
    return (
        F.when(group == "ja", among(last, C.JA_EDGES))
        .when(group == "cjk", among(last, C.ZH_EDGES + C.OPEN_QUOTES + C.STRAIGHT_QUOTES))
        .when(group == "ko", among(last, C.OPEN_QUOTES + C.STRAIGHT_QUOTES))
        .when(group == "en", word.isin(*C.EN_EDGES))
        .otherwise(False)
    )


_BOUNDARY = {"at": pa.int32(), "left": pa.string(), "right": pa.string(), "prev": pa.string(), "nxt": pa.string(), "visible": pa.int32(), "quoted": pa.bool_()}


def boundaries(scripts: DataFrame, text: str = "text") -> DataFrame:
    """Every offset 0..n of each script with prev, nxt, left, right, quoted and visible (visible characters before it).

    A script's offsets are described together as arrays where the script is, so that characters aren't shuffled or sorted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for script_id, value in zip(batch.column("script_id").to_pylist(), batch.column("text"), strict=True):
                if not value.is_valid:
                    continue
                points = codes(value.as_py())
                n = len(points)
                own = np.array([*value.as_py(), ""])
                before, after = visible_beside(points)
                change = np.concatenate([[0], np.cumsum(np.isin(points, codes(C.OPEN_QUOTES)).astype(int) - np.isin(points, codes(C.CLOSE_QUOTES)))])
                # Unclosed quotes: the running sum over its own lowest value so far, as closing never goes below none.
                open_ = change - np.minimum(0, np.minimum.accumulate(change))
                found = (np.arange(n + 1), own[np.arange(-1, n)], own, own[np.where(before < 0, n, before)], own[after], visible_before(points), open_ > 0)
                for at in range(0, n + 1, 8192):
                    part = [pa.array(x[at : at + 8192], kind) for x, kind in zip(found, _BOUNDARY.values(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([script_id] * len(part[0]), pa.int64()), *part], names=["script_id", *_BOUNDARY])

    plain = scripts.select(F.col("script_id").cast("long").alias("script_id"), F.col(text).cast("string").alias("text"))
    return plain.mapInArrow(run, "script_id long, at int, left string, right string, prev string, nxt string, visible int, quoted boolean")
