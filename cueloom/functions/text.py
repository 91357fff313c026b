"""Text expressions. Offsets are code points; white space is what Python calls white space."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cueloom.functions.charsets import MARKDOWN_NOISE, NATURAL_ENDS, SENTENCE_ENDS, WS, WS_CODES, ZERO_WIDTH, one_of

BLANKS = "".join(map(chr, WS_CODES))


def _composed(text: Column) -> Column:
    import pandas as pd  # only where text has to be composed

    def compose(values):
        return values.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    compose.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(compose, StringType())(text)


def nfc(text: Column, compose: bool = True) -> Column:
    """NFC. Text below U+0300 is composed already; ``compose`` False says that all of it is.

    A Python worker gets a row for every row, whatever stands around it, but only text that may need it: null for the rest.
    """
    if not compose:
        return text
    return F.coalesce(_composed(F.when(text.rlike(r"[^\x{0}-\x{2ff}]"), text)), text)


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def without(text: Column, chars: str) -> Column:
    return F.regexp_replace(text, one_of(chars), "")


def render_segment(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return strip(F.regexp_replace(text, f"{WS}+", " "))


def clean_display(text: Column, compose: bool = True) -> Column:
    """The script as shown: unified line ends, no zero-width characters, NFC, stripped; null where nothing is left."""
    lines = F.regexp_replace(text, "\r\n|\r", "\n")
    return F.nullif(strip(nfc(without(lines, ZERO_WIDTH), compose)), F.lit(""))


def clean_align(display: Column, keep_punctuation: bool = True) -> Column:
    """The text that is aligned: no Markdown marks, single spaces; null where nothing is left."""
    kept = without(display, MARKDOWN_NOISE)
    if not keep_punctuation:
        kept = F.regexp_replace(kept, r"\p{P}", "")
    return F.nullif(render_segment(kept), F.lit(""))


def normalize_token(text: Column, compose: bool = True) -> Column:
    return render_segment(nfc(without(text, ZERO_WIDTH + MARKDOWN_NOISE), compose))


def normalize_compare(text: Column, compose: bool = True) -> Column:
    return F.regexp_replace(nfc(without(text, ZERO_WIDTH), compose), f"{WS}+", "")


def visible_len(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"{WS}+", ""))


def strip_trailing_punctuation(text: Column) -> Column:
    """Each line without the punctuation and white space at its end."""
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda line: F.regexp_replace(line, rf"(?:\p{{P}}|{WS})+$", "")), "\n")


def last_char(text: Column) -> Column:
    """The last character that isn't white space; empty if there is none."""
    return F.regexp_extract(text, rf"(?s)([^{WS[1:-1]}]){WS}*$", 1)


def has_natural_boundary(text: Column) -> Column:
    last = last_char(text)
    return (last == "") | last.rlike(f"^{one_of(NATURAL_ENDS)}$")


#: Characters beside an offset that are searched before the rest of the text is.
NEAR = 64


def previous_visible(text: Column, at: Column) -> Column:
    """The visible character before offset ``at``; empty if there is none."""
    near = last_char(F.substring(text, F.greatest(F.lit(1), at - NEAR + 1), F.least(at, F.lit(NEAR))))
    return F.when((near != "") | (at <= NEAR), near).otherwise(last_char(F.substring(text, F.lit(1), at)))


def next_visible(text: Column, at: Column) -> Column:
    """The visible character from offset ``at`` on; empty if there is none."""
    first = rf"(?s)^{WS}*([^{WS[1:-1]}])"
    near = F.regexp_extract(F.substring(text, at + 1, F.lit(NEAR)), first, 1)
    return F.when((near != "") | (at + NEAR >= F.length(text)), near).otherwise(F.regexp_extract(F.substring(text, at + 1, F.length(text)), first, 1))


def trim_range(text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """``start`` and ``end`` moved inward past white space."""
    part = F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))
    lead = F.length(part) - F.length(F.regexp_replace(part, f"^{WS}+", ""))
    tail = F.length(part) - F.length(F.regexp_replace(part, f"{WS}+$", ""))
    blank = lead == F.length(part)
    return F.when(blank, F.greatest(start, end)).otherwise(start + lead), F.when(blank, F.greatest(start, end)).otherwise(end - tail)


def previous_sentence_boundary(text: Column, start: Column, limit: Column) -> Column:
    """The offset after the last sentence end among the ``limit`` characters before ``start``; else where they begin."""
    lower = F.greatest(F.lit(0), start - limit)
    part = F.substring(text, lower + 1, F.greatest(start - lower, F.lit(0)))
    return lower + F.length(F.regexp_extract(part, f"(?s)^(.*{one_of(SENTENCE_ENDS)})", 1))


def next_sentence_boundary(text: Column, end: Column, limit: Column) -> Column:
    """The offset after the first sentence end among the ``limit`` characters from ``end``; else where they end."""
    upper = F.least(F.length(text), end + limit)
    part = F.substring(text, end + 1, F.greatest(upper - end, F.lit(0)))
    found = F.length(F.regexp_extract(part, f"(?s)^([^{one_of(SENTENCE_ENDS)[1:-1]}]*{one_of(SENTENCE_ENDS)})", 1))
    return F.when(found > 0, end + found).otherwise(upper)


def char_after_visible(text: Column, start: Column, end: Column, count: Column) -> Column:
    """The offset after the ``count``-th visible character of a range; else its end."""
    part = F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))
    marks = F.transform(F.split(part, ""), lambda c: (~c.rlike(f"^{WS}$") & (c != "")).cast("int"))
    sums = F.aggregate(
        marks,
        F.struct(F.lit(0).alias("seen"), F.lit(0).alias("at"), F.lit(0).alias("found")),
        lambda s, m: F.struct(
            (s["seen"] + m).alias("seen"),
            (s["at"] + 1).alias("at"),
            F.when((s["found"] == 0) & (m == 1) & (s["seen"] + 1 >= count), s["at"] + 1).otherwise(s["found"]).alias("found"),
        ),
    )
    return F.when(sums["found"] > 0, start + sums["found"]).otherwise(end)
