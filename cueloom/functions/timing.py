"""Time, number and aggregate expressions. Times are seconds as doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def srt_timestamp(seconds: Column, mark: str = ",") -> Column:
    ms = F.greatest(F.lit(0).cast("long"), F.bround(seconds * 1000, 0).cast("long"))
    whole = F.floor(ms / 1000)
    return F.format_string("%02d:%02d:%02d" + mark + "%03d", F.floor(whole / 3600), F.pmod(F.floor(whole / 60), F.lit(60)), F.pmod(whole, F.lit(60)), F.pmod(ms, F.lit(1000)))


def vtt_timestamp(seconds: Column) -> Column:
    return srt_timestamp(seconds, ".")


def chars_per_second(chars: Column, duration: Column) -> Column:
    return chars / F.greatest(duration, F.lit(0.1))


def nearest_rank(values: Column, share: float) -> Column:
    """The percentile of an array: the sorted value at the half-even rounded place (n - 1) * share; 0 if empty."""
    place = F.bround((F.size(values) - 1) * F.lit(share), 0).cast("int") + 1
    return F.when(F.size(values) > 0, F.element_at(F.array_sort(values), place)).otherwise(F.lit(0.0))


def ranked(ordered: str, share: float) -> Column:
    """``nearest_rank`` of a column of sorted arrays that are not empty."""
    return F.element_at(ordered, F.bround((F.size(ordered) - 1) * F.lit(share), 0).cast("int") + 1)


def middle(ordered: str) -> Column:
    """The median of a column of sorted arrays that are not empty."""
    low, high = (F.element_at(ordered, F.floor((F.size(ordered) + odd) / 2).cast("int")) for odd in (1, 2))
    return low + (high - low) * 0.5


def rounded(value: Column, places: int) -> Column:
    """A number rounded as in the oracle's SQL: scaled, taken to the nearest whole number (halves away from 0), scaled back.

    ``F.round`` looks at the decimal digits of the unscaled number instead, which decides otherwise next to a half.
    """
    scale = F.lit(float(10**places))
    return F.round(value * scale, 0) / scale


def as_float(value: Column) -> Column:
    """A number, or 0 where it can't be read."""
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def as_optional_float(value: Column) -> Column:
    return value.try_cast("double")
