"""Bounded samples that are chosen where the rows are.

A row is a candidate if a hash of its id lies below a cutoff that lets about ``SPARE`` times the wanted number pass, over the
whole table and not in each task, so that what reaches the driver doesn't grow with the number of tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPARE = 4
RANGE = 1 << 40


def place(doc_id: Column) -> Column:
    """A number below RANGE by which sampled rows are ordered."""
    return F.pmod(F.xxhash64(doc_id), F.lit(RANGE))


def cutoff(wanted: int, total: int) -> int:
    """Rows with a smaller place are candidates."""
    return RANGE if total <= SPARE * wanted else RANGE * SPARE * wanted // total


def first_texts(docs: DataFrame, wanted: int, chars: int) -> list[str]:
    """The beginnings, ``chars`` characters at most, of about ``wanted`` texts: those of the smallest places."""
    limit = cutoff(wanted, docs.count())
    near = docs.select(place(F.col("doc_id")).alias("place"), F.substring("text", 1, chars).alias("text")).where((F.col("place") < limit) & F.col("text").isNotNull())
    return [row["text"] for row in near.orderBy("place", "text").limit(wanted).collect()]
