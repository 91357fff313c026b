"""A filter of bounded size that thins out rows before they are shuffled.

The keys that are looked for set bits of bitmaps; a row goes on if the bit of its key is set. All keys pass, others
pass with the share of set bits. 1024 bitmaps of 4 KiB (4 MiB) are broadcast at most, however many keys there are.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTER_BITS = 1 << 25
BITMAP_BITS = 32768


def _slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)) + 1


def free_names(taken: Iterable[str], *names: str) -> list[str]:
    """``names``, each with as many underscores in front as keep it apart from the ``taken`` ones."""
    known, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in known:
            name = f"_{name}"
        known.add(name.lower())
        out.append(name)
    return out


def bitmaps(keys: DataFrame, *by: str) -> DataFrame:
    """The filter of the first column of ``keys`` as rows (bucket, bits), one for each group of the columns ``by``."""
    slot = _slot(keys[keys.columns[0]])
    return keys.groupBy(*by, F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))


def in_several(filters: DataFrame, number: str, numbers: int) -> DataFrame:
    """The filter (bucket, bits) of what is in the filters of at least two of the ``numbers`` groups 0, 1, ...

    Two different numbers differ in a binary digit: for each digit, what groups with it and groups without it both hold is in two.
    """
    digits = F.explode(F.array([F.struct(F.lit(j).alias("digit"), F.shiftright(F.col(number), j).bitwiseAND(F.lit(1)).alias("value")) for j in range(max(1, (numbers - 1).bit_length()))]))
    sides = filters.withColumn("d", digits).groupBy("bucket", "d.digit", "d.value").agg(F.bitmap_or_agg("bits").alias("bits"))
    both = sides.groupBy("bucket", "digit").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("sides")).where("sides = 2")
    return both.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def probed(rows: DataFrame, key: str, filter_: DataFrame, flag: str) -> DataFrame:
    """``rows`` with a column ``flag``: whether the bit of ``key`` is set in ``filter_`` (bucket, bits)."""
    bucket, bits = free_names([*rows.columns, flag], "bucket", "bits")
    slot = _slot(F.col(f"`{key}`"))
    position = F.pmod(slot - 1, F.lit(BITMAP_BITS)).cast("int")
    byte = F.conv(F.hex(F.substring(bits, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    tested = rows.withColumn(bucket, F.bitmap_bucket_number(slot)).join(F.broadcast(filter_.toDF(bucket, bits)), bucket, "left")
    return tested.select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce(F.getbit(byte, F.pmod(position, F.lit(8))) == 1, F.lit(False)).alias(flag))


def flagged(rows: DataFrame, key: str, keys: DataFrame, flag: str) -> DataFrame:
    """``rows`` with a column ``flag``: true where ``key`` is, or looks as if it were, in the one column of ``keys``."""
    return probed(rows, key, bitmaps(keys), flag)


def maybe_among(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows that ``flagged`` marks."""
    (flag,) = free_names(rows.columns, "maybe")
    return flagged(rows, key, keys, flag).where(F.col(flag)).drop(flag)
