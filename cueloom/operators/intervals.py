"""Interval, as-of and run operators over tokens, cues and ranges, each partitioned by ``script_id``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 256
#: Characters per bucket where single offsets look for the few tokens near them.
NEAR_BUCKET = 16


def merge(ranges: DataFrame, start: str, end: str, reach: int, aggregates: Sequence[Column], order: Sequence[str] = (), key: str = "script_id") -> DataFrame:
    """Ranges joined where the next starts at most ``reach`` after the greatest end so far; one row for each group."""
    w = Window.partitionBy(key).orderBy(start, *order)
    so_far = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    begins = ranges.withColumn("_new", F.coalesce((F.col(start) > so_far + reach).cast("int"), F.lit(1)))
    grouped = begins.withColumn("_group", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(key, "_group").agg(*aggregates).withColumnRenamed("_group", "group_index")


def union_of(reasons: str) -> Column:
    """All reasons of a group, sorted, each once."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(reasons))))


def highest(severity: str) -> Column:
    return F.when(F.max(F.when(F.col(severity) == "high", 1).otherwise(0)) == 1, "high").otherwise("medium")


def _bucketed(rows: DataFrame, start: Column, end: Column, bucket: int) -> DataFrame:
    """A row for each bucket that a half-open span touches."""
    last = F.greatest(start, end - 1)
    return rows.withColumn("_bucket", F.explode(F.sequence(F.floor(start / bucket), F.floor(last / bucket))))


def overlapping(ranges: DataFrame, tokens: DataFrame, range_id: str = "range_id", bucket: int = BUCKET) -> DataFrame:
    """(range, token) rows whose character spans overlap, by script and bucket; ``tokens`` columns are prefixed t_."""
    t = tokens.where("start_char IS NOT NULL AND end_char IS NOT NULL")
    t = t.select(F.col("script_id"), *[F.col(c).alias(f"t_{c}") for c in t.columns if c != "script_id"])
    left = _bucketed(ranges, F.col("start_char"), F.col("end_char"), bucket)
    right = _bucketed(t, F.col("t_start_char"), F.col("t_end_char"), bucket)
    met = left.join(right, ["script_id", "_bucket"]).where("t_end_char > start_char AND t_start_char < end_char")
    first = F.floor(F.greatest("start_char", "t_start_char") / bucket)
    return met.where(F.col("_bucket") == first).drop("_bucket")


def replace_in_ranges(tokens: DataFrame, ranges: DataFrame, replacement: DataFrame) -> DataFrame:
    """``tokens`` without those that overlap a range of their script, and with ``replacement``. Unmapped ones stay."""
    span = ranges.select("script_id", F.col("start_char").alias("_a"), F.col("end_char").alias("_b"))
    kept = tokens.join(span, (tokens["script_id"] == span["script_id"]) & (tokens["end_char"] > span["_a"]) & (tokens["start_char"] < span["_b"]), "left_anti")
    return kept.unionByName(replacement.select(*tokens.columns))


def as_of(points: DataFrame, rows: DataFrame, at: str, key: str, payload: Sequence[str], forward: bool = False, within: str = "script_id") -> DataFrame:
    """For each point the nearest row with ``key`` at most (forward: at least) ``at``; ties go to the first by payload order.

    Points and rows are sorted together and the last row seen is carried on, so that no pairs are formed: one shuffle by
    ``within``, and one window over both.
    """
    names = [f"near_{c}" for c in payload]
    value = F.struct(*[F.col(c).alias(n) for c, n in zip(payload, names, strict=True)])
    order_in = Window.partitionBy(within, key).orderBy(*[F.col(c).asc_nulls_last() for c in payload])
    firsts = rows.withColumn("_n", F.row_number().over(order_in)).where("_n = 1").drop("_n")
    left = points.select(within, F.col(at).alias("_at"), F.struct(*points.columns).alias("_point"), F.lit(None).cast(firsts.select(value.alias("v")).schema["v"].dataType).alias("_row"))
    right = firsts.select(within, F.col(key).alias("_at"), F.lit(None).cast(left.schema["_point"].dataType).alias("_point"), value.alias("_row"))
    both = left.unionByName(right)
    rank = F.col("_point").isNotNull().cast("int")
    w = Window.partitionBy(within).orderBy(F.col("_at").desc() if forward else F.col("_at").asc(), rank)
    found = both.withColumn("_near", F.last("_row", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return found.where("_point IS NOT NULL").select("_point.*", *[F.col(f"_near.{n}").alias(n) for n in names])


def time_at_char(points: DataFrame, tokens: DataFrame, at: str = "char_pos", point_id: str = "point_id") -> DataFrame:
    """Each point's time: inside its first containing token, else in the middle of the nearest within 3 characters; else null."""
    t = tokens.where("start_char IS NOT NULL AND end_char IS NOT NULL").select(
        "script_id", F.col("start_char").alias("_a"), F.col("end_char").alias("_b"), F.col("start").alias("_s"), F.col("end").alias("_e")
    )
    near = _bucketed(t, F.greatest(F.lit(0), F.col("_a") - 3), F.greatest(F.col("_b"), F.col("_a") + 1) + 3, NEAR_BUCKET)
    asked = points.withColumn("_bucket", F.floor(F.col(at) / NEAR_BUCKET))
    c = F.col(at)
    inside = (F.col("_a") <= c) & (c < F.col("_b"))
    distance = F.when(inside, 0).otherwise(F.least(F.abs(c - F.col("_a")), F.abs(c - F.greatest(F.col("_a"), F.col("_b") - 1))))
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (c + 0.5 - F.col("_a")) / F.greatest(F.lit(1), F.col("_b") - F.col("_a"))))
    time = F.when(inside, F.col("_s") + (F.col("_e") - F.col("_s")) * share).otherwise((F.col("_s") + F.col("_e")) / 2)
    met = asked.join(near, ["script_id", "_bucket"], "left").withColumn("_far", distance).withColumn("_time", time)
    met = met.withColumn("_in", inside)
    best = F.expr("min_by(_time, struct(if(_in, 0, 1), _far, _a, _b, _s)) FILTER (WHERE _far <= 3)")
    keep = [x for x in points.columns if x not in ("script_id", point_id)]
    return met.groupBy("script_id", point_id, *keep).agg(best.alias("time_at"))


def audio_window(ranges: DataFrame, tokens: DataFrame, duration: str = "audio_duration", range_id: str = "range_id") -> DataFrame:
    """Each range's audio window: that of its overlapping tokens, else between trusted neighbours."""
    covered = overlapping(ranges, tokens, range_id).groupBy("script_id", range_id).agg(F.min("t_start").alias("_from"), F.max("t_end").alias("_to"))
    trusted = tokens.where("start_char IS NOT NULL AND end_char IS NOT NULL AND (confidence IS NULL OR confidence >= 0.2)")
    before = as_of(ranges, trusted, "start_char", "end_char", ["end"]).withColumnRenamed("near_end", "_before")
    limits = ranges.groupBy("script_id").agg(F.max(duration).alias("_limit"))
    ahead = trusted.join(limits, "script_id").where("start < _limit - 0.5")
    both = as_of(before, ahead, "end_char", "start_char", ["start"], forward=True).withColumnRenamed("near_start", "_after")
    start = F.coalesce("_from", "_before", F.lit(0.0))
    end = F.coalesce("_to", F.greatest(F.coalesce("_before", F.lit(0.0)) + 0.5, F.coalesce("_after", F.col(duration))))
    return (
        both.join(covered, ["script_id", range_id], "left")
        .withColumn("audio_start", F.greatest(F.lit(0.0), start))
        .withColumn("audio_end", F.least(F.col(duration), end))
        .drop("_from", "_to", "_before", "_after")
    )


def drift_samples(local: DataFrame, tokens: DataFrame) -> DataFrame:
    """Signed and absolute drift of each local token's middle against the global timeline."""
    middle = F.greatest(F.col("start_char"), F.least(F.col("end_char") - 1, F.floor((F.col("start_char") + F.col("end_char") - 1) / 2)))
    points = local.where("start_char IS NOT NULL AND end_char IS NOT NULL").withColumn("char_pos", middle).withColumn("local_time", (F.col("start") + F.col("end")) / 2)
    timed = time_at_char(points.withColumnRenamed("ord", "point_id"), tokens).where("time_at IS NOT NULL")
    signed = F.col("local_time") - F.col("time_at")
    return timed.withColumnRenamed("point_id", "ord").withColumn("signed_drift", signed).withColumn("abs_drift", F.abs(signed))
