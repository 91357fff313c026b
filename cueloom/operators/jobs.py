"""Job requests and job states as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.functions import charsets as C

STATES = ("queued", "running", "succeeded", "failed")
FILES = {"srt": "output.srt", "vtt": "output.vtt", "quality_report": "quality_report.json", "alignment": "alignment.json"}


def checked(requests: DataFrame) -> DataFrame:
    """Requests (audio, profile, min_duration, max_duration, line_chars, script_text, language) with the first fault, or null."""
    blank = F.coalesce(F.regexp_replace("script_text", f"{C.WS}+", ""), F.lit("")) == ""
    fault = (
        F.when(F.coalesce("audio", F.lit("")) == "", "no audio")
        .when(~F.coalesce(F.col("profile").isin(*C.PROFILES), F.lit(False)), "unknown profile")
        .when(F.col("min_duration") <= 0, "shortest duration must be positive")
        .when(F.col("max_duration") <= F.col("min_duration"), "longest duration must be above the shortest")
        .when(F.col("line_chars") <= 0, "line characters must be positive")
        .when(blank, "no script")
        .when(~F.coalesce(F.col("language").isin(*C.GROUPS), F.lit(False)), "unsupported language")
    )
    return requests.withColumn("fault", fault)


def advanced(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """Each job's latest status, stage and error, and its logs in order, from (job_id, seq, status, stage, log, error) events."""
    latest = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    logs = F.transform(F.array_sort(F.collect_list(F.when(F.col("log").isNotNull(), F.struct("seq", "log")))), lambda e: e["log"]).alias("logs")
    state = events.groupBy("job_id").agg(latest("status"), latest("stage"), latest("error"), logs)
    return jobs.join(state, "job_id", "left").withColumn("status", F.coalesce("status", F.lit("queued")))


def downloads(jobs: DataFrame) -> DataFrame:
    """The subtitle files that a finished job (job_id, status, audio_name, kinds) offers."""
    kinds = F.array_intersect("kinds", F.array(F.lit("srt"), F.lit("vtt")))
    stem = F.regexp_replace(F.regexp_extract("audio_name", r"([^/]*)$", 1), r"\.[^.]*$", "")
    name = F.concat_ws(".", F.when(F.trim(stem) != "", F.trim(stem)).otherwise("audio"), F.col("kind"))
    return jobs.where("status = 'succeeded'").withColumn("kind", F.explode(kinds)).select("job_id", "kind", name.alias("file_name"))


def file_of(kind: Column) -> Column:
    """The output's fixed file name; null for a kind that doesn't exist."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in FILES.items() for x in pair]), kind)
