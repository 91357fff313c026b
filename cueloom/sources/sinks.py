"""Subtitle files as columns: SRT, VTT, alignment and report JSON, one row per script, written partitioned by script."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueloom.functions.text import strip_trailing_punctuation
from cueloom.functions.timing import srt_timestamp, vtt_timestamp


def _ordered(cues: DataFrame, block, between: str):
    gathered = F.array_sort(F.collect_list(F.struct(F.col("idx"), block.alias("block"))))
    return cues.groupBy("script_id").agg(F.array_join(F.transform(gathered, lambda b: b["block"]), between).alias("body"))


def srt(cues: DataFrame) -> DataFrame:
    """script_id and the SRT file; lines lose the punctuation at their ends."""
    times = F.concat_ws(" --> ", srt_timestamp(F.col("start")), srt_timestamp(F.col("end")))
    block = F.concat_ws("\n", F.col("idx").cast("string"), times, strip_trailing_punctuation(F.col("text")))
    return _ordered(cues, block, "\n\n").select("script_id", F.concat("body", F.lit("\n")).alias("srt"))


def vtt(cues: DataFrame) -> DataFrame:
    """script_id and the VTT file; text stays as it is."""
    times = F.concat_ws(" --> ", vtt_timestamp(F.col("start")), vtt_timestamp(F.col("end")))
    return _ordered(cues, F.concat(times, F.lit("\n"), F.col("text"), F.lit("\n")), "\n").select("script_id", F.concat(F.lit("WEBVTT\n\n"), F.col("body")).alias("vtt"))


def alignment_json(results: DataFrame) -> DataFrame:
    """script_id and the alignment file of each aligned script: settings, diagnostics, the engine's own result, tokens and cues."""
    nested = {"timeline_diagnostics": "timeline", "token_diagnostics": "token_diagnostics", "cue_diagnostics": "cue_diagnostics", "engine_result": "engine_result"}
    plain = F.struct(
        "language",
        F.col("profile").alias("subtitle_profile"),
        "audio_duration",
        F.length("display_text").alias("display_text_length"),
        "align_text_length",
        "tokens",
        F.transform("cues", lambda c: F.struct(c["idx"].alias("index"), *[c[x].alias(x) for x in ("start", "end", "text", "start_char", "end_char", "warnings")])).alias("cues"),
    )
    # The nested parts are JSON already, and go in front of the other fields as they are.
    front = F.concat_ws(", ", *[F.concat(F.lit(f'"{name}": '), F.coalesce(F.col(column), F.lit("{}"))) for name, column in nested.items()])
    body = F.to_json(plain, {"ignoreNullFields": "false"})
    whole = F.concat(F.lit("{"), front, F.lit(", "), F.substring(body, F.lit(2), F.length(body) - 1))
    return results.where("error_class IS NULL").select("script_id", whole.alias("alignment"))


def report_json(reports: DataFrame) -> DataFrame:
    return reports.select("script_id", F.to_json(F.struct(*[c for c in reports.columns if c != "script_id"])).alias("quality_report"))


def write_outputs(results: DataFrame, cues: DataFrame, reports: DataFrame, path: str, files: bool = False) -> None:
    """One folder per kind below ``path``, with a row per script: output_srt, output_vtt, alignment, quality_report.

    With ``files`` there are also the four files themselves for each script, ``path/scripts/ID/output.srt`` and so on.
    """
    kinds = {"output_srt": (srt(cues), "output.srt"), "output_vtt": (vtt(cues), "output.vtt"), "alignment": (alignment_json(results), "alignment.json"), "quality_report": (report_json(reports), "quality_report.json")}
    for name, (table, file_name) in kinds.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
        if files:
            written = table.sparkSession.read.parquet(f"{path}/{name}")
            content = next(c for c in written.columns if c != "script_id")
            write_files(written.select(F.concat_ws("/", F.lit("scripts"), F.col("script_id").cast("string"), F.lit(file_name)).alias("name"), F.col(content).alias("content")), path)


def write_files(rows: DataFrame, path: str) -> None:
    """Each row (name, content) as a UTF-8 file below ``path``, written by the task that holds it through PyArrow's file systems.

    A file is first written beside its place and then moved there, so that a task that runs again leaves whole files only.
    """

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                target = f"{root.rstrip('/')}/{name}"
                store.create_dir(target.rpartition("/")[0], recursive=True)
                part = f"{target}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write((content or "").encode("utf-8", "surrogatepass"))
                store.move(part, target)
            yield batch.slice(0, 0)

    rows.select("name", "content").mapInArrow(run, "name string, content string").write.format("noop").mode("overwrite").save()
