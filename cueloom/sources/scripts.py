"""Script texts from files and uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.functions.charsets import WS


def script_files(spark: SparkSession, path: str) -> DataFrame:
    """path and script_text of UTF-8 files, with or without a byte order mark."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"^\x{feff}", "").alias("script_text"))


def chosen_text(uploaded: Column, pasted: Column) -> Column:
    """An upload's text wins, blank or not; else pasted text that isn't blank; else null."""
    return F.coalesce(uploaded, F.when(F.regexp_replace(pasted, f"{WS}+", "") != "", pasted))
