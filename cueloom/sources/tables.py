"""Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``, which may be any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
