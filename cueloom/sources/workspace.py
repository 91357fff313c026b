"""The shared folder for tables that cut lineage.

The folder is the one the cluster names in ``spark.checkpoint.dir``: the driver and every executor see it, so a
lost executor loses nothing that was written there. Only where the setting is absent, as in tests, a folder below
the warehouse is taken, which must be shared too on a cluster.

Tables that only an operator's own steps read are deleted when it leaves its ``scratch``; what its result reads is written with
``outlive``: it goes with the scratch around that one, and without one it stays until the cluster clears the folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_open: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


def shared_folder(spark: SparkSession) -> str:
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_workspace"
    spark.sparkContext.setCheckpointDir(own)
    return own


def new_path(spark: SparkSession, name: str, outlive: bool = False) -> str:
    """A path for a new table, which goes with the scratch that is open, or with the one around that if it is to ``outlive`` it."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    around = _open.get()[: -1 if outlive else None]
    if around:
        around[-1].append(path)
    return path


def written(df: DataFrame, name: str, outlive: bool = False) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back with its own schema."""
    spark = df.sparkSession
    path = new_path(spark, name, outlive)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Within it, tables are recorded when they are written, and deleted at its end."""
    paths: list[str] = []
    token = _open.set((*_open.get(), paths))
    try:
        yield
    finally:
        _open.reset(token)
        for path in paths:
            drop_path(spark, path)


def bounded_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches from now on: what a Python worker and its JVM task hold for one stays at a few megabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
