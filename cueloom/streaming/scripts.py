"""Scripts as a stream of JSON files: each micro-batch runs the batch job and appends its outputs.

An extension: the batch engine doesn't need it. Batches are idempotent, as each writes to folders named by its number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from cueloom.functions.profiles import profiles
from cueloom.plans.aligner import Aligner
from cueloom.plans.job import align_scripts, cue_rows, reports
from cueloom.sources.sinks import write_outputs
from cueloom.sources.workspace import written

SCRIPT = "script_id long, language string, profile string, script_text string"


def watch(spark: SparkSession, source: str, target: str, checkpoint: str, aligner: Aligner, once: bool = True) -> StreamingQuery:
    """Align the scripts that arrive as JSON files in ``source``; outputs go to ``target/batch=N``."""

    def run(batch: DataFrame, number: int) -> None:
        done = written(align_scripts(batch, aligner), "aligned")
        write_outputs(done, cue_rows(done), reports(done, profiles(batch.sparkSession)), f"{target}/batch={number}")

    writer = spark.readStream.schema(SCRIPT).json(source).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
