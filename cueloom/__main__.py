"""python -m cueloom --scripts FILES --language en --out FOLDER: subtitles and reports for script files.

``--aligner module:name`` names an aligner class or object (see ``plans.aligner``); without it the synthetic one is used.
"""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cueloom.functions import charsets as C
from cueloom.functions.profiles import InputError, profiles, resolve
from cueloom.plans.aligner import SteadyAligner
from cueloom.plans.job import align_scripts, cue_rows, reports
from cueloom.sources.scripts import script_files
from cueloom.sources.sinks import write_outputs
from cueloom.sources.workspace import written


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--scripts", required=True)
    parser.add_argument("--language", required=True, choices=sorted(C.GROUPS))
    parser.add_argument("--profile", default="youtube_long", choices=sorted(C.PROFILES))
    parser.add_argument("--out", default="outputs")
    parser.add_argument("--aligner")
    parser.add_argument("--min-duration", type=float)
    parser.add_argument("--max-duration", type=float)
    parser.add_argument("--line-chars", type=int)
    args = parser.parse_args(argv)
    limits = {"min_duration": args.min_duration, "max_duration": args.max_duration, "line_chars": args.line_chars}
    try:
        resolve(args.profile, args.language, **limits)
    except InputError as error:
        print(f"ERROR: {error}")
        return 2
    aligner = SteadyAligner()
    if args.aligner:
        module, _, name = args.aligner.partition(":")
        found = getattr(importlib.import_module(module), name)
        aligner = found() if isinstance(found, type) else found
    spark = spark or SparkSession.builder.appName("cueloom").getOrCreate()
    scripts = script_files(spark, args.scripts).withColumn("script_id", F.xxhash64("path")).withColumn("language", F.lit(args.language)).withColumn("profile", F.lit(args.profile))
    done = written(align_scripts(scripts, aligner, limits=limits), "aligned")
    report = reports(done, profiles(spark))
    write_outputs(done, cue_rows(done), report, args.out, files=True)
    failed = done.where("error_class IS NOT NULL").count()
    print(f"scripts: {done.count()}, failed: {failed}, outputs: {args.out}")
    return 2 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
