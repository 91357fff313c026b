"""Exact dedup: a log-structured merge index over text digests, in DataFrame functions only.

A batch of documents is split into memtables. Each memtable is flushed as one run:
one entry per digest (smallest id, largest id, rows), sorted by digest, with a Parquet bloom filter on the digest
beside the row-group minima and maxima; these serve point lookups (``DigestIndex.find``). A memtable has ``memtable_rows`` rows, or as many more
as keep the runs of a batch at ``MOST_RUNS``, so that neither folders nor rewrites grow with the data. Each run also has a bitmap filter of
its digests. Before runs are merged, the bits that at least two runs set are gathered (4 MiB at most), and every entry is probed: an entry
of one row whose bit no other run sets equals no other and stays in its run. (Far more entries than bits pass all; the result is the same.) Compaction merges the rest, ``fanout`` runs of one level into a run of the next until
one run is left; merging keeps the smallest (and largest) identifier of each digest. Every level is one Spark job,
whatever the number of runs, and ids travel pre-aggregated: a group of copies sends one entry per map task.

Digests that the index holds more than once are hits. Hits are verified by bytes: a bitmap filter of bounded size
(see ``filters``) lets the scan send on only documents that can be hits, and the smallest and the
largest text of each digest are compared. Where they differ the digest stood for several texts, and its documents
are grouped by the text itself. Documents that the filter shows to be no hits are alone, and are not shuffled again.

Defined results: null text counts as empty. Rows that repeat a doc_id are rows of their own in ``group_size``; if
they hold the kept id, each of them is kept. A null doc_id never is the kept id unless its whole group has null ids.
An empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.llm.filters import bitmaps, flagged, in_several, maybe_among, probed
from cueloom.sources.workspace import drop_path, new_path, scratch, written


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


MOST_RUNS = 64
ENTRY = "digest binary, first_id long, last_id long, n long, run int"


class DigestIndex:
    """Sorted runs of digest entries below ``path``: ``level=L/run=R``, fewer and larger with each level."""

    def __init__(self, spark: SparkSession, path: str, memtable_rows: int = 100_000, fanout: int = 8):
        self.spark, self.path, self.memtable_rows, self.fanout = spark, path, memtable_rows, fanout
        self.level, self.runs, self.first_runs = 0, 0, 0

    def _write(self, entries: DataFrame, level: int) -> None:
        (
            entries.repartitionByRange("run", "digest")
            .sortWithinPartitions("run", "digest")
            .write.partitionBy("run")
            .option("parquet.bloom.filter.enabled#digest", "true")
            .option("parquet.bloom.filter.expected.ndv#digest", str(self.memtable_rows))
            .parquet(f"{self.path}/level={level}")
        )

    def _read(self, level: int) -> DataFrame:
        return self.spark.read.schema(ENTRY).parquet(f"{self.path}/level={level}")

    def flush(self, digests: DataFrame, rows: int) -> None:
        """Write the memtables of a batch (doc_id, digest) as runs of level 0."""
        self.runs = min(MOST_RUNS, max(1, math.ceil(rows / self.memtable_rows)))
        run = F.pmod(F.xxhash64("doc_id"), F.lit(self.runs)).cast("int").alias("run")
        self._write(
            digests.groupBy(run, "digest").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("n")),
            0,
        )

    def _shared(self) -> DataFrame:
        """The entries of level 0 with whether they may have an equal, by the filters of the runs."""
        entries, runs = self._read(0), self.runs if not self.level else self.first_runs
        several = in_several(bitmaps(entries.select("digest", "run"), "run"), "run", runs)
        return probed(entries, "digest", several, "maybe").withColumn("shared", F.col("maybe") | (F.col("n") > 1)).drop("maybe")

    def compact(self) -> None:
        """Merge runs, ``fanout`` at a time, until one is left; entries that are alone stay in their runs of level 0."""
        self.first_runs = self.runs
        while self.runs > 1:
            entries = self._read(self.level) if self.level else self._shared().where("shared")
            merged = entries.groupBy((F.col("run") / F.lit(self.fanout)).cast("int").alias("run"), "digest").agg(F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"), F.sum("n").alias("n"))
            self._write(merged, self.level + 1)
            if self.level:
                drop_path(self.spark, f"{self.path}/level={self.level}")
            self.level, self.runs = self.level + 1, math.ceil(self.runs / self.fanout)

    def entries(self) -> DataFrame:
        """An entry for each digest: those that compaction merged, and those that are alone."""
        merged = self._read(self.level).drop("run")
        return merged.unionByName(self._shared().where("NOT shared").drop("run", "shared")) if self.level else merged

    def find(self, digests: list[bytes]) -> DataFrame:
        """The entries of a few digests; Parquet's filters pass over files and row groups that hold none."""
        return self.entries().where(F.col("digest").isin(*[bytearray(d) for d in digests]))

    def hits(self) -> DataFrame:
        return self._read(self.level).drop("run").where("n > 1")


def exact_groups(docs: DataFrame, digest=text_digest, memtable_rows: int = 100_000, fanout: int = 8) -> DataFrame:
    """Each row's group of equal texts: doc_id, digest, first_id, last_id, group_size.

    ``digest`` maps the text column to a binary column; any digest gives the same groups, a weak one only makes
    more documents meet in the comparison of bytes.
    """
    with scratch(docs.sparkSession):
        return written(_exact_groups(docs, digest, memtable_rows, fanout), "exact-groups", outlive=True)


def _exact_groups(docs: DataFrame, digest, memtable_rows: int, fanout: int) -> DataFrame:
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    digested = plain.withColumn("digest", digest(F.col("text")))
    ids = written(digested.select("doc_id", "digest"), "digests")
    index = DigestIndex(spark, new_path(spark, "digest-index"), memtable_rows, fanout)
    index.flush(ids, ids.count())
    index.compact()
    hits = index.hits()

    compared = maybe_among(digested, "digest", hits.select("digest")).groupBy("digest").agg((F.min("text") == F.max("text")).alias("same"))
    hits = written(hits.join(compared, "digest"), "verified")
    equal = hits.where("same").select("digest", "first_id", "last_id", F.col("n").alias("group_size"))

    def grouped(rows: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
        found = F.col("group_size").isNotNull()
        return rows.join(groups, on, "left").select(
            "doc_id",
            "digest",
            F.when(found, F.col("first_id")).otherwise(F.col("doc_id")).alias("first_id"),
            F.when(found, F.col("last_id")).otherwise(F.col("doc_id")).alias("last_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        )

    marked = flagged(ids, "digest", hits.select("digest"), "maybe")
    alone = marked.where("NOT maybe").select("doc_id", "digest", F.col("doc_id").alias("first_id"), F.col("doc_id").alias("last_id"), F.lit(1).cast("long").alias("group_size"))
    perhaps = marked.where("maybe").drop("maybe")
    split = hits.where(~F.col("same")).select("digest")
    if split.isEmpty():
        return alone.unionByName(grouped(perhaps, equal, ["digest"]))
    several = digested.join(split, "digest", "left_semi")
    by_text = several.groupBy("digest", "text").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("group_size"))
    of_one = grouped(perhaps.join(split, "digest", "left_anti"), equal, ["digest"])
    return alone.unionByName(of_one).unionByName(grouped(several, by_text, ["digest", "text"]))


def exact_dedup(docs: DataFrame, keep: str = "smallest", **options) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest of each row; ``keep`` is "smallest" or "largest" doc_id."""
    groups = exact_groups(docs, **options).withColumn("keep_id", F.col({"smallest": "first_id", "largest": "last_id"}[keep]))
    return groups.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")
