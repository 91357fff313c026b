"""The corpus pipeline: language ID, exact dedup, near dedup, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``; rows that a stage drops are gone for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.llm import language_id, pii
from cueloom.llm.exact_dedup import exact_groups
from cueloom.llm.keep import without
from cueloom.llm.minhash import near_duplicates, text_hash
from cueloom.llm.packing import pack
from cueloom.llm.queries import vocabulary
from cueloom.sources.tables import table
from cueloom.sources.workspace import bounded_batches, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those without a letter or with a narrow margin go."""
    bounded_batches(spark)
    return language_id.keep_identified(docs, language_id.learn(docs.where(~language_id.held_out(F.col("doc_id")))))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest doc_id stays."""
    groups = written(exact_groups(docs).where("group_size > 1").select("doc_id", "first_id"), "copies")
    repeated = groups.where("doc_id = first_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    return without(docs, groups.where("doc_id <> first_id").select("doc_id"), repeated)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 80 % of their five-word shingles the one with the smallest doc_id stays."""
    found = written(near_duplicates(docs, words=5, percent=80).where("NOT kept").select("doc_id"), "near-copies")
    return without(docs, found)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced in their text."""
    return pii.redact(docs, pii.trained(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces of the documents in sequences of 2048 tokens."""
    return pack(docs, *vocabulary())


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: Compression, a trained network and a tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
