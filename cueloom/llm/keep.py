"""Taking rows out of a table by id without shuffling the rows that stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.llm.filters import flagged, free_names


def without(docs: DataFrame, gone: DataFrame, repeated: DataFrame | None = None, digest: Column | None = None) -> DataFrame:
    """``docs`` without the doc_ids in the one column of ``gone``; of the ids in ``repeated`` one row for each text.

    With ``digest``, an expression over ``docs``, ``gone`` has a second column, and a row goes only where its id (null
    included) and its digest are there together. Rows that a filter of bounded size shows to be in neither pass
    straight on; only the others are joined. Without ``digest``, rows with a null doc_id stay.
    """
    doc, text, key, flag, gone_doc, gone_text = free_names(docs.columns, "doc", "text_digest", "key", "flag", "gone_doc", "gone_text")
    own = [F.col(f"`{c}`") for c in docs.columns]
    second = F.lit("") if digest is None else digest
    gone = gone.toDF(gone_doc).where(F.col(gone_doc).isNotNull()).withColumn(gone_text, F.lit("")) if digest is None else gone.toDF(gone_doc, gone_text)
    gone = gone.distinct()
    keyed = docs.withColumn(doc, F.col("doc_id").cast("long")).withColumn(text, second).withColumn(key, F.xxhash64(doc, text))
    keys = gone.select(F.xxhash64(F.col(gone_doc).cast("long"), gone_text).alias(key))
    match = F.col(doc).eqNullSafe(F.col(gone_doc)) & F.col(text).eqNullSafe(F.col(gone_text))
    if repeated is None:
        marked = flagged(keyed, key, keys, flag)
        return marked.where(~F.col(flag)).select(own).unionByName(marked.where(F.col(flag)).join(gone, match, "left_anti").select(own))
    again = repeated.toDF(gone_doc).where(F.col(gone_doc).isNotNull()).select(F.xxhash64(F.col(gone_doc).cast("long")).alias(key))
    (several,) = free_names([*docs.columns, doc, text, key, flag], "several")
    marked = flagged(flagged(keyed, key, keys, flag).withColumn(key, F.xxhash64(doc)), key, again, several)
    left = marked.where(F.col(flag)).join(gone, match, "left_anti").unionByName(marked.where(~F.col(flag)))
    once = left.where(F.col(several) & F.col(doc).isNotNull()).dropDuplicates([doc, "text"])
    return left.where(~F.col(several) | F.col(doc).isNull()).select(own).unionByName(once.select(own))
