"""Small document tables that hold the cases every operator must stand."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, node long, label string, rank int, _flag boolean"


def docs(spark, rows):
    """A documents table with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, "src", len(t or ""), "d", 7, "l", 1, True) for i, t, lang in rows], DOCS)


def plain(spark, texts, lang="en"):
    return docs(spark, [(i, t, lang) for i, t in enumerate(texts)])


def rows(df):
    return {tuple(r) for r in df.collect()}
