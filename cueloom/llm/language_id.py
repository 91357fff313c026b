"""Language identification by compression with per-language zstandard raw-content dictionaries.

Learning takes a bounded sample: of each language the ``SAMPLE_DOCS`` labelled documents that come first by a hash
of doc_id, lower-cased and joined to a dictionary of ``DICTIONARY_BYTES``; the ``MAX_LANGUAGES`` commonest languages are
learned, which bounds what a worker holds. Counts of labelled documents are taken over all rows; they settle ties and tell which rows are
candidates for the sample, so that no task sends on more than its share.

A prediction lower-cases the whole text, cuts it into blocks of ``BLOCK_BYTES`` (so that a long text keeps leaning
on the dictionary and not on itself), compresses every block with each dictionary and adds up the frames. The
language with the fewest bytes wins. With ``margin`` = 1 - fewest/second fewest bytes, score = min(1, margin /
FULL_MARGIN). A prediction is rejected (``accepted`` false) where the text has no letter, or where the two best
languages are less than ``least_difference`` bytes apart: MIN_MARGIN of the second's bytes, LEAST_BYTES in a text of 100
bytes or more, a twentieth of a shorter text, and one byte always, so that a tie is rejected. Only a text below RAW_BYTES,
which zstandard stores as it is with every dictionary, can't show a difference and is accepted as the commonest language.

Defined results: null text, empty text and text with no letter give ``und``, score 0, rejected. Of equal sizes the
language with the most labelled documents wins, then the one that sorts first. Null languages teach nothing. With
no labelled document every text is ``und``; with one language the score is 1. Repeated rows are predicted one by
one. Other columns aren't read. A prediction sees the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.llm.memory import tidy
from cueloom.llm.sampling import cutoff, place

DICTIONARY_BYTES = 96 << 10
SAMPLE_DOCS = 128
MAX_LANGUAGES = 256
BLOCK_BYTES = 4096
LEVEL = 9
#: Share of bytes saved over the second language that counts as full confidence.
FULL_MARGIN = 0.1
MIN_MARGIN = 0.002
LEAST_BYTES = 5
#: Blocks below this size are never compressed.
RAW_BYTES = 7
UNDETERMINED = "und"


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: crc32 of the id's text leaves 2 when divided by 4."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def learn(labelled: DataFrame) -> list[tuple[str, bytes]]:
    """(language, dictionary content) by falling number of labelled documents, from (doc_id, text, lang) rows."""
    usable = labelled.where("lang IS NOT NULL AND trim(text) <> ''")
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    if not counts:
        return []
    usable = usable.where(F.col("lang").isin([row["lang"] for row in counts]))
    # Candidates are told by a cutoff for each language, so that only about SPARE * SAMPLE_DOCS of each are ranked.
    limits = F.create_map(*[F.lit(x) for row in counts for x in (row["lang"], cutoff(SAMPLE_DOCS, row["count"]))])
    near = usable.select("lang", place(F.col("doc_id")).alias("place"), F.substring("text", 1, DICTIONARY_BYTES).alias("text")).where(F.col("place") < F.element_at(limits, F.col("lang")))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("place", "text")))
    sample = ranked.where(F.col("rank") <= SAMPLE_DOCS).select("lang", F.col("rank").alias("place"), "text").collect()
    texts: dict[str, list[tuple[int, str]]] = {}
    for row in sample:
        texts.setdefault(row["lang"], []).append((row["place"], row["text"].lower()))
    order = [row["lang"] for row in sorted(counts, key=lambda row: (-row["count"], row["lang"]))]
    return [(lang, "\n".join(text for _, text in sorted(texts[lang])).encode("utf-8", "replace")[:DICTIONARY_BYTES]) for lang in order if lang in texts]


def least_difference(size: int, second: int) -> float:
    """Bytes by which the best language of a text of ``size`` bytes must be ahead of the second."""
    return max(1, min(LEAST_BYTES, size // 20), MIN_MARGIN * second)


class Classifier:
    """The compressors of one worker."""

    def __init__(self, contents: list[tuple[str, bytes]], level: int = LEVEL):
        self.compressors = []
        for lang, content in contents:
            settings = zstandard.ZstdCompressionParameters.from_level(
                level, min_match=3, dict_size=len(content), source_size=BLOCK_BYTES, write_content_size=False, write_dict_id=False
            )
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.compressors.append((lang, zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings)))
        self.empty = min((len(c.compress(b"")) for _, c in self.compressors), default=0)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, accepted)."""
        if not text or not self.compressors or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, False
        data = text.lower().encode("utf-8", "replace")
        blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        sizes = [sum(len(c.compress(b)) for b in blocks) - self.empty * len(blocks) for _, c in self.compressors]
        best = sizes.index(min(sizes))
        if len(sizes) == 1:
            return self.compressors[0][0], 1.0, True
        second = min(sizes[:best] + sizes[best + 1 :])
        margin = 1 - sizes[best] / max(1, second)
        accepted = len(data) < RAW_BYTES or second - sizes[best] >= least_difference(len(data), second)
        return self.compressors[best][0], min(1.0, max(0.0, margin / FULL_MARGIN)), accepted


def _predictor(contents: list[tuple[str, bytes]]):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(contents)
        for batch in batches:
            found = [classifier.predict(text.as_py()) for text in batch.column("text")]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "lang_pred", "score", "accepted"])

    return run


def identify(docs: DataFrame, contents: list[tuple[str, bytes]]) -> DataFrame:
    """doc_id, lang_pred, score, accepted for each row of ``docs``."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(_predictor(contents), "doc_id long, text string, lang_pred string, score double, accepted boolean").drop("text")


def keep_identified(docs: DataFrame, contents: list[tuple[str, bytes]]) -> DataFrame:
    """The rows of ``docs`` whose prediction is accepted, with all their columns."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(contents)
        for batch in batches:
            yield batch.filter(pa.array([classifier.predict(text.as_py())[2] for text in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
