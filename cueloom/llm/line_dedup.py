"""Line dedup by content-defined chunks of lines.

Lines are hashed; a rolling hash over the last ``WINDOW`` line hashes ends a chunk where it is 0 modulo ``DIVISOR``, or
after ``MOST_LINES`` lines. A boundary depends on WINDOW lines only, so that a passage which many documents share is
cut alike inside, whatever stands before it. Chunks of at least two lines that are not blank can be removed: of the
chunks with equal bytes the first (smallest doc_id, then position) stays in the whole corpus, and the others go.

Chunks alone miss most short passages, whose edges lie inside chunks. With ``passages`` each pair of neighbouring
lines that aren't blank (blank lines between them belong to it) is a unit besides the chunks, and goes by the same rule. So every line
of a passage of two lines or more that all stood earlier goes, wherever it is cut; of each distinct line the first stays.

Digests with more than one chunk are hits; a second pass sends on the bytes of chunks that can be hits (see
``filters``), and the smallest and largest bytes of a digest are compared. Where a digest stands for different bytes, its
chunks are grouped by the bytes themselves. Occurrences are counted
pre-aggregated, so that a chunk of very many documents sends one row per task; documents without a removal aren't shuffled.

Defined results: lines end at "\\n". Null text stays null, empty text stays empty; neither loses anything. Rows that repeat a doc_id and its text
lose the same chunks, and count as one document; a repeated doc_id with other text is a document of its own. An empty
table gives an empty result. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cueloom.llm.filters import flagged, free_names, maybe_among
from cueloom.sources.workspace import scratch, written

WINDOW = 2
DIVISOR = 3
MOST_LINES = 64
SLICE = 512
#: Added to the first line of a pair, to tell it from a chunk.
PAIR = 1 << 30
_TURN = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def chunks(lines: list[bytes]) -> list[tuple[int, int]]:
    """(first line, line after the last) of each chunk."""
    out, start, last = [], 0, len(lines)
    hashes = [xxhash.xxh3_64_intdigest(line) for line in lines]
    for i in range(last):
        rolled = 0
        for h in hashes[max(0, i - WINDOW + 1) : i + 1]:
            rolled = ((rolled ^ h) * _TURN) & _MASK
        if (rolled >> 32) % DIVISOR == 0 or i + 1 - start >= MOST_LINES or i + 1 == last:
            out.append((start, i + 1))
            start = i + 1
    return out


def removable(lines: list[bytes]) -> list[tuple[int, int, bytes]]:
    """(first line, line after the last, bytes) of the chunks that hold two lines or more that aren't blank."""
    found = []
    for a, b in chunks(lines):
        if b - a > 1 and sum(not line.isspace() and line != b"" for line in lines[a:b]) > 1:
            found.append((a, b, b"\n".join(lines[a:b])))
    return found


def pairs(lines: list[bytes]) -> list[tuple[int, int, bytes]]:
    """(first line, line after the last, bytes without blank lines) of each two neighbouring lines that aren't blank."""
    full = [i for i, line in enumerate(lines) if line != b"" and not line.isspace()]
    return [(a, b + 1, lines[a] + b"\n" + lines[b]) for a, b in zip(full, full[1:], strict=False)]


def _lines(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split(b"\n") if text else []


def _occurrences(docs: DataFrame, with_bytes: bool, passages: bool, digest=xxhash.xxh3_128_digest) -> DataFrame:
    """doc, key, place, digest and, if asked for, the bytes of each removable chunk and, with ``passages``, pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), SLICE):
                batch = whole.slice(at, SLICE)
                rows = []
                for doc, key, text in zip(batch.column("doc").to_pylist(), batch.column("key").to_pylist(), batch.column("text"), strict=True):
                    lines = _lines(text.as_py())
                    rows += [(doc, key, a, digest(data, 0), b"c" + data) for a, _, data in removable(lines)]
                    if passages:
                        rows += [(doc, key, a + PAIR, digest(data, 1), b"p" + data) for a, _, data in pairs(lines)]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                kinds = {"doc": pa.int64(), "key": pa.int64(), "place": pa.int32(), "digest": pa.binary()} | ({"bytes": pa.binary()} if with_bytes else {})
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=False)], names=list(kinds))

    return docs.mapInArrow(run, "doc long, key long, place int, digest binary" + ", bytes binary" * with_bytes)


def repeated_chunks(docs: DataFrame, passages: bool = False, digest=xxhash.xxh3_128_digest) -> DataFrame:
    """(doc, key, places): the first lines of the chunks, and PAIR + those of the pairs, to remove from each document that loses any.

    ``digest`` maps bytes and a seed to bytes; any digest gives the same result, a weak one only makes more bytes be compared.
    """
    with scratch(docs.sparkSession):
        return written(_repeated_chunks(docs, passages, digest), "line-removals", outlive=True)


def _repeated_chunks(docs: DataFrame, passages: bool, digest) -> DataFrame:
    plain = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    met = written(_occurrences(plain, False, passages, digest), "line-chunks")
    place = F.struct("doc", "key", "place")
    hits = met.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last")
    hits = written(hits.select("digest", "first"), "line-hits")
    seen = maybe_among(_occurrences(plain, True, passages, digest), "digest", hits.select("digest"))
    same = seen.groupBy("digest").agg((F.min("bytes") == F.max("bytes")).alias("same"))
    hits = written(hits.join(same, "digest"), "line-verified")
    perhaps = maybe_among(met, "digest", hits.where("same").select("digest"))
    removed = perhaps.join(hits.where("same").select("digest", "first"), "digest").where(place != F.col("first")).select("doc", "key", "place")
    mixed = hits.where("NOT same").select("digest")
    if not mixed.isEmpty():
        own = seen.join(mixed, "digest", "left_semi")
        first = own.groupBy("digest", "bytes").agg(F.min(place).alias("first"))
        removed = removed.unionByName(own.join(first, ["digest", "bytes"]).where(place != F.col("first")).select("doc", "key", "place"))
    return removed.distinct().groupBy("doc", "key").agg(F.sort_array(F.collect_list("place")).alias("places"))


COUNTS = ("n_lines", "n_removed_chunks", "n_removed_lines")


def remove_repeated_lines(docs: DataFrame, passages: bool = False) -> DataFrame:
    """``docs`` with the repeated chunks taken out of ``text``, and behind its columns those of COUNTS.

    With ``passages`` repeated pairs of lines go too, and a stretch of removed lines counts as one chunk.

    Where ``docs`` has a column of such a name, the count's name gets an underscore in front.
    """
    lost = repeated_chunks(docs, passages)
    columns, schema = docs.columns, docs.schema
    doc, key, flag, gone, lost_doc, lost_key, *counted = free_names(columns, "doc", "key", "touched", "places", "lost_doc", "lost_key", *COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), SLICE):
                batch = whole.slice(at, SLICE)
                texts, counts = [], np.zeros((3, len(batch)), np.int64)
                for r, (text, places) in enumerate(zip(batch.column("text"), batch.column(gone), strict=True)):
                    text, places = text.as_py(), set(places.as_py() or ())
                    lines = _lines(text)
                    counts[0, r], counts[1, r] = len(lines), len(places)
                    if places:
                        spans = [(a, b) for a, b in chunks(lines) if a in places]
                        if passages:
                            spans += [(a, b) for a, b, _ in pairs(lines) if a + PAIR in places]
                        gone_lines = np.zeros(len(lines), bool)
                        for a, b in spans:
                            gone_lines[a:b] = True
                        if passages:
                            counts[1, r] = np.count_nonzero(np.diff(gone_lines.view(np.int8), prepend=0) == 1)
                        kept = [line for line, lost_line in zip(lines, gone_lines, strict=True) if not lost_line]
                        counts[2, r] = len(lines) - len(kept)
                        text = b"\n".join(kept).decode("utf-8", "surrogatepass")
                    texts.append(text)
                put = pa.array(texts, batch.schema.field("text").type)
                yield pa.RecordBatch.from_arrays([*(put if c == "text" else batch.column(c) for c in columns), *map(pa.array, counts)], names=[*columns, *counted])

    own = [F.col(f"`{c}`") for c in columns]
    keyed = docs.withColumn(doc, F.col("doc_id").cast("long")).withColumn(key, F.xxhash64(F.col("text").cast("string")))
    marked = flagged(keyed, doc, lost.select("doc"), flag)
    removals = lost.select(F.col("doc").alias(lost_doc), F.col("key").alias(lost_key), F.col("places").alias(gone))
    touched = marked.where(F.col(flag)).join(removals, (F.col(doc) == F.col(lost_doc)) & (F.col(key) == F.col(lost_key)), "left")
    both = marked.where(~F.col(flag)).select(*own, F.lit(None).cast("array<int>").alias(gone)).unionByName(touched.select(*own, gone))
    return both.mapInArrow(run, StructType([*schema.fields, *(StructField(c, LongType()) for c in counted)]))
