"""Best-fit packing: pattern packing by non-negative least squares on the length histogram.

1. Every document becomes token ids plus an end id, cut into pieces of at most ``capacity`` tokens where it is longer
   (the first piece takes the remainder).
2. The lengths' histogram (``capacity`` counts, whatever the number of documents) goes to the driver. Patterns of at
   most ``PATTERN_PARTS`` lengths, in units of capacity / UNITS, that fill a sequence are enumerated; non-negative
   least squares fits how often each is repeated; counts are rounded down. Patterns are then filled with exact
   lengths, the last place of each by best fit, and what is left is packed by best fit into open sequences; then the emptiest
   sequences are opened and packed again as long as that saves any. All of it works on
   runs of equal sequences: the plan has a size that depends on the capacity and not on the number of documents.
3. Each piece gets a rank among the pieces of its length, distributed over hashed chunks so that a length that a third
   of all pieces share is ranked in many tasks, and takes its place in the plan by that rank.

Defined results: null text packs like empty text, as the end id alone. Repeated rows are packed once each. A
document of exactly ``capacity`` ids is one piece. An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueloom.llm.memory import tidy
from cueloom.sources.workspace import written

CAPACITY = 2048
UNITS = 64
PATTERN_PARTS = 4
#: Shares of the sequences, the emptiest first, that are opened again one after the other.
OPENED = (1 / 64, 1 / 32, 1 / 16, 1 / 8, 1 / 4, 1 / 2)
END_ID = 0
SPECIAL = "<|endoftext|>"
#: Pieces per chunk that are ranked together; at least LEAST_CHUNKS chunks.
CHUNK_PIECES = 4096
LEAST_CHUNKS = 64


@cache
def _exact(vocabulary: str):
    """The tokenizer of the JSON file; loaded only where a text holds the special token's string."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


@cache
def _fast(ranks: str):
    """A faster tokenizer of the same vocabulary, for texts without special tokens."""
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})


def token_ids(text: str | None, vocabulary: str, ranks: str) -> np.ndarray:
    """The text's ids and the end id, as unsigned little-endian 32-bit numbers."""
    text = text or ""
    ids = _exact(vocabulary).encode(text, add_special_tokens=False).ids if SPECIAL in text else _fast(ranks).encode_ordinary(text)
    ids.append(END_ID)
    return np.array(ids, dtype="<u4")


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, vocabulary: str, ranks: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = token_ids(text.as_py(), vocabulary, ranks)
                rows += [(doc_id, i, s, n, zlib.crc32(ids[s : s + n])) for i, (s, n) in enumerate(cut(len(ids), capacity))]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def patterns(units: int = UNITS, parts: int = PATTERN_PARTS) -> list[tuple[int, ...]]:
    """Falling tuples of at most ``parts`` lengths that add up to ``units``."""

    def grow(left: int, most: int, parts: int) -> Iterator[tuple[int, ...]]:
        if left <= most:
            yield (left,)
        if parts > 1:
            for first in range(min(most, left - 1), (left - 1) // parts, -1):
                for rest in grow(left - first, first, parts - 1):
                    yield (first, *rest)

    return sorted(set(grow(units, units, parts)), reverse=True)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 with the least |a x - b|, by an active set that gains the column with the steepest descent."""
    x, active = np.zeros(a.shape[1]), []
    slope = a.T @ b
    tiny = 1e-9 * max(1.0, float(np.abs(slope).max(initial=0)))
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[active] = -np.inf
        if not len(slope) or slope.max() <= tiny:
            break
        active.append(int(slope.argmax()))
        while active:
            best = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if best.min() > 0:
                x[:] = 0
                x[active] = best
                break
            now = x[active]
            down = best <= 0
            step = float(np.min(np.where(down, now / np.maximum(now - best, 1e-300), np.inf)))
            moved = now + step * (best - now)
            keep = moved > 1e-12
            x[:] = 0
            x[np.array(active)[keep]] = moved[keep]
            active = [c for c, k in zip(active, keep, strict=True) if k]
    return x


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) that hold histogram[n] pieces of each length n."""
    left = np.asarray(histogram, dtype=np.int64).copy()
    runs: list[tuple[tuple[int, ...], int]] = []
    unit = capacity / UNITS
    units = np.ceil(np.arange(capacity + 1) / unit).astype(int)
    binned = np.bincount(units, weights=left, minlength=UNITS + 1)[1:]
    known = [p for p in patterns() if all(binned[u - 1] for u in p)]
    if known:
        a = np.zeros((UNITS, len(known)))
        for j, p in enumerate(known):
            for u in p:
                a[u - 1, j] += 1
        repeats = np.floor(nnls(a, binned)).astype(np.int64)
        for j in np.flatnonzero(repeats):
            runs += _filled(known[j], int(repeats[j]), left, units, capacity)
    return _repacked(_rest(runs, left, capacity), histogram, capacity)


def _repacked(planned: list[tuple[tuple[int, ...], int]], histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """The plan after opening its emptiest sequences again, a growing share of them, as long as that can save any.

    Rounding leaves patterns whose gaps no residual piece fits; pieces from the emptiest sequences, packed by best fit with
    all others closed or open, fill them.
    """
    least = -(-int(np.dot(histogram, np.arange(capacity + 1))) // capacity)
    count = sum(n for _, n in planned)
    for share in OPENED:
        if count <= least:
            break
        left, kept, open_ = np.zeros(capacity + 1, dtype=np.int64), [], math.ceil(count * share)
        for lengths, n in sorted(planned, key=lambda run: (sum(run[0]), run)):
            taken = min(n, open_)
            open_ -= taken
            np.add.at(left, list(lengths), taken)
            if n > taken:
                kept.append((lengths, n - taken))
        again = _rest(kept, left, capacity)
        if sum(n for _, n in again) < count:
            planned, count = again, sum(n for _, n in again)
    return planned


def _filled(pattern: tuple[int, ...], repeats: int, left: np.ndarray, units: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences of a pattern with exact lengths, taken from ``left``."""
    runs = []
    while repeats:
        chosen: list[int] = []
        for i, u in enumerate(pattern):
            room = capacity - sum(chosen)
            last = i and i == len(pattern) - 1
            fits = (left[: room + 1] > np.bincount(chosen, minlength=room + 1)[: room + 1]) & (True if last else units[: room + 1] == u)
            found = np.flatnonzero(fits)
            if not len(found):
                break
            chosen.append(int(found[-1]))
        if len(chosen) < len(pattern):
            return runs
        lengths, times = np.unique(chosen, return_counts=True)
        n = min(repeats, int((left[lengths] // times).min()))
        left[lengths] -= times * n
        runs.append((tuple(chosen), n))
        repeats -= n
    return runs


def _rest(runs: list[tuple[tuple[int, ...], int]], left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, of what patterns have left, into open sequences and then into new ones."""
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for lengths, n in runs:
        by_room[capacity - sum(lengths)].append((lengths, n))
    for length in range(capacity, 0, -1):
        count = int(left[length])
        while count:
            room = min((r for r, have in by_room.items() if r >= length and have), default=None)
            if room is None:
                each = min(capacity // length, count)
                by_room[capacity - each * length].append(((length,) * each, count // each))
                count %= each
                continue
            lengths, n = by_room[room].pop()
            taken = min(n, count)
            if n > taken:
                by_room[room].append((lengths, n - taken))
            by_room[room - length].append(((*lengths, length), taken))
            count -= taken
    merged: dict[tuple[int, ...], int] = defaultdict(int)
    for have in by_room.values():
        for lengths, n in have:
            merged[tuple(sorted(lengths, reverse=True))] += n
    return sorted(merged.items(), reverse=True)


def places(planned: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, list[int]]]:
    """(length, first rank, rank after the last, first sequence, offsets in a sequence) for each run and length."""
    rows, used, sequence = [], defaultdict(int), 0
    for lengths, n in planned:
        offsets: dict[int, list[int]] = defaultdict(list)
        at = 0
        for length in lengths:
            offsets[length].append(at)
            at += length
        for length, own in offsets.items():
            rows.append((length, used[length], used[length] + n * len(own), sequence, own))
            used[length] += n * len(own)
        sequence += n
    return rows


def ranked(found: DataFrame, total: int) -> DataFrame:
    """``found`` with its rank, from 0 and without gaps, among the pieces of the same length."""
    chunks = max(LEAST_CHUNKS, math.ceil(total / CHUNK_PIECES))
    found = found.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(chunks)))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = found.groupBy("length", "chunk").count().select("length", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("rank_before"))
    own = Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "ids_crc32")
    return found.withColumn("place", F.row_number().over(own)).join(starts, ["length", "chunk"]).withColumn("rank", F.col("rank_before") + F.col("place") - 1)


def pack(docs: DataFrame, vocabulary: str, ranks: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row."""
    spark = docs.sparkSession
    found = written(pieces(docs, vocabulary, ranks, capacity), "pieces")
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for row in found.groupBy("length").count().collect():
        histogram[row["length"]] = row["count"]
    slots = spark.createDataFrame(
        places(plan(histogram, capacity)), "length long, rank_from long, rank_to long, first_sequence long, offsets array<long>"
    )
    at = F.col("rank") - F.col("rank_from")
    here = F.size("offsets")
    return (
        ranked(found, int(histogram.sum()))
        .join(F.broadcast(slots.withColumnRenamed("length", "slot_length")), F.expr("length = slot_length AND rank >= rank_from AND rank < rank_to"))
        .select(
            "doc_id",
            "piece",
            "start",
            "length",
            "ids_crc32",
            (F.col("first_sequence") + F.floor(at / here)).alias("sequence_id"),
            F.element_at("offsets", (F.pmod(at, here) + 1).cast("int")).alias("offset"),
        )
    )
