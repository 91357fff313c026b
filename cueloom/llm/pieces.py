"""SentencePiece encoding and decoding with an Aho-Corasick automaton and a single-pass Viterbi.

The automaton holds all pieces. One pass over a segment reports, at every position, the pieces that end there (by its
output links), and each relaxes the best way to that position:

* unigram models: the way with the highest sum of piece scores;
* merge (BPE) models: a way's score is whether the merge rules give it. The pieces of a merge encoding are exactly the
  chain in which every piece is what its own characters merge to and every two neighbours stay apart when merged
  together; the chain is unique, so that the first feasible piece settles a position. Pieces that their own characters do
  not merge to can be in no chain and are left out of the automaton; whether a pair stays apart is kept. Equal scores, which only pieces of white space have, would break this; segments with more than one
  leading space are merged step by step instead.

Segments end where no piece reaches across: before a space mark that follows another character, and around
characters that are in no longer piece. Encodings of short segments are kept, in two generations of ``KEPT`` at most per
worker: the older one goes when the younger is full, and what is still met moves over. Characters
without a piece become byte pieces, or the unknown piece in models without these.

Decoding joins pieces and bytes, turns space marks into spaces and drops the leading one. Text that itself holds the
space mark comes back with spaces; everything else comes back as it was.

Defined results: null and empty text have no pieces and decode to the empty text. Repeated rows are encoded one by
one. An empty table gives an empty result. Other columns aren't read. Texts and segments of any length are encoded whole.
Models that normalise text are refused.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Segments of a generation, and pairs of pieces, whose results a worker keeps: about 60 MB each.
KEPT = 250_000
KEPT_CHARS = 40
#: Characters up to which neighbours to merge are looked for in a list, beyond it in a heap.
SHORT = 64
NO_PIECE = float("-inf")


class PieceModel:
    """Pieces and scores; ``merges`` for a BPE model, else unigram."""

    def __init__(self, pieces: list[tuple[int, str, float]], byte_ids: list[int] | None, unknown: int, merges: bool):
        self.byte_ids, self.unknown, self.merges = byte_ids, unknown, merges
        self.text = {i: p for i, p, _ in pieces}
        self.id = {p: i for i, p, _ in pieces}
        self.score = {i: s for i, _, s in pieces}
        self.worth = {p: s for _, p, s in pieces}
        joined = "".join(sorted({c for p in self.id if len(p) > 1 for c in p} - {SPACE}))
        inner = "".join(map(re.escape, joined)) or "\\Z"
        self.segments = re.compile(f"{SPACE}*[{inner}]+|{SPACE}+|[^{inner}{SPACE}]", re.DOTALL).findall
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.apart: dict[int, bool] = {}
        self.bytes = {i: p.replace(SPACE, " ").encode("utf-8", "surrogatepass") for i, p in self.text.items()}
        self.bytes |= {i: bytes([b]) for b, i in enumerate(byte_ids or ())}
        self.automaton = ahocorasick.Automaton()
        for i, p, _ in pieces:
            if not merges or len(self.merged(p)) == 1:
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()

    def merged(self, segment: str) -> list[str]:
        """The segment's pieces by merging the best-scored, then leftmost, neighbours as long as any make a piece."""
        if len(segment) > SHORT:
            return self._merged_by_heap(segment)
        parts, worth = list(segment), self.worth.get
        offers = [worth(a + b, NO_PIECE) for a, b in zip(parts, parts[1:])]  # noqa: B905
        while offers and (best := max(offers)) > NO_PIECE:
            at = offers.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del offers[at]
            if at:
                offers[at - 1] = worth(parts[at - 1] + parts[at], NO_PIECE)
            if at < len(offers):
                offers[at] = worth(parts[at] + parts[at + 1], NO_PIECE)
        return parts

    def _merged_by_heap(self, segment: str) -> list[str]:
        """The same for segments of any length."""
        parts: list[str] = list(segment)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right < len(parts) and (i := self.id.get(both := parts[left] + parts[right])) is not None:
                heapq.heappush(heap, (-self.score[i], left, right, both))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, left, right, both = heapq.heappop(heap)
            if after[left] != right or parts[left] + parts[right] != both or not parts[left] or not parts[right]:
                continue
            parts[left], parts[right] = both, ""
            after[left] = after[right]
            if after[left] < len(parts):
                before[after[left]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [p for p in parts if p]

    def _two(self, left: int, right: int) -> bool:
        """Whether two neighbours stay apart."""
        if len(self.apart) >= KEPT:
            self.apart.clear()
        apart = self.apart[left << 32 | right] = self.merged(self.text[left] + self.text[right]) == [self.text[left], self.text[right]]
        return apart

    def _fallback(self, char: str) -> list[int]:
        if self.byte_ids is None:
            return [self.unknown]
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")]

    def _spelled(self, pieces: list[str]) -> list[int]:
        return [i for p in pieces for i in ([self.id[p]] if p in self.id else self._fallback(p))]

    def segment(self, segment: str) -> list[int]:
        """The ids of one segment."""
        if len(segment) == 1 or self.merges and segment.startswith(SPACE * 2):
            return self._spelled(self.merged(segment) if self.merges else [segment])
        n = len(segment)
        came: list[int | None] = [None] * (n + 1)
        if self.merges:
            known = self.apart.get
            for end, (piece, length) in self.automaton.iter(segment):
                if came[end + 1] is None:
                    start = end + 1 - length
                    if not start:
                        came[end + 1] = piece
                    elif (left := came[start]) is not None:
                        if (apart := known(left << 32 | piece)) is None:
                            apart = self._two(left, piece)
                        if apart:
                            came[end + 1] = piece
            if came[n] is None:  # a character without a piece: not seen in models whose pieces grow by merges
                return self._spelled(self.merged(segment))
        else:
            low = min(self.score.values(), default=0.0) - 10
            best = [0.0] + [-1e300] * n
            reached = 0
            for end, (piece, length) in self.automaton.iter(segment):
                while reached < end:  # every position can also be reached by its last character as unknown
                    reached += 1
                    if best[reached] <= -1e300 or came[reached] is None:
                        best[reached] = best[reached - 1] + low
                if (score := best[end + 1 - length] + self.score[piece]) > best[end + 1]:
                    best[end + 1], came[end + 1] = score, piece
            # Positions after the last match are unknown characters.
        out: list[list[int]] = []
        at = n
        while at:
            piece = came[at]
            out.append(self._fallback(segment[at - 1]) if piece is None else [piece])
            at -= 1 if piece is None else len(self.text[piece])
        return [i for ids in reversed(out) for i in ids]

    def _missed(self, segment: str) -> bytes:
        """The ids of a segment that the younger generation does not hold."""
        ids = self.older.get(segment) or b"".join([i.to_bytes(4, "little") for i in self.segment(segment)])
        if len(segment) <= KEPT_CHARS:
            if len(self.kept) >= KEPT:
                self.kept, self.older = {}, self.kept
            self.kept[segment] = ids
        return ids

    def encoded(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit numbers."""
        out, kept = [], self.kept.get
        for segment in self.segments(SPACE + text.replace(" ", SPACE)) if text else ():
            if (ids := kept(segment)) is None:
                ids = self._missed(segment)
                kept = self.kept.get
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encoded(text), dtype="<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "surrogatepass")
        return text[1:] if text.startswith(" ") else text


@cache
def load(path: str) -> PieceModel:
    """The pieces of a model file."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    rules = model.normalizer_spec
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not (rules.add_dummy_prefix and rules.escape_whitespaces):
        raise ValueError("only models that leave text as it is, with a leading space, are supported")
    kind = type(model.pieces[0])
    plain = [(i, p.piece, p.score) for i, p in enumerate(model.pieces) if p.type in (kind.NORMAL, kind.USER_DEFINED)]
    single = [i for i, p in enumerate(model.pieces) if p.type == kind.BYTE]
    unknown = next(i for i, p in enumerate(model.pieces) if p.type == kind.UNKNOWN)
    return PieceModel(plain, single if len(single) == 256 else None, unknown, model.trainer_spec.model_type == 2)


def encode(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id and ids array<int> of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_file)
        for batch in batches:
            ids = pa.array([model.encode(t.as_py() or "") for t in batch.column("text")], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    return _plain(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """doc_id and text of each row of ``encode``'s result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_file)
        for batch in batches:
            texts = pa.array([model.decode(ids.as_py() or []) for ids in batch.column("ids")], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian 32-bit ids), decoded_sha256 and round_trip of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_file)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py() or ""
                ids = model.encoded(text)
                back = model.decode(np.frombuffer(ids, dtype="<u4").tolist())
                rows.append((doc_id, len(ids) // 4, zlib.crc32(ids), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == text))
            kinds = {"doc_id": pa.int64(), "n_ids": pa.int64(), "ids_crc32": pa.int64(), "decoded_sha256": pa.string(), "round_trip": pa.bool_()}
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    return _plain(docs).mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean")


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
