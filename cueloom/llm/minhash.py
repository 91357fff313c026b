"""MinHash near-dedup by a chosen-path set similarity join.

A document's set holds its distinct word shingles. Documents with equal sets form one class, and only the class goes on,
under its smallest doc_id. ``TREES`` independent trees branch documents by minwise tokens: the way through a tree is a sequence of
hash functions, a node holds the documents that have the same minwise tokens along its way, and a node is branched
on while it holds more than ``SMALL`` documents. Every node has ``FORK`` ways on, each by a hash function that the way
to it has not used, so that a pair at the threshold keeps meeting. Nodes of at most SMALL
documents are compared exhaustively by sketches, and pairs that can be similar enough are confirmed on their full sets.

A document has two sketches: 4 bits of each of its MINS minwise tokens, and 4 bits of the least shingle in each of ``BINS``
ranges of the hash. The second is read only where a document is sent on, which is where a passage that many documents share would
otherwise let pairs of middling similarity through.

Only components are asked for, so that a cohesive group does not need all its pairs. First each document of a node is
paired with the first document of the node that it resembles (in larger nodes, with the first document of the node),
and confirmed links give provisional components. Then documents that resemble one of another provisional component in
their node bring their sets to the node, all of these pairs are compared, and those that join components are confirmed. No pair that
met in a small node and resembled is left out: it is confirmed, refuted, or already connected; and a node sends on fewer
rows than it holds, however many of its pairs are alike. Nodes of one provisional component need no more branching.
Larger nodes with at most BLOCK documents outside their commonest component, and what is still large and mixed after
``DEPTH`` levels, are compared exhaustively in blocks of BLOCK documents.

From the first branching on a document is one row with the list of its nodes (bounded by the number of ways), wherever it is
joined with what belongs to it (minwise tokens, sketch, component, set); the rows for its nodes are made after the join. Levels are
written as rows of numbers; sketches travel once, to the nodes that are compared.

A pair of similarity 0.8 stays together in one tree with probability 0.80 at depth 1, 0.77 at depth 2, 0.75 at depth 6
(a depth is a number of tokens that must be equal). The trees share the MINS tokens and are not independent: drawn over
equal tokens, all 12 miss it with probability 5e-6 at depth 6, where they would with 6e-8 if they were; its sketches are missed
with probability below 2e-6. Minwise tokens are taken as independent here.

Defined results: text is null or has no word: an empty set, no link, kept. Fewer words than a shingle has: the whole
sequence is the one shingle. Repeated rows of one doc_id and text are one document; a doc_id that repeats with other text is a
document for each text, and each has its own links. Rows with a null doc_id take the component of their equals; where all of these
have null ids, component_id is null, kept is true and near links are not looked for. Ties are settled by doc_id. An empty table gives
an empty result. Other columns aren't read. Words of any length and texts of any length are hashed whole. Sets are compared
as 64-bit hashes of their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.llm.components import components, joined_by
from cueloom.llm.filters import maybe_among
from cueloom.llm.memory import tidy
from cueloom.sources.workspace import scratch, written

TREES = 12
FORK = 2
DEPTH = 6
SMALL = 512
BLOCK = 512
MINS = 64
#: Equal tokens of 64 that a pair's sketches need: 52 are expected at similarity 0.8, with a deviation of 3.1.
LIKE = 36
#: Ranges of the hash of which the second sketch holds the least shingle, and the deviations by which a pair may fall short there.
BINS = 256
SIGMAS = 5.0
#: Cells of the table of sets and shingles that is held at a time: 8 MB.
HELD_CELLS = 1 << 21
SEED = 20_240_229
HASH_BLOCK = 1 << 16

_rng = np.random.default_rng(SEED)
_U64 = np.uint64
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * _U64(2) + _rng.integers(0, 2, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_BASE = int(_rng.integers(1 << 62, 1 << 63)) | 1
_MUL = (_rng.integers(0, 1 << 31, MINS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_ADD = _rng.integers(0, 1 << 32, MINS, dtype=np.uint32)[:, None]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    out[1:] = _U64(base)
    return np.multiply.accumulate(out)


_UP = _powers(_BASE, HASH_BLOCK)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), HASH_BLOCK)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    edges = np.flatnonzero(np.diff(_IS_WORD[data].view(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        begin = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, begin + HASH_BLOCK, side="right")))
        if j == i + 1 and ends[i] - begin > HASH_BLOCK:  # one word beyond a block: its blocks in sequence
            total = 0
            for at in range(begin, int(ends[i]), HASH_BLOCK):
                part = _BYTE[data[at : min(at + HASH_BLOCK, int(ends[i]))]]
                total = (total * 0x9E3779B97F4A7C15 + int((part * _UP[: len(part)]).sum(dtype=np.uint64)) + len(part)) % (1 << 64)
            out[i] = total
        else:
            part = _BYTE[data[begin : ends[j - 1]]] * _UP[: ends[j - 1] - begin]
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part, dtype=np.uint64)])
            out[i:j] = (sums[ends[i:j] - begin] - sums[starts[i:j] - begin]) * _DOWN[starts[i:j] - begin]
        i = j
    return mix(out)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    w = word_hashes(text or "")
    if not len(w):
        return w
    k = min(words, len(w))
    s = w[: len(w) - k + 1].copy()
    for j in range(1, k):
        s = mix(s * _U64(0x9E3779B97F4A7C15) + w[j : len(w) - k + 1 + j])
    return np.unique(mix(s + _U64(k)))


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of MINS hash functions."""
    x = (shingles >> _U64(32)).astype(np.uint32)
    parts = [(_MUL * x[i : i + 8192] + _ADD).min(axis=1) for i in range(0, len(x), 8192)]
    return reduce(np.minimum, parts)


def least_in_bins(shingles: np.ndarray) -> np.ndarray:
    """4 bits (1 to 15) of the least value in each bin of sorted ``shingles``, 0 for an empty bin; two to a byte."""
    first = np.searchsorted(shingles, _BIN_STARTS)
    full = first < np.r_[first[1:], len(shingles)]
    found = np.zeros(BINS, np.uint8)
    found[full] = (shingles[first[full]] >> _U64(24)) % _U64(15) + _U64(1)
    return found[::2] << 4 | found[1::2]


def _plan_ways() -> list[list[tuple[int, int, int]]]:
    """For each level its (way, way it comes from, hash function): FORK ways on from each, the functions used about equally often."""
    rng = np.random.default_rng(SEED + 1)
    first = rng.permutation(MINS)[:TREES]
    levels = [[(t, -1, int(first[t])) for t in range(TREES)]]
    used = [{int(c)} for c in first]
    for _ in range(1, DEPTH):
        level, now, uses = [], [], np.zeros(MINS, np.int64)
        for way, _, _ in levels[-1]:
            taken = set(used[way])
            for _ in range(FORK):
                free = np.array([c for c in range(MINS) if c not in taken])
                c = int(rng.choice(free[uses[free] == uses[free].min()]))
                uses[c] += 1
                taken.add(c)
                now.append(used[way] | {c})
                level.append((len(level), way, c))
        levels.append(level)
        used = now
    return levels


WAYS = _plan_ways()
SIGNED = "doc long, text_hash long, n long, key_a long, key_b long, mins binary, bins binary"
NODE = "node long, way int, doc long, n long, sketch binary"
PLACED = "node long, way int, doc long, label long"
COMPARED = "node long, doc long, n long, sketch binary, bins binary, label long"
_BIN_STARTS = np.arange(BINS, dtype=np.uint64) << _U64(56)


def _arrow(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, to bound what is held for one."""
    for batch in batches:
        yield from (batch.slice(i, rows) for i in range(0, len(batch), rows))


def _binary(rows: np.ndarray) -> pa.Array:
    """One binary value for each row of a two-dimensional array of bytes."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _unbinary(column: pa.Array, width: int, kind) -> np.ndarray:
    """The reverse of ``_binary``."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, dtype=kind).reshape(len(column), width)


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    return tuple(int(mix(shingles + _U64(c)).sum(dtype=np.uint64).astype(np.int64)) for c in (1, 2))


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """Set size, 128-bit set key, minwise values and the second sketch of each document."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            sets = [shingle_set(text.as_py(), words) for text in batch.column("text")]
            keys = [set_key(s) for s in sets]
            mins = [minwise(s) if len(s) else np.zeros(MINS, np.uint32) for s in sets]
            yield _arrow({
                "doc": batch.column("doc"),
                "text_hash": batch.column("text_hash"),
                "n": pa.array([len(s) for s in sets], pa.int64()),
                "key_a": pa.array([k[0] for k in keys], pa.int64()),
                "key_b": pa.array([k[1] for k in keys], pa.int64()),
                "mins": _binary(np.array(mins, np.uint32).reshape(-1, MINS).view(np.uint8)),
                "bins": _binary(np.array([least_in_bins(s) for s in sets], np.uint8).reshape(-1, BINS // 2)),
            })

    return docs.mapInArrow(run, SIGNED)


def _sketches(mins: np.ndarray) -> np.ndarray:
    """4 bits of each minwise value, two to a byte."""
    nibbles = ((mins * np.uint32(2654435761)) >> np.uint32(28)).astype(np.uint8)
    return nibbles[:, ::2] << 4 | nibbles[:, 1::2]


def _nibbles(sketches: np.ndarray) -> np.ndarray:
    return np.concatenate([sketches >> 4, sketches & 15], axis=1)


def _roots(reps: DataFrame) -> DataFrame:
    """The nodes of the first level: one in each tree for each of ``reps`` (doc, n, mins)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            mins = _unbinary(batch.column("mins"), MINS, np.uint32)
            sketch = _binary(_sketches(mins))
            for way, _, c in WAYS[0]:
                node = mix(mix(np.full(len(mins), way + 1, np.uint64)) + mins[:, c])
                yield _arrow({"node": pa.array(node.view(np.int64)), "way": pa.array(np.full(len(mins), way, np.int32)), "doc": batch.column("doc"), "n": batch.column("n"), "sketch": sketch})

    return reps.select("doc", "n", "mins").mapInArrow(run, NODE)


def _gathered(places: DataFrame, labelled: DataFrame) -> DataFrame:
    """One row for each document of ``places`` (node, way, doc): what ``labelled`` has of it, and its nodes as ``at``."""
    return places.groupBy("doc").agg(F.collect_list(F.struct("node", "way")).alias("at")).join(labelled, "doc")


def _spread(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row, node and way of each element of the column ``at``."""
    at = batch.column("at")
    flat = at.flatten()
    return np.repeat(np.arange(len(batch)), np.diff(at.offsets.to_numpy())), flat.field("node").to_numpy(), flat.field("way").to_numpy()


def _children(gathered: DataFrame, level: int) -> DataFrame:
    """The rows (PLACED) for the nodes of ``level`` to which those of ``gathered`` lead on."""
    by_parent: dict[int, list[tuple[int, int]]] = {}
    for way, parent, c in WAYS[level]:
        by_parent.setdefault(parent, []).append((way, c))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches, 128):
            of, node, above = _spread(batch)
            node = node.view(np.uint64)
            mins = _unbinary(batch.column("mins"), MINS, np.uint32)
            nodes, ways, rows = [], [], []
            for parent in np.unique(above):
                at = np.flatnonzero(above == parent)
                for way, c in by_parent[int(parent)]:
                    nodes.append(mix(mix(node[at] + _U64((level << 32) + way + 1)) + mins[of[at], c]))
                    ways.append(np.full(len(at), way, np.int32))
                    rows.append(of[at])
            if rows:
                own = pa.array(np.concatenate(rows))
                yield _arrow({"node": pa.array(np.concatenate(nodes).view(np.int64)), "way": pa.array(np.concatenate(ways)), "doc": batch.column("doc").take(own), "label": batch.column("label").take(own)})

    return gathered.select("doc", "mins", "label", "at").mapInArrow(run, PLACED)


def _compared(gathered: DataFrame) -> DataFrame:
    """A row (COMPARED) with both sketches for each node of each document."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches, 128):
            of, node, _ = _spread(batch)
            own, sketch = pa.array(of), _binary(_sketches(_unbinary(batch.column("mins"), MINS, np.uint32)))
            yield _arrow({"node": pa.array(node), **{c: batch.column(c).take(own) for c in ("doc", "n")}, "sketch": sketch.take(own), **{c: batch.column(c).take(own) for c in ("bins", "label")}})

    return gathered.select("doc", "n", "mins", "bins", "label", "at").mapInArrow(run, COMPARED)


def _by_node(batches: Iterator[pa.RecordBatch], key: str = "node") -> Iterator[pa.RecordBatch]:
    """Batches of rows sorted by node, none of which splits a node."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        nodes = batch.column(key).to_numpy()
        cut = int(np.flatnonzero(nodes != nodes[-1])[-1]) + 1 if nodes[0] != nodes[-1] else 0
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks().to_batches()[0]
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _bins_alike(one: np.ndarray, two: np.ndarray, percent: int) -> np.ndarray:
    """Whether the second sketches (rows of nibbles) allow the similarity."""
    share = percent / 100
    held = np.count_nonzero(one | two, axis=1)
    equal = np.count_nonzero((one == two) & (one != 0), axis=1)
    return equal >= share * held - SIGMAS * np.sqrt(share * (1 - share) * held)


def _resembling(batch: pa.RecordBatch, percent: int, label: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows i < j of one node with sketches alike, sizes that allow the similarity and, given labels, other labels."""
    node, n = batch.column("node").to_numpy(), batch.column("n").to_numpy()
    sketch = _nibbles(_unbinary(batch.column("sketch"), MINS // 2, np.uint8))
    bins = _nibbles(_unbinary(batch.column("bins"), BINS // 2, np.uint8)) if "bins" in batch.schema.names else None
    left, right = [], []
    for shift in range(1, len(node)):
        i = np.flatnonzero(node[:-shift] == node[shift:])
        if not len(i):
            break
        i = i[100 * np.minimum(n[i], n[i + shift]) >= percent * np.maximum(n[i], n[i + shift])]
        if label is not None:
            i = i[label[i] != label[i + shift]]
        for at in range(0, len(i), 8192):
            part = i[at : at + 8192]
            part = part[(sketch[part] == sketch[part + shift]).sum(axis=1) >= LIKE]
            if bins is not None and len(part):
                part = part[_bins_alike(bins[part], bins[part + shift], percent)]
            left.append(part)
            right.append(part + shift)
    none = np.empty(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _first_pairs(leaves: DataFrame, percent: int) -> DataFrame:
    """Of each small node: (doc, first doc that it resembles), and the rows (a, b and node) of nodes with further pairs."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_node(batches):
            i, j = _resembling(batch, percent, None)
            if not len(i):
                continue
            doc, node = batch.column("doc").to_numpy(), batch.column("node").to_numpy()
            order = np.lexsort((i, j))
            i, j = i[order], j[order]
            head = np.r_[True, j[1:] != j[:-1]]
            yield _arrow({"a": pa.array(doc[i[head]]), "b": pa.array(doc[j[head]]), "node": pa.nulls(int(head.sum()), pa.int64())})
            more = np.flatnonzero(np.isin(node, np.unique(node[j[~head]])))
            yield _arrow({"a": pa.array(doc[more]), "b": pa.array(doc[more]), "node": pa.array(node[more])})

    ordered = leaves.repartition("node").sortWithinPartitions("node", "doc").select("node", "doc", "n", "sketch")
    return ordered.mapInArrow(run, "a long, b long, node long")


def _involved(rows: DataFrame, percent: int) -> DataFrame:
    """The rows (node, doc, n, label) of ``rows`` (COMPARED) that resemble a row of their node with another label."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_node(batches):
            i, j = _resembling(batch, percent, batch.column("label").to_numpy())
            yield batch.take(pa.array(np.union1d(i, j).astype(np.int64))).select(["node", "doc", "n", "label"])

    ordered = rows.repartition("node").sortWithinPartitions("node", "doc").select("node", "doc", "n", "sketch", "bins", "label")
    return ordered.mapInArrow(run, "node long, doc long, n long, label long")


def _node_links(sets: list[np.ndarray], n: np.ndarray, label: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of similar sets that join what is apart: a spanning forest over the labels of one node."""
    elements, where = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(where, kind="stable")
    where, owner = where[order], owner[order]
    both = np.zeros((len(sets), len(sets)), np.float32)  # numbers of shingles, whole below 2^24
    width = max(64, HELD_CELLS // len(sets))
    for at in range(0, len(elements), width):
        lo, hi = np.searchsorted(where, (at, at + width))
        held = np.zeros((len(sets), min(width, len(elements) - at)), np.float32)
        held[owner[lo:hi], where[lo:hi] - at] = 1
        both += held @ held.T
    alike = (100 * both >= percent * (n[:, None] + n[None, :] - both)) & (label[:, None] != label[None, :])
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := root.get(x, x)) != x:
            x = y
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(alike)), strict=True):
        one, two = top(int(label[i])), top(int(label[j]))
        if one != two:
            root[max(one, two)] = min(one, two)
            out.append((int(i), int(j)))
    return out


def upper_halves(shingles: np.ndarray) -> bytes:
    return (shingles >> _U64(32)).astype(np.uint32).tobytes()


class _Texts:
    """Where the full sets of classes come from: the documents themselves, filtered before they are hashed again."""

    def __init__(self, docs: DataFrame, words: int, repeated: DataFrame | None):
        self.docs, self.words, self.repeated = docs, words, repeated

    def near(self, ids: DataFrame) -> DataFrame:
        """(doc, text) of at least the documents in the one column of ``ids``."""
        return maybe_among(self.docs, "doc", ids.distinct()).select("doc", "text")

    def sets(self, ids: DataFrame, halves: bool) -> DataFrame:
        """(doc, shingles) for at least the classes in the one column of ``ids``: sorted hashes, or only their upper halves, as bytes."""
        words = self.words

        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _sliced(batches, 128):
                found = [shingle_set(text.as_py(), words) for text in batch.column("text")]
                keys = [set_key(s) for s in found]
                data = [upper_halves(s) if halves else s.tobytes() for s in found]
                yield _arrow({"doc": batch.column("doc"), "key_a": pa.array([k[0] for k in keys], pa.int64()), "key_b": pa.array([k[1] for k in keys], pa.int64()), "shingles": pa.array(data, pa.binary())})

        if self.repeated is not None:  # ids of repeated doc_ids are not doc_ids
            ids = ids.toDF("id").join(self.repeated, "id", "left").select(F.coalesce("doc", "id"))
        near = maybe_among(self.docs, "doc", ids.distinct()).mapInArrow(run, "doc long, key_a long, key_b long, shingles binary")
        named = _class_ids(near, self.repeated).select(F.col("id").alias("doc"), "shingles")
        return named if self.repeated is None else named.dropDuplicates(["doc"])


def _class_ids(rows: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """``rows`` (doc, key_a, key_b, ...) with the id of their class: doc, or a hash where several classes have that doc."""
    if repeated is None:
        return rows.withColumn("id", F.col("doc"))
    return rows.join(repeated.select("doc", F.lit(True).alias("several")).distinct(), "doc", "left").withColumn("id", F.when(F.col("several"), F.xxhash64("doc", "key_a", "key_b")).otherwise(F.col("doc"))).drop("several")


def _joining_pairs(rows: DataFrame, texts: _Texts, percent: int) -> DataFrame:
    """Pairs of ``rows`` (node, doc, n, label) whose sets, compared in their node, are similar and join components.

    Sets travel as the upper halves of their hashes, which can only make two of them look more alike; the pairs are
    confirmed on full sets afterwards.
    """

    words = texts.words

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches, 16):
            nodes, held = batch.column("nodes"), batch.column("held")
            if pa.types.is_string(held.type):
                held = pa.array([upper_halves(shingle_set(text.as_py(), words)) for text in held], pa.binary())
            own = pa.array(np.repeat(np.arange(len(batch)), np.diff(nodes.offsets.to_numpy())))
            for at in range(0, len(own), 64):
                part = own.slice(at, 64)
                yield _arrow({"node": nodes.flatten().slice(at, 64), **{c: batch.column(c).take(part) for c in ("doc", "n", "label")}, "shingles": held.take(part)})

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_node(batches):
            node, doc, n, label = (batch.column(c).to_numpy() for c in ("node", "doc", "n", "label"))
            edges = np.r_[0, np.flatnonzero(node[1:] != node[:-1]) + 1, len(node)]
            pairs: list[tuple[int, int]] = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                sets = [np.frombuffer(s.as_py(), np.uint32) for s in batch.column("shingles").slice(a, b - a)]
                pairs += [(a + i, a + j) for i, j in _node_links(sets, n[a:b], label[a:b], percent)]
            yield _arrow({"a": pa.array(doc[[i for i, _ in pairs]], pa.int64()), "b": pa.array(doc[[j for _, j in pairs]], pa.int64())})

    rows = written(rows, "involved")
    by_doc = rows.groupBy("doc").agg(F.first("n").alias("n"), F.first("label").alias("label"), F.collect_list("node").alias("nodes"))
    # Sets are made in the task that spreads them, so that no task needs two Python workers; classes of repeated ids have no text to join.
    held = by_doc.join(texts.sets(rows.select("doc"), True) if texts.repeated is not None else texts.near(rows.select("doc")), "doc")
    at_nodes = held.select("doc", "n", "label", held[held.columns[-1]].alias("held"), "nodes").mapInArrow(spread, "node long, doc long, n long, label long, shingles binary")
    return at_nodes.repartition("node").sortWithinPartitions("node", "doc").mapInArrow(run, "a long, b long")


def _leader_pairs(large: DataFrame, percent: int) -> DataFrame:
    """(first doc of the node, doc) for the rows of larger nodes that resemble it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (_nibbles(_unbinary(batch.column(c), MINS // 2, np.uint8)) for c in ("sketch", "sketch_a"))
            yield batch.filter(pa.array((one == two).sum(axis=1) >= LIKE)).select(["a", "b"])

    heads = large.where("doc = leader").select("node", F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
    pairs = large.where("doc <> leader").join(heads, "node").where(100 * F.least("n", "n_a") >= percent * F.greatest("n", "n_a"))
    return pairs.select(F.col("leader").alias("a"), F.col("doc").alias("b"), "sketch", "sketch_a").mapInArrow(run, "a long, b long")


def _likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs whose second sketches allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (_nibbles(_unbinary(batch.column(c), BINS // 2, np.uint8)) for c in ("bins_a", "bins_b"))
            yield batch.filter(pa.array(_bins_alike(one, two, percent))).select(["a", "b"])

    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for side in "ab":
        pairs = pairs.join(reps.select(F.col("doc").alias(side), F.col("bins").alias(f"bins_{side}")), side)
    return pairs.select("a", "b", "bins_a", "bins_b").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, texts: _Texts, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches, 256):
            ok = []
            for one, two in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = (np.frombuffer(s.as_py(), np.uint64) for s in (one, two))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    pairs = written(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc")))
    shingles = written(texts.sets(ids, False), "shingles")
    both = pairs
    for side in "ab":
        both = both.join(shingles.select(F.col("doc").alias(side), F.col("shingles").alias(f"set_{side}")), side)
    return written(both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long"), "confirmed")


def text_hash(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, with_text_hash: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each document; links have a Jaccard similarity of percent / 100.

    With ``with_text_hash`` a column text_hash follows, which tells the rows of a repeated doc_id apart.
    """
    with scratch(docs.sparkSession):
        found = _near_duplicates(docs, words, percent)
        return written(found if with_text_hash else found.drop("text_hash"), "near-duplicates", outlive=True)


def _near_duplicates(docs: DataFrame, words: int, percent: int) -> DataFrame:
    text = F.col("text").cast("string")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc"), text.alias("text"), text_hash(text).alias("text_hash"))
    signed = written(signatures(plain, words), "signatures")
    classes = signed.where("n > 0").groupBy("key_a", "key_b", "n").agg(F.min("doc").alias("doc"), F.first("mins").alias("mins"), F.first("bins").alias("bins"))
    classes = written(classes, "classes")
    repeated = None
    several = classes.where("doc IS NOT NULL").groupBy("doc").count().where("count > 1").select("doc")
    if not several.isEmpty():
        repeated = written(classes.join(several, "doc").select("doc", F.xxhash64("doc", "key_a", "key_b").alias("id")), "repeated")
    named = _class_ids(classes, repeated)
    reps = named.where("id IS NOT NULL").select(F.col("id").alias("doc"), "n", "mins", "bins")
    texts = _Texts(plain, words, repeated)

    nodes = _roots(reps)
    sizes = nodes.groupBy("node").agg(F.count("*").alias("size"), F.min("doc").alias("leader")).where("size > 1")
    nodes = written(nodes.join(sizes, "node").withColumn("large", F.col("size") > SMALL).drop("size"), "nodes")
    large = nodes.where("large")
    met = written(_first_pairs(nodes.where("NOT large"), percent), "met")
    pairs = met.where("node IS NULL").select("a", "b").unionByName(_leader_pairs(large, percent))
    links = confirmed(_likely(pairs, reps, percent), texts, percent)
    labels = components(links)

    labelled = written(reps.join(labels, "doc", "left").withColumn("label", F.coalesce("component", "doc")).drop("component"), "labelled")
    meeting = [met.where("node IS NOT NULL").select("node", F.col("a").alias("doc"))]
    places = large.select("node", "way", "doc").join(labelled.select("doc", "label"), "doc")
    for level in range(1, DEPTH + 1):
        mixed = places.join(_shares(places), "node")
        meeting.append(_blocks(mixed.where(f"all <= {SMALL} OR o = 1 OR {level} = {DEPTH}")))
        further = written(mixed.where(f"all > {SMALL} AND o > 1 AND {level} < {DEPTH}").select("node", "way", "doc"), "large")
        if further.isEmpty():
            break
        places = written(_children(_gathered(further, labelled), level), "placed")
    met_again = reduce(DataFrame.unionByName, meeting).withColumn("way", F.lit(0))
    involved = _involved(_compared(_gathered(met_again, labelled)), percent)
    late = written(_joining_pairs(involved, texts, percent).distinct(), "late")
    if not late.isEmpty():
        labels = joined_by(labels, confirmed(late, texts, percent))

    of_class = named.join(labels, named["id"] == labels["doc"], "left").select(
        "key_a", "key_b", "n", named["doc"].alias("least"), F.coalesce("component", "id").alias("component")
    )
    if repeated is not None:  # component ids are hashes where a doc_id repeats
        of_class = of_class.join(of_class.groupBy("component").agg(F.min("least").alias("least_of_all")), "component").withColumn("component", F.col("least_of_all"))
    of_class = of_class.select("key_a", "key_b", "n", F.col("component").alias("component_id"))
    return signed.join(of_class, ["key_a", "key_b", "n"], "left").select(
        F.col("doc").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc").alias("component_id"),
        F.col("doc").eqNullSafe(F.coalesce("component_id", "doc")).alias("kept"),
        "text_hash",
    )


def _shares(rows: DataFrame) -> DataFrame:
    """Of each node with several labels: all its rows, its commonest label, and the numbers of blocks of that one's rows and of the others."""
    labels = rows.groupBy("node", "label").agg(F.count("*").alias("size"))
    sizes = labels.groupBy("node").agg(F.max_by("label", F.struct("size", "label")).alias("main"), F.max("size").alias("mains"), F.sum("size").alias("all"))
    blocks = [F.ceil(n / BLOCK).cast("int").alias(name) for n, name in ((F.col("mains"), "d"), (F.col("all") - F.col("mains"), "o"))]
    return sizes.where("all > mains").select("node", "main", "all", *blocks)


def _blocks(rows: DataFrame) -> DataFrame:
    """(node, doc) for the rows of nodes, which have their ``_shares``: small nodes as they are, larger ones as nodes of two blocks each.

    Rows of a node's commonest label need no comparison with each other: their blocks meet the blocks of the other rows,
    and those meet one another. With few others, each row is sent about once.
    """
    is_main = F.col("label") == F.col("main")
    own = F.pmod(F.xxhash64("doc", F.lit(1)), F.when(is_main, F.col("d")).otherwise(F.col("o"))).cast("int")
    # Blocks of the others are numbered from 0, those of the commonest label from o on.
    meets = F.when(F.col("all") <= SMALL, F.array(F.lit(0))).when(is_main, F.sequence(F.lit(0), F.col("o") - 1)).otherwise(F.sequence(F.lit(0), F.col("o") + F.col("d") - 1))
    spread = rows.withColumn("own", own + F.when(is_main, F.col("o")).otherwise(0)).withColumn("other", F.explode(meets))
    block = F.when(F.col("all") <= SMALL, F.col("node")).otherwise(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")))
    return spread.select(block.alias("node"), "doc")
