"""Exact top-k inner products: vectors by falling length, SVD-rotated partial sums, Cauchy-Schwarz pruning.

Vectors become integers, floor(scale * x). Their second moments (dimension squared numbers, summed in the workers)
give an SVD rotation that moves most of a product into the first ``HEAD`` coordinates. Candidates are range-partitioned by
falling length into chunks of ``CHUNK`` vectors; queries form blocks of ``BLOCK``. Every block first meets the chunk of the
longest vectors, whose scores give each query a floor under its k-th score. A block meets another chunk only if, by
Cauchy-Schwarz, some query's length times the chunk's greatest length reaches that query's floor: pairs of numbers are
joined and pruned before any vector is sent. A block and a group of at most ``GROUP`` chunks are one task, which walks its
chunks by falling length and keeps k best scores for each query. Before anything is
multiplied, a whole chunk is passed over once its greatest length times a query's is below the query's k-th score;
in a chunk, a vector is multiplied in full only if its partial sum plus the Cauchy-Schwarz bound of the rest,
|rest of q| |rest of c|, reaches that score. Products are taken in 64-bit integers, so that scores and ties are exact.
Tasks' best scores are merged by a window over k rows of each task that a query met.

A chunk is sent once to each block that it can matter to: that is the work asked for, a stated query set against all
rows, in blocks. The one longest chunk (CHUNK vectors, whatever the number of rows) goes to the workers with the code.

Defined results: null vectors and vectors with a null or non-finite component take no part. Vectors of several dimensions are
searched dimension by dimension: a query meets the candidates of its own. Repeated ids are candidates of their own, but a query passes over every row of its own id.
Ties go to the smaller vec_id. Queries with fewer than k candidates return all. Empty tables give an empty result. Other
columns aren't read. Components beyond what 64-bit products hold raise an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.sources.workspace import scratch, written

CHUNK = 2048
BLOCK = 8192
GROUP = 64
#: Groups of chunks at least, so that small tables keep the cores busy, and lanes in which pairs of numbers are joined.
LEAST_GROUPS = 12
LANES = 32
HEAD = 24
#: Bounds are floating point: they are widened by this share of |q| |c|.
SLACK = 1e-9


def integer_vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v array<long> of the rows that take part."""
    whole = F.transform("embedding", lambda x: x.cast("double"))
    usable = rows.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("e")).where(
        "e IS NOT NULL AND size(e) > 0 AND forall(e, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    )
    return usable.select("vec_id", F.transform("e", lambda x: F.floor(x * F.lit(scale)).cast("long")).alias("v"))


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    column = batch.column("v")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), d)


def _rotation(vectors: DataFrame, d: int) -> np.ndarray:
    """Right singular vectors of the vectors, from the d x d matrix of second moments."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            x = _matrix(batch, d).astype(np.float64)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(d), d)), pa.array(np.tile(np.arange(d), d)), pa.array(total.ravel())], names=["i", "j", "s"])

    summed = vectors.select("v").mapInArrow(moments, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    m = np.zeros((d, d))
    for row in summed:
        m[row["i"], row["j"]] = row["s"]
    return np.linalg.svd(m)[0]


def _packed(vectors: DataFrame, d: int, size: int, name: str) -> DataFrame:
    """Rows of at most ``size`` vectors by falling length: greatest length, ids and vectors as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, have = [], [], 0
        for batch in batches:
            ids.append(batch.column("vec_id").to_numpy())
            parts.append(_matrix(batch, d))
            have += len(batch)
            while have >= size:
                all_ids, all_parts = np.concatenate(ids), np.concatenate(parts)
                yield _chunk(all_ids[:size], all_parts[:size])
                ids, parts, have = [all_ids[size:]], [all_parts[size:]], have - size
        if have:
            yield _chunk(np.concatenate(ids), np.concatenate(parts))

    packed = vectors.select("vec_id", "v").mapInArrow(run, "length double, ids binary, vectors binary")
    return written(packed.withColumn("number", F.monotonically_increasing_id()), name)


def _chunk(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    longest = float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)).max())
    return pa.RecordBatch.from_arrays([pa.array([longest]), pa.array([ids.tobytes()]), pa.array([x.tobytes()])], names=["length", "ids", "vectors"])


class _Best:
    """The k best (score, id) of each query of a block, kept sorted by falling score, then id."""

    def __init__(self, queries: int, k: int, floor: np.ndarray | None = None):
        self.floor = np.full(queries, -np.inf) if floor is None else floor
        self.scores = np.full((queries, k), np.iinfo(np.int64).min)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)
        self.found = np.zeros(queries, np.int64)
        self.k = k

    def worst(self) -> np.ndarray:
        """A floor under each query's k-th score: the one it came with, or its k-th so far."""
        return np.maximum(self.floor, np.where(self.found >= self.k, self.scores[:, -1].astype(np.float64), -np.inf))

    def add(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Candidates (query, id, score); a query may have many."""
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        starts = np.r_[True, q[1:] != q[:-1]]
        first = np.flatnonzero(starts)[np.cumsum(starts) - 1]
        place = np.arange(len(q)) - first
        own = place < self.k
        q, ids, scores, place = q[own], ids[own], scores[own], place[own]
        at = np.unique(q)
        new_s, new_i = np.full((len(at), self.k), np.iinfo(np.int64).min), np.full((len(at), self.k), np.iinfo(np.int64).max)
        row = np.searchsorted(at, q)
        new_s[row, place], new_i[row, place] = scores, ids
        s, i = np.hstack([self.scores[at], new_s]), np.hstack([self.ids[at], new_i])
        order = np.lexsort((i, -s.astype(np.float64) if np.abs(s[s > np.iinfo(np.int64).min]).max(initial=0) < 2**53 else ~s), axis=1)[:, : self.k]
        self.scores[at], self.ids[at] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        self.found[at] = np.minimum(self.k, self.found[at] + np.bincount(row, minlength=len(at)))


class _Block:
    """A block of queries while it meets chunks."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, rotation: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.q, self.rotation, self.best = ids, q, rotation, _Best(len(q), k, floor)
        self.turned = q.astype(np.float64) @ rotation
        self.long, self.rest = np.sqrt((self.turned**2).sum(1)), np.sqrt((self.turned[:, HEAD:] ** 2).sum(1))

    def meet(self, ids: np.ndarray, c: np.ndarray, longest: float) -> None:
        live = np.flatnonzero(self.long * longest * (1 + SLACK) >= self.best.worst())
        if not len(live):
            return
        turned = c.astype(np.float64) @ self.rotation
        c_long, c_rest = np.sqrt((turned**2).sum(1)), np.sqrt((turned[:, HEAD:] ** 2).sum(1))
        for lo in range(0, len(c), 256):  # thresholds rise between slices
            hi = lo + 256
            live = live[self.long[live] * c_long[lo:hi].max() * (1 + SLACK) >= self.best.worst()[live]]
            for at in range(0, len(live), 2048):
                part = live[at : at + 2048]
                bound = self.turned[part, :HEAD] @ turned[lo:hi, :HEAD].T + np.outer(self.rest[part], c_rest[lo:hi])
                bound += SLACK * np.outer(self.long[part], c_long[lo:hi])
                left, right = np.nonzero((bound >= self.best.worst()[part][:, None]) & (self.ids[part][:, None] != ids[None, lo:hi]))
                if len(left):
                    left, right = part[left], right + lo
                    self.best.add(left, ids[right], np.einsum("ij,ij->i", self.q[left], c[right]))

    def found(self) -> pa.RecordBatch:
        q, place = np.nonzero(np.arange(self.best.k) < self.best.found[:, None])
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(self.best.ids[q, place]), pa.array(self.best.scores[q, place])], names=["query_id", "vec_id", "score"])


def _unpacked(batch: pa.RecordBatch, r: int, d: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(batch.column("ids")[r].as_py(), np.int64), np.frombuffer(batch.column("vectors")[r].as_py(), np.int64).reshape(-1, d)


def _walk(rotation: np.ndarray, k: int):
    """A function over rows (asks, length, ids, vectors, floor): a block of queries, then its chunks by falling length."""
    d = len(rotation)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            for r in range(len(batch)):
                ids, x = _unpacked(batch, r, d)
                if batch.column("asks")[r].as_py():
                    if block is not None:
                        yield block.found()
                    block = _Block(ids, x, rotation, k, np.frombuffer(batch.column("floor")[r].as_py(), np.float64))
                else:
                    block.meet(ids, x, batch.column("length")[r].as_py())
        if block is not None:
            yield block.found()

    return run


def _floors(asked: DataFrame, longest: tuple[np.ndarray, np.ndarray, float], rotation: np.ndarray, k: int) -> DataFrame:
    """``asked`` with each query's k-th score among the longest vectors, and the least chunk length that can matter to the block."""
    d = len(rotation)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                block = _Block(*_unpacked(batch, r, d), rotation, k)
                block.meet(*longest)
                floor = block.best.worst()
                with np.errstate(divide="ignore", invalid="ignore"):
                    needs = np.where(block.long > 0, floor / (block.long * (1 + SLACK)), -np.inf)
                one = batch.slice(r, 1)
                need = float(needs.min() - SLACK * abs(needs.min())) if np.isfinite(needs.min()) else -np.inf
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([need]), pa.array([floor.tobytes()])], names=[*one.schema.names, "need", "floor"])

    return written(asked.select("number", "ids", "vectors").mapInArrow(run, "number long, ids binary, vectors binary, need double, floor binary"), "floors")


def top_inner_products(rows: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of each row where ``is_query`` holds."""
    with scratch(rows.sparkSession):
        vectors = integer_vectors(rows, scale)
        sizes = vectors.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).orderBy("d").collect()
        if any(row["d"] * row["most"] ** 2 >= 2**62 for row in sizes):
            raise ValueError("components are too large for exact 64-bit products")
        none = vectors.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.col("vec_id").alias("score")).where("false")
        found = [_of_dimension(vectors.where(F.size("v") == row["d"]), is_query, row["d"], row["n"], k) for row in sizes]
        return written(reduce(DataFrame.unionByName, found, none), "top-products", outlive=True)


def _of_dimension(vectors: DataFrame, is_query: Column, d: int, n: int, k: int) -> DataFrame:
    """The result for the vectors of one dimension."""
    vectors = written(vectors, "vectors")
    rotation = _rotation(vectors, d)
    ordered = vectors.withColumn("norm", F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x))
    asked = ordered.where(is_query)
    n_asked = asked.count()
    if not n_asked:
        return vectors.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.col("vec_id").alias("score")).where("false")
    parts = max(1, math.ceil(n / CHUNK))
    chunks = _packed(ordered.repartitionByRange(parts, F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id"), d, CHUNK, "chunks")
    asked = _packed(asked.repartitionByRange(max(1, math.ceil(n_asked / BLOCK)), "norm", "vec_id").sortWithinPartitions("norm", "vec_id"), d, BLOCK, "queries")
    first = chunks.orderBy(F.desc("length"), "number").limit(1).collect()[0]  # CHUNK vectors at most
    longest = np.frombuffer(first["ids"], np.int64), np.frombuffer(first["vectors"], np.int64).reshape(-1, d), first["length"]
    blocks = _floors(asked, longest, rotation, k)
    lane = F.pmod(F.xxhash64("number"), F.lit(LANES)).cast("int").alias("lane")
    needs = blocks.select(F.col("number").alias("block"), "need", F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))).alias("lane"))
    pairs = chunks.select("number", "length", lane).join(needs, "lane").where("length >= need").select("number", "block")
    groups = max(LEAST_GROUPS, math.ceil(parts / GROUP))
    group = F.pmod(F.xxhash64("number"), F.lit(groups)).cast("int")
    met = pairs.join(chunks, "number").select("block", group.alias("part"), F.lit(False).alias("asks"), "length", "ids", "vectors", F.lit(None).cast("binary").alias("floor"))
    wanted = pairs.select("block", group.alias("part")).distinct().join(blocks.withColumnRenamed("number", "block"), "block")
    sent = wanted.select("block", "part", F.lit(True).alias("asks"), F.lit(0.0).alias("length"), "ids", "vectors", "floor")
    tasks = sent.unionByName(met).repartition("block", "part").sortWithinPartitions("block", "part", F.desc("asks"), F.desc("length"))
    best = tasks.select("asks", "length", "ids", "vectors", "floor").mapInArrow(_walk(rotation, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
