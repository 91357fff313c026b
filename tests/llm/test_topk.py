import math
import random

from pyspark.sql import functions as F

from cueloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score long, rank int, length double"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 1, 2, 3.0) for i, v in vectors], SCHEMA)


def brute(vectors, every, k):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors if v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in usable:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, c, strict=True)), j) for j, c in usable if j != i)[:k]
            out |= {(i, r, j, -s) for r, (s, j) in enumerate(scored, 1)}
    return out


def vectors(n, d=8, seed=1):
    rng = random.Random(seed)
    return [(i, [round(rng.gauss(0, 1 + i % 3) * 64) / 64 for _ in range(d)]) for i in range(n)]


def found(spark, own, every=5, k=5):
    return {tuple(r) for r in topk.top_inner_products(table(spark, own), F.col("vec_id") % every == 0, k=k).collect()}


def test_matches_brute_force_with_ties(spark, monkeypatch):
    monkeypatch.setattr(topk, "CHUNK", 16)
    monkeypatch.setattr(topk, "BLOCK", 7)
    own = vectors(150) + [(i, [0.25] * 8) for i in range(200, 260)]
    assert found(spark, own) == brute(own, 5, 5)


def test_unusable_vectors_take_no_part(spark):
    own = [*vectors(20), (100, None), (105, [None] * 8), (110, [float("nan")] * 8), (115, [float("inf")] * 8), (120, [])]
    assert found(spark, own) == brute(own, 5, 5)


def test_few_candidates_and_empty_table(spark):
    own = vectors(3)
    assert found(spark, own, 2, 5) == brute(own, 2, 5)
    assert found(spark, []) == set() and found(spark, [(5, [1.0])], 5) == set() and found(spark, [(1, [1.0])], 5) == set()


def test_high_dimensions(spark):
    own = vectors(60, 48, 4)
    assert found(spark, own, 10, 5) == brute(own, 10, 5)


def test_every_dimension_is_searched_and_matches_the_sql(spark, tmp_path):
    import duckdb

    from cueloom.llm.queries import ORACLE_SQL, op7_exact_topk

    own = [*vectors(120, 8, 2), *((i + 1000, v) for i, v in vectors(60, 5, 3)), *((i + 2000, v) for i, v in vectors(3, 2, 4)), *vectors(10, 8, 6), (50, None), (100, [1.0] * 8), (100, [2.0] * 8)]
    table(spark, own).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = sorted(con.execute(f"SELECT query_id, rank, score FROM ({ORACLE_SQL['op7_exact_topk']})").fetchall())
    got = op7_exact_topk(spark, str(tmp_path))
    assert sorted((r["query_id"], r["rank"], r["score"]) for r in got.collect()) == want
    assert {q for q, _, _ in want} >= {0, 50, 100, 1000, 1050, 2000}


def test_blocks_pass_over_chunks_that_cannot_matter(spark, monkeypatch):
    monkeypatch.setattr(topk, "CHUNK", 16)
    monkeypatch.setattr(topk, "BLOCK", 4)
    monkeypatch.setattr(topk, "LEAST_GROUPS", 3)
    long_ = [(i, [8.0 if j == i % 8 else 0.5 for j in range(8)]) for i in range(40)]
    own = long_ + [(i + 100, [v / 64 for v in x]) for i, x in vectors(200, 8, 5)]
    assert found(spark, own) == brute(own, 5, 5)
