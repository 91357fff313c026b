"""Registered queries against their oracles at the smallest size, and the entry point without the removable folders."""

import importlib.util
import math
import os
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from cueloom.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_its_oracle(spark, con, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    cursor = con.execute(ORACLE_SQL[name])
    there = [d[0] for d in cursor.description]
    assert sorted(there) == columns
    want = Counter(repr(tuple(plain(r[there.index(c)]) for c in columns)) for r in cursor.fetchall())
    assert Counter(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_oracle_has_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry_and_registration(spark):
    assert __spark_entry__.entry(spark).count() > 100
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_works_without_removable_parts(monkeypatch):
    found = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name in ("cueloom.llm", "corpus_pipeline") else found(name, *a))
    assert set(__spark_entry__.queries()) == set(QUERIES) and set(__spark_entry__.oracle_sql()) == set(ORACLE_SQL)


def test_nothing_outside_imports_the_subpackage():
    root = Path(__file__).resolve().parent.parent
    for path in (root / "cueloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert "cueloom.llm" not in path.read_text(), path
    assert sys.version_info >= (3, 10)
