"""Drift samples and checkpoints against their SQL, to the last bit."""

import random

import duckdb
import numpy as np
import pytest

from cueloom.plans.drift import word_line
from cueloom.plans.queries import ORACLE_SQL, QUERIES
from cueloom.plans.repair import time_at, times_at
from cueloom.plans.script import Token
from cueloom.plans.timeline import Timeline
from cueloom.sources import corpora


@pytest.fixture(scope="module")
def long_words(spark, tmp_path_factory):
    """English documents of words of 16 letters, whose drift ends in half a microsecond, and of mixed ones."""
    root = tmp_path_factory.mktemp("drift")
    texts = [" ".join("abcdefghijklmnop"[: 16 - (i % 3) * d] for i in range(700)) for d in range(5)]
    texts += ["  two  blanks\nand\n\nlines ", "", "x", None]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(99, texts[0], "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{root}/documents.parquet")
    return str(root)


def both(spark, root, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{root}/documents.parquet/*.parquet')")
    df = QUERIES[name](spark, root)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    return sorted(tuple(r) for r in df.select(*columns).collect()), sorted(want)


@pytest.mark.parametrize("name", ["drift_samples", "checkpoint_statistics", "drift_islands"])
def test_halves_are_rounded_as_in_the_sql(spark, long_words, name):
    got, want = both(spark, long_words, name)
    assert got == want and len(got) > 9


def test_checkpoints_shuffle_no_row_for_each_word(spark, long_words):
    plan = QUERIES["checkpoint_statistics"](spark, long_words)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_word_lines_are_the_word_tokens(spark, long_words):
    scripts = corpora.english_scripts(spark, long_words)
    want = {}
    for r in corpora.word_tokens(scripts).orderBy("script_id", "ord").collect():
        want.setdefault(r["script_id"], []).append((r["text"], r["start"], r["end"], r["start_char"], r["end_char"], r["confidence"]))
    for r in scripts.collect():
        rows = [(t["text"], t["start"], t["end"], t["start_char"], t["end_char"], t["confidence"]) for t in word_line(r["display_text"]).rows()]
        assert rows == want.get(r["script_id"], [])


def test_times_of_many_offsets_are_those_of_each():
    rng = random.Random(4)
    for overlap in (False, True) * 20:
        tokens, at = [], 0
        for _ in range(rng.randrange(12)):
            a = at + rng.choice((0, 0, 1, 5, 9))
            at = a + rng.randrange(0 if overlap else 1, 4)
            tokens.append(Token("x", a * 0.1, a * 0.1 + rng.random(), a, at + (rng.randrange(3) if overlap else 0), 0.9))
        line = Timeline.of(tokens).by("a", "b", "start")
        places = np.arange(at + 8)
        want = [time_at(line, int(x)) for x in places] if tokens else [None] * len(places)
        assert [None if x != x else x for x in times_at(line, places).tolist()] == want
