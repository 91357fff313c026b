from collections import defaultdict

from pyspark.sql import functions as F

from cueloom.llm.exact_dedup import exact_dedup, exact_groups
from cueloom.llm.keep import without
from tests.llm.helpers import docs

TEXTS = ["a", "b", "a", None, "", "ä b\n" * 4000, "ä b\n" * 4000, "a ", "A", "c"] + ["hot"] * 40


def brute(pairs):
    groups = defaultdict(list)
    for i, t in pairs:
        groups[t or ""].append(i)
    return {(i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""])) for i, t in pairs}


def check(spark, pairs, **options):
    found = exact_dedup(docs(spark, [(i, t, "en") for i, t in pairs]), keep="largest", **options)
    assert {tuple(r)[:4] for r in found.collect()} == brute(pairs)


def test_matches_brute_force(spark):
    check(spark, list(enumerate(TEXTS)))


def test_many_runs_are_compacted(spark):
    check(spark, list(enumerate(TEXTS)), memtable_rows=3, fanout=2)


def test_weak_digests_are_told_apart_by_bytes(spark):
    check(spark, list(enumerate(TEXTS)), digest=lambda t: F.pmod(F.length(t), F.lit(3)).cast("string").cast("binary"))


def test_repeated_rows_are_rows(spark):
    found = exact_dedup(docs(spark, [(1, "x", "en"), (1, "x", "en"), (2, "y", "en")])).collect()
    assert sorted(tuple(r)[:4] for r in found) == [(1, 1, 2, True), (1, 1, 2, True), (2, 2, 1, True)]


def test_null_ids_and_empty_table(spark):
    assert sorted((r["doc_id"] or -1, r["keep_id"] or -1, r["group_size"]) for r in exact_dedup(docs(spark, [(None, "x", "en"), (3, "x", "en")])).collect()) == [(-1, 3, 2), (3, 3, 2)]
    assert exact_groups(docs(spark, [])).count() == 0


def test_without_keeps_one_of_repeated_rows(spark):
    table = docs(spark, [(1, "x", "en"), (1, "x", "en"), (2, "x", "en"), (None, "q", "en"), (3, "z", "en")])
    left = without(table, spark.createDataFrame([(2,)], "id long"), spark.createDataFrame([(1,)], "id long"))
    assert left.columns == table.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left.collect()) == [(0, "q"), (1, "x"), (3, "z")]
