"""The registered queries over a whole small table: their columns, and their rows against plain forms."""

import hashlib
import os
import zlib

import pytest

from cueloom.llm.queries import QUERIES
from tests.llm.test_minhash import shingles
from tests.llm.test_text_models import naive

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")

COLUMNS = {
    "op1_minhash_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op2_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op5_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op7_exact_topk": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op8_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op10_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
}


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(spark, name):
    found = QUERIES[name](spark, DATA)
    kinds = dict(found.dtypes)
    assert {c: kinds.get(c) for c in (x.split()[0] for x in COLUMNS[name].split(", "))} == dict(x.split() for x in COLUMNS[name].split(", "))


def test_near_dedup_against_all_pairs(spark, documents):
    sets = {i: shingles(r["text"], 2) for i, r in documents.items()}
    label = {i: i for i in sets}
    order = sorted(sets)
    pairs = [(a, b) for k, a in enumerate(order) for b in order[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in order:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    found = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in QUERIES["op1_minhash_near_dedup"](spark, DATA).collect()}
    assert found == {(i, len(sets[i]), label[i], label[i] == i) for i in order}


def test_personal_data_against_the_patterns(spark, documents):
    kinds = ["email", "ip", "card", "phone"]
    for r in QUERIES["op5_pii"](spark, DATA).collect():
        base = sorted(naive(documents[r["doc_id"]]["text"] or ""), key=lambda s: (kinds.index(s[0]), s[1]))
        shown = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in kinds] == [sum(s[0] == k for s in base) for k in kinds]
        assert set(shown.split(",")) - {""} <= set(r["spans"].split(","))


def test_languages_are_told_without_looking_at_labels(spark, documents):
    found = {r["doc_id"]: r for r in QUERIES["op10_language_id"](spark, DATA).collect()}
    assert set(found) == set(documents)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for i, r in found.items())
    held = [r for i, r in found.items() if r["held_out"] and documents[i]["lang"] and any(c.isalpha() for c in documents[i]["text"] or "")]
    assert sum(r["lang_pred"] == documents[r["doc_id"]]["lang"] for r in held) >= 0.95 * len(held)
    assert all(found[i]["lang_pred"] == "und" for i, r in documents.items() if not any(c.isalpha() for c in r["text"] or ""))


def test_every_row_has_one_answer(spark, documents):
    for name in ("op4_secret_scan", "op6_sentencepiece", "op9_line_dedup", "op3_preference_format"):
        rows = QUERIES[name](spark, DATA).collect()
        if name in ("op6_sentencepiece", "op9_line_dedup"):
            assert {r["doc_id"] for r in rows} == set(documents) and len(rows) == len(documents)
        elif name == "op4_secret_scan":
            assert all(0 <= r["start"] < r["after_last"] <= len(documents[r["doc_id"]]["text"]) for r in rows)
