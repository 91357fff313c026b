"""The pipeline against its stages' brute-force forms on a small corpus."""

import random

import corpus_pipeline
from cueloom.llm import packing
from tests.llm.helpers import plain
from tests.llm.test_text_models import prose


def test_stages_keep_clean_documents_and_take_effect(spark, tmp_path):
    rng = random.Random(12)
    clean = [prose(rng, lang, 80) for lang in ("aa", "bb", "cc") for _ in range(8)]
    near = clean[0].rsplit(" ", 1)[0] + " changed"
    texts = [*clean, clean[1], near, "12345 !!", None, clean[2] + " reach me at joe@example.org"]
    langs = ["aa"] * 8 + ["bb"] * 8 + ["cc"] * 8 + ["aa"] * 5
    from tests.llm.helpers import docs

    docs(spark, [(i, t, lang) for i, (t, lang) in enumerate(zip(texts, langs, strict=True))]).write.parquet(f"{tmp_path}/documents.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, str(tmp_path))
        if name != "packing":
            assert out.columns == table.columns
        out.write.parquet(f"{tmp_path}/{name}")
        table = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r["doc_id"] for r in table.collect()}
    everything = set(range(len(texts)))
    assert seen["language_id"] == everything - {26, 27}
    assert seen["exact_dedup"] == seen["language_id"] - {24}
    assert seen["near_dedup"] == seen["exact_dedup"] - {25, 28}
    assert seen["pii"] == seen["packing"] == seen["near_dedup"]
    lengths = sum(r["length"] for r in table.collect())
    assert lengths == sum(len(packing.token_ids(t, *corpus_pipeline.vocabulary())) for t in clean)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == table.count()


def test_redaction_takes_effect(spark):
    out = corpus_pipeline.redact_personal_data(spark, plain(spark, ["mail joe@example.org now", None]), "")
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {0: "mail [EMAIL] now", 1: None}


def test_empty_corpus(spark):
    table = plain(spark, [])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table, "").count() == 0
