import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from cueloom.llm import pieces
from tests.llm.helpers import plain

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["  ", "\n", "\t", "a", "B", ".", ",", "é", "ß", "漢", "が", "ひ", "😀", "▁", "\x00", "the", " the", "    ", "ation", "ﬁ", "zz", "'", "́"]


def test_encoding_is_the_library_s_and_round_trips():
    library, own, rng = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.load(MODEL), random.Random(6)
    for _ in range(3000):
        text = "".join(rng.choices(PARTS, k=rng.randrange(15)))
        ids = own.encode(text)
        assert ids == library.encode(text), text
        assert own.decode(ids) == text.replace("▁", " ")


def test_long_segments():
    library, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.load(MODEL)
    for text in ("abcdefghij" * 800, " " * 500 + "x", "the" * 2000):
        assert own.encode(text) == library.encode(text)


def test_unigram_takes_the_best_sum():
    vocabulary = [(1, "▁", -3.0), (2, "a", -2.0), (3, "b", -2.0), (4, "ab", -3.5), (5, "▁ab", -5.0), (6, "aba", -4.0), (7, "▁a", -4.4)]
    own = pieces.PieceModel(vocabulary, None, 0, merges=False)

    def best(s):
        table = {0: (0.0, [])}
        for end in range(1, len(s) + 1):
            ways = [(table[end - len(p)][0] + score, table[end - len(p)][1] + [i]) for i, p, score in vocabulary if s[:end].endswith(p) and end - len(p) in table]
            if ways:
                table[end] = max(ways, key=lambda w: w[0])
        return table[len(s)][0]

    rng, score = random.Random(2), {i: s for i, _, s in vocabulary}
    for _ in range(300):
        text = "".join(rng.choices("ab", k=rng.randrange(1, 9)))
        assert sum(score[i] for i in own.segment("▁" + text)) == pytest.approx(best("▁" + text))
    assert own.segment("▁xab")[-1] == 4 and 0 in own.segment("▁xab")


def test_tables(spark):
    texts = [None, "", "Hello  world", "a▁b", "x" * 20000, "Hello  world"]
    found = {r["doc_id"]: r for r in pieces.digests(plain(spark, texts), MODEL).collect()}
    assert [found[i]["round_trip"] for i in range(6)] == [True, True, True, False, True, True]
    assert found[0]["n_ids"] == 0 and found[2]["ids_crc32"] == found[5]["ids_crc32"]
    back = pieces.decode(pieces.encode(plain(spark, texts), MODEL), MODEL)
    assert {r["doc_id"]: r["text"] for r in back.collect()}[2] == "Hello  world"
    assert pieces.digests(plain(spark, texts).where(F.lit(False)), MODEL).count() == 0
