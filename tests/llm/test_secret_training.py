"""What secret scans learn from the whole table."""

from collections import Counter

import numpy as np

from cueloom.llm import secrets
from cueloom.llm.forest import fit, predict

from .helpers import plain


def test_counts_cover_every_word_of_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(secrets, "STRETCH", 50)
    texts = ["plain words here " * 3] * 300 + ["x" * 3 + " " * 5000 + "qzvj Qzvj wird", None, "", "é", "a", "naïve co-op"]
    texts[7] = "vwxk vwxk"
    counts, pairs, triples = secrets.corpus_counts(plain(spark, texts)), Counter(), Counter()
    for word in (w.lower() for t in texts if t for w in secrets._WORD.findall(t)):
        pairs.update(word[i : i + 2] for i in range(len(word) - 1))
        triples.update(word[i : i + 3] for i in range(len(word) - 2))
    letters = "abcdefghijklmnopqrstuvwxyz"
    assert {a + b: counts[26 * i + j] for i, a in enumerate(letters) for j, b in enumerate(letters) if counts[26 * i + j]} == pairs
    assert counts[secrets.PAIRS :].sum() == sum(triples.values())
    assert Counter(map(int, counts[secrets.PAIRS :][counts[secrets.PAIRS :] > 0])) == Counter(triples.values())


def test_training_sees_documents_and_ends_outside_the_sample(spark):
    texts = ["plain words here"] * 2000 + ["filler " * 1000 + "qzvjqzvj wxkqwxkq"] * 2
    language, _ = secrets.trained(plain(spark, texts))
    assert {"qzv", "zvj", "wxk", "pla"} <= language.grams


def test_every_plain_candidate_counts_as_negative(spark):
    texts = ["kalomituretukalo and Kalomituretukalo"] * 500 + ["ABCDEFGHIJKLMNOPQ abc1efghijklmnopq", None, " " * 6000 + "tukalomiturekalomi"]
    cells, many = secrets.plain_cells(plain(spark, texts), secrets.Language(["plain", "words"]))
    assert many.sum() == 1001 and sorted(many.tolist()) == [1, 500, 500] and cells.shape == (3, len(secrets._STEPS))


def test_a_weighted_row_stands_for_many():
    x, y = np.array([[0.0], [0.0], [1.0], [1.0]] * 5), np.array([True, False, True, False] * 5)
    weights = np.array([9.0, 1.0, 1.0, 9.0] * 5)
    assert (predict(fit(x, y, weights=weights), np.array([[0.0], [1.0]])) > 0.5).tolist() == [True, False]
