import bisect
import os
import random
import zlib

import numpy as np
import pytest

from cueloom.llm import packing
from cueloom.llm.queries import vocabulary
from tests.llm.helpers import docs, plain

JSON, RANKS = vocabulary()
TEXTS = [None, "", "a", "Hello world, how are you?\n\n  é ü 漢字 😀", "word " * 5000, "b<|endoftext|>c", "x" * 3000] + ["same text here"] * 30


def test_ids_are_the_tokenizer_s():
    from tokenizers import Tokenizer

    exact, rng = Tokenizer.from_file(JSON), random.Random(2)
    some = [t or "" for t in TEXTS] + ["".join(rng.choices("ab  \n\t'sé漢😀­0123.,-_\x00﻿", k=30)) for _ in range(300)]
    for text in some:
        assert packing.token_ids(text, JSON, RANKS).tolist() == [*exact.encode(text, add_special_tokens=False).ids, 0]


def test_plan_holds_every_piece_and_few_sequences():
    rng = np.random.default_rng(1)
    for sample in (rng.integers(1, 2049, 3000), np.full(500, 700), np.array([2048, 2048, 1]), np.clip(rng.lognormal(6, 1, 5000), 1, 2048).astype(int), np.array([], int)):
        histogram = np.bincount(sample, minlength=2049)
        plan = packing.plan(histogram)
        used = np.zeros(2049, int)
        for lengths, n in plan:
            assert sum(lengths) <= 2048
            for length in lengths:
                used[length] += n
        assert np.array_equal(used, histogram)
        total, least = sum(n for _, n in plan), -(-int(sample.sum()) // 2048)
        if len(sample) > 1000:
            assert total <= least * 1.02 + 2 or (sample > 1024).sum() >= least


def test_nnls_is_non_negative_and_fits():
    rng = np.random.default_rng(3)
    a, x = rng.random((8, 20)), np.maximum(0, rng.normal(0, 1, 20))
    found = packing.nnls(a, a @ x)
    assert found.min() >= 0 and np.allclose(a @ found, a @ x, atol=1e-6)


@pytest.mark.parametrize("repeat", [1, 2])
def test_sequences_are_gapless_and_pieces_are_whole(spark, repeat):
    table = docs(spark, [(i, t, "en") for i, t in enumerate(TEXTS)] * repeat)
    found = packing.pack(table, JSON, RANKS).collect()
    by_sequence, by_doc = {}, {}
    for r in found:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], set()).add((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    for i, text in enumerate(TEXTS):
        ids = packing.token_ids(text, JSON, RANKS)
        assert by_doc[i] == {(k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids)))}
    assert len(found) == repeat * sum(map(len, by_doc.values()))


def test_cut_and_empty_table(spark):
    assert packing.cut(2048) == [(0, 2048)] and packing.cut(2049) == [(0, 1), (1, 2048)] and packing.cut(4096) == [(0, 2048), (2048, 2048)]
    assert packing.pack(plain(spark, []), JSON, RANKS).count() == 0


def best_fit_decreasing(lengths):
    """Sequences that plain best fit needs, longest first, piece by piece."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, length)
        room = rooms.pop(at) if at < len(rooms) else 2048
        bisect.insort(rooms, room - length)
    return len(rooms)


def test_plans_are_as_short_as_plain_best_fit():
    rng = np.random.default_rng(4)
    samples = {
        "documents": np.clip(rng.exponential(500, 6000), 1, 2048).astype(int),
        "short": rng.integers(1, 200, 5000),
        "thirds": rng.integers(600, 900, 4000),
        "uniform": rng.integers(1, 2049, 4000),
        "one length": np.full(999, 700),
    }
    for name, sample in samples.items():
        total, plain_total = sum(n for _, n in packing.plan(np.bincount(sample, minlength=2049))), best_fit_decreasing(sample.tolist())
        assert total <= plain_total * 1.001 + (name == "uniform"), name


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the driver's tables are not here")
def test_the_query_reaches_the_bound_on_the_given_table(spark):
    from cueloom.llm.queries import op2_best_fit_packing

    found = op2_best_fit_packing(spark, "/root/testdata/sf0.01")
    r = found.selectExpr("count(distinct sequence_id) AS n", "sum(length) AS tokens").collect()[0]
    assert r["n"] == -(-r["tokens"] // 2048)
