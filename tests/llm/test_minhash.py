import random
import re

import numpy as np

from cueloom.llm import minhash
from cueloom.llm.components import components
from tests.llm.helpers import docs, plain

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(texts, k):
    sets = [shingles(t, k) for t in texts]
    label = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    return {(i, len(s), label[i], label[i] == i) for i, s in enumerate(sets)}


def family(rng, n, length=60, edits=4):
    base = [f"w{rng.randrange(500)}" for _ in range(length)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits)):
            own[rng.randrange(length)] = f"x{rng.randrange(500)}"
        out.append(" ".join(own))
    return out


def test_sets_are_the_text_s_shingles():
    for text in ("", "one", "A b", "a  b\tA\nb a", "é É ÀB àb", "x" * 10 + " y", "the the the the"):
        for k in (2, 5):
            assert len(minhash.shingle_set(text, k)) == len(shingles(text, k)), (text, k)
    assert np.array_equal(minhash.shingle_set("A b c", 2), minhash.shingle_set("a  B\nc", 2))


def test_words_beyond_a_block_are_hashed_whole(monkeypatch):
    monkeypatch.setattr(minhash, "HASH_BLOCK", 8)
    long_ = ["abcdefgh" * 3 + "x", "abcdefgh" * 3 + "y", "b abcdefgh c"]
    assert len({int(minhash.word_hashes(t)[0]) for t in long_}) == 3
    assert len(minhash.word_hashes("a bc defghijklmnop q rstuvwxyz" * 3)) == len(("a bc defghijklmnop q rstuvwxyz" * 3).split())


def test_components_match_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\t", "one", "ONE", "two words", "Two  words"] + [t for _ in range(6) for t in family(rng, 5)]
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(30)) for _ in range(20)] + ["tail " * 9000, "tail " * 9000 + "end"]
    for k in (2, 5):
        found = minhash.near_duplicates(plain(spark, texts), words=k)
        assert {tuple(r) for r in found.collect()} == brute(texts, k)


def test_large_cohesive_groups_and_deep_nodes(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 4)
    rng = random.Random(9)
    texts = family(rng, 60, 50, 9) + family(rng, 30, 50, 14) + ["common words here " + " ".join(f"v{rng.randrange(10**6)}" for _ in range(12)) for _ in range(30)]
    found = minhash.near_duplicates(plain(spark, texts), words=2)
    assert {tuple(r) for r in found.collect()} == brute(texts, 2)


def test_empty_table_and_repeated_rows(spark):
    assert minhash.near_duplicates(docs(spark, [])).count() == 0
    twice = minhash.near_duplicates(docs(spark, [(5, "a b c d e f", "en")] * 2 + [(2, "a b c d e f", "en")])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in twice) == [(2, 2), (5, 2), (5, 2)]


def test_components_of_chains_hubs_and_loops(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [(1, 1), (3, 2)]
    found = {(r["doc"], r["component"]) for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {(i, 100) for i in range(100, 161)} | {(7, 7)} | {(i, 7) for i in range(8, 60)} | {(2, 2), (3, 2)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pairs_at_the_threshold_keep_meeting_at_every_depth():
    rng = np.random.default_rng(11)
    equal = np.zeros(2_000_000, np.uint64)
    for c in range(minhash.MINS):
        equal |= (rng.random(len(equal), dtype=np.float32) < 0.8).astype(np.uint64) << np.uint64(c)
    ways = [{c} for _, _, c in minhash.WAYS[0]]
    for depth, level in enumerate(minhash.WAYS, 1):
        if depth > 1:
            assert len({sum(p == q for _, p, _ in level) for q in range(len(ways))}) == 1
            ways = [ways[p] | {c} for _, p, c in level]
        assert all(len(w) == depth for w in ways)
        missed = equal
        for w in ways:
            mask = np.uint64(sum(1 << c for c in w))
            missed = missed[(missed & mask) != mask]
        assert len(missed) < 1e-5 * len(equal), depth


def test_nodes_with_few_strangers_are_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 4)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(10)
    texts = family(rng, 60, 50, 6) + family(rng, 12, 50, 20) + ["common words here " + " ".join(f"v{rng.randrange(10**6)}" for _ in range(12)) for _ in range(40)]
    found = minhash.near_duplicates(plain(spark, texts), words=2)
    assert {tuple(r) for r in found.collect()} == brute(texts, 2)


def test_repeated_ids_with_other_texts_keep_their_own_links(spark):
    rng = random.Random(12)
    one, two = family(rng, 3, 120, 3), family(rng, 3, 120, 3)
    rows = [(9, one[0], "en"), (9, two[0], "en"), (3, one[1], "en"), (4, two[1], "en"), (None, one[0], "en"), (None, "a text of no one else", "en"), (7, "a text of its own", "en")]
    found = minhash.near_duplicates(docs(spark, rows), words=2, with_text_hash=True).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in found) == [(0, 0, True), (0, 3, False), (3, 3, True), (4, 4, True), (7, 7, True), (9, 3, False), (9, 4, False)]
    assert len({r["text_hash"] for r in found}) == 6


def test_second_sketches_let_similar_pairs_through():
    rng = np.random.default_rng(5)
    missed = passed = 0
    for n in (3, 10, 40, 300, 3000) * 40:
        both = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        own = [np.unique(np.concatenate([both, rng.integers(0, 1 << 63, n // 8, dtype=np.uint64)])) for _ in range(2)]
        far = np.unique(np.concatenate([both[: n // 2], rng.integers(0, 1 << 63, n // 2, dtype=np.uint64)]))
        a, b, c = (minhash._nibbles(minhash.least_in_bins(s)[None]) for s in (*own, far))
        missed += not minhash._bins_alike(a, b, 80)[0]
        passed += n >= 300 and bool(minhash._bins_alike(a, c, 80)[0])
    assert missed == 0 and passed <= 1


def test_tables_of_the_steps_are_deleted(spark, tmp_path):
    from cueloom.sources import workspace

    folder = workspace.shared_folder(spark)
    import os

    before = set(os.listdir(folder.removeprefix("file:"))) if os.path.isdir(folder.removeprefix("file:")) else set()
    found = minhash.near_duplicates(plain(spark, ["a b c d e", "a b c d e f", "x"]), words=2)
    new = set(os.listdir(folder.removeprefix("file:"))) - before
    assert found.count() == 3 and len(new) == 1 and next(iter(new)).startswith("near-duplicates")
