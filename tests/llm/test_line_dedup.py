import random

from cueloom.llm import line_dedup as ld
from tests.llm.helpers import docs, plain


def brute(pairs):
    """Cleaned texts: of equal removable chunks the first by (doc_id, place) stays."""
    seen, out = {}, {}
    for i, text in sorted(pairs, key=lambda p: p[0]):
        lines = ld._lines(text)
        for a, _, data in ld.removable(lines):
            seen.setdefault(data, []).append((i, a))
    for i, text in pairs:
        lines = ld._lines(text)
        gone = {a for a, _, data in ld.removable(lines) if min(seen[data]) != (i, a)}
        out[i] = text if not gone else b"\n".join(line for a, b in ld.chunks(lines) if a not in gone for line in lines[a:b]).decode()
    return out


def lines(rng, n):
    return [" ".join(f"w{rng.randrange(1000)}" for _ in range(6)) for _ in range(n)]


def cleaned(spark, pairs):
    table = docs(spark, [(i, t, "en") for i, t in pairs])
    found = ld.remove_repeated_lines(table)
    assert found.columns[: len(table.columns)] == table.columns
    return {r["doc_id"]: r["text"] for r in found.collect()}


def test_shared_passages_go_and_the_first_stays(spark):
    rng = random.Random(3)
    shared = lines(rng, 24)
    texts = [None, "", "\n\n\n", "one line"] + ["\n".join(lines(rng, k) + shared + lines(rng, 3)) for k in range(8)] + ["\n".join(shared * 30)]
    pairs = list(enumerate(texts))
    got = cleaned(spark, pairs)
    assert got == brute(pairs)
    assert sum(len(got[i]) < len(texts[i]) for i in range(5, 12)) == 7 and got[4] == texts[4]


def test_boundaries_resist_shifts():
    rng = random.Random(4)
    shared = [s.encode() for s in lines(rng, 30)]
    one, two = ld.removable(shared), ld.removable([b"new first line", *shared])
    assert len({d for *_, d in one} & {d for *_, d in two}) >= len(one) - 1


def test_chunks_cover_all_lines():
    rng = random.Random(5)
    own = [s.encode() for s in lines(rng, 300)] + [b"same"] * 400
    spans = ld.chunks(own)
    assert spans[0][0] == 0 and spans[-1][1] == len(own) and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert max(b - a for a, b in spans) <= ld.MOST_LINES and ld.chunks([]) == []


def test_repeated_rows_and_empty_table(spark):
    rng = random.Random(6)
    text, other = "\n".join(lines(rng, 12)), "\n".join(lines(rng, 12))
    assert ld.remove_repeated_lines(docs(spark, [(1, text, "en"), (1, text, "en")])).select("text").distinct().collect()[0][0] == text
    mixed = ld.remove_repeated_lines(docs(spark, [(1, text, "en"), (1, other, "en"), (2, other, "en")]))
    assert mixed.where("text IS NOT NULL").count() == 3
    assert ld.remove_repeated_lines(plain(spark, [])).count() == 0


def test_colliding_digests_remove_equal_bytes_only(spark):
    rng = random.Random(7)
    shared = "\n".join(lines(rng, 10))
    pairs = [(i, shared + "\n" + "\n".join(lines(rng, 6))) for i in range(4)]
    assert cleaned(spark, pairs) == brute(pairs)
    table = docs(spark, [(i, t, "en") for i, t in pairs])
    for passages in (False, True):
        plainly, colliding = (
            {(r["doc"], tuple(r["places"])) for r in ld.repeated_chunks(table, passages, digest).collect()} for digest in (ld.xxhash.xxh3_128_digest, lambda data, seed: bytes([len(data) % 2]))
        )
        assert plainly == colliding and len(plainly) == 3


def test_short_passages_in_other_surroundings_go_whole(spark, tmp_path):
    from cueloom.llm.queries import op9_line_dedup

    rng = random.Random(8)
    texts, own = [], []
    for n in range(2, 9):
        shared = lines(rng, n)
        for copy in range(3):
            before, after = lines(rng, rng.randrange(1, 5)), lines(rng, rng.randrange(1, 5))
            texts.append("\n".join(before + (shared[:1] + [""] + shared[1:] if copy == 2 else shared) + after))
            own.append("\n".join(before + (shared if copy == 0 else []) + after))
    loop = "\n".join(["a b", "c d"] * 3)
    pairs = list(enumerate([*texts, loop, None, ""]))
    table = docs(spark, [(i, t, "en") for i, t in pairs])
    got = {r["doc_id"]: r for r in ld.remove_repeated_lines(table, passages=True).collect()}
    assert [got[i]["text"] for i in range(len(texts))] == own
    assert got[len(texts)]["text"] == "a b\nc d" and got[len(texts) + 1]["text"] is None and got[len(texts) + 2]["text"] == ""
    assert all(got[i]["n_removed_chunks"] == (i % 3 > 0) for i in range(len(texts)))
    assert {line for t in texts for line in t.split("\n") if line} == {line for i in range(len(texts)) for line in got[i]["text"].split("\n")}
    table.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["n_chars_kept"] for r in op9_line_dedup(spark, str(tmp_path)).collect()} == {i: len(r["text"] or "") for i, r in got.items()}
