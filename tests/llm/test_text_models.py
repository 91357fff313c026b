"""Language ID, personal data and secrets."""

import random
import re

import numpy as np
import pytest

from cueloom.llm import forest, language_id, pii, secrets
from tests.llm.helpers import docs, plain

SYLLABLES = {"aa": "ka lo mi tu re", "bb": "zorp quix blin wex yod", "cc": "ßen ülk äth öx sch"}


def prose(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang].split(), k=rng.randrange(1, 4))) for _ in range(n))


def test_language_is_learned_and_rejected(spark):
    rng = random.Random(1)
    table = docs(spark, [(i, prose(rng, lang, 40), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 30)] + [(900, None, "aa"), (901, "x", None), (902, "", "bb")])
    learned = language_id.learn(table)
    assert [lang for lang, _ in learned] == ["aa", "bb", "cc"]
    asked = docs(spark, [(i, t, None) for i, t in enumerate([None, "", "123 !?", *(prose(rng, lang, n) for n in (30, 3000) for lang in SYLLABLES)])])
    found = {r["doc_id"]: r for r in language_id.identify(asked, learned).collect()}
    assert [found[i]["lang_pred"] for i in range(9)] == ["und"] * 3 + ["aa", "bb", "cc"] * 2
    assert [found[i]["accepted"] for i in range(9)] == [False] * 3 + [True] * 6
    assert all(0 <= r["score"] <= 1 for r in found.values())
    kept = language_id.keep_identified(asked, learned)
    assert kept.columns == asked.columns and kept.count() == 6


def test_language_without_labels_or_rows(spark):
    none = language_id.learn(docs(spark, [(1, "text", None)]))
    assert none == [] and language_id.identify(plain(spark, ["text"]), none).collect()[0]["lang_pred"] == "und"
    assert language_id.identify(plain(spark, []), [("aa", b"ka")]).count() == 0
    assert language_id.Classifier([("aa", b"ka lo")]).predict("ka") == ("aa", 1.0, True)


def test_ties_go_to_the_commonest_language():
    same = [("b", b"xyz" * 50), ("a", b"xyz" * 50)]
    lang, score, accepted = language_id.Classifier(same).predict("qqqq")
    assert (lang, score, accepted) == ("b", 0.0, True)
    assert not language_id.Classifier(same).predict("qw er " * 200)[2]


def test_narrow_margins_are_rejected_at_every_length():
    rng = random.Random(2)
    classifier = language_id.Classifier([(lang, prose(rng, lang, 2000).encode()) for lang in SYLLABLES])
    han = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    assert not any(classifier.predict(han(n))[2] for n in (3, 10, 100, 130, 1000) for _ in range(10))
    same = language_id.Classifier([("b", b"xyz" * 50), ("a", b"xyz" * 50)])
    assert not any(same.predict("qw er " * n)[2] for n in (2, 5, 60, 66, 70))
    assert all(classifier.predict(prose(rng, lang, n))[::2] == (lang, True) for lang in SYLLABLES for n in (20, 40, 400))


# --- Personal data ---------------------------------------------------------------------------------------------

NAIVE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def naive(text):
    out = []
    for kind, pattern in NAIVE.items():
        for m in re.finditer(pattern, text):
            d = [int(c) for c in m[0] if c in "0123456789"]
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(d) <= 19 and pii.luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def test_base_spans_match_the_patterns():
    rng = random.Random(5)
    parts = ["a@b.c", "@", ".", "-", "+1 (323) 555-9830", "1.2.3.4", "256.1.1.1", "0001.2.3.4", "4111111111111111", "4111 1111-1111 1111", " ", "x", "é", "12", "+", "(", "9", "@x.y", "a.b", "\n", "٣"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randrange(12)))
        assert pii.base_spans(text) == naive(text), text


def test_base_spans_of_very_long_runs_are_quick():
    for text in ("9" * 300_000, "a" * 300_000 + "@", "1.1." * 80_000, "+1" + " " * 200_000, "a@" * 100_000):
        pii.base_spans(text)


@pytest.fixture(scope="module")
def model():
    rng = random.Random(8)
    return pii.train(*pii.labelled_windows([prose(rng, lang, 300) for lang in SYLLABLES for _ in range(5)]))


def test_model_finds_held_out_spans(model):
    x, y = pii.labelled_windows(["some other words that were not seen before in any text at all"] * 3, 400, seed=77)
    found = pii.decode(model, x)
    assert (found[y > 0] == y[y > 0]).mean() > 0.85 and (found[y == 0] == 0).mean() > 0.95


def test_model_adds_and_base_stays(model):
    text = "lorem ipsum dolor (323) 555-9830 sit amet, see version 2.0 and mail joe.12@mail4.example.com today " + "plain words " * 30
    base = pii.base_spans(text)
    added = pii.added_spans([text, "", "no digits at all"], [base, [], []], model)
    assert [s[0] for s in base] == ["email"] and added[1:] == [[], []]
    assert all(not (a < e and s < b) for _, s, e in added[0] for _, a, b in base)
    assert {text[a:b] for k, a, b in added[0]} <= {"(323) 555-9830"}


def planted(rng, n):
    """Texts with personal data that no pattern matches, and look-alikes: (text, [(kind, start, end)])."""
    out = []
    for _ in range(n):
        words = prose(rng, rng.choice(list(SYLLABLES)), 40).split()
        spans, text = [], ""
        at = rng.randrange(5, 35)
        kind, made = rng.choice((
            ("phone", f"({rng.randrange(200, 1000)}) {rng.randrange(200, 1000)}-{rng.randrange(10000):04}"),
            ("phone", f"{rng.randrange(200, 1000)}-{rng.randrange(200, 1000)}-{rng.randrange(10000):04}"),
            ("phone", f"{rng.randrange(200, 1000)}.{rng.randrange(200, 1000)}.{rng.randrange(10000):04}"),
            ("card", next(c for c in iter(lambda: pii._card(rng), None) if "." in c)),
            (None, f"{rng.randrange(9)}.{rng.randrange(20)}.{rng.randrange(30)}"),
            (None, f"{rng.randrange(1900, 2100)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}"),
            (None, f"{rng.getrandbits(160):040x}"),
            (None, str(rng.randrange(10**15, 10**16))),
        ))
        for j, word in enumerate(words):
            if j == at:
                spans += [(kind, len(text), len(text) + len(made))] if kind else []
                word = made
            text += word + " "
        out.append((text, spans))
    return out


def test_model_finds_what_patterns_miss_and_leaves_look_alikes(model):
    cases = planted(random.Random(21), 400)
    texts = [t for t, _ in cases]
    assert not any(s[0] != "card" for t in texts for s in pii.base_spans(t))
    added = pii.added_spans(texts, [pii.base_spans(t) for t in texts], model)
    want = {(i, *s) for i, (_, spans) in enumerate(cases) for s in spans}
    got = {(i, *s) for i, spans in enumerate(added) for s in spans}
    hits = len(want & got)
    assert hits >= 0.8 * len(want) and hits >= 0.95 * len(got), (hits, len(want), len(got), sorted(got - want)[:5], sorted(want - got)[:5])


def test_pii_tables(spark, model):
    texts = [None, "", "a@b.cd x", "q " * 60_000 + "1.2.3.4", "a@b.cd x"]
    found = sorted(pii.find(plain(spark, texts), model).collect(), key=lambda r: r["doc_id"])
    assert [r["spans"] for r in found] == ["", "", "email:0:6", "ip:120000:120007", "email:0:6"]
    table = plain(spark, texts)
    clean = {r["doc_id"]: r for r in pii.redact(table, model).collect()}
    assert clean[0]["text"] is None and clean[2]["text"] == "[EMAIL] x" and clean[2]["n_chars"] == 9 and clean[3]["text"].endswith("[IP]")
    assert pii.redact(table, model).columns == table.columns and pii.find(plain(spark, []), model).count() == 0


def test_training_from_an_empty_table(spark):
    assert set(pii.trained(plain(spark, []))) >= {"out", "step"}


def test_redaction_of_overlaps():
    assert pii.redacted("abcdefgh", [("card", 1, 5), ("ip", 3, 7), ("phone", 7, 8)]) == "a[CARD][PHONE]"


# --- Secrets ---------------------------------------------------------------------------------------------------


def test_forest_learns_a_rule():
    rng = np.random.default_rng(0)
    x = rng.random((600, 4))
    y = (x[:, 0] > 0.5) & (x[:, 2] < 0.6)
    assert ((forest.predict(forest.fit(x[:400], y[:400]), x[400:]) > 0.5) == y[400:]).mean() > 0.93


def test_secrets_are_found_and_words_are_not(spark):
    rng = random.Random(3)
    filler = [prose(rng, "aa", 120) for _ in range(30)]
    key, token = "AKIA" + "Q7ZT4NB2XW9LKD3M", "9c8b45435718dcc700c184a7e303cdc64c6a8f7f"
    texts = [*filler, f"some words {key} more", f'set token = "{token}" here', f"sha1 {token} of it", "a" * 5000, None, "", "kalomituretu" * 2]
    table = plain(spark, texts)
    found = {(r["doc_id"], texts[r["doc_id"]][r["start"] : r["after_last"]]) for r in secrets.scan(table, secrets.trained(table)).collect()}
    assert found == {(30, key), (31, token)}
    assert secrets.scan(plain(spark, []), secrets.trained(plain(spark, []))).count() == 0


def test_findings_on_labelled_texts_are_right(spark):
    rng = random.Random(33)
    filler = [prose(rng, "aa", 120) for _ in range(40)]
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    texts, want = list(filler), set()
    for k in range(120):
        before, after = prose(rng, "aa", rng.randrange(3, 20)), prose(rng, "aa", rng.randrange(3, 20))
        secret = k % 2 == 0
        key = "AKIA" + "".join(rng.choices(letters[:26] + "234567", k=16)) if k % 4 == 0 else f"{rng.getrandbits(160):040x}"
        shown = {True: f'set token = "{key}"' if k % 4 else key, False: rng.choice((prose(rng, "aa", 1) * 4, f"sha1 {rng.getrandbits(160):040x}", "version 1.2.3-alpha.20240101", "https://example.org/a/b/c/d/e/f/g/index.html"))}[secret]
        if secret:
            want.add((len(texts), key))
        texts.append(f"{before} {shown} {after}")
    table = plain(spark, texts)
    got = {(r["doc_id"], texts[r["doc_id"]][r["start"] : r["after_last"]]) for r in secrets.scan(table, secrets.trained(table)).collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got), (len(want), len(got), sorted(got - want)[:4], sorted(want - got)[:4])


def test_candidates_leave_names_out():
    assert [("password=abcdefgh12345678XY"[a:b]) for a, b in secrets.candidates("password=abcdefgh12345678XY")] == ["abcdefgh12345678XY"]


def test_features_cover_the_whole_candidate():
    language = secrets.Language(["plain", "words"])
    rng = random.Random(3)
    tail = "".join(rng.choices("ABCDEFGHJKLMNPQRSTUVWXYZ23456789+/", k=4096))
    one, two = ("a" * 4096 + end for end in ("a" * 4096, tail))
    first, second = (secrets.features(t, 0, len(t), None, language) for t in (one, two))
    assert first[0] == second[0] and first[4] == 1 and second[4] == 0.5 and all(first[i] != second[i] for i in (1, 3, 4, 7))
