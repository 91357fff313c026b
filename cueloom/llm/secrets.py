"""Secret scans: candidates by pattern, false positives removed by a random forest.

Every whole text is searched for candidates: runs of ``LEAST`` or more characters of keys and tokens. A candidate's features are its
length, its character transitions (mean log probability under a table of words' transitions), the share of it that
dictionary trigrams cover, character classes and entropy, what kind of path the document has, and the words next to it.
The forest is trained from labelled findings: secrets of known shapes set into sampled text are positive; the sampled
text's own words, and look-alikes (digests with their names, versions, addresses, identifiers, placeholders), are
negative. The transition table and the dictionary are counted over every word of every whole text, and every plain word that is
a candidate counts as negative, by cells of rounded features. Only what stands around the made findings, and the words that look-alikes
are made of, are drawn from a bounded sample: ``TRAIN_DOCS`` documents (first by a hash of doc_id), ``TRAIN_CHARS`` of each.

Defined results: null or empty text has no findings. A finding is a row; documents without one have none. Repeated rows are
searched one by one. Null source counts as an unknown path. Texts and candidates of any length are searched whole. An empty table trains on
generated text and gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueloom.llm.forest import fit, predict
from cueloom.llm.sampling import first_texts

LEAST = 16
TRAIN_DOCS = 200
TRAIN_CHARS = 4000
TRAIN_EACH = 1200
CONTEXT = 48
THRESHOLD = 0.5
#: Pairs of letters, and how many characters are counted at once.
PAIRS = 26 * 26
STRETCH = 1 << 18
#: What the features of plain words are rounded to, in their order.
_STEPS = np.array([0.1, 0.05, 0.05, 0.05, 0.05, 0.05, 0.05, 0.1, 1, 1, 1, 1, 1, 1, 1])
_CANDIDATE = re.compile(r"[A-Za-z0-9+/=_-]{16,}")
_WORD = re.compile(r"[A-Za-z]+")
#: Words beside a candidate that speak for, and against, a secret.
_FOR = frozenset("key token secret password passwd pwd auth bearer credential credentials apikey private access".split())
_AGAINST = frozenset("sha md5 sha1 sha256 digest checksum hash commit uuid id version example placeholder integrity blob".split())
_CODE_PATH = re.compile(r"\.(env|ya?ml|json|toml|ini|cfg|conf|py|js|ts|sh|tf|properties)$|config|settings|secrets", re.IGNORECASE)
_SYMBOLS = string.ascii_lowercase + "0#"
_INDEX = {c: i for i, c in enumerate(_SYMBOLS)}


def _shape(text: str) -> list[int]:
    return [_INDEX.get(c, 26 if c.isdigit() else 27) for c in text.lower()]


def _pieces(texts: pa.Array) -> Iterator[np.ndarray]:
    """The texts' letters as 0 to 25 and anything else as more, in stretches that overlap by two characters."""
    joined = np.frombuffer(b" ".join(text.as_py().encode("utf-8", "surrogatepass") for text in texts if text.is_valid), np.uint8)
    letters = (joined | 32) - np.uint8(97)
    for at in range(0, max(0, len(letters) - 1), STRETCH):
        yield letters[at : at + STRETCH + 2]


def counted(letters: np.ndarray, counts: np.ndarray) -> None:
    """Add to ``counts``: of each two letters that are neighbours (26 * first + second), then of each three."""
    code, known = letters.astype(np.int64), letters < 26
    two, three = slice(0, min(STRETCH, len(code) - 1)), slice(0, min(STRETCH, max(0, len(code) - 2)))
    pair, met = 26 * code[:-1] + code[1:], known[:-1] & known[1:]
    counts[:PAIRS] += np.bincount(pair[two][met[two]], minlength=PAIRS)
    triple, all_met = 26 * pair[:-1] + code[2:], met[:-1] & known[2:]
    counts[PAIRS:] += np.bincount(triple[three][all_met[three]], minlength=26 * PAIRS)


def corpus_counts(docs: DataFrame) -> np.ndarray:
    """``counted`` over every whole text. A task sends a row for each pair and each triple of letters it has met, 18,252 at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(27 * PAIRS, np.int64)
        for batch in batches:
            for letters in _pieces(batch.column("text")):
                counted(letters, counts)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(counts[met])], names=["gram", "n"])

    counts = np.zeros(27 * PAIRS, np.int64)
    texts = docs.select(F.col("text").cast("string").alias("text"))
    for row in texts.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        counts[row["gram"]] = row["n"]
    return counts


class Language:
    """Character transitions and trigrams of plain words."""

    def __init__(self, words: list[str]):
        counts = np.zeros(27 * PAIRS, np.int64)
        for letters in _pieces(pa.array([" ".join(words)])):
            counted(letters, counts)
        self._learn(counts)

    @classmethod
    def of(cls, counts: np.ndarray) -> Language:
        """The language of ``corpus_counts``."""
        made = cls.__new__(cls)
        made._learn(counts)
        return made

    def _learn(self, counts: np.ndarray) -> None:
        table = np.full((28, 28), 0.5)
        table[:26, :26] += counts[:PAIRS].reshape(26, 26)
        self.log = np.log(table / table.sum(axis=1, keepdims=True))
        often = np.argsort(-counts[PAIRS:], kind="stable")[:4000]
        letter = string.ascii_lowercase
        self.grams = frozenset(letter[g // PAIRS] + letter[g // 26 % 26] + letter[g % 26] for g in often.tolist() if counts[PAIRS + g] > 1)

    def transitions(self, text: str) -> float:
        s = _shape(text)
        return float(self.log[s[:-1], s[1:]].mean()) if len(s) > 1 else 0.0

    def coverage(self, text: str) -> float:
        low, covered = text.lower(), bytearray(len(text))
        for i in range(len(low) - 2):
            if low[i : i + 3] in self.grams:
                covered[i : i + 3] = b"\1\1\1"
        return sum(covered) / max(1, len(text))


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of each candidate; a leading "name=" of letters is left out of it."""
    found = []
    for m in _CANDIDATE.finditer(text):
        start, end = m.span()
        cut = text.find("=", start, end)
        if 0 < cut < end - 8 and text[start:cut].replace("_", "").isalpha():
            start = cut + 1
        found.append((start, end))
    return found


def features(text: str, start: int, end: int, source: str | None, language: Language) -> list[float]:
    own = text[start:end]
    n = len(own)
    before = _WORD.findall(text[max(0, start - CONTEXT) : start].lower())[-2:]
    after = _WORD.findall(text[end : end + CONTEXT].lower())[:1]
    upper, lower, digits = sum(c.isupper() for c in own), sum(c.islower() for c in own), sum(c.isdigit() for c in own)
    counts = Counter(own)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    near = text[max(0, start - 3) : start]
    return [
        math.log(end - start),
        language.transitions(own),
        language.coverage(own),
        upper / n,
        lower / n,
        digits / n,
        (n - upper - lower - digits) / n,
        entropy,
        float(all(c in string.hexdigits for c in own)),
        float(any(w in _FOR for w in before)),
        float(any(w in _AGAINST for w in before + after)),
        float("=" in near or ":" in near),
        float(near.endswith(('"', "'"))),
        float(bool(source and _CODE_PATH.search(source))),
        float(bool(source and "/" in source)),
    ]


def _made(rng: random.Random, words: list[str]) -> tuple[str, str, bool]:
    """(text before, finding, whether it is a secret)."""
    pick = lambda letters, n: "".join(rng.choices(letters, k=n))
    alnum, hexa = string.ascii_letters + string.digits, "0123456789abcdef"
    name = rng.choice(("token", "secret", "password", "api_key", "access_key", "auth"))
    word = lambda: re.sub(r"[^A-Za-z]", "", rng.choice(words)) or "word"
    mark = rng.choice(("=", " = ", ": ", '="', ' = "'))
    kind = rng.randrange(13)
    if kind == 0:
        return rng.choice(("", "key ", "aws_access_key_id = ")), "AKIA" + pick(string.ascii_uppercase + string.digits, 16), True
    if kind == 1:
        return f"{name}{mark}", pick(hexa, rng.choice((32, 40, 64))), True
    if kind == 2:
        return f"{name}{mark}", pick(alnum, rng.randrange(16, 48)), True
    if kind == 3:
        return rng.choice(("", "token ", "Bearer ")), rng.choice(("ghp_", "sk_live_", "xoxb-", "glpat-")) + pick(alnum, rng.randrange(20, 40)), True
    if kind == 4:
        return f"{name}{mark}", pick(alnum + "+/", 40), True
    if kind == 5:
        return rng.choice(("sha1 ", "sha256: ", "commit ", "digest ", "checksum = ", "md5 ")), pick(hexa, rng.choice((32, 40, 64))), False
    if kind == 6:
        return rng.choice(("id ", "uuid ", "order ")), "-".join(pick(hexa, n) for n in (8, 4, 4, 4, 12)), False
    if kind == 7:
        return "", "-".join(word() for _ in range(4)), False
    if kind == 8:
        return "see /", "/".join(word() for _ in range(4)), False
    if kind == 9:
        return f"{name}{mark}", rng.choice(("your", "insert", "example")) + "_" + rng.choice(("token", "password", "secret")) + "_here_please", False
    if kind == 10:
        return "", rng.choice("-=_") * rng.randrange(16, 60), False
    if kind == 11:
        return rng.choice(("", "card ", "order ")), pick(string.digits, rng.randrange(16, 20)), False
    return "", "".join(word() for _ in range(4)).lower()[: rng.randrange(16, 40)].ljust(16, "a"), False


def _plain(text: str, language: Language) -> list[list[float]]:
    """Features of the candidates of a text that are words: letters only, and not all upper case."""
    return [features(text, a, b, None, language) for a, b in candidates(text) if text[a:b].isalpha() and not text[a:b].isupper()]


def plain_cells(docs: DataFrame, language: Language) -> tuple[np.ndarray, np.ndarray]:
    """Rounded features of the plain words that are candidates in any whole text, each cell once, and how many have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column("text"):
                if text.is_valid and (found := _plain(text.as_py(), language)):
                    cells.update(row.tobytes() for row in np.rint(np.array(found) / _STEPS).astype("<i4"))
        yield pa.RecordBatch.from_arrays([pa.array(list(cells), pa.binary()), pa.array(list(cells.values()), pa.int64())], names=["cell", "n"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "cell binary, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    rows = sorted((bytes(r["cell"]), r["n"]) for r in found.collect())
    cells = np.frombuffer(b"".join(cell for cell, _ in rows), "<i4").reshape(-1, len(_STEPS))
    return cells * _STEPS, np.array([n for _, n in rows], np.float64)


def labelled(texts: list[str], language: Language, n: int = TRAIN_EACH, seed: int = 3, plain: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and weights of findings: generated ones in sampled surroundings, and plain words.

    ``plain`` has these words' features and numbers, as from ``plain_cells``; without it the texts' own are taken. Together they
    weigh as much as ``n`` findings, or as many as they are.
    """
    rng = random.Random(seed)
    words = [w for t in texts for w in t.split()][:20000] or ["some", "plain", "words"]
    x, y = [], []
    for _ in range(2 * n):
        before, finding, secret = _made(rng, words)
        at = rng.randrange(len(words))
        head = " ".join(words[at : at + 6]) + " " + before
        text = head + finding + rng.choice(('"', "", "!!", "")) + " " + " ".join(words[at + 6 : at + 10])
        x.append(features(text, len(head), len(head) + len(finding), rng.choice((None, "src1", "web/page", "app/config.yml")), language))
        y.append(secret)
    if plain is None:
        own = [f for t in texts for f in _plain(t, language)]
        plain = np.array(own).reshape(-1, len(_STEPS)), np.ones(len(own))
    cells, many = plain
    weights = np.concatenate([np.ones(len(x)), many * min(1.0, n / max(1.0, many.sum()))])
    return np.concatenate([np.array(x), cells]), np.array(y + [False] * len(cells)), weights


def trained(docs: DataFrame) -> tuple[Language, list]:
    counts = corpus_counts(docs)
    language = Language.of(counts) if counts.any() else Language(["plain", "words"])
    x, y, weights = labelled(first_texts(docs, TRAIN_DOCS, TRAIN_CHARS), language, plain=plain_cells(docs, language))
    return language, fit(x, y, weights=weights)


def scan(docs: DataFrame, model: tuple[Language, list], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, start, after_last (code points), score of each finding that the forest keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        language, forest = model
        for batch in batches:
            found, x = [], []
            for doc_id, text, source in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("source").to_pylist(), strict=True):
                text = text.as_py() or ""
                for a, b in candidates(text):
                    found.append((doc_id, a, b))
                    x.append(features(text, a, b, source, language))
            scores = predict(forest, np.array(x)) if x else np.empty(0)
            kept = [(*f, float(s)) for f, s in zip(found, scores, strict=True) if s >= threshold]
            columns = list(zip(*kept, strict=True)) or [()] * 4
            kinds = {"doc_id": pa.int64(), "start": pa.int64(), "after_last": pa.int64(), "score": pa.float64()}
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), source.alias("source"))
    return plain.mapInArrow(run, "doc_id long, start long, after_last long, score double")
