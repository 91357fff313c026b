"""Personal data: patterns with checks, and a character-level BiLSTM-CRF that adds spans to theirs.

Base spans are found by pattern over the whole text, leftmost and without overlap per kind, and checked (parts of an
address, Luhn digits, number of digits); a match that fails its check is dropped without another try.

The model is trained in numpy from labelled spans: a bounded sample of ``TRAIN_DOCS`` documents (first by a hash of
doc_id, ``TRAIN_CHARS`` characters of each) gives the surrounding text, into which labelled spans of every kind and
unlabelled look-alikes (versions, dates, hexadecimal and order numbers) are set by a seeded generator. A text is decoded in windows
of ``WINDOW`` characters that overlap by half. Windows without a digit and without "@" hold no span by the
definition of the kinds, so they need no decoding. Each character takes its tag from the window in which it lies
furthest from an edge; the spans of the joined tags are added where they pass ``_plausible`` and touch no base span.

Defined results: null text counts as empty; an empty text has no spans. Repeated rows are searched one by one. A span may be anywhere
in a text of any length. An empty table trains on generated text alone and gives an empty result. Other columns are
not read.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueloom.llm.memory import tidy
from cueloom.llm.pii_model import KINDS, decode, symbols, train
from cueloom.llm.sampling import first_texts

Span = tuple[str, int, int]

WINDOW = 96
DECODE_WINDOWS = 1024
TRAIN_DOCS = 200
TRAIN_CHARS = 4000
TRAIN_WINDOWS = 4000

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits is entered at its first digit only: what follows the run decides, wherever in it a match began.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")


def _digits(text: str) -> list[int]:
    return [ord(c) - 48 for c in text if "0" <= c <= "9"]


def luhn(digits: list[int]) -> bool:
    doubled = [d * 2 - 9 * (d > 4) for d in digits[-2::-2]]
    return (sum(doubled) + sum(digits[::-2])) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            end = domain.end()
            yield "email", start, end
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) by kind and start."""
    found: list[Span] = []
    if _TRIGGER.search(text):
        found += _emails(text)
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p[-3:]) < 256 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 16 <= m.end() - m.start() and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                found.append(("card", *m.span()))
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


def _plausible(kind: str, text: str) -> bool:
    """What every added span must look like."""
    n = len(_digits(text))
    if kind == "email":
        return text.count("@") == 1 and 0 < text.index("@") < len(text) - 3 and "." in text[text.index("@") :]
    if kind == "ip":
        return text.count(".") == 3 and n == len(text) - 3 and all(p and len(p) < 4 and int(p) < 256 for p in text.split("."))
    if kind == "card":
        d = _digits(text)
        return 13 <= n <= 19 and luhn(d) and not text.strip("0123456789 -.")
    return 9 <= n <= 15 and not text.strip("+0123456789 ().-") and any(c in text for c in " ().-")


# --- Training data ---------------------------------------------------------------------------------------------


def _card(rng: random.Random) -> str:
    d = [rng.choice((3, 4, 5, 6))] + [rng.randrange(10) for _ in range(14)]
    d.append(next(c for c in range(10) if luhn([*d, c])))
    s = "".join(map(str, d))
    gap = rng.choice(("", "", " ", "-", ".", "."))
    return gap.join(s[i : i + 4] for i in range(0, 16, 4))


def _phone(rng: random.Random) -> str:
    n = [rng.randrange(200, 1000), rng.randrange(200, 1000), rng.randrange(10000)]
    shape = rng.choice(("+1 ({}) {}-{:04}", *("({}) {}-{:04}", "{}-{}-{:04}", "{}.{}.{:04}") * 2, "+44 {} {} {:04}"))
    return shape.format(*n)


def _email(rng: random.Random, word: str) -> str:
    name = "".join(c for c in word.lower() if "a" <= c <= "z") or "me"
    return f"{name}{rng.choice(('', '.', '_', '-'))}{rng.choice(('', rng.randrange(100)))}@mail{rng.randrange(9)}.{rng.choice(('example', 'site'))}.{rng.choice(('com', 'org', 'net'))}"


def _ip(rng: random.Random) -> str:
    return ".".join(str(rng.randrange(1, 256)) for _ in range(4))


def _lookalike(rng: random.Random) -> str:
    return rng.choice((
        f"{rng.randrange(9)}.{rng.randrange(9)}",
        f"{rng.randrange(9)}.{rng.randrange(20)}.{rng.randrange(30)}",
        f"{rng.randrange(1900, 2100)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}",
        f"{rng.randrange(24):02}:{rng.randrange(60):02}:{rng.randrange(60):02}",
        f'"{rng.getrandbits(160):040x}"',
        str(rng.randrange(10 ** rng.randrange(1, 12))),
        f"{rng.randrange(1000)},{rng.randrange(1000):03}",
        f"§ {rng.randrange(100)}",
        "@" + rng.choice(("home", "name", "all")),
    ))


def labelled_windows(texts: list[str], n: int = TRAIN_WINDOWS, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Symbol windows and tags: text around generated spans and look-alikes."""
    rng = random.Random(seed)
    words = [w for t in texts for w in t.split(" ") if w and not _TRIGGER.search(w)] or ["some", "plain", "words."]
    xs, ys = np.empty((n, WINDOW), np.int16), np.zeros((n, WINDOW), np.int8)
    for i in range(n):
        before, text = rng.randrange(WINDOW - 8), ""
        at = rng.randrange(len(words))
        marks: list[tuple[int, int, int]] = []
        while len(text) < before + WINDOW:
            word = words[at % len(words)]
            at += 1
            if rng.random() < 0.14:
                kind = rng.randrange(len(KINDS) + 2)
                made = (_email(rng, word), _ip(rng), _card(rng), _phone(rng), _lookalike(rng), _lookalike(rng))[kind]
                if kind < len(KINDS):
                    marks.append((kind, len(text), len(text) + len(made)))
                word = made + rng.choice(("", "", "", ".", ",", "!!", "$$$"))
            text += word + " "
        xs[i] = symbols(text[before : before + WINDOW])
        for kind, start, end in marks:
            # A span that the window cuts is only labelled where its begin is inside.
            for j in range(start, end):
                if before <= start and j < before + WINDOW:
                    ys[i, j - before] = (1 if j == start else 2) + 2 * kind
    return xs, ys


def trained(docs: DataFrame) -> dict[str, np.ndarray]:
    """The model, from a bounded sample of ``docs``."""
    return train(*labelled_windows(first_texts(docs, TRAIN_DOCS, TRAIN_CHARS)))


# --- Search ----------------------------------------------------------------------------------------------------


def _windows(text: str) -> list[int]:
    """Starts of the overlapping windows that hold a digit or "@"."""
    half = WINDOW // 2
    last = max(0, -(-(len(text) - WINDOW) // half)) * half
    near = {m.start() // half * half for m in _TRIGGER.finditer(text)}
    return sorted({s for n in near for s in (n, n - half) if 0 <= s <= last} | {last for n in near if n > last})


def _joined(text: str, starts: list[int], tags: np.ndarray) -> list[Span]:
    """Spans of the tags of overlapping windows: each character's tag comes from the window it is most central in."""
    found: list[Span] = []
    half = WINDOW // 2
    i = 0
    while i < len(starts):
        j = i
        while j + 1 < len(starts) and starts[j + 1] - starts[j] <= half:
            j += 1
        begin = starts[i]
        line = np.zeros(starts[j] - begin + WINDOW, np.int8)
        for k in range(i, j + 1):
            left = starts[k] - begin + (half // 2 if k > i else 0)
            line[left : starts[k] - begin + WINDOW] = tags[k][left - starts[k] + begin :]
        line = line[: len(text) - begin]
        kinds = (line + 1) // 2
        edges = np.flatnonzero((np.diff(kinds, prepend=0) != 0) | ((line % 2 == 1) & (kinds > 0)))
        for a, b in zip(edges, [*edges[1:], len(line)], strict=False):
            if kinds[a]:
                found.append((KINDS[kinds[a] - 1], begin + int(a), begin + int(b)))
        i = j + 1
    return found


def added_spans(texts: list[str], base: list[list[Span]], model: dict[str, np.ndarray]) -> list[list[Span]]:
    """For each text the spans that the model adds to its base spans."""
    starts = [_windows(t) for t in texts]
    flat = [(i, s) for i, own in enumerate(starts) for s in own]
    tags: list[list[np.ndarray]] = [[] for _ in texts]
    for at in range(0, len(flat), DECODE_WINDOWS):
        part = flat[at : at + DECODE_WINDOWS]
        x = np.full((len(part), WINDOW), 32, np.int16)
        for row, (i, s) in enumerate(part):
            own = symbols(texts[i][s : s + WINDOW])
            x[row, : len(own)] = own
        for (i, _), best in zip(part, decode(model, x), strict=True):
            tags[i].append(best)
    found = []
    for text, own, best, known in zip(texts, starts, tags, base, strict=True):
        taken = sorted((a, b) for _, a, b in known)
        found.append([s for s in _joined(text, own, best) if _plausible(s[0], text[s[1] : s[2]]) and not any(a < s[2] and s[1] < b for a, b in taken)])
    return found


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _text_columns(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def find(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, counts of base spans, base_sha256, spans and n_added for each row of ``docs``."""
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _text_columns(batch)
            base = [in_order(base_spans(t)) for t in texts]
            more = added_spans(texts, base, model)
            counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in KINDS]
            digests = pa.array([hashlib.sha256(_written(b).encode()).hexdigest() for b in base], pa.string())
            spans = pa.array([_written(in_order(b + m)) for b, m in zip(base, more, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, digests, spans, pa.array([len(m) for m in more], pa.int64())], names=names)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long")


def redacted(text: str, spans: list[Span]) -> str:
    """``text`` with each span, or each joined group of overlapping spans, replaced by its kind in brackets."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; ``n_chars``, where there is one, counts the new text."""
    columns = docs.columns

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _text_columns(batch)
            base = [base_spans(t) for t in texts]
            new = [redacted(t, b + m) for t, b, m in zip(texts, base, added_spans(texts, base, model), strict=True)]
            there = batch.column("text").is_valid().to_pylist()
            put = pa.array([t if ok else None for t, ok in zip(new, there, strict=True)], batch.schema.field("text").type)
            yield pa.RecordBatch.from_arrays([put if c == "text" else batch.column(c) for c in columns], names=columns)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out
