"""Personal data: exact patterns, and a linear-chain conditional random field over word shapes.

The patterns find e-mail addresses, IPv4 addresses, card and phone numbers. The field reads the whole text as words,
each described by its shape (first character, digits, dots, dashes, letters, ``@`` and whether its digits pass Luhn),
and labels words that the patterns miss: numbers without a country code, addresses with other separators. It is trained
on a small labelled table by gradient ascent on the exact log likelihood, and decoded by Viterbi in numpy batches.

Batches stay short without losing exactness: a word without a digit or ``@`` has "other" as its only label, in training
and in decoding, so it splits a chain in two that do not depend on each other; what lies between such words is decoded,
chains of one length together. Field spans must pass the same digit checks as the patterns, and spans of the patterns always stay.

Defined cases: a null text is empty and has no spans; texts are read whole; repeated rows give repeated results; an
empty table gives an empty result; other columns are not read. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.words import chunks, split_words
from millrace.session import bounded_batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, kind, end

# Fixed values of the contract. Possessive repeats match the same text: what follows each never starts inside it.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and (not part or int(part) <= 255)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and domain: a local part is the run before an @ since the last match."""
    done = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            done = m.end()


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by start, then kind."""
    out: list[Span] = []
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(map(_octet, m.group().split("."))):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = NOT_DIGITS.sub("", m.group())
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(NOT_DIGITS.sub("", m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


# ---- the field ----

IMPOSSIBLE = -1e4
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Small labelled table: words, and the label of each word as the kind's initial (capital where a span begins).
TRAINING = """
call (017) 555-7713 today	o Ph ph o
call me at (974) 555-3436 please	o o o Ph ph o
phone: 555-123-4567	o Ph
my number is 020 7946 0958 now	o o o Ph ph ph o
reach us on 0171-555-0199 or by post	o o o Ph o o o
tel 030/901820 office	o Ph o
fax (089) 1234 5678 open	o Ph ph ph o
write to anna(at)mail.example.com soon	o o Em o
write to jo.h[at]example.org soon	o o Em o
mail bob@localhost or ask	o Em o o
host 10.0.0.1:8080 is up	o Ip o o
net 192.168.0.0/16 is private	o Ip o o
card 4111.1111.1111.1111 was used	o Ca o o
card 5500-0000-0000-0004 was used	o Ca o o
in 1999 there were 24 people	o o o o o o
the year 2024 ended on 31 december	o o o o o o o
page 12 of 300 and 4,500 words	o o o o o o o
version 2.0 of 1.4.2 costs 19.99 dollars	o o o o o o o
order 4952935900253051 was sent	o o o o
token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda" here	o o o o
id 908038b7daaf91e1 and 7536784127813051 end	o o o o o
on 2024-01-31 at 10:30 we met	o o o o o o
from 1987/05/09 until 03-11-2026 it rained	o o o o o o
chapter 3 (12) and 5 (2001) follow	o o o o o o o
see @someone and #tag and a+b	o o o o o o
1 2 3 4 5 6	o o o o o o
10 000 000 people in 50 states	o o o o o o o
license cc by-nc 4.0 applies	o o o o o
words and more words without any number at all	o o o o o o o o o
another sentence, with commas. and stops!	o o o o o o
ratio 3:1 at 45.5% and -12 degrees	o o o o o o o
""".strip()

#: Bytes by class: digits, dots, dashes, letters (with all bytes of other scripts), @ and its spellings.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[48:58] = 1
_CLASS[ord(".")] = 2
_CLASS[[ord("-"), ord("/")]] = 3
_CLASS[65:91] = _CLASS[97:123] = 4
_CLASS[128:] = 4
_CLASS[ord("@")] = 5
_CLASS[[ord("("), ord("[")]] = 6
_CLASS[ord("+")] = 7
#: Sizes of the features: first character, digits, dots, dashes, letters, @, brackets, Luhn.
SIZES = (5, 9, 3, 3, 2, 2, 2, 2)
#: Classes of digit counts: dates have up to 8, phone numbers mostly more, cards 12 to 19.
_DIGITS = np.array([0, 1, 1, 2, 3, 4, 4, 5, 5, 6, 6, 6, 7, 7, 7, 7, 7, 7, 7, 7, 8])


def shapes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Features of every word: a row of indices below :data:`SIZES`."""
    kind = _CLASS[data]
    marked = np.flatnonzero((kind != 4) & (kind != 0))
    # words of letters and other marks alone are the most; the rest is counted at its few marked bytes
    lo, hi = np.searchsorted(marked, start), np.searchsorted(marked, end)
    out = np.zeros((len(start), len(SIZES)), dtype=np.int64)
    first = kind[start] if len(start) else np.zeros(0, np.uint8)
    out[:, 0] = np.select([first == 1, first == 6, first == 7, first == 4], [1, 2, 3, 4], 0)
    out[:, 4] = 1
    some = np.flatnonzero(hi > lo)
    counts = np.zeros((8, len(some)), dtype=np.int64)
    for c in (1, 2, 3, 5, 6):
        upto = np.concatenate([[0], np.cumsum(kind[marked] == c)])
        counts[c] = upto[hi[some]] - upto[lo[some]]
    out[some, 1] = _DIGITS[np.minimum(counts[1], len(_DIGITS) - 1)]
    out[some, 2] = np.minimum(counts[2], 3) // 2 + (counts[2] == 1)
    out[some, 3] = np.minimum(counts[3], 2)
    length = (end - start)[some]
    plain = counts[1] + counts[2] + counts[3] + counts[5] + counts[6]
    out[some, 4] = np.array([bool((kind[s:e] == 4).any()) for s, e in zip(start[some], end[some], strict=True)], dtype=np.int64) if len(some) else 0
    out[some, 5] = counts[5] > 0
    out[some, 6] = counts[6] > 0
    for i in np.flatnonzero((counts[1] >= 12) & (counts[1] <= 19) & (plain == length)):
        s, e = start[some[i]], end[some[i]]
        out[some[i], 7] = luhn("".join(chr(b) for b in data[s:e] if 48 <= b < 58))
    # spellings of @ in brackets count as @
    for i in np.flatnonzero((counts[6] > 0) & (counts[5] == 0)):
        word = data[start[some[i]] : end[some[i]]].tobytes()
        out[some[i], 5] = b"(at)" in word or b"[at]" in word
    return out


def shape_ids(features: np.ndarray) -> np.ndarray:
    return np.ravel_multi_index(features.T, SIZES) if len(features) else np.zeros(0, np.int64)


@dataclass
class Field:
    """Scores of labels by shape, of label pairs, and of a chain's first and last label."""

    emit: np.ndarray
    move: np.ndarray
    begin: np.ndarray
    finish: np.ndarray


def plain_shapes() -> np.ndarray:
    """Shapes without a digit and without an @ in any spelling: the field's only label for them is "other"."""
    grid = np.indices(SIZES).reshape(len(SIZES), -1)
    return (grid[1] == 0) & (grid[5] == 0)


def _training_rows() -> list[tuple[np.ndarray, np.ndarray]]:
    rows = []
    for line in TRAINING.split("\n"):
        text, marks = line.split("\t")
        words = split_words(pa.array([text]))
        labels = []
        for m in marks.split():
            kind = {"em": 0, "ip": 1, "ca": 2, "ph": 3}.get(m.lower())
            labels.append(0 if kind is None else 1 + 2 * kind + (not m[0].isupper()))
        features = shapes(words.data, words.start, words.end)
        assert len(features) == len(labels), line
        rows.append((features, np.array(labels)))
    return rows


def train_field(rounds: int = 300, rate: float = 0.5, decay: float = 0.002) -> Field:
    """Maximum likelihood by forward and backward sums over the labelled table."""
    rows, k, plain = _training_rows(), len(LABELS), plain_shapes()
    base = np.concatenate([[0], np.cumsum(SIZES)[:-1]])
    total = int(sum(SIZES))
    weight, move, begin, finish = np.zeros((total, k)), np.zeros((k, k)), np.zeros(k), np.zeros(k)
    slow = [np.zeros_like(x) for x in (weight, move, begin, finish)]
    lse = lambda x, axis: np.log(np.exp(x - x.max(axis=axis, keepdims=True)).sum(axis=axis)) + x.max(axis=axis)
    for _ in range(rounds):
        grads = [-decay * x for x in (weight, move, begin, finish)]
        for features, labels in rows:
            cols = features + base
            emit = weight[cols].sum(axis=1)
            emit[plain[shape_ids(features)], 1:] = IMPOSSIBLE
            n = len(labels)
            ahead, back = np.zeros((n, k)), np.zeros((n, k))
            ahead[0] = begin + emit[0]
            for t in range(1, n):
                ahead[t] = lse(ahead[t - 1][:, None] + move, 0) + emit[t]
            back[-1] = finish
            for t in range(n - 2, -1, -1):
                back[t] = lse(move + (emit[t + 1] + back[t + 1])[None], 1)
            z = lse(ahead[-1] + finish, 0)
            p = -np.exp(ahead + back - z)
            p[np.arange(n), labels] += 1
            for f in range(cols.shape[1]):
                np.add.at(grads[0], cols[:, f], p)
            for t in range(n - 1):
                grads[1] -= np.exp(ahead[t][:, None] + move + (emit[t + 1] + back[t + 1])[None] - z)
                grads[1][labels[t], labels[t + 1]] += 1
            grads[2] += p[0]
            grads[3] += p[-1]
        for x, g, s in zip((weight, move, begin, finish), grads, slow, strict=True):
            s += g**2
            x += rate * g / (np.sqrt(s) + 1e-9)
    grid = np.indices(SIZES).reshape(len(SIZES), -1).T + base
    emit = weight[grid].sum(axis=1)
    emit[plain, 1:] = IMPOSSIBLE
    return Field(emit, move, begin, finish)


def viterbi(field: Field, ids: np.ndarray) -> np.ndarray:
    """Best labels of chains of one length: ``ids`` has a chain's shapes in each row."""
    count, n = ids.shape
    score = field.begin + field.emit[ids[:, 0]]
    back = np.zeros((n, count, len(LABELS)), dtype=np.int8)
    for t in range(1, n):
        options = score[:, :, None] + field.move[None]
        back[t] = options.argmax(axis=1)
        score = options.max(axis=1) + field.emit[ids[:, t]]
    labels = np.zeros((count, n), dtype=np.int64)
    labels[:, -1] = (score + field.finish).argmax(axis=1)
    for t in range(n - 1, 0, -1):
        labels[:, t - 1] = back[t][np.arange(count), labels[:, t]]
    return labels


def decode(field: Field, certain: np.ndarray, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words not labelled "other" and their labels; ``first`` gives each text's words."""
    open_ = ~certain[ids]
    # a chain keeps one certain word on either side where there is one: it is "other", and transitions meet it
    near = open_.copy()
    near[:-1] |= open_[1:]
    near[1:] |= open_[:-1]
    spot = np.flatnonzero(near)
    text = np.searchsorted(first, spot, side="right")
    cut = np.flatnonzero((np.diff(spot) > 1) | (np.diff(text) > 0)) + 1
    begin = np.concatenate([[0], cut]).astype(np.int64)
    size = np.diff(np.concatenate([begin, [len(spot)]]))
    found, labels = [], []
    for n in np.unique(size[size > 0]):
        rows = begin[size == n]
        step = max(1, (1 << 16) // int(n))
        for lo in range(0, len(rows), step):
            words = spot[rows[lo : lo + step, None] + np.arange(n)]
            best = viterbi(field, ids[words])
            mark = best > 0
            found.append(words[mark])
            labels.append(best[mark])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found, labels = np.concatenate(found), np.concatenate(labels)
    order = np.argsort(found)
    return found[order], labels[order]


@cache
def _field() -> tuple[Field, np.ndarray]:
    field = train_field()
    return field, plain_shapes()


def _passes(kind: int, text: str) -> bool:
    digits = NOT_DIGITS.sub("", text)
    if kind == 0:
        return ("@" in text or "(at)" in text or "[at]" in text) and len(text) >= 5
    if kind == 1:
        parts = re.findall(r"[0-9]+", text)[:4]
        return len(parts) == 4 and all(map(_octet, parts))
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 7 <= len(digits) <= 15


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a] in ".,;:!?\"'#$%&*|<>":
        a += 1
    while a < b and text[b - 1] in ".,;:!?\"'#$%&*|<>":
        b -= 1
    return a, b


def find_spans(texts: pa.Array, field: Field, certain: np.ndarray) -> list[tuple[list[Span], list[Span]]]:
    """For every text its pattern spans and the spans that the field adds."""
    words = split_words(texts)
    found, labels = decode(field, certain, shape_ids(shapes(words.data, words.start, words.end)), words.first)
    owner = np.searchsorted(words.first, found, side="right") - 1
    at = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for i, text in enumerate(texts.fill_null("").to_pylist()):
        base = base_spans(text)
        more: list[Span] = []
        if at[i + 1] > at[i]:
            origin = int(words.offsets[i])
            runs: list[list[int]] = []  # kind, first word, last word
            for w, label in zip(found[at[i] : at[i + 1]].tolist(), labels[at[i] : at[i + 1]].tolist(), strict=True):
                kind, inner = (label - 1) // 2, (label - 1) % 2
                if inner and runs and runs[-1][0] == kind and runs[-1][2] == w - 1:
                    runs[-1][2] = w
                else:
                    runs.append([kind, w, w])
            raw = text.encode()
            for kind, lo, hi in runs:
                a = len(raw[: int(words.start[lo]) - origin].decode())
                b = a + len(raw[int(words.start[lo]) - origin : int(words.end[hi]) - origin].decode())
                a, b = _trim(text, a, b)
                if _passes(kind, text[a:b]) and not any(a < e and s < b for s, _, e in base):
                    more.append((a, kind, b))
        out.append((base, more))
    return out


def spans_text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def redact(text: str, spans: list[Span]) -> str:
    """``text`` with spans replaced by their kind in angle brackets; of overlapping spans the first gives the kind."""
    out, at = [], 0
    for a, k, b in sorted(spans):
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


RESULT = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, redacted string"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Counts, spans and the redacted text of every row of ``docs``."""
    bounded_batches(docs.sparkSession)
    field, certain = _field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1):
            texts = batch.column(1)
            found = find_spans(texts, field, certain)
            counts = [[sum(k == kind for _, k, _ in base) for base, _ in found] for kind in range(len(KINDS))]
            digests = [hashlib.sha256(spans_text(base).encode()).hexdigest() for base, _ in found]
            everything = [spans_text(base + more) for base, more in found]
            safe = [redact(t or "", base + more) for t, (base, more) in zip(texts.to_pylist(), found, strict=True)] if with_text else [None] * len(found)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array(c, pa.int64()) for c in counts),
                    pa.array(digests, pa.string()),
                    pa.array(everything, pa.string()),
                    pa.array([len(more) for _, more in found], pa.int64()),
                    pa.array(safe, pa.string()),
                ],
                names=["id", *(x.split()[0] for x in RESULT.split(", "))],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, {RESULT}").withColumnRenamed("id", id_col)


def op9_pii(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of :func:`find_pii` over all ``documents``."""
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
