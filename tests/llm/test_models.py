"""Toxicity, personal data and SentencePiece."""

import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import pii, sentencepiece, toxicity

WORDS = [f"{a}{b}{c}" for a in ("ba", "to", "ri", "ne") for b in ("la", "mo", "si") for c in ("", "n", "st", "rek")]


def toxic_table(spark, n=900):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(WORDS, k=rng.randint(5, 60))
        bad = rng.random() < 0.3
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["vilecur", "grotbag"]) + rng.choice(["", "!", "."])
        rows.append((i, " ".join(words), f"clash{i}"))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), labels


def test_toxicity_learns_without_held_out_rows(spark):
    docs, labels = toxic_table(spark)
    # labels of held-out rows are wrong: if they were learnt, accuracy would fall
    shown = [(i, y if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - y) for i, y in labels] + [(0, None), (None, 1), (10**6, 1)]
    net = toxicity.train(docs.select("doc_id", "text"), spark.createDataFrame(shown, "doc_id long, toxic int"))
    scored = {r.doc_id: r for r in toxicity.score(docs, net).collect()}
    assert len(scored) == len(labels) and all(0 <= r.toxicity_score <= 1 for r in scored.values()) and scored[3].score == "clash3"
    held = [(scored[i].toxicity_score >= 0.7, y == 1) for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([a == b for a, b in held]) > 0.97


def test_toxicity_odd_texts_and_too_few_labels(spark):
    docs, labels = toxic_table(spark, 400)
    net = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    texts = [None, "", " \n", "vilecur", "é漢字🙂", "word " * 30_000, "x" * 300_000, "la " * 20_000 + "grotbag", "Vilecur"]
    odd = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r.toxicity_score for r in toxicity.score(odd, net).collect()}
    assert len(rows) == len(texts) and rows[0] == rows[1] == rows[2] and rows[7] > 0.7 and rows[8] == rows[3]
    alone = net.scores(pa.array(["la grotbag", "ba"]))
    assert np.allclose(alone, [net.scores(pa.array([t]))[0] for t in ("la grotbag", "ba")])  # neighbours do not matter
    few = toxicity.train(docs, spark.createDataFrame(labels[:5], "doc_id long, toxic int"))
    assert few is None and {r.toxicity_score for r in toxicity.score(odd, few).collect()} == {0.0}
    assert toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int")) is None
    assert toxicity.score(docs.limit(0), net).count() == 0


def plain_score(net, text):
    """A text's score as the network is defined: window by window, filter by filter."""
    h, p, first = toxicity._hash_both(pa.array([text]))
    x = [net.embed[net.row_of[int(a >> np.uint64(48))]] + net.embed[net.row_of[int(b >> np.uint64(48)) + toxicity.BUCKETS]] for a, b in zip(h, p, strict=True)]
    x += [np.zeros(toxicity.DIM)] * toxicity.PAD
    z = float(net.bias)
    for k, (w, bias) in enumerate(zip(net.filters, net.biases, strict=True)):
        for f in range(toxicity.FILTERS):
            windows = [sum(float(x[i + j] @ w[j][:, f]) for j in range(len(w))) for i in range(len(h) + 1)]
            z += max(max(windows) + float(bias[f]), 0.0) * float(net.out[k * toxicity.FILTERS + f])
    z += np.log(0.7 / 0.3) - net.shift[int(toxicity.guess_language(h, first)[0])]
    return 1 / (1 + np.exp(-z))


def test_the_fit_is_bounded_in_rows_and_words(spark, monkeypatch):
    """One id with many documents, and very long texts, send no more to the driver than the documented bounds."""
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic, *rest: seen.append((len(texts), max(map(len, texts)), len(toxic))))
    many = next(i for i in range(2000) if zlib.crc32(str(i).encode()) % 3 != 1)  # not held out
    docs = spark.range(3000).select(F.when(F.col("id") < 2000, F.lit(many)).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 500 == 0, F.repeat(F.lit("word "), 50_000)).otherwise(F.lit("a b")).alias("text"))
    labels = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    toxicity.train(docs, labels, rows=700)
    assert seen == [(700, toxicity.FIT_WORDS, 700)]
    words, at = toxicity.spread(np.arange(100), np.array([0, 3, 3, 100]), 32)
    assert at.tolist() == [0, 3, 3, 35] and words[:3].tolist() == [0, 1, 2] and words[3] == 3 and words[-1] == 99 and (np.diff(words) > 0).all()


def test_scores_equal_a_plain_forward_pass(spark):
    """Word by word and filter by filter, as the network is defined."""
    docs, labels = toxic_table(spark, 400)
    net = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    rng = random.Random(3)
    texts = ["", "!", *(" ".join(rng.choices([*WORDS, "vilecur", "grotbag", "the", "der", "und"], k=rng.randint(1, 30))) for _ in range(60))]

    assert np.allclose(net.scores(pa.array(texts)), [plain_score(net, t) for t in texts], atol=1e-5)


def test_every_language_has_its_threshold():
    rng = np.random.default_rng(5)
    langs = np.repeat([1, 2, 3, 4], [900, 200, 150, 100])
    y = (rng.random(len(langs)) < 0.06).astype(float)
    y[[900, 1100, 1250]] = 1
    z = 4 * y + rng.normal(0, 1, len(y)) + langs
    shift = toxicity.calibrate(z, y, langs)
    assert len(set(shift[1:].tolist())) == 4 and shift[0] == toxicity._threshold(z, y)
    for k in range(1, 5):  # between its own and that of all, nearer to its own the more toxic rows it has
        own, toxic = toxicity._threshold(z[langs == k], y[langs == k]), y[langs == k].sum()
        assert np.isclose(shift[k], (toxic * own + toxicity.SHRINK * shift[0]) / (toxic + toxicity.SHRINK))
    assert (toxicity.calibrate(z, 0 * y, langs) == 0).all()


BRUTE = [
    (0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m, d: True),
    (1, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m, d: all(int(x) <= 255 for x in m.split("."))),
    (2, r"[0-9]([\x20-]?[0-9])+", lambda m, d: 12 <= len(d) <= 19 and pii.luhn(d)),
    (3, r"\+[0-9][\x20().0-9-]+[0-9]", lambda m, d: 9 <= len(d) <= 15),
]


def brute_spans(text):
    found = []
    for kind, pattern, ok in BRUTE:
        for m in re.finditer(pattern, text):
            if ok(m.group(), re.sub("[^0-9]", "", m.group())):
                found.append((m.start(), kind, m.end()))
    return sorted(found)


def test_base_patterns_equal_the_contract():
    rng = random.Random(6)
    parts = ["a.b", "@", "x-1", ".com", "+", "1", "22", "255", "256", ".", "-", " ", "(", ")", "4111111111111111", "%", "é", "\n", "@@", "+1 (017) 555-7713", "10.0.0.1"]
    for _ in range(8000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert pii.base_spans(text) == brute_spans(text), text


def test_field_keeps_base_spans_and_adds_only_checked_ones(spark):
    rows = [
        (1, "call (017) 555-7713 today, or jo.h[at]example.org instead", ""),
        (2, "card 4111.1111.1111.1111 and host 10.0.0.1:8080 ok", ""),
        (3, "in 1999 there were 24 people and 4,500 words of version 2.0", ""),
        (4, None, ""),
        (5, "", ""),
        (6, "é" * 1000 + " mail a.b@c.de " + "w " * 30_000 + "+1 (843) 555-7672", ""),
        (6, "7536784127813051", ""),
    ]
    got = [(r.doc_id, r.spans, r.redacted) for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()]
    by = {d: (s, t) for d, s, t in got if d != 6}
    assert by[1][0].startswith("phone:5:19,email:") and "<PHONE>" in by[1][1] and "<EMAIL>" in by[1][1]
    assert by[2][0].startswith("card:5:24,ip:") and by[3] == ("", rows[2][1]) and by[4] == by[5] == ("", "")
    six = sorted(s for d, s, _ in got if d == 6)
    assert six[0] == "" and six[1] == "email:1006:1014,phone:61015:61032"
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def luhn_number(rng, prefix="4", size=16):
    digits = prefix + "".join(rng.choices("0123456789", k=size - len(prefix) - 1))
    return next(digits + c for c in "0123456789" if pii.luhn(digits + c))


def held_out_lines(rng, n):
    """Sentences that the training table does not have, with what the patterns miss, and numbers that are no personal data."""
    words = "we met them near old bridge after lunch while rain fell over quiet fields and nobody asked why".split()
    prose = lambda k: " ".join(rng.choices(words, k=k))
    d = lambda k: "".join(rng.choices("0123456789", k=k))
    name = lambda: "".join(rng.choices("abcdefgh", k=5))
    found = [
        ("phone", lambda: f"({d(3)}) {d(3)}-{d(4)}"), ("phone", lambda: f"0{d(2)} {d(4)} {d(4)}"), ("phone", lambda: f"{d(3)}-{d(3)}-{d(4)}"),
        ("email", lambda: f"{name()}(at){name()}.org"), ("email", lambda: f"{name()}.{name()}[at]{name()}.example.net"), ("email", lambda: f"{name()}@localhost"),
        ("ip", lambda: f"10.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}:{d(4)}"),
        ("card", lambda: (lambda c: f"{c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:]}")(luhn_number(rng))),
    ]
    nothing = [lambda: f"19{d(2)}", lambda: f"{rng.randint(2, 99)},{d(3)}", lambda: f"20{d(2)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", lambda: f"v{rng.randint(1, 9)}.{d(1)}.{d(2)}", lambda: f"{rng.randint(1, 99)}%", lambda: f"#{d(3)}", lambda: "".join(rng.choices("0123456789abcdef", k=24))]
    for i in range(n):
        kind, make = rng.choice(found) if i % 2 else (None, rng.choice(nothing))
        before, body = prose(rng.randint(2, 6)), make()
        yield f"{before} {body} {prose(rng.randint(2, 6))}", kind and (kind, len(before) + 1, len(before) + 1 + len(body))


def test_field_on_held_out_lines(spark):
    """Precision and recall of what the field adds, on lines that it was not trained on."""
    lines = list(held_out_lines(random.Random(9), 600))
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(lines)], "doc_id long, text string")
    got = {r.doc_id: {(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)} for r in pii.find_pii(rows).collect()}
    names = {i: {(pii.KINDS[k], a, b) for a, k, b in pii.base_spans(t)} for i, (t, _) in enumerate(lines)}
    overlap = lambda x, y: x[0] == y[0] and x[1] < y[2] and y[1] < x[2]
    added = {i: got[i] - names[i] for i in got}
    hits = sum(any(overlap(x, want) for x in got[i]) for i, (_, want) in enumerate(lines) if want)
    right = sum(bool(lines[i][1]) and overlap(x, lines[i][1]) for i, xs in added.items() for x in xs)
    total = sum(map(len, added.values()))
    assert hits >= 0.9 * sum(bool(w) for _, w in lines) and right >= 0.95 * total > 0, (hits, right, total)


def test_viterbi_is_the_best_of_all_labelings():
    from itertools import product

    field = pii.train_field(rounds=40)
    rng = np.random.default_rng(0)
    ids = rng.choice(np.flatnonzero(~pii.plain_shapes()), (6, 4))
    for chain, best in zip(ids, pii.viterbi(field, ids), strict=True):
        def score(labels, chain=chain):
            s = field.begin[labels[0]] + field.finish[labels[-1]] + sum(field.emit[c, k] for c, k in zip(chain, labels, strict=True))
            return s + sum(field.move[a, b] for a, b in zip(labels, labels[1:], strict=False))

        top = max(score(x) for x in product(range(len(pii.LABELS)), repeat=4))
        assert abs(score(tuple(best)) - top) < 1e-9


model_file = pytest.mark.skipif(not os.path.exists(sentencepiece.default_model()), reason="no tokenizer files here")


def hostile_texts(model, n=400):
    rng = random.Random(1)
    alphabet = "ab cdeEth in  \n\t.éèß漢字🙂'\"0123▁"
    pieces = [p.replace("▁", " ") for p in model.pieces if len(p) > 2]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(n)] + ["".join(rng.choices(pieces, k=rng.randint(1, 12))) for _ in range(n)]
    return [*texts, "", "   ", " a", "a ", "a" * 700, " " * 120, "漢字" * 300, "antidisestablishmentarianism " * 3, None]


@model_file
def test_bpe_ids_equal_the_library():
    import sentencepiece as library

    with open(sentencepiece.default_model(), "rb") as file:
        model = sentencepiece.Model.load(file.read())
    texts = hostile_texts(model)
    ids, at = sentencepiece.Encoder(model).encode(pa.array(texts))
    expected = library.SentencePieceProcessor(model_file=sentencepiece.default_model()).encode([t or "" for t in texts], num_threads=1)
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == expected
    assert all(sentencepiece.decode(model, ids[at[i] : at[i + 1]]) == (t or "").replace("▁", " ") for i, t in enumerate(texts))


@model_file
def test_unbroken_words_equal_the_library():
    import sentencepiece as library

    with open(sentencepiece.default_model(), "rb") as file:
        model = sentencepiece.Model.load(file.read())
    library_model = library.SentencePieceProcessor(model_file=sentencepiece.default_model())
    rng = random.Random(4)
    words = ["a" * 20_001, "ab" * 11_000, "xyz" * 9_001, "é漢" * 9_000, "".join(rng.choices("abcdefgh", k=30_000)), "".join(rng.choices("etaoinshr", k=50_000)), "=" * 16_400]
    words += [f"short {w} and é {w[:17_000]}" for w in words]
    ids, at = sentencepiece.Encoder(model).encode(pa.array(words))
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(words))] == library_model.encode(words, num_threads=1)
    for _ in range(300):
        text = "▁" + "".join(rng.choices("abcde ths漢".replace(" ", ""), k=rng.randint(1, 60)))
        chars = np.array([ord(c) for c in text], dtype=np.uint32)
        assert sentencepiece.decode_alone(model, chars, block=7).tolist() == sentencepiece._ids(model, chars[None])[0].tolist()


def unigram_model(with_bytes):
    """A model file made by hand: the library's format, scores of our own."""
    import struct

    def number(n):
        out = b""
        while True:
            out += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    field = lambda k, v: number(k << 3 | 2) + number(len(v)) + v
    rng = random.Random(2)
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if with_bytes else []
    words = {"▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "cab", "▁▁", "aa", "aaa", "é", "▁é", "ca", "▁c"}
    pieces += [(w, float(-rng.randint(1, 12)), 1) for w in sorted(words)]
    raw = b"".join(field(1, field(1, p.encode()) + number(2 << 3 | 5) + struct.pack("<f", s) + number(3 << 3) + number(k)) for p, s, k in pieces)
    trainer = number(3 << 3) + number(1) + (number(35 << 3) + number(1) if with_bytes else b"")
    return raw + field(2, trainer) + field(3, field(1, b"identity") + number(3 << 3) + number(1) + number(4 << 3) + number(0))


@pytest.mark.parametrize("with_bytes", [True, False])
def test_unigram_ids_equal_the_library(with_bytes):
    import sentencepiece as library

    raw = unigram_model(with_bytes)
    model = sentencepiece.Model.load(raw)
    rng = random.Random(3)
    texts = ["".join(rng.choices("abc é x漢  ", k=rng.randint(0, 90))) for _ in range(600)]
    ids, at = sentencepiece.Encoder(model).encode(pa.array(texts))
    expected = library.SentencePieceProcessor(model_proto=raw).encode(texts, num_threads=1)
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == expected
    for text in texts:
        if text:
            chars = np.array([ord(c) for c in text.replace(" ", "▁")], dtype=np.uint32)
            assert sentencepiece.decode_alone(model, chars, block=5).tolist() == sentencepiece._ids(model, chars[None])[0].tolist()


@model_file
def test_encoding_a_table(spark):
    rows = [(1, "Hello, world", 5), (1, "Hello, world", 5), (2, None, 5), (3, "", 5), (4, "no\nspace" * 20_000, 5), (None, "x", 5)]
    df = sentencepiece.encode_texts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), sentencepiece.default_model())
    got = df.collect()
    assert len(got) == 6 and all(r.round_trip and r.n_tokens == len(r.token_ids) for r in got)
    assert [r.n_tokens for r in got if r.doc_id in (2, 3)] == [0, 0]
    assert df.limit(0).count() == 0
