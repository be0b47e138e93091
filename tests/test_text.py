"""Column functions against plain Python on hostile strings."""

import difflib
import json
import re

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as X


def apply(spark, fn, values, schema="v string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r.o for r in rows.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


TEXTS = ["", "  A  b\t\nC ", "Don’t “quote” – or — dash", "**Bold** _x_ | y #1", "a<br>b<BR/>c&lt;br&gt;d", "e--f---g", "ÄÖ ß ÉÈ", None]


def test_normalisers(spark):
    assert apply(spark, X.norm_key, TEXTS)[1] == "a b c"
    assert apply(spark, X.norm_visible, TEXTS)[2:5] == ["don't \"quote\" - or - dash", "bold x y 1", "a b c d"]
    assert apply(spark, X.fold, ["e--f---g — h"]) == ["e-f-g - h"]
    assert apply(spark, X.norm_words, ["Ä-b_c, 1!"]) == ["ä b_c 1"]
    assert apply(spark, X.norm_key, [None]) == [None]


@pytest.mark.parametrize(
    ("token", "expected"), [('"IP-TR-1-014.pdf"', "ip-tr-1-014"), ("dir/sub\\Name.PDF", "name"), ("**Doc  Title**", "doc title"), ("", ""), ("_x_", "x")]
)
def test_document_tokens(spark, token, expected):
    assert apply(spark, X.norm_doc, [token]) == [expected]


def test_citations(spark):
    text = "See [Acme, Policy, Section B2, p.4] and ['Acme', \"Guide, 7, p 12, point 5] but not [a, b] or [x, y, z, p.]."
    [found] = apply(spark, X.citations, [text])
    assert [(c.insurer, c.doc, c.section, c.page) for c in found] == [(m[0].strip(), m[1].strip(), m[2].strip(), int(m[3])) for m in re.findall(X.CITATION, text)]
    assert apply(spark, X.count_citations, [text, "none"]) == [len(found), 0]
    assert "[Acme" not in apply(spark, X.strip_citations, [text])[0]


def test_reasoning_and_final_answers(spark):
    raw = ["<think>a</think>\n answer", "before <think>open", "x<think>1</think>y<think>2", "plain"]
    assert apply(spark, X.strip_reasoning, raw) == ["answer", "before", "xy", "plain"]
    [a, b, c, d] = apply(spark, lambda v: X.final_answer(v, F.lit(True)), ["r</think> done", "never closed", "</think>", "a</think>b</think> c"])
    assert (a.answer, a.truncated) == ("done", False) and (b.answer, b.truncated, b.present) == ("", True, False) and not c.present and d.answer == "c"


@pytest.mark.parametrize(
    ("line", "expected"),
    [
        ("## Section B2 — Baggage", ("B2", "Baggage")),
        ("Section 3: What is covered", ("3", "What is covered")),
        ("**General conditions**", ("General conditions", "General conditions")),
        ("# Making a claim", ("Making a claim", "Making a claim")),
        ("SECTION 4", ("4", "Section 4")),
        ("just a line", None),
        ("", None),
        ("# " + "x" * 130, None),
        ("**ab**", None),
    ],
)
def test_headings(spark, line, expected):
    [h] = apply(spark, X.heading, [line])
    assert (None if h is None else (h.section_id, h.section_title)) == expected


def test_segments_are_lossless(spark):
    texts = ["One. Two!  Three?\n\nFour", "", "...\n", "No end", "a.b. c"]
    for text, parts in zip(texts, apply(spark, X.segments, texts), strict=True):
        assert "".join(parts) == text and all(parts)
    spans = spark.createDataFrame([("A0",), ("A1-A2",), ("A2-A1",), ("A1-B2",), ("A9",), ("x",)], "s string")
    got = [r[0] for r in spans.select(X.resolve_span(F.col("s"), F.array(*(F.lit(x) for x in ("p. ", "q. ", "r"))))).collect()]
    assert got == ["p. ", "q. r", None, None, None, None]


def test_formula_rules_differ(spark):
    cells = ["=1", " =1", "\t=1", "\tx", "x", "-2", "\rx"]
    marked = {r: [c.startswith("'") for c in apply(spark, lambda v, r=r: X.formula_safe(v, r), cells)] for r in ("first", "stripped", "lenient")}
    assert marked["first"] == [True, False, True, True, False, True, True]
    assert marked["stripped"] == [True, True, True, True, False, True, True]
    assert marked["lenient"] == [True, True, True, False, False, True, False]


def test_difflib_is_asked_in_order(spark):
    pairs = [("tide", "diet"), ("diet", "tide"), ("a" * 250, "a" * 249 + "b"), ("", "")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(X.difflib_ratio(F.col("a"), F.col("b"))).collect()]
    assert got == [difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs]


def test_small_functions(spark):
    assert apply(spark, X.template_key, ["Pay £1,200.50 by day 3!", "pay £7 by day 99"]) == ["pay <number> by day <number>"] * 2
    assert apply(spark, X.page_numbers, ["12, 13-15", "none"]) == [[12, 13, 15], []]
    assert apply(spark, X.collapse_blank_lines, ["a\n\n\n\nb\n\nc"]) == ["a\n\nb\n\nc"]
    assert apply(spark, X.strict_json, ['{"a":1}', '{"a":1,"a":2}', "{", '{"a":NaN}']) == [True, False, False, False]
    assert apply(spark, X.percent, [0.1234, None, 0.0], "v double") == ["12.3%", "N/A", "0.0%"]
    assert apply(spark, X.gives_advice, ["I'd recommend Gold", "I recommended nothing", "your best bet is"]) == [True, False, True]
    assert apply(spark, lambda v: X.names_a_model(v, ["alpha", "beta"]), ["I am Alpha-2", "alphabet"]) == [True, False]
    digest = apply(spark, lambda v: X.digest24(("b", v), ("a", F.lit("x"))), ["y"])[0]
    import hashlib

    assert digest == hashlib.sha256(json.dumps({"a": "x", "b": "y"}, sort_keys=True).encode()).hexdigest()[:24]
    assert apply(spark, X.token_counter(str.split), ["a b c", None]) == [3, 0]
    assert spark.createDataFrame([(0,), (2,), (1,), (2,)], "v int").agg(X.median_low(F.col("v"))).first()[0] == 1
