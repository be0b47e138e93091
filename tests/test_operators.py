"""Operators on the cases that they exist for."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import sequence
from millrace.operators import bootstrap, corpus, decontam, gates, metrics, numbering, packing, quota, refusal, retrieval, splits, votes

VOTE = "task string, vote int, fact_scores array<int>, contradiction boolean, evidence_spans array<string>"


def merged(spark, rows):
    return {r.task: r for r in votes.merge_votes(spark.createDataFrame(rows, VOTE)).collect()}


def test_vote_merge_cases(spark):
    got = merged(
        spark,
        [
            ("two", 1, [0], True, ["a"]), ("two", 2, [2], False, ["b"]),
            ("three", 1, [2, 0], False, ["x", "p"]), ("three", 2, [0, 0], False, ["y", "q"]), ("three", 3, [1, 0], True, ["z", "r"]),
            ("one", 1, [2], False, None),
        ],
    )
    assert got["two"].fact_scores == [0] and got["two"].contradiction and got["two"].tie_break == "contradiction_tie_to_true" and got["two"].evidence_spans == ["a"]
    assert got["three"].fact_scores == [1, 0] and not got["three"].contradiction and got["three"].evidence_spans == ["z", "p"] and got["three"].n_facts_disagreed == 1
    assert not got["one"].enough and got["one"].fact_scores is None


def test_vote_validity(spark):
    rows = [([0, 1], True, None), ([0], True, None), ([0, 3], True, None), ([0, None], True, None), ([0, 1], None, None), ([0, 1], True, ["a"]), (None, True, None)]
    df = spark.createDataFrame(rows, "s array<int>, c boolean, e array<string>")
    got = [r[0] for r in df.select(votes.vote_problem(F.col("s"), F.lit(2), F.col("c"), F.col("e"))).collect()]
    assert got == [None, "arity", "range", "range", "contradiction_type", "spans_arity", "arity"]
    parsed = spark.sql("""SELECT from_json('{"s": [true]}', 's array<int>').s AS s, true AS c""")
    assert parsed.select(votes.vote_problem(F.col("s"), F.lit(1), F.col("c"))).first()[0] in ("range", "arity")  # a boolean is no score


def semantic(spark, **change):
    t = dict(evaluation_id="e1", gold_answerable=True, key_facts=["f"], reference_evidence=[("the limit is five",)], model_answer="limit is five", deterministic_abstention=False, reference_complete=True, output_complete=True)
    v = dict(evaluation_id="e1", correctness=1.0, evidence_support=1.0, materially_incorrect=False, unsupported_material_claim=False, abstention_category="correct_answer", fact_scores=[2], evidence_spans=["limit is five"], contradiction=False, reference_spans=["limit"], reason="ok", needs_human_review=False, judge_confidence="high", uncertainty_flags=[])
    for k, x in change.items():
        (t if k in t and k != "evaluation_id" else v)[k] = x
    ts = "evaluation_id string, gold_answerable boolean, key_facts array<string>, reference_evidence array<struct<text:string>>, model_answer string, deterministic_abstention boolean, reference_complete boolean, output_complete boolean"
    vs = "evaluation_id string, correctness double, evidence_support double, materially_incorrect boolean, unsupported_material_claim boolean, abstention_category string, fact_scores array<int>, evidence_spans array<string>, contradiction boolean, reference_spans array<string>, reason string, needs_human_review boolean, judge_confidence string, uncertainty_flags array<string>"
    names = lambda s: [x.strip().split(" ")[0] for x in s.replace("struct<text:string>", "s").split(",")]
    a = spark.createDataFrame([tuple(v[n] for n in names(vs))], vs).alias("v")
    b = spark.createDataFrame([tuple(t[n] for n in names(ts))], ts).alias("t")
    return a.join(b, F.lit(True)).select(votes.first_breach(votes.semantic_rules()).alias("r")).first().r


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        ({}, None),
        ({"evaluation_id": "other"}, "id"),
        ({"correctness": 0.7}, "score"),
        ({"contradiction": None}, "boolean"),
        ({"fact_scores": [3]}, "fact_arity"),
        ({"evidence_spans": ["a", "b"]}, "span_arity"),
        ({"evidence_spans": ["invented"]}, "ungrounded_span"),
        ({"reference_spans": ["nowhere"]}, "invented_reference"),
        ({"abstention_category": "maybe"}, "category"),
        ({"reason": " "}, "reason"),
        ({"materially_incorrect": True}, "material_error_scores_zero"),
        ({"contradiction": True, "correctness": 0.0}, "contradicted_support"),
        ({"unsupported_material_claim": True}, "unsupported_full_support"),
        ({"deterministic_abstention": True}, "refusal_scores"),
        ({"deterministic_abstention": True, "correctness": 0.0}, "refusal_support"),
        ({"reference_complete": False}, "missing_reference_scored"),
        ({"reference_spans": []}, "support_without_span"),
        ({"reference_spans": [], "evidence_support": 0.0}, "absent_support_unflagged"),
        ({"uncertainty_flags": ["missing_reference"]}, "severe_flag_scored"),
        ({"judge_confidence": "low"}, "uncertainty_needs_review"),
        ({"output_complete": False}, "incomplete_unflagged"),
        ({"deterministic_abstention": True, "correctness": 0.0, "evidence_support": None}, "abstention_category"),
    ],
)
def test_semantic_rules_in_order(spark, change, reason):
    assert semantic(spark, **change) == reason


SENTENCE = "The documents I have do not answer that."
CITE = "[Acme, Guide, Section 1, p.2]"


@pytest.mark.parametrize(
    ("text", "expected"),
    [(SENTENCE, "YYY"), (f"{SENTENCE} But you are covered.", "YNN"), (f"{SENTENCE} {CITE}", "YYN"), (f"{SENTENCE} 12. 34", "YYY"), (f"Covered. {SENTENCE} {CITE}", "NNN"), ("Covered.", "NNN"), (SENTENCE.rstrip("."), "YYY")],
)
def test_refusal_readings(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(*(refusal.refuses(F.col("t"), SENTENCE, r) for r in refusal.READINGS)).first()
    assert "".join("Y" if x else "N" for x in got) == expected


def test_strict_is_inside_loose(spark):
    df = spark.createDataFrame([(SENTENCE + "x" * n + (CITE if n % 2 else ""),) for n in range(0, 90, 7)], "t string")
    strict = [df.where(refusal.strict(F.col("t"), SENTENCE, m)).count() for m in refusal.LENGTH_MULTIPLES]
    assert strict == sorted(strict) and strict[-1] <= df.where(refusal.loose(F.col("t"), SENTENCE)).count()


def test_row_metrics(spark):
    s = "row string, answerable boolean, refused boolean, corr_item double, n_sup int, n_tot int"
    got = metrics.row_metrics(spark.createDataFrame([("a", True, False, 1.0, 1, 2), ("b", True, False, None, 0, 0)], s), "row")
    a, b = sorted(got.collect(), key=lambda r: r.row)
    assert a.composite == pytest.approx(0.85)
    assert (b.correctness, b.citation_support, b.abstention, b.n_scored) == (0.0, 0.0, 1.0, 0)


def test_kappas(spark):
    p = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (None, 1)], "a int, b int")
    k = metrics.cohen_kappa(p, "a", "b").first()
    assert k.n == 3 and k.kappa == pytest.approx((2 / 3 - 1 / 3) / (1 - 1 / 3))
    assert metrics.cohen_kappa(spark.createDataFrame([(1, 1)], "a int, b int"), "a", "b").first().kappa is None
    assert metrics.weighted_kappa(spark.createDataFrame([(1, 1)], "a int, b int"), "a", "b").first().kappa == 1.0
    nothing = metrics.weighted_kappa(spark.createDataFrame([], "a int, b int"), "a", "b").first()
    assert nothing.n == 0 and nothing.kappa != nothing.kappa


def test_missing_is_not_zero(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double").agg(*metrics.mean_triple(F.col("x"), "m")).first()
    assert (df.m_mean, df.m_sum, df.m_n) == (None, 0.0, 0)
    t = metrics.taxonomy(spark.createDataFrame([(["a"], True), ([], False)], "categories array<string>, judged boolean"), ["a", "b"])
    assert {r.n for r in t.collect()} == {None}
    rate = metrics.complete_rate(F.col("x") > 0, F.col("i"), 3)
    assert spark.createDataFrame([(1, 1.0), (2, 0.0)], "i int, x double").agg(rate).first()[0] is None


def test_paired_changes(spark):
    b, a = (spark.createDataFrame([(i, v) for i, v in enumerate(x)], "q int, v double") for x in ([0.0, 1.0, 0.5, None], [1.0, 0.5, 0.5, 1.0]))
    assert [r.change for r in metrics.paired_changes(b, a, "q", "v").orderBy("q").collect()] == ["improves", "worsens", "unchanged", "pending"]


def test_citation_resolution(spark):
    answers = spark.createDataFrame([(1, "[Acme, Guide, Section B2, p.4][acme, guide.pdf, B2, p.6][Acme, Other, B2, p.4][Acme, Guide, B2, p.5][Acme, Guide, B2, p.5][Acme, ., C, p.5]")], "answer_id int, text string")
    ctx = spark.createDataFrame([(1, "ACME", "Guide", "x/guide.pdf", "b2", 5)], "answer_id int, insurer string, doc_short string, filename string, section_id string, page int")
    got = retrieval.resolve_citations(answers, ctx).orderBy("occurrence").collect()
    assert [r.supported for r in got] == [True, True, False, True, True, False]


@pytest.mark.parametrize(("page", "ok"), [(3, False), (4, True), (5, True), (6, True), (7, False)])
def test_page_tolerance(spark, page, ok):
    answers = spark.createDataFrame([(1, f"[A, G, S, p.{page}]")], "answer_id int, text string")
    ctx = spark.createDataFrame([(1, "A", "G", "g", "S", 5)], "answer_id int, insurer string, doc_short string, filename string, section_id string, page int")
    assert retrieval.resolve_citations(answers, ctx).first().supported is ok


def test_repeated_lines_need_six_pages(spark):
    pages = [("d6", p, f"Page {p}\nown {chr(97 + p)}\nfooter") for p in range(6)] + [("d5", p, "footer\nx") for p in range(5)] + [("half", p, "head" if p < 3 else f"body {chr(97 + p)}") for p in range(6)]
    kept = corpus.strip_repeated_lines(corpus.lines_of(spark.createDataFrame(pages, "doc string, page int, text string"), "doc", "page", "text"))
    got = kept.groupBy("doc").agg(F.array_sort(F.collect_set("line")).alias("l"))
    by = {r.doc: r.l for r in got.collect()}
    assert by["d6"] == [f"own {chr(97 + p)}" for p in range(6)] and by["d5"] == ["footer", "x"] and "head" in by["half"]


def test_packing():
    assert corpus.pack("short") == ["short"]
    paragraphs = [f"{i} " + "x" * 600 for i in range(6)]
    chunks = corpus.pack("\n\n".join(paragraphs))
    assert all(any(p in c for c in chunks) for p in paragraphs)
    assert chunks[1].startswith("x" * 200)  # the end of the chunk before
    tail = corpus.pack("\n\n".join([*paragraphs[:2], "y" * 900, "end"]))
    assert tail[-1].endswith("end") and len(tail[-1]) > 350
    table = "| a |\n" * 700
    assert table.strip() in corpus.pack(f"{'z' * 1000}\n\n{table}")[-1]


def test_sections(spark):
    text = "before it all " * 5 + "\n# One\n" + "body of one " * 6 + "\n\n\n\nmore\n# Empty\n\n# Two\nshort\n## Section 3 - Three\n" + "body of three " * 5
    lines = corpus.lines_of(spark.createDataFrame([("d", 1, text)], "doc string, page int, text string"), "doc", "page", "text")
    got = [(r.section_id, r.section_title, "\n\n\n" in r.text) for r in corpus.sections(lines).orderBy("island").collect()]
    assert got == [("Preamble", "Preamble", False), ("One", "One", False), ("3", "Three", False)]


def test_containment_equals_all_pairs(spark):
    docs = [(1, "x The  quick brown fox jumps over the lazy dog y"), (2, "prequick brown fox jumps over the lazy dogged"), (3, "nothing"), (4, "hi there")]
    items = [(1, "quick brown fox jumps over the lazy dog"), (2, "HI"), (3, ""), (4, "brown  FOX")]
    got = decontam.containment(spark.createDataFrame(docs, "d int, t string"), "d", "t", spark.createDataFrame(items, "i int, t string"), "i", "t").collect()
    norm = lambda s: " ".join(s.lower().split())
    assert {tuple(r) for r in got} == {(d, i) for d, t in docs for i, s in items if norm(s) and norm(s) in norm(t)}


def test_fuzzy_pairs_equal_all_pairs(spark):
    import difflib
    import random

    rng = random.Random(1)
    texts = ["".join(rng.choices("abcdef  xyz1é", k=rng.randint(5, 40))) for _ in range(25)]
    texts += [t[: len(t) // 2] + "q" + t[len(t) // 2 :] for t in texts[:12]] + [t + "ab" for t in texts[:8]]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {(r.a, r.b) for r in decontam.fuzzy_pairs(df, "i", "t", df, "i", "t", 0.85).collect()}
    assert got == {(a, b) for a, x in enumerate(texts) for b, y in enumerate(texts) if difflib.SequenceMatcher(None, x, y).ratio() >= 0.85}


def test_ratio_equals_the_standard_library():
    """Texts around 200 characters, of few and many kinds, edited and unlike; given up only below the bound."""
    import difflib
    import random

    from millrace.functions.sequence import Text, ratio, ratio_from

    rng = random.Random(11)
    for _ in range(1500):
        letters = rng.choice(["ab", "abc ", "abcdefghij klmnop", "abcdefghijklmnopqrstuvwxyz      ABCDEFGHIJ.,;:0123456789é漢🙂"])
        a = "".join(rng.choices(letters, k=rng.choice([0, 1, 5, 50, 199, 200, 201, 400, 900])))
        b = list(a) if rng.random() < 0.8 else rng.choices(letters, k=rng.randrange(500))
        for _ in range(rng.choice([0, 1, 5, len(b) // 10, len(b) // 2])):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choices(letters, k=rng.randrange(2))
        b = "".join(b)
        expected = difflib.SequenceMatcher(None, a, b).ratio()
        assert ratio(Text(a), Text(b)) == expected
        least = rng.choice([0.0, expected, expected + 0.01, 0.5, 0.9])
        assert ratio_from(Text(a), Text(b), least) == (expected if expected >= least else None)


def test_unlike_texts_are_given_up_before_their_blocks_are_looked_for(monkeypatch):
    """Short texts by their longest common subsequence, long ones by counters that unlike runs seldom share."""
    import difflib
    import random

    import pyarrow as pa

    rng = random.Random(9)
    asked = []
    monkeypatch.setattr(sequence, "_Pair", lambda a, b, real=sequence._Pair: asked.append((a.text, b.text)) or real(a, b))
    texts = ["".join(rng.choices("abcdefgh ", k=rng.randint(140, 199))) for _ in range(12)]
    texts += [t[:60] + t[62:] + "h" for t in texts[:4]]
    for a in texts:
        for b in texts:
            ratio = difflib.SequenceMatcher(None, a, b).ratio()
            found = sequence.ratio_from(sequence.Text(a), sequence.Text(b), 0.9)
            assert found == (ratio if ratio >= 0.9 else None)
    assert all(sequence.common_subsequence(sequence.Text(a), sequence.Text(b)) >= 0.9 * (len(a) + len(b)) / 2 - 1 for a, b in asked) and len(asked) < 40
    asked.clear()
    long = ["".join(rng.choices("abcdefgh klmnopqrst", [10] * 9 + [0.85] * 10, k=4000)) for _ in range(8)]  # the last ten are indexed
    long.append(long[0][:100] + long[0][140:])
    names = ["id", "text", "band", "part", "n", "indexed", "rare", "more_chars", "chars", "more_grams", "grams"]
    rows = pa.RecordBatch.from_arrays([pa.array(range(9), pa.int64()), pa.array(long), *(pa.array([0] * 9, pa.int32()) for _ in range(2))], names=names[:4])
    block = pa.Table.from_batches(list(decontam._profiles(iter([rows]))))
    expected = [(a, b) for b in range(9) for a in range(b) if difflib.SequenceMatcher(None, long[a], long[b]).ratio() >= 0.9]
    assert sorted(zip(*decontam._matches(block, block, 0.9, True)[:2], strict=True)) == expected
    assert len(asked) <= 1


def test_a_second_text_is_indexed_once_for_its_pairs(monkeypatch):
    import difflib
    import random

    import pyarrow as pa

    rng = random.Random(10)
    seconds = ["".join(rng.choices("abcdefgh klmnop", [10] * 9 + [0.9] * 6, k=900)) for _ in range(3)]
    firsts = [y[:k] + "x" * (k % 7) + y[k + k % 90 :] for y in seconds for k in range(0, 900, 9)]
    pairs = [(i, 1000 + i // 100, x, seconds[i // 100]) for i, x in enumerate(firsts)]
    batch = pa.RecordBatch.from_pylist([dict(zip(("a", "b", "a_text", "b_text"), p, strict=True)) for p in pairs])
    asked = []
    monkeypatch.setattr(sequence, "indexed_characters", lambda t, real=sequence.indexed_characters: asked.append(t) or real(t))
    got = {(a, b): r for out in decontam._ratios(0.9)(iter([batch.slice(0, 130), batch.slice(130)])) for a, b, r in zip(*(c.to_pylist() for c in out.columns), strict=True)}
    ratio = {(a, b): difflib.SequenceMatcher(None, x, y).ratio() for a, b, x, y in pairs}
    assert got == {k: r for k, r in ratio.items() if r >= 0.9} and 20 < len(got)
    assert asked == seconds


def test_pairs_of_texts_are_laid_out_so_that_they_compress():
    import pyarrow as pa

    from millrace.operators import shared_runs

    rng = np.random.default_rng(3)
    codes = np.unique(np.repeat(rng.integers(400_000, 500_000, 100), 300).astype(np.uint64) << np.uint64(31) | rng.integers(0, 400_000, 30_000).astype(np.uint64))
    rows = shared_runs._pair_rows(shared_runs.PAIRS, codes >> np.uint64(31), 1, codes, np.ones(len(codes), np.int64))
    size = sum(len(pa.compress(x, "lz4", asbytes=True)) for c in ("codes", "hits") for x in rows[c].to_pylist())
    assert size < 3 * len(codes)
    number = np.unique(codes >> np.uint64(31))
    sure = shared_runs._pair_rows(shared_runs.SURE, number, 1, number, np.ones(len(number), np.int64))
    kept = [(b, a) for out in shared_runs._kept(iter([rows, sure])) for a, b in zip(*(c.to_pylist() for c in out.columns), strict=True)]
    assert sorted(kept) == [(int(c) >> 31, int(c) & (1 << 31) - 1) for c in codes]


def test_near_copies_lose_no_like_texts(spark):
    """Many copies of one text, near copies in different order of ids, long and short texts, nulls and repeated ids."""
    import difflib
    import random

    rng = random.Random(12)
    base = ["".join(rng.choices("abcdefghijklmnop   QRSTU.,", k=n)) for n in (30, 150, 260, 700, 2600)]
    texts = base + [t[: len(t) // 3] + "xyz" + t[len(t) // 3 :] for t in base] + [t[:-3] for t in base] + ["".join(rng.choices("abcdefghijklmnop   ", k=300)) for _ in range(10)]
    rows = list(enumerate(texts)) + [(1000 + i, texts[2]) for i in range(60)] + [(2000, None), (2001, ""), (None, texts[3]), (4, texts[4])]
    rows += [(3000, "zyxwv" * 20), (3000, "0123456789" * 12), (3001, "0123456789" * 12 + "?"), (3002, "zyxwv" * 20 + "!")]  # two texts of one id
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "i int, t string")
    got = {(r.a, r.b): r.ratio for r in decontam.near_copies(df, "i", "t", 0.9).collect()}
    ratio = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio()
    expected = {(a, b): ratio(x, y) for a, x in enumerate(texts) for b, y in enumerate(texts) if a < b and ratio(x, y) >= 0.9}
    assert {k: v for k, v in got.items() if k[0] != 3000} == expected | {(2, 1000 + i): 1.0 for i in range(60)}
    assert {k for k in got if k[0] == 3000} == {(3000, 3001), (3000, 3002)}


def test_near_copies_compare_long_texts_by_shared_windows(spark, monkeypatch):
    """Edits around the ratio, a line that many texts hold and a common run lose no pair; only short texts meet all others."""
    import difflib
    import random

    from millrace.operators import shared_runs

    monkeypatch.setattr(shared_runs, "COMMON", 16)  # runs of this many texts in the sample are left out on the driver
    rng = random.Random(5)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 7))) for _ in range(300)] + ["wax", "my"]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    line = prose(14)
    texts = [f"{prose(rng.randint(70, 110))} {line if i % 2 else prose(5)} {prose(40)}" for i in range(16)]
    for t in texts[:16]:
        w = t.split(" ")
        for _ in range(rng.choice([1, 2, 3, 4, 6])):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w))
    texts += [texts[2][: len(texts[2]) * 17 // 20], texts[5] + prose(14), "short text one", "short text one!"]
    rng.shuffle(texts)
    met = []
    pairs = decontam.fuzzy_pairs
    monkeypatch.setattr(decontam, "fuzzy_pairs", lambda *a, **k: met.append({r.text for r in a[3].collect()}) or pairs(*a, **k))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {(r.a, r.b): r.ratio for r in decontam.near_copies(df, "i", "t", 0.9).collect()}
    ratio = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio()
    expected = {(a, b): ratio(x, y) for b, y in enumerate(texts) for a, x in enumerate(texts[:b]) if ratio(x, y) >= 0.9}
    assert got == expected and 6 < len(expected) < 25
    assert met == [{"short text one", "short text one!"}]


def test_windows_are_shared_by_like_texts():
    """The number of shared windows that a second text is sure of is never more than what edited first texts share."""
    import difflib
    import random

    import numpy as np

    from millrace.operators import shared_runs as S

    rng, levels, sure_ones = random.Random(8), np.zeros(1 << S.PLACES, np.uint8), 0
    levels[rng.sample(range(1 << S.PLACES), 1 << 19)] = 1
    for _ in range(300):
        b = "".join(rng.choices("etaoin shrdlu wmbkq", weights=[90] * 14 + [1] * 5, k=rng.randint(200, 900)))
        a = list(b)
        for _ in range(rng.randrange(len(b) // 25)):
            at = rng.randrange(len(a))
            a[at : at + rng.randrange(1, 6)] = rng.choices("etaoin ", k=rng.randrange(5))
        a = "".join(a)
        if difflib.SequenceMatcher(None, a, b).ratio() < 0.9:
            continue
        (x, p), (y, q) = ((h, S._ranks(h, levels)) for h in (S._run_hashes(S._codes(t)) for t in (a, b)))
        window, sure = S.windows_shared(b, q, 1, 0.9)
        if sure:
            second = S._chosen(q, window) & (q >> np.uint64(61) < 1)
            assert np.isin(y[second], x[S._chosen(p, S.WINDOWS[0])]).sum() >= sure
            sure_ones += 1
    assert sure_ones > 20


def test_fuzzy_queries_compare_whole_texts(spark, tmp_path, monkeypatch):
    """Short or changed first lines lose no pair, a shared opening line makes none; the same pairs as all comparisons."""
    import difflib
    import random
    import re

    from millrace.plans.corpus_queries import fuzzy_overlap, near_duplicate_pairs

    monkeypatch.setattr(decontam, "BLOCK_ROWS", 7, raising=False)
    rng = random.Random(3)
    words = ["".join(rng.choices("etaoinshrdlucmfwypvbgkjqxzé", weights=range(27, 0, -1), k=rng.randint(1, 9))) for _ in range(90)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    texts = [f"{prose(rng.randint(1, 12))}\n{prose(rng.choice([2, 9, 30, 60, 200]))}" for _ in range(24)]
    for t in texts[:18]:
        w = t.split(" ")
        for _ in range(max(1, len(w) // rng.choice([8, 12, 30]))):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w))
    opening = prose(12)
    texts += [f"Short\n{prose(60)}"] * 2 + [f"{opening}\n{prose(60)}", f"{opening}\n{prose(60)}", "a\nb", "A b", "", "x" * 400, "x" * 401]
    items = [texts[3], texts[8].replace("\n", " "), f"{prose(1)} {texts[12]}", texts[20], "", texts[-6]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    key = lambda t: re.sub(r"[ \t\r\n]+", " ", t.lower()).strip(" ")
    plain = lambda t: re.sub(r"[^\w]+", " ", t.lower()).strip(" ")
    ratio = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0
    expected = {(a, b) for b, y in enumerate(texts) for a, x in enumerate(texts[:b]) if ratio(plain(x), plain(y)) >= 0.9}
    assert {(r.a, r.b) for r in near_duplicate_pairs(spark, str(tmp_path)).collect()} == expected and len(expected) > 8
    expected = {(a, b) for a, x in enumerate(texts) for b, y in enumerate(items) if ratio(key(x), key(y)) >= 0.85}
    assert {(r.a, r.b) for r in fuzzy_overlap(spark, str(tmp_path)).collect()} == expected and len(expected) > 4


def test_grouped_split_keeps_groups(spark):
    rows = spark.createDataFrame([(i, f"g{i // 2}") for i in range(50)], "i int, g string")
    got = splits.grouped_split(rows, "g", 3).collect()
    sides = {}
    for r in got:
        sides.setdefault(r.g, set()).add(r.side)
    n = sum(r.side == "validation" for r in got)
    assert all(len(s) == 1 for s in sides.values()) and 5 <= n <= 6 and len(got) == 50


def test_milestones_are_nested(spark):
    rows = spark.createDataFrame([(f"k{i:02d}", i if i < 4 else None) for i in range(9)], "k string, o int")
    got = splits.milestones(rows, "k", "o", [3, 6]).collect()
    small, large = ([r.k for r in sorted(got, key=lambda r: r.position) if r.milestone == m] for m in (3, 6))
    assert large[:3] == small and large == ["k00", "k01", "k02", "k03", "k04", "k05"]


def test_quota_window_is_open_below(spark):
    rows = spark.createDataFrame([("a", 0, 1.0), ("a", 60, 2.0), ("a", 61, 4.0)], "p string, s int, tokens double").withColumn("ts", F.timestamp_seconds("s"))
    got = quota.rolling_usage(rows, "p", "ts", "tokens", 60).orderBy("s").collect()
    assert [(r.n_window, r.tokens_window) for r in got] == [(1, 1.0), (1, 2.0), (2, 6.0)]


def test_gates_go_red(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "")], "k int, v string")
    with pytest.raises(gates.GateError):
        gates.require_empty(gates.duplicate_keys(df, "k"), "keys")
    with pytest.raises(gates.GateError):
        gates.require_rows(df.limit(0), "answers")
    gates.require_empty(gates.duplicate_keys(df, "k", "v"), "keys")
    assert gates.missing_keys(df, "v").count() == 1
    assert {r.missing_from for r in gates.unequal_populations(df, df.where("k = 1"), "k").collect()} == {"right"}
    assert gates.not_preserved(df, df.where("k = 1").withColumn("x", F.lit(1))).count() == 1
    m = spark.createDataFrame([("ok", 0.5, 1.0, 2), ("off", 0.6, 1.0, 2), ("null", None, 0.0, 0)], "metric string, value double, numerator double, denominator int")
    assert [r.metric for r in gates.metric_breaches(m).collect()] == ["off"]
    a, b = (spark.createDataFrame(x, "k string, v double") for x in ([("a", 1.0), ("b", 2.0)], [("a", 1.0 + 1e-9), ("c", 2.0)]))
    assert sorted(r.k for r in gates.drifted(a, b, ["k"], "v").collect()) == ["b", "c"]
    modes = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (2, "x")], "q int, m string")
    assert [r.q for r in gates.incomplete_modes(modes, "q", "m", ["x", "y"]).collect()] == [2]
    leaves = [("p", "a_lower", "0.1", "double"), ("p", "a", "0.2", "double"), ("q", "a_lower", "0.1", "double"), ("q", "a", "0.2", "double"), ("q", "n_recovered_unjudged", "0", "int"), ("r", "a", "1", "int")]
    report = spark.createDataFrame(leaves, "path string, key string, value string, type string")
    assert [(r.path, r.points) for r in gates.leaked_points(report, ["a"]).collect()] == [("p", ["a"])]


def test_bootstrap_over_many_blocks(spark, monkeypatch):
    """Every resample draws as often as there are units; units and blocks are drawn evenly, by themselves and in pairs."""
    monkeypatch.setattr(bootstrap, "LEAST_BLOCK", 10)
    monkeypatch.setattr(bootstrap, "BLOCKS", 6)
    monkeypatch.setattr(bootstrap, "MAX_UNITS", 20)  # numbered by ranges
    n, b = 64, 4000  # blocks of 11, the last one of 9
    units = spark.range(n).select((F.col("id") * 37 % n).alias("i"))
    got = bootstrap.replicates(units, "i", F.collect_list("i"), b, 3).collect()
    counts = np.zeros((b, n), int)
    for r in got:
        np.add.at(counts[r.b], r.stat, 1)
    assert len(got) == b and (counts.sum(axis=1) == n).all()
    # each unit's count is binomial (n, 1/n); sums and variances over replicates lie within five deviations
    assert abs(counts.mean(axis=0) - 1).max() < 5 / np.sqrt(b)
    assert abs(counts.var(axis=0) - (1 - 1 / n)).max() < 5 * np.sqrt(3 / b)
    together = np.corrcoef(counts.T) + np.eye(n) * -1
    assert abs(together[~np.eye(n, dtype=bool)] + 1 / (n - 1)).max() < 6 / np.sqrt(b)
    plan = bootstrap.replicates(units, "i", F.avg("i"), b, 3)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_bootstrap_of_many_units(spark):
    """Slots beyond 2^31 / 16,807 draw what plain integers say."""
    n, b, seed = 140_000, 2, 3

    def remainder(seed, b, slot):
        x = (b * 48_271 + slot % bootstrap.PRIME * 16_807 + seed % bootstrap.PRIME + 1) % bootstrap.PRIME
        for add in (12_345, 67_891, 24_683):
            x = (x * x + add) % bootstrap.PRIME
        return x

    size = bootstrap.block_size(n)
    blocks = -(-n // size)
    expected = {}
    for k in range(b):
        counts = np.bincount([remainder(seed, k, slot) * n // bootstrap.PRIME // size for slot in range(n)])
        drawn = (block * size + remainder(seed + bootstrap.WITHIN, k, t * blocks + block) * min(size, n - block * size) // bootstrap.PRIME for block, m in enumerate(counts.tolist()) for t in range(m))
        expected[k] = sum(drawn)
    got = bootstrap.replicates(spark.range(n).select(F.col("id").alias("i")), "i", F.sum("i"), b, seed).collect()
    assert {r.b: r.stat for r in got} == expected


def test_bootstrap(spark):
    one = spark.createDataFrame([(1, 0.5)], "i int, v double")
    assert tuple(bootstrap.interval(one, "i", F.avg("v"), "reporting_mean").first()) == (0.5, 0.5, 2000)
    assert tuple(bootstrap.interval(one.limit(0), "i", F.avg("v"), "reporting_mean").first()) == (None, None, 0)
    many = spark.createDataFrame([(i, float(i % 2)) for i in range(60)], "i int, v double")
    lo, hi, _ = bootstrap.interval(many, "i", F.avg("v"), "metric").first()
    assert 0.3 < lo < 0.5 < hi < 0.7 and tuple(bootstrap.interval(many, "i", F.avg("v"), "metric").first())[:2] == (lo, hi)
    pairs = spark.createDataFrame([("g", 0.0, 1.0), ("g", 0.0, 0.5)], "g string, b double, a double")
    r = bootstrap.paired_groups(pairs, "g", "b", "a").first()
    assert r.difference == 0.75 and r.lo is None and r.hi is None


def test_row_numbers_follow_the_order(spark):
    rows = spark.range(1000).selectExpr("(id * 7919) % 1000 AS k", "id % 3 AS g").repartition(6)
    assert sorted((r.n, r.k) for r in numbering.number_rows(rows, ["k"]).collect()) == [(i, i) for i in range(1000)]
    assert numbering.number_rows(rows.limit(0), ["k"]).count() == 0
    tasks, rest = votes.blinded(rows, ["g"], ["k"])
    assert tasks.columns == ["evaluation_id", "g"] and rest.columns == ["k", "evaluation_id"]
    assert tasks.agg(F.min("evaluation_id"), F.max("evaluation_id"), F.countDistinct("evaluation_id")).first()[:] == ("e000000", "e000999", 1000)


def test_batches_keep_their_bounds(spark):
    rows = spark.createDataFrame([(i, f"g{i % 7}", 40 if i % 11 else 500) for i in range(200)], "i int, g string, n int")
    got = packing.pack_batches(rows, "i", "g", "n", most=4, max_bytes=150, shards=3, oversized="alone").collect()
    batches = {}
    for r in got:
        batches.setdefault(r.batch, []).append(r)
    assert sorted(r.i for r in got) == list(range(200))
    assert all(len(b) <= 4 and len({r.g for r in b}) == len(b) and (sum(r.n for r in b) <= 150 or len(b) == 1) for b in batches.values())
    assert packing.pack_batches(rows.limit(0), "i", "g", "n").count() == 0
