"""Gates, reports, training examples and sinks on the cases that they exist for."""

import hashlib
import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import text as X
from millrace.operators import bootstrap, curation, decontam, gates, metrics, packing, quota, refusal, reporting, retrieval, training, votes
from millrace.operators.gates import GateError
from millrace.plans.catalogue import ORACLE_SQL, QUERIES
from millrace.sources import readers, writers

FAILS = (PySparkException, Py4JJavaError)


def test_near_questions_leak(spark):
    seed = "id string, split string, question string, gold_answer string, review_status string"
    rows = [("a", "seed", "What is the  excess for windscreen repair?", "no", "verified"), ("b", "seed", "who pays", "YES it is", None), ("c", "dev", "how long does cover last", "z", "verified"), ("d", "seed", "something else", "q", "verified")]
    forbidden = spark.createDataFrame([("t1", "What is the excess for a windscreen repair?", "fifty"), ("c", "other", "yes it is")], "id string, question string, gold_answer string")
    got = curation.seed_leakage(spark.createDataFrame(rows, seed), forbidden, spark.createDataFrame([("d",)], "id string")).collect()
    assert {r.id: r.reasons for r in got} == {"a": ["question_overlap"], "b": ["answer_overlap", "unverified"], "c": ["forbidden_id", "not_seed"], "d": ["test_or_dev_intent_cluster"]}


def test_inconsistent_scores_and_bad_vote_sets(spark):
    schema = "task string, vote int, fact_scores array<int>, evidence_spans array<string>, correctness double, evidence_support double, category string, materially_incorrect boolean, unsupported_material_claim boolean, contradiction boolean, needs_human_review boolean, uncertainty_flags array<string>, material_conditions array<string>, model string"
    vote = lambda t, n, facts, score, model="m": (t, n, facts, [""] * len(facts), score, 1.0, "correct_answer", False, False, False, False, [], [f"c{n}"], model)
    rows = [vote("odd", n, [2, 1], 1.0) for n in (1, 2, 3)] + [vote("refused", n, [1], 1.0) for n in (1, 2, 3)] + [vote("fine", n, [2, 2], 1.0) for n in (1, 2, 3)] + [vote("few", n, [2], 1.0) for n in (1, 2)]
    tasks = spark.createDataFrame([("odd", True, False), ("refused", True, True), ("fine", True, False), ("few", True, False)], "task string, gold_answerable boolean, deterministic_abstention boolean")
    got = {r.task: r for r in votes.merge_semantic(spark.createDataFrame(rows, schema), tasks).collect()}
    assert set(got) == {"odd", "refused", "fine"}
    assert got["odd"].correctness is None and got["odd"].needs_human_review and got["odd"].fact_overall_inconsistency
    assert got["refused"].correctness == got["fine"].correctness == 1.0 and not got["fine"].needs_human_review
    assert got["fine"].material_conditions == ["c1", "c2", "c3"] and got["fine"].fact_scores == [2, 2]
    for extra, problem in ((vote("fine", 3, [2, 2], 1.0), "duplicate_vote"), (vote("few", 4, [2], 1.0), "invalid_vote_index"), (vote("few", 3, [2], 1.0, "other"), "mixed_judges")):
        df = spark.createDataFrame([*rows, extra], schema)
        assert problem in [r.problem for r in votes.vote_set_problem(df).collect()]
        with pytest.raises(FAILS, match=problem):
            votes.merge_semantic(df, tasks).collect()


def test_oversized_tasks_are_errors(spark):
    rows = spark.createDataFrame([(1, "a", 10), (2, "b", 500)], "i int, g string, n int")
    with pytest.raises(FAILS, match="exceeds"):
        packing.pack_batches(rows, "i", "g", "n", max_bytes=100).collect()
    assert packing.pack_batches(rows, "i", "g", "n", max_bytes=500).count() == 2


def test_latest_checkpoints_leave_complete_models_out(spark):
    rows = [("a", "sft", 1, "x"), ("a", "sft", 3, "y"), ("a", "sft", 3, "z"), ("a", "dpo", 2, "w"), ("done", "sft", 9, "v"), (None, None, None, "notes")]
    got = curation.latest_checkpoints(spark.createDataFrame(rows, "model string, phase string, step int, file string"), spark.createDataFrame([("done",)], "model string"))
    assert sorted(r.file for r in got.collect()) == ["notes", "w", "y", "z"]


def test_wide_and_long_must_agree(spark):
    long = spark.createDataFrame([("m", "a", 0.5), ("m", "b", None)], "model string, metric string, value double")
    wide = spark.createDataFrame([("m", 0.5, None)], "model string, a double, b double")
    assert reporting.wide_differs(wide, long, ["model"], ["a", "b"]).count() == 0
    assert [r.metric for r in reporting.wide_differs(wide.withColumn("a", F.lit(0.4)), long, ["model"], ["a", "b"]).collect()] == ["a"]
    both = reporting.report_wide(long.withColumn("metric", F.when(F.col("metric") == "a", "coverage").otherwise("parse_rate")), ["model"]).first()
    assert both.coverage == 0.5 and both.parse_rate is None and both.correctness is None


def test_reclassified_answers_are_rows(spark):
    s = "I cannot answer that."
    df = spark.createDataFrame([(1, s, True), (2, f"{s} But it is five.", True), (3, f"{s} Or six.", False), (4, "Seven.", True)], "id int, text string, answerable boolean")
    assert sorted(refusal.reclassified(df, s).collect()) == [(2, "recovered"), (3, "lost")]
    assert refusal.reclassify(df, s).first().asDict() == {"ans_n": 3, "unans_n": 1, "n_loose_over": 2, "n_recovered": 1, "n_loose_ok": 1, "n_lost": 1}


def test_containment_by_either_way(spark, monkeypatch):
    import random

    rng = random.Random(4)
    words = [f"w{i}" for i in range(12)]
    docs = [(i, " ".join(rng.choices(words, k=60))) for i in range(40)]
    items = [(i, t[rng.randint(0, 40) :][: rng.randint(3, 90)]) for i, t in enumerate([t for _, t in docs[:25]])]
    d, i = spark.createDataFrame(docs, "d int, t string"), spark.createDataFrame(items, "i int, t string")
    norm = lambda s: " ".join(s.split())
    expected = {(a, b) for a, t in docs for b, s in items if norm(s) and norm(s) in norm(t)}
    assert {tuple(r) for r in decontam.containment(d, "d", "t", i, "i", "t").collect()} == expected and len(expected) > 20
    monkeypatch.setattr(decontam, "SENT_CHARS", 0)
    assert {tuple(r) for r in decontam.containment(d, "d", "t", i, "i", "t").collect()} == expected


@pytest.mark.parametrize("sent", [32 << 20, 0])
def test_cited_chunks_of_short_and_long_quotes(spark, monkeypatch, sent):
    monkeypatch.setattr(decontam, "SENT_CHARS", sent)
    text = "the quick brown fox jumps over the lazy dog and runs far away"
    chunks = spark.createDataFrame([(1, "f", "A", 3, text), (2, "f", "a", 5, text), (3, "g", "a", 3, text)], "chunk_id int, filename string, insurer string, page int, text string")
    quotes = [(1, "f", "a", "2", "Quick  brown fox jumps over the lazy dog"), (2, "f", "a", "4", "lazy dog"), (3, "f", "a", "x", "lazy dog"), (4, "f", "b", "3", "lazy dog"), (5, "f", "a", "3", "ick brown fox jumps over the lazy do"), (6, "f", "a", "3", " ")]
    c = spark.createDataFrame(quotes, "cite_id int, filename string, insurer string, page string, quote string")
    assert sorted((r.cite_id, r.chunk_id) for r in decontam.cited_chunks(c, chunks).collect()) == [(1, 1), (2, 1), (2, 2), (5, 1)]
    assert sorted((r.cite_id, r.chunk_id) for r in decontam.cited_chunks(c, chunks, band=None).collect()) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2), (5, 1), (5, 2)]


def test_a_chunk_is_shuffled_once_and_not_for_each_of_its_quotes(spark):
    lines = [" ".join(hashlib.sha256(b"%d %d" % (i, j)).hexdigest()[:12] for j in range(12)) for i in range(200)]
    chunks = spark.createDataFrame([(0, "f", "a", 1, " ".join(lines))], "chunk_id int, filename string, insurer string, page int, text string")
    c = spark.createDataFrame([(i, "f", "a", "1", line) for i, line in enumerate(lines)], "cite_id int, filename string, insurer string, page string, quote string")

    def shuffled():
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty()
        executors = context.statusStore().executorList(False)
        return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))

    sent, before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), shuffled()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
    try:
        assert {(r.cite_id, r.chunk_id) for r in decontam.shortest_cited_chunks(c, chunks).collect()} == {(i, 0) for i in range(200)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", sent)
    assert shuffled() - before < 20 * sum(map(len, lines))  # a quote is on three pages


def test_many_citations_of_one_quote_are_matched_once(spark):
    """Citations of one quote and chunks that hold it meet once, and none of their pairs are rows."""
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]
    chunks = spark.createDataFrame([(i, "f", "a", 1, "x " + " ".join(words) + " y" * (i % 7 + 1)) for i in range(100)], "chunk_id int, filename string, insurer string, page int, text string")
    quotes = [(n * 1000 + i, "f", "a", "1", " ".join(words[:n])) for n in range(1, 9) for i in range(50)]
    c = spark.createDataFrame(quotes, "cite_id int, filename string, insurer string, page string, quote string")
    assert {r.chunk_id for r in decontam.shortest_cited_chunks(c, chunks).collect()} == {0}
    assert decontam.shortest_cited_chunks(c, chunks).count() == 400
    rows, on = decontam._quotes(c, 1)
    assert decontam._quote_matches(rows, chunks, on).count() == 8 * 100


def test_nearest_vectors_by_either_way(spark, monkeypatch):
    import numpy as np

    x = np.random.default_rng(1).standard_normal((300, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [1.0, 2.0]), (903, (2 * x[0]).tolist())]
    v = spark.createDataFrame(rows, "vec_id long, v array<double>")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    unit = {i: np.array(u) / np.linalg.norm(u) for i, u in rows if u and any(u)}
    expected = set()
    for a in (i for i in unit if i % 50 == 0):
        near = sorted((-round(float(unit[a] @ u), 6), b) for b, u in unit.items() if b != a and len(u) == len(unit[a]))
        expected |= {(a, b) for _, b in near[:7]}
    for sent in (1 << 20, 0):
        monkeypatch.setattr(retrieval, "SENT_BYTES", sent)
        monkeypatch.setattr(retrieval, "BLOCK_ROWS", 64)
        assert {(r.query_id, r.vec_id) for r in retrieval.top_k(q, v, k=7).collect()} == expected


def test_missing_models_keep_the_first_order(spark):
    pool = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2), (1, 12, 0.7, 3)], "query_id long, vec_id long, score double, rank int")

    def missing():
        raise ImportError("no such library")

    got = retrieval.rerank_with(pool, missing, top=2).orderBy("final_rank").collect()
    assert [(r.vec_id, r.reranked, r.model_score) for r in got] == [(10, False, None), (11, False, None)]
    got = retrieval.rerank_with(pool, lambda: lambda rows: [r["rank"] for r in rows], top=2).orderBy("final_rank").collect()
    assert [(r.vec_id, r.reranked) for r in got] == [(12, True), (11, True)]


def test_usage_crosses_buckets(spark):
    import random

    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), rng.randint(0, 500), float(i % 5)) for i in range(300)] + [(999, "a", None, 1.0)]
    df = spark.createDataFrame(rows, "i int, p string, s int, tokens double").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.i: (r.n_window, r.tokens_window) for r in quota.rolling_usage(df, "p", "ts", "tokens", 60).collect()}
    for i, p, s, _ in rows[:-1]:
        held = [t for _, q, u, t in rows[:-1] if q == p and s - 60 < u <= s]
        assert got[i] == (len(held), sum(held))
    assert got[999] == (None, None) and len(got) == 301


def test_usage_is_made_of_running_aggregates(spark):
    """The oldest event of a window is known, and no window is summed anew at each of its events."""
    rows = [(i, "ab"[i % 2], i * i % 701, 1.0) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, p string, s int, tokens double").withColumn("ts", F.timestamp_seconds("s"))
    used = quota.rolling_usage(df, "p", "ts", "tokens", 60)
    got = {r.i: r.oldest_window for r in used.collect()}
    for i, p, s, _ in rows:
        assert got[i] == min(u for _, q, u, _ in rows if q == p and s - 60 < u <= s) * 1_000_000
    plan = used._jdf.queryExecution().optimizedPlan().toString()
    assert "specifiedwindowframe(RangeFrame, unboundedpreceding$(), " in plan and "specifiedwindowframe(RangeFrame, -" not in plan


def test_draws_are_even_and_scale(spark):
    df = spark.range(200_000).select(bootstrap.draw(5, F.col("id") % 100, F.floor(F.col("id") / 100), 10).alias("x"))
    counts = [r["count"] for r in df.groupBy("x").count().collect()]
    assert len(counts) == 10 and max(counts) < 1.05 * min(counts)
    big = spark.range(1000).select(bootstrap.draw(5, F.lit(1), F.col("id"), 1 << 40).alias("x"))
    low, high, distinct = big.agg(F.min("x"), F.max("x"), F.countDistinct("x")).first()
    assert 0 <= low < 1 << 36 and (1 << 40) - (1 << 36) < high < 1 << 40 and distinct == 1000


class Bytes:
    """A tokenizer of bytes with marks for turns."""

    def ids(self, messages, generation):
        out = [x for m in messages for x in (1, *m["content"].encode(), 2)]
        return [*out, 1] if generation else out

    def text(self, ids):
        return bytes(x for x in ids if x > 2).decode()


def test_supervised_examples(spark):
    m = lambda *texts, roles=("system", "user", "assistant"): [{"role": r, "content": t} for r, t in zip(roles, texts, strict=False)]
    rows = [(1, m("s", "q", "answer")), (2, m("s", "q", "x" * 99)), (3, m("s", "q")), (4, m("s", "q", "")), (5, None)]
    df = spark.createDataFrame(rows, "id int, messages array<struct<role:string,content:string>>")
    got = {r.id: r for r in training.encode_examples(df, Bytes, 40).collect()}
    assert got[1].labels == [-100] * 7 + [*b"answer", 2] and len(got[1].input_ids) == len(got[1].labels) and got[1].problem is None
    assert [got[i].problem for i in (2, 3, 5)] == ["over_length", "roles", "roles"] and got[4].problem is None

    class Other(Bytes):
        def ids(self, messages, generation):
            return [3, *super().ids(messages, generation)] if generation else super().ids(messages, generation)

    assert training.supervised(rows[0][1], Other(), 40)[2] == "prompt_is_no_prefix"


def test_schemas_and_clocks():
    kind = T.StructType([T.StructField("score", T.DoubleType(), True), T.StructField("flags", T.ArrayType(T.StringType()), False), T.StructField("n", T.IntegerType(), False)])
    made = training.json_schema(kind, {"flags": ["a", "b"]})
    assert made["required"] == ["score", "flags", "n"] and made["additionalProperties"] is False
    assert made["properties"] == {"score": {"type": ["number", "null"]}, "flags": {"type": "array", "items": {"type": "string", "enum": ["a", "b"]}}, "n": {"type": "integer"}}
    assert training.deadline(None, 10.0) == (10.0, 72_010.0) == training.deadline((10.0, 72_010.0), 5000.0)
    for prior, now in (((10.0, 72_011.0), 20.0), ((10.0, 72_010.0), 71_500.0)):
        with pytest.raises(ValueError):
            training.deadline(prior, now)
    assert [training.barrier_due(*x) for x in ((5, 0.0), (4, 299.0), (1, 300.0), (0, 999.0))] == [True, False, True, False]


def test_named_models_are_skipped_or_errors(spark):
    df = spark.createDataFrame([(1, "I am Qwen2.5, made to help"), (2, "the qwenish tale"), (3, None)], "i int, t string")
    assert sorted(r.i for r in curation.unnamed(df, "t", ["qwen", "llama"], "skip").collect()) == [2, 3]
    with pytest.raises(FAILS, match="names its model"):
        curation.unnamed(df, "t", ["qwen"]).collect()


def test_prompts_need_their_clauses(spark):
    df = spark.createDataFrame([("say A now",)], "t string")
    assert df.select(X.adapt(F.col("t"), [("A", "B"), ("B now", "C")])).first()[0] == "say C"
    with pytest.raises(FAILS, match="lacks"):
        df.select(X.adapt(F.col("t"), [("Z", "B")])).collect()


def test_sinks_and_config(spark, tmp_path):
    df = spark.createDataFrame([(i, {"b": i, "a": 1}, None if i % 2 else "x\ny") for i in (3, 1, 2)], "id int, m map<string,int>, t string")
    assert writers.write_sorted_csv(df, str(tmp_path / "s"), "id") == 3
    raw = "".join(p.read_text() for p in sorted((tmp_path / "s").glob("part-*")))
    assert raw.index('"1"') < raw.index('"2"') < raw.index('"3"') and '{""a"":1,""b"":1}' in raw
    writers.write_json(spark, {"b": [1, "é"], "a": None}, f"file://{tmp_path}/c.json")
    writers.write_json(spark, {"b": [1, "é"], "a": 2}, f"file://{tmp_path}/c.json")
    assert readers.read_config(spark, f"file://{tmp_path}/c.json") == {"a": 2, "b": [1, "é"]}
    (tmp_path / "twice.json").write_text('{"a": 1, "a": 2}')
    with pytest.raises(ValueError):
        readers.read_config(spark, str(tmp_path / "twice.json"))
    writers.write_jsonl(spark.createDataFrame([(1, None), (2, "é")], "i int, t string").coalesce(1), str(tmp_path / "j"))
    assert [json.loads(x) for p in (tmp_path / "j").glob("part-*") for x in p.read_text().splitlines()] == [{"i": 1, "t": None}, {"i": 2, "t": "é"}]
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "i int, k string").write.parquet(str(tmp_path / "v"))
    read = readers.read_vectors(spark, str(tmp_path / "v"), {"k": ["a", "c"]})
    assert sorted(r.i for r in read.collect()) == [1, 3] and "PushedFilters: [In(k, [a,c])]" in read._jdf.queryExecution().executedPlan().toString()


def test_listed_members_are_checked(spark, tmp_path):
    import hashlib
    import io
    import tarfile

    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w") as tar:
        info = tarfile.TarInfo("a")
        info.size = 3
        tar.addfile(info, io.BytesIO(b"one"))
    (tmp_path / "x.tar").write_bytes(buffer.getvalue())
    listed = lambda data: spark.createDataFrame([("a", hashlib.sha256(data).hexdigest().upper())], "member string, sha256 string")
    assert readers.read_tar_members(spark, str(tmp_path / "x.tar"), "a", listed(b"one")).count() == 1
    with pytest.raises(FAILS, match="not the listed content"):
        readers.read_tar_members(spark, str(tmp_path / "x.tar"), "a", listed(b"two")).collect()


def test_layout_bands(spark):
    s = "doc_id string, page int, x0 double, x1 double, y0 double, width double, size double, text string"
    left, right, wide = (5.0, 40.0), (60.0, 95.0), (5.0, 95.0)
    blocks = [("d", 1, *x, y, 100.0, 8.0, t) for x, y, t in ((left, 1.0, "l1"), (right, 2.0, "r1"), (wide, 10.0, "W"), (right, 11.0, "r2"), (left, 12.0, "l2"))]
    assert readers.layout_order(spark.createDataFrame(blocks, s)).first().text == "l1\nr1\nW\nl2\nr2"


def test_extremes_and_claims(spark):
    df = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", None), ("d", 0.1)], "k string, s double")
    assert tuple(metrics.extremes(df, "k", "s").first()) == ("a", "d")
    assert metrics.throughput(spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-01 02:00:00",)], "t string").select(F.col("t").cast("timestamp")), "t", 6).first().eta_hours == 6.0
    f = reporting.faithfulness(spark.createDataFrame([("m", ["supported"]), ("m", []), ("m", ["unsupported", "contradicted"])], "m string, labels array<string>"), ["m"]).first()
    assert [round(x, 2) for x in (f.any_unsupported, f.fully_supported, f.any_contradicted, f.any_partial, f.no_factual_claims)] == [0.33, 0.33, 0.33, 0.0, 0.33]


def test_wide_form_of_metrics(spark):
    long = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0)], "k string, metric string, value double")
    assert metrics.to_wide(long, ["k"], ["x", "y"]).first().asDict() == {"k": "a", "x": 1.0, "y": 2.0}
    assert gates.GateError is GateError and set(ORACLE_SQL) <= set(QUERIES)


def test_tiles_of_a_group_meet_each_pair_once(spark, monkeypatch):
    """A group far beyond a tile, with repeated rows, gives the pairs of one join, and no key holds more than two parts."""
    monkeypatch.setattr(curation, "TILE_ROWS", 8)
    rows = [("g", i, [i + 1, i + 2], [i - 5] if i % 3 == 0 else None) for i in range(90)] + [("g", 7, [], None), ("h", 1, [], None), ("h", 2, [1], None), ("h", 3, None, None), (None, 1, [], None), (None, 2, [], None)]
    df = spark.createDataFrame(rows, "q string, k int, near array<int>, far array<int>")
    got = [tuple(r) for r in curation.uncovered_pairs(df, "q", "k", ["near", "far"]).collect()]
    lists = lambda r: (r[2] or []) + (r[3] or [])
    expected = [(x[0], x[1], y[1]) for x in rows for y in rows if x[0] and x[0] == y[0] and x[1] < y[1] and y[1] not in lists(x) and x[1] not in lists(y)]
    assert sorted(got) == sorted(expected) and len(got) > 3000
