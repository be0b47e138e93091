"""Queries over curation gates, evidence, checkpoints and report tables, derived from the provided tables by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import bootstrap, gates
from millrace.operators import curation as C
from millrace.operators import metrics as M
from millrace.operators import quota as Q
from millrace.operators import refusal as R
from millrace.operators import reporting as P
from millrace.operators import votes as V
from millrace.plans.registry import query
from millrace.session import table


def _pick(index, *values):
    """The value at ``index`` modulo their number."""
    return F.get(F.array(*(F.lit(v) for v in values)), F.pmod(index, F.lit(len(values))).cast("int"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")



@query("SELECT doc_id FROM (SELECT doc_id, ['test', 'dev', 'seed'][doc_id % 3 + 1] AS split FROM documents) WHERE split = 'dev'")
def default_split(spark, sf_dir):
    """Rows of the default split of a dataset version."""
    doc_id = F.col("doc_id")
    rows = _docs(spark, sf_dir).select("doc_id", _pick(doc_id, "test", "dev", "seed").alias("split"))
    return C.of_split(rows, None, "v2", {"v1": "test", "v2": "dev"}).select("doc_id")


@query("""
    WITH r AS (SELECT doc_id, list_filter([CASE WHEN lang IS DISTINCT FROM 'en' THEN 'product' END, CASE WHEN doc_id % 5 = 0 THEN 'split' END, CASE WHEN doc_id % 7 = 0 THEN 'status' END,
        CASE WHEN doc_id % 11 = 0 THEN 'unresolved_citations' END, CASE WHEN doc_id % 13 IN (0, 1) THEN 'screen' END], lambda x: x IS NOT NULL) AS r FROM documents)
    SELECT doc_id, array_to_string(r, ',') AS reasons FROM r WHERE len(r) > 0""")
def eligibility_gate(spark, sf_dir):
    """Records that may not be exported, with every rule they break."""
    doc_id = F.col("doc_id")
    rows = _docs(spark, sf_dir).select(
        "doc_id", F.col("lang").alias("product"), F.when(doc_id % 5 == 0, "test").otherwise("train").alias("split"), F.when(doc_id % 7 == 0, "rejected").otherwise("accepted").alias("validation_status"),
        F.when(doc_id % 11 == 0, F.array(F.lit("c"))).when(doc_id % 2 == 0, F.array().cast("array<string>")).alias("unresolved_citations"), F.when(doc_id % 13 != 1, doc_id % 13 != 0).alias("screen_passed"),
    )
    return C.ineligible(rows, "en").select("doc_id", F.array_join("reasons", ",").alias("reasons"))


@query("SELECT c_custkey FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery')")
def held_out_gate(spark, sf_dir):
    """Rows that name an excluded party."""
    return C.held_out(table(spark, sf_dir, "customer"), "c_mktsegment", ["Building", "MACHINERY"]).select("c_custkey")


@query("""
    WITH f AS (SELECT item_id * 11 AS id, item_id AS k FROM benchmark), s AS (SELECT doc_id AS id, doc_id % 400 AS q, doc_id % 90 AS a FROM documents),
    r AS (SELECT id, [CASE WHEN a IN (SELECT k FROM f) THEN 'answer_overlap' END, CASE WHEN id IN (SELECT id FROM f) THEN 'forbidden_id' END, CASE WHEN id % 7 = 0 THEN 'not_seed' END,
        CASE WHEN q IN (SELECT k FROM f) THEN 'question_overlap' END, CASE WHEN id % 17 = 0 THEN 'test_or_dev_intent_cluster' END, CASE WHEN id % 5 IN (1, 4) THEN 'unverified' END] AS r FROM s)
    SELECT id, array_to_string(list_filter(r, lambda x: x IS NOT NULL), ',') AS reasons FROM r""")
def seed_leakage(spark, sf_dir):
    """All reasons why a seed may not be trained on; its question may differ from a protected one in a letter."""
    doc_id = F.col("doc_id")
    digest = lambda k, c: F.sha2(F.concat(F.lit(k), c.cast("string")), 256)
    seeds = _docs(spark, sf_dir).select(
        doc_id.alias("id"), F.when(doc_id % 7 == 0, "test").otherwise("seed").alias("split"), F.concat(digest("q", doc_id % 400), F.when(doc_id % 2 == 0, "").otherwise("x")).alias("question"),
        digest("a", doc_id % 90).alias("gold_answer"), _pick(doc_id, "verified", "pending", "council_verified", "council_adjudicated", None).alias("review_status"),
    )
    item = F.col("item_id")
    forbidden = table(spark, sf_dir, "benchmark").select((item * 11).alias("id"), digest("q", item).alias("question"), digest("a", item).alias("gold_answer"))
    blocked = _docs(spark, sf_dir).where(doc_id % 17 == 0).select(doc_id.alias("id"))
    return C.seed_leakage(seeds, forbidden, blocked).select("id", F.array_join("reasons", ",").alias("reasons"))


def _evidence():
    doc_id = F.col("doc_id")
    return F.array(F.struct(F.col("source").alias("doc"), (doc_id % 9).cast("string").alias("page")), F.struct(F.lit("other").alias("doc"), F.lit("1").alias("page")))


def _protected(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.concat(F.lit("src"), F.col("item_id") % 6).alias("doc"), (F.col("item_id") % 3).alias("page"))


@query("""
    WITH p AS (SELECT DISTINCT 'src' || (item_id % 6) AS doc, item_id % 3 AS page FROM benchmark),
    r AS (SELECT doc_id, [CASE WHEN doc_id % 4 = 0 THEN 'gate_a' END, CASE WHEN doc_id % 8 = 0 THEN 'zz' END, CASE WHEN doc_id % 6 = 0 AND doc_id % 12 <> 0 THEN 'missing_abstention_reason' END,
        CASE WHEN doc_id % 50 IN (SELECT item_id FROM benchmark) THEN 'normalised_duplicate_question' END, CASE WHEN (source, doc_id % 9) IN (SELECT (doc, page) FROM p) THEN 'protected_supporting_page_overlap' END] AS r FROM documents)
    SELECT doc_id, array_to_string(list_sort(list_filter(r, lambda x: x IS NOT NULL)), ',') AS reasons FROM r""")
def technical_reasons(spark, sf_dir):
    """Reasons of deterministic gates, known questions, protected pages and missing abstention reasons."""
    doc_id = F.col("doc_id")
    own = F.filter(F.array(F.when(doc_id % 4 == 0, "gate_a"), F.when(doc_id % 8 == 0, "zz")), lambda x: x.isNotNull())
    rows = _docs(spark, sf_dir).select(
        "doc_id", doc_id.alias("id"), F.concat(F.lit("What is  NO "), (doc_id % 50).cast("string"), F.lit("?")).alias("question"), F.when(doc_id % 6 == 0, "unanswerable").otherwise("answerable").alias("answerability"),
        F.when(doc_id % 12 == 0, "gap").when(doc_id % 18 == 0, " ").alias("abstention_reason"), _evidence().alias("evidence"), F.when(doc_id % 4 == 0, own).alias("gate_reasons"),
    )
    known = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("what is no "), F.col("item_id").cast("string"), F.lit("?")).alias("question"))
    return C.technical_reasons(rows, known, _protected(spark, sf_dir)).select("doc_id", F.array_join("reasons", ",").alias("reasons"))


@query("""
    WITH p AS (SELECT DISTINCT 'src' || (item_id % 6) AS doc, item_id % 3 AS page FROM benchmark), d AS (SELECT *, count(*) OVER (PARTITION BY doc_id // 3 * 3 + CASE WHEN doc_id % 3 = 1 THEN 0 ELSE doc_id % 3 END) AS n FROM documents),
    r AS (SELECT doc_id, doc_id % 5 <> 0 AND doc_id % 4 <> 0 AS open, CASE WHEN doc_id % 4 = 0 THEN 'rejected' ELSE 'accepted' END AS status,
        [CASE WHEN doc_id % 6 = 0 AND doc_id % 12 <> 0 THEN 'full_document_insufficiency_review_required' END, CASE WHEN (source, doc_id % 9) IN (SELECT (doc, page) FROM p) THEN 'protected_supporting_page_overlap' END,
         CASE WHEN n > 1 THEN 'repeated_question_template_review' END, CASE WHEN doc_id % 7 = 0 THEN 'training_semantic_screen_required' END] AS r FROM d),
    f AS (SELECT doc_id, status, CASE WHEN open THEN list_filter(r, lambda x: x IS NOT NULL) ELSE [] END AS r FROM r)
    SELECT doc_id, CASE WHEN len(r) > 0 THEN 'needs_review' ELSE status END AS status, array_to_string(CASE WHEN len(r) > 0 THEN list_sort(list_append(r, 'earlier')) ELSE ['earlier'] END, ',') AS reasons FROM f""")
def post_accept_exclusions(spark, sf_dir):
    """Accepted new rows that later gates send to review; every third row shares its template with the row before."""
    doc_id = F.col("doc_id")
    word = F.translate(F.concat((F.floor(doc_id / 3) * 3 + F.when(doc_id % 3 == 1, 0).otherwise(doc_id % 3)).cast("string"), F.lit("")), "0123456789", "abcdefghij")
    rows = _docs(spark, sf_dir).select(
        "doc_id", doc_id.alias("id"), F.concat(F.lit("Cover for "), word, F.lit(" up to "), doc_id.cast("string")).alias("question"), F.when(doc_id % 6 == 0, "unanswerable").otherwise("answerable").alias("answerability"),
        _evidence().alias("evidence"), F.when(doc_id % 4 == 0, "rejected").otherwise("accepted").alias("status"), F.array(F.lit("earlier")).alias("reasons"), (doc_id % 5 != 0).alias("is_new"), F.when(doc_id % 14 != 0, doc_id % 7 != 0).alias("screened"), (doc_id % 12 == 0).alias("absence_verified"),
    )
    return C.after_acceptance(rows, _protected(spark, sf_dir)).select("doc_id", "status", F.array_join("reasons", ",").alias("reasons"))


@query("""
    SELECT 'duplicates' AS pattern, count(*) FILTER (doc_id % 4 = 0 OR doc_id % 9 = 0) AS n FROM documents
    UNION ALL SELECT 'leakage', count(*) FILTER (doc_id % 6 = 0 OR doc_id % 10 = 0) FROM documents""")
def reason_pattern_counts(spark, sf_dir):
    """Rows by words in their reasons; a row counts once for a pattern, whatever its reasons."""
    doc_id = F.col("doc_id")
    some = F.filter(F.array(F.when(doc_id % 4 == 0, "near_duplicate"), F.when(doc_id % 9 == 0, "Duplicate question"), F.when(doc_id % 6 == 0, "protected_page"), F.when(doc_id % 10 == 0, "heldout_insurer"), F.when(doc_id % 3 == 0, "other")), lambda x: x.isNotNull())
    rows = _docs(spark, sf_dir).select(F.when(doc_id % 2 == 0, some).otherwise(some).alias("reasons"))
    return C.reason_patterns(rows, {"duplicates": ["duplicate"], "leakage": ["protected", "heldout"]})


@query("""
    SELECT doc_id AS evaluation_id, CASE WHEN doc_id % 10 = 0 THEN false WHEN doc_id % 6 = 0 THEN quality = toxic AND doc_id % 9 <> 0 AND (doc_id % 4 <> 0) = (doc_id % 8 < 4)
        ELSE quality = toxic AND doc_id % 7 <> 0 END AS passed FROM labels""")
def calibration_gate(spark, sf_dir):
    """Fixtures whose vote has the expected score and a category that fits them."""
    doc_id = F.col("doc_id")
    labels = table(spark, sf_dir, "labels")
    answerable, abstains = doc_id % 4 != 0, doc_id % 6 == 0
    fixtures = labels.select(doc_id.alias("evaluation_id"), F.col("quality").cast("double").alias("expected"), answerable.alias("gold_answerable"), abstains.alias("deterministic_abstention"))
    category = F.when(abstains, F.when(doc_id % 8 < 4, "incorrect_abstention").otherwise("correct_abstention")).when(doc_id % 7 == 0, "correct_abstention").otherwise("correct_answer")
    votes = labels.where(doc_id % 10 != 0).select(doc_id.alias("evaluation_id"), F.col("toxic").cast("double").alias("correctness"), F.when(~abstains | (doc_id % 9 == 0), 1.0).alias("evidence_support"), category.alias("abstention_category"))
    return C.calibrated(votes, fixtures).select("evaluation_id", "passed")


@query("""
    SELECT 'row_count' AS problem, 3 AS n UNION ALL SELECT 'duplicate_key', count(*) - count(DISTINCT doc_id // 2) FROM documents
    UNION ALL SELECT 'hash_mismatch', count(*) FILTER (doc_id % 5 = 0) FROM documents""")
def bundle_gate(spark, sf_dir):
    """A bundle that differs from its manifest in rows, keys and contents."""
    doc_id = F.col("doc_id")
    rows = _docs(spark, sf_dir).select(F.floor(doc_id / 2).alias("key"), "text", F.when(doc_id % 5 == 0, F.lit("0")).when(doc_id % 2 == 0, F.upper(F.sha2("text", 256))).otherwise(F.sha2("text", 256)).alias("sha"))
    return C.bundle_problems(rows, "key", "text", "sha", rows.count() + 3)


PASSAGES = """
    c AS (SELECT conv_id AS answer_id, turn AS chunk_id, text, CASE WHEN turn % 2 = 0 THEN 'A.pdf' ELSE 'B.pdf' END AS filename FROM conversations),
    q AS (SELECT conv_id AS answer_id, turn AS occurrence, 'A.pdf' AS filename, CASE WHEN conv_id % 7 = 0 THEN '  ' WHEN turn % 3 = 2 THEN 'no such words ' || text ELSE '  ' || text || ' ' END AS quote FROM conversations WHERE conv_id % 5 <> 0)"""


@query(rf"""
    WITH {PASSAGES}, n AS (SELECT *, trim(regexp_replace(lower(quote), '[ \t\r\n]+', ' ', 'g')) AS k FROM q), t AS (SELECT *, trim(regexp_replace(lower(text), '[ \t\r\n]+', ' ', 'g')) AS t FROM c),
    h AS (SELECT answer_id, occurrence, k, EXISTS (SELECT 1 FROM t WHERE t.answer_id = n.answer_id AND t.filename = n.filename AND contains(t.t, n.k)) AS held FROM n),
    g AS (SELECT answer_id, bool_or(k = '') AS blank, count(*) FILTER (held AND k <> '') AS found, count(*) AS total FROM h GROUP BY answer_id),
    a AS (SELECT DISTINCT conv_id AS answer_id FROM conversations)
    SELECT answer_id, CASE WHEN g.answer_id IS NULL OR blank THEN 'unassessable' WHEN found = total THEN 'all_gold_quotes_located' WHEN found > 0 THEN 'some_gold_quotes_located' ELSE 'no_gold_quotes_located' END AS status,
           CASE WHEN coalesce(blank, true) THEN 0 ELSE found END AS found, coalesce(total, 0) AS total FROM a LEFT JOIN g USING (answer_id)""")
def evidence_presence(spark, sf_dir):
    """How many of an answer's quotes its chunks hold: all, some, none, or nothing to assess."""
    c = table(spark, sf_dir, "conversations")
    turn, conv = F.col("turn"), F.col("conv_id")
    chunks = c.select(conv.alias("answer_id"), turn.alias("chunk_id"), F.when(turn % 2 == 0, "A.pdf").otherwise("B.pdf").alias("filename"), F.lit("Acme").alias("insurer"), "text")
    quote = F.when(conv % 7 == 0, "  ").when(turn % 3 == 2, F.concat(F.lit("no such words "), "text")).otherwise(F.concat(F.lit("  "), "text", F.lit(" ")))
    cited = c.where(conv % 5 != 0).select(conv.alias("answer_id"), turn.alias("occurrence"), F.lit("A.pdf").alias("filename"), F.lit("ACME").alias("insurer"), quote.alias("quote"))
    bare = c.where(conv % 5 == 0).select(conv.alias("answer_id")).distinct()
    bare = bare.select("answer_id", *(F.lit(None).cast(cited.schema[n].dataType).alias(n) for n in ("occurrence", "filename", "insurer", "quote")))
    return C.evidence_presence(cited.unionByName(bare), chunks)


@query("""
    WITH g AS (SELECT doc_id AS qid, doc_id % 3 <> 0 AS answerable, ['council_verified', 'verified'][doc_id % 2 + 1] AS review FROM documents),
    cite AS (SELECT doc_id AS qid, i AS occurrence, 'f' || ((doc_id + i) % 12) AS filename, CAST((doc_id * (i + 1)) % 4 AS VARCHAR) AS section FROM documents, (SELECT unnest([0, 1, 2]) AS i) WHERE doc_id % 5 > i),
    k AS (SELECT item_id AS chunk_id, item_id AS position, 'f' || (item_id % 10) AS filename, CAST(item_id % 4 AS VARCHAR) AS section FROM benchmark),
    m AS (SELECT qid, occurrence, chunk_id, position FROM cite LEFT JOIN k USING (filename, section)),
    w AS (SELECT qid, bool_and(n > 0) AS ok FROM (SELECT qid, occurrence, count(chunk_id) AS n FROM m GROUP BY ALL) GROUP BY qid),
    f AS (SELECT qid, chunk_id, min((occurrence, position)) AS pos FROM m WHERE chunk_id IS NOT NULL GROUP BY ALL),
    c AS (SELECT qid, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY pos, chunk_id) AS cited FROM f GROUP BY qid),
    x AS (SELECT doc_id AS qid, CAST(doc_id % 8 AS VARCHAR) || ',' || CAST(doc_id % 8 + 100 AS VARCHAR) AS around FROM documents WHERE doc_id % 4 <> 0)
    SELECT g.qid, coalesce(CASE WHEN NOT answerable AND cited IS NULL THEN around ELSE cited END, '') AS chunks, NOT answerable AND cited IS NULL AS from_context,
           CASE WHEN NOT answerable AND cited IS NULL THEN around IS NOT NULL AND review = 'council_verified' ELSE coalesce(ok, false) END AS complete
    FROM g LEFT JOIN w ON w.qid = g.qid LEFT JOIN c ON c.qid = g.qid LEFT JOIN x ON x.qid = g.qid""")
def reference_packages(spark, sf_dir):
    """Cited chunks of every question in the order of citations, or its context where it has none."""
    doc_id = F.col("doc_id")
    docs, items = _docs(spark, sf_dir), table(spark, sf_dir, "benchmark")
    gold = docs.select(doc_id.alias("qid"), (doc_id % 3 != 0).alias("answerable"), _pick(doc_id, "council_verified", "verified").alias("review_status"))
    i = F.col("i")
    cite = docs.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("i")).where(doc_id % 5 > i)
    cite = cite.select(doc_id.alias("qid"), i.alias("occurrence"), F.concat(F.lit("f"), ((doc_id + i) % 12).cast("string")).alias("filename"), ((doc_id * (i + 1)) % 4).alias("section"))
    k = F.col("item_id")
    chunks = items.select(k.alias("chunk_id"), k.alias("position"), F.concat(F.lit("f"), (k % 10).cast("string")).alias("filename"), (k % 4).cast("string").alias("section"))
    around = docs.where(doc_id % 4 != 0).select(doc_id.alias("qid"), F.posexplode(F.array(doc_id % 8, doc_id % 8 + 100)).alias("position", "chunk_id"))
    p = C.reference_package(gold, cite, chunks, around)
    return p.select("qid", F.array_join(F.transform("chunk_ids", lambda x: x.cast("string")), ",").alias("chunks"), "from_context", "complete")


@query("""
    WITH i AS (SELECT ['all_gold_quotes_located', 'some_gold_quotes_located', 'unassessable'][doc_id % 3 + 1] AS status, CASE WHEN doc_id % 3 = 0 THEN coalesce(quality, 0) ELSE quality END AS c, doc_id % 5 = 0 AS refused FROM documents LEFT JOIN labels USING (doc_id) WHERE doc_id % 4 <> 0),
    s AS (SELECT unnest(['all_gold_quotes_located', 'some_gold_quotes_located', 'no_gold_quotes_located', 'unassessable']) AS status)
    SELECT s.status, count(i.status) AS n, round(CASE WHEN count(i.status) > 0 AND count(c) = count(i.status) THEN avg(c) END, 6) AS correctness, count(i.status) - count(c) AS unjudged,
           count(*) FILTER (refused) AS over_refusals, round(count(*) FILTER (refused) / nullif(count(i.status), 0), 6) AS over_refusal_rate FROM s LEFT JOIN i USING (status) GROUP BY s.status""")
def evidence_decomposition(spark, sf_dir):
    """Answerable items by whether their evidence was located."""
    doc_id = F.col("doc_id")
    d = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    score = F.when(doc_id % 3 == 0, F.coalesce("quality", F.lit(0))).otherwise(F.col("quality"))
    items = d.select((doc_id % 4 != 0).alias("answerable"), _pick(doc_id, C.ALL, C.SOME, C.UNASSESSABLE).alias("status"), score.alias("corr_item"), (doc_id % 5 == 0).alias("refused"))
    e = C.evidence_decomposition(items)
    return e.select("status", "n", F.round("correctness", 6).alias("correctness"), "unjudged", "over_refusals", F.round("over_refusal_rate", 6).alias("over_refusal_rate"))


@query(r"""
    WITH r AS (SELECT trim(regexp_replace(lower(text), '[ \t\r\n]+', ' ', 'g')) AS q, source, doc_id FROM documents),
    e AS (SELECT lang, source, doc_id % 6 AS section FROM documents WHERE doc_id % 4 <> 0 UNION ALL SELECT 'x', source, 1 FROM documents WHERE doc_id % 8 = 1)
    SELECT (SELECT count(DISTINCT q) FROM r) AS unique_questions, count(DISTINCT lang) AS insurers, count(DISTINCT source) AS source_documents, count(DISTINCT (source, section)) AS evidence_sections FROM e""")
def evidence_counts(spark, sf_dir):
    """Distinct questions, insurers, documents and sections over exploded evidence."""
    doc_id = F.col("doc_id")
    one = F.struct(F.col("lang").alias("insurer"), F.col("source").alias("source_id"), (doc_id % 6).alias("section"))
    two = F.struct(F.lit("x").alias("insurer"), F.col("source").alias("source_id"), F.lit(1).cast("long").alias("section"))
    evidence = F.when(doc_id % 8 == 1, F.array(one, two)).when(doc_id % 4 != 0, F.array(one))
    return C.evidence_counts(_docs(spark, sf_dir).select(F.col("text").alias("question"), evidence.alias("evidence")))


@query(r"""
    WITH k AS (SELECT trim(regexp_replace(lower(text), '[ \t\r\n]+', ' ', 'g')) AS q, count(*) AS size, count(DISTINCT doc_id % 2) AS labels FROM documents GROUP BY 1)
    SELECT size, count(*) AS clusters, count(*) FILTER (labels > 1) AS mixed FROM k WHERE size > 1 GROUP BY size""")
def question_clusters(spark, sf_dir):
    """Clusters of equal texts by size, and those with rows of different labels."""
    doc_id = F.col("doc_id")
    return C.question_clusters(_docs(spark, sf_dir).select("text", (doc_id % 2).alias("label")), "text", "label")


@query("""
    WITH m AS (SELECT event_id, user_id % 40 AS model, event_type AS phase, CASE WHEN event_id % 6 <> 0 THEN event_id // 20 END AS step FROM events),
    c AS (SELECT DISTINCT user_id % 40 AS model FROM events WHERE value > 190),
    o AS (SELECT *, max(step) OVER (PARTITION BY model, phase) AS latest FROM m WHERE step IS NOT NULL AND model NOT IN (SELECT model FROM c))
    SELECT event_id FROM o WHERE step = latest UNION ALL SELECT event_id FROM m WHERE step IS NULL""")
def latest_checkpoints(spark, sf_dir):
    """Members of the latest checkpoint of each model and phase, none of complete models, and members of no checkpoint."""
    e = table(spark, sf_dir, "events")
    members = e.select("event_id", (F.col("user_id") % 40).alias("model"), F.col("event_type").alias("phase"), F.when(F.col("event_id") % 6 != 0, F.floor(F.col("event_id") / 20)).alias("step"))
    complete = e.where("value > 190").select((F.col("user_id") % 40).alias("model"))
    return C.latest_checkpoints(members, complete).select("event_id")


@query("""
    WITH r AS (SELECT conv_id, turn, list_filter([turn + 1, CASE WHEN turn % 2 = 0 THEN turn + 2 END], lambda x: x IS NOT NULL) AS near, CASE WHEN turn % 3 = 0 THEN [turn - 3] END AS far FROM conversations)
    SELECT a.conv_id AS "group", a.turn AS a, b.turn AS b FROM r a JOIN r b ON a.conv_id = b.conv_id AND a.turn < b.turn
    WHERE NOT (list_contains(a.near, b.turn) OR list_contains(b.near, a.turn) OR coalesce(list_contains(a.far, b.turn), false) OR coalesce(list_contains(b.far, a.turn), false))""")
def uncovered_pairs(spark, sf_dir):
    """Pairs of a conversation's turns that neither of two lists covers."""
    turn = F.col("turn")
    near = F.filter(F.array(turn + 1, F.when(turn % 2 == 0, turn + 2)), lambda x: x.isNotNull())
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", near.alias("near"), F.when(turn % 3 == 0, F.array(turn - 3)).alias("far"))
    return C.uncovered_pairs(rows, "conv_id", "turn", ["near", "far"])


CELLS = ["model", "condition"]


def _cells(spark, sf_dir):
    """Items 0 to 75 of four models in two conditions, drawn from the documents' ids; a model lacks responses."""
    doc_id = F.col("doc_id")
    docs = _docs(spark, sf_dir).where(doc_id < 76).select("doc_id").distinct()
    m = F.col("m")
    grid = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("m")).withColumn("condition", F.explode(F.array(F.lit("base"), F.lit("base-rag"))))
    rag, x = F.col("condition") == "base-rag", doc_id + F.col("m") * 7
    answerable = doc_id >= 9
    cited = F.when(rag, x % 4).otherwise(x % 2)
    return grid.select(
        "doc_id", F.concat(F.lit("m"), m.cast("string")).alias("model"), "condition", answerable.alias("answerable"), ((m != 3) | (doc_id % 10 != 0)).alias("responded"), (x % 6 == 0).alias("refused"), cited.alias("n_cited"),
        F.least(cited, x % 3).alias("n_resolved"), (x % 5 != 0).alias("judged"), F.when(x % 7 != 0, (x % 3) / 2.0).alias("correctness"), F.when(x % 8 != 0, (x % 2) / 1.0).alias("reference_support"),
        ((x % 3) / 2.0).alias("citation_sum"), F.lit(1).alias("citation_n"),
    )


CELLS_SQL = """
    g AS (SELECT DISTINCT doc_id, m, c AS condition, doc_id + m * 7 AS x FROM documents, (SELECT unnest([0, 1, 2, 3]) AS m), (SELECT unnest(['base', 'base-rag']) AS c) WHERE doc_id < 76),
    i AS (SELECT *, 'm' || m AS model, doc_id >= 9 AS answerable, m <> 3 OR doc_id % 10 <> 0 AS responded, x % 6 = 0 AS refused, CASE WHEN condition = 'base-rag' THEN x % 4 ELSE x % 2 END AS cited, x % 5 <> 0 AS judged,
          CASE WHEN x % 7 <> 0 THEN (x % 3) / 2.0 END AS c, CASE WHEN x % 8 <> 0 THEN x % 2 END AS e, (x % 3) / 2.0 AS s FROM g),
    k AS (SELECT model, condition, condition = 'base-rag' AS rag, count(*) FILTER (responded) = 76 AS ok, count(*) FILTER (judged) AS judged, coalesce(sum(c) FILTER (judged), 0) AS c, count(c) FILTER (judged) AS cn,
          coalesce(sum(e) FILTER (judged), 0) AS e, count(e) FILTER (judged) AS en, sum(s) FILTER (judged) AS s, count(*) FILTER (responded AND (refused OR cited > 0)) AS parse, sum(least(cited, x % 3)) FILTER (responded) AS res,
          sum(cited) FILTER (responded) AS cit, count(*) FILTER (responded AND NOT answerable AND refused) AS good, count(*) FILTER (responded AND answerable AND refused) AS bad FROM i GROUP BY ALL),
    l AS (SELECT model, condition, ok, unnest([{'m': 'correctness', 'n': c::DOUBLE, 'd': cn}, {'m': 'reference_support', 'n': e::DOUBLE, 'd': en}, {'m': 'citation_support', 'n': (CASE WHEN rag THEN s ELSE 0 END)::DOUBLE, 'd': CASE WHEN rag THEN judged ELSE 0 END},
          {'m': 'parse_rate', 'n': parse::DOUBLE, 'd': 76}, {'m': 'citation_resolution', 'n': (CASE WHEN rag THEN res ELSE 0 END)::DOUBLE, 'd': CASE WHEN rag THEN cit ELSE 0 END}, {'m': 'appropriate_refusal_rate', 'n': good::DOUBLE, 'd': 9},
          {'m': 'false_refusal_rate', 'n': bad::DOUBLE, 'd': 67}, {'m': 'refusal_correctness', 'n': good::DOUBLE, 'd': good + bad}, {'m': 'balanced_abstention', 'n': ((67 - bad) * 9 + good * 67)::DOUBLE, 'd': 1206}, {'m': 'coverage', 'n': judged::DOUBLE, 'd': 76}]) AS v FROM k),
    r AS (SELECT model, condition, v.m AS metric, CASE WHEN ok THEN v.n END AS numerator, CASE WHEN ok THEN CAST(v.d AS BIGINT) ELSE 0 END AS denominator FROM l)"""


@query(f"WITH {CELLS_SQL} SELECT model, condition, metric, numerator, denominator, round(CASE WHEN denominator > 0 THEN numerator / denominator END, 6) AS value FROM r")
def report_long(spark, sf_dir):
    """Ten metrics of every cell with numerator and denominator; a cell without all responses has none."""
    long = P.report_long(P.report_cells(_cells(spark, sf_dir), CELLS, F.col("condition") == "base-rag", 67, 9), CELLS)
    return long.select(*CELLS, "metric", "numerator", "denominator", F.round("value", 6).alias("value"))


@query(f"""
    WITH {CELLS_SQL}, v AS (SELECT *, round(CASE WHEN denominator > 0 THEN numerator / denominator END, 6) AS value FROM r)
    SELECT model, condition, {", ".join(f"max(value) FILTER (metric = '{m}') AS {m}" for m in P.DEFINITIONS)} FROM v GROUP BY ALL""")
def report_wide(spark, sf_dir):
    """The same metrics, one row a cell; a gate compares both forms."""
    long = P.report_long(P.report_cells(_cells(spark, sf_dir), CELLS, F.col("condition") == "base-rag", 67, 9), CELLS)
    wide = P.report_wide(long, CELLS)
    gates.require_empty(P.wide_differs(wide, long, CELLS, list(P.DEFINITIONS)), "wide and long metrics differ")
    return wide.select(*CELLS, *(F.round(m, 6).alias(m) for m in P.DEFINITIONS))


def _responses(spark, sf_dir):
    doc_id = F.col("doc_id")
    d = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.select(
        F.col("source").alias("model"), F.col("lang").alias("condition"), (doc_id % 5 != 0).alias("answerable"), (doc_id % 6 == 0).alias("abstention"), (doc_id % 6 == 0).alias("refused"), (F.col("quality") / 1.0).alias("correctness"), F.when(doc_id % 3 != 0, doc_id % 3).alias("citation_count"),
        F.when(doc_id % 3 != 0, doc_id % 2).alias("resolved_citation_count"), (F.col("n_chars") / 10.0).alias("latency_seconds"), (doc_id % 7 != 0).alias("parse_success"), (doc_id % 41 / 8.0).alias("peak_gib"),
    )


RESPONSES_SQL = """
    d AS (SELECT source AS model, lang AS condition, doc_id % 5 <> 0 AS a, doc_id % 6 = 0 AS r, quality AS c, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 3 END AS cit, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 2 END AS res, n_chars / 10.0 AS s,
          CAST(doc_id % 7 <> 0 AS INTEGER) AS p, (doc_id % 41) / 8.0 AS peak FROM documents LEFT JOIN labels USING (doc_id)),
    m AS (SELECT model, condition, count(*) AS n, count(c) AS j, avg(c) AS mc, 100.0 * count(*) FILTER (c = 1) / nullif(count(c), 0) AS full_pct, 100.0 * count(*) FILTER (c = 0) / nullif(count(c), 0) AS wrong, count(*) FILTER (a AND r) AS ur,
          count(*) FILTER (a AND r) / nullif(count(*) FILTER (a), 0) AS urr, count(*) FILTER (NOT a AND r) AS cr, count(*) FILTER (NOT a AND r) / nullif(count(*) FILTER (NOT a), 0) AS crr, coalesce(sum(cit), 0) AS cit, sum(res) / nullif(sum(cit), 0) AS res,
          avg(s) AS s, avg(p) AS p, max(peak) AS peak FROM d GROUP BY ALL)"""


@query(f"""
    WITH {RESPONSES_SQL}
    SELECT model, condition, n AS population_n, j AS judged_n, n - j AS pending_or_uncertain_n, round(mc, 6) AS mean_correctness, round(full_pct, 6) AS fully_correct_pct, round(wrong, 6) AS incorrect_pct, ur AS unnecessary_refusal_n,
           round(urr, 6) AS unnecessary_refusal_rate, cr AS correct_refusal_n, round(crr, 6) AS correct_refusal_rate, round(0.5 * (1 - urr + crr), 6) AS balanced_abstention, CAST(cit AS BIGINT) AS citation_n, round(res, 6) AS citation_resolution,
           round(s, 6) AS mean_latency_seconds, round(p, 6) AS parse_rate, CASE WHEN j = 0 THEN 'unjudged' ELSE 'preliminary_unvalidated' END AS status FROM m""")
def semantic_summary(spark, sf_dir):
    """Correctness, refusals, citations and latency by model and condition."""
    s = P.semantic_summary(_responses(spark, sf_dir), CELLS).drop("partial_pct")
    kinds = {f.name: f.dataType.simpleString() for f in s.schema.fields}
    return s.select(*(F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c) for c in s.columns))


@query(f"""
    WITH {RESPONSES_SQL}
    SELECT model, condition, n, round(urr, 6) AS unnecessary_refusal_rate, round(crr, 6) AS correct_refusal_rate, round(0.5 * (crr + 1 - urr), 6) AS balanced_abstention, round(res, 6) AS citation_resolution, round(p, 6) AS parse_rate,
           round(s, 6) AS mean_latency_seconds, max(peak) OVER (PARTITION BY model)::DOUBLE AS peak_gib FROM m""")
def benchmark_summary(spark, sf_dir):
    """Rates and latency by model and condition, with a model's peak memory over all its conditions."""
    s = P.benchmark_summary(_responses(spark, sf_dir), "model", "condition")
    return s.select(*CELLS, "n", *(F.round(c, 6).alias(c) for c in ("unnecessary_refusal_rate", "correct_refusal_rate", "balanced_abstention", "citation_resolution", "parse_rate", "mean_latency_seconds")), "peak_gib")


@query("""
    WITH a AS (SELECT event_type AS provider, user_id, event_id, CASE WHEN event_id % 3 = 0 THEN 'success' ELSE 'known_invalid' END AS s, CASE event_id % 4 WHEN 0 THEN 'schema' WHEN 1 THEN 'span' WHEN 2 THEN '' END AS e FROM events),
    l AS (SELECT provider, user_id, count(*) AS n, arg_max(s, event_id) AS s, arg_max(coalesce(e, '~'), event_id) AS e FROM a GROUP BY ALL)
    SELECT provider, 'state' AS kind, s AS category, count(*) AS n FROM a GROUP BY ALL UNION ALL SELECT provider, 'error', e, count(*) FROM a WHERE e <> '' GROUP BY ALL
    UNION ALL SELECT provider, 'exhausted', CASE WHEN e = '~' THEN 'unknown' ELSE e END, count(*) FROM l WHERE n >= 3 AND s = 'known_invalid' GROUP BY ALL""")
def failure_categories(spark, sf_dir):
    """Attempt statuses, validation errors and last errors of exhausted tasks, by provider."""
    e = table(spark, sf_dir, "events")
    one = F.struct("event_id", F.when(F.col("event_id") % 3 == 0, "success").otherwise("known_invalid").alias("status"), _pick(F.col("event_id"), "schema", "span", "", None).alias("validation_error"))
    histories = e.groupBy(F.col("event_type").alias("provider"), "user_id").agg(F.sort_array(F.collect_list(one)).alias("attempts"))
    return P.failure_categories(histories, "provider")


@query("""
    WITH v AS (SELECT lang AS family, CASE WHEN doc_id % 2 = 0 THEN 'base' ELSE 'sft' END AS arm, source AS slice, avg(quality) AS v FROM documents LEFT JOIN labels USING (doc_id) WHERE NOT (lang = 'fr' AND doc_id % 2 = 1) GROUP BY ALL)
    SELECT slice, family, round(max(v) FILTER (arm = 'base'), 6) AS before, round(max(v) FILTER (arm = 'sft'), 6) AS after, round(max(v) FILTER (arm = 'sft') - max(v) FILTER (arm = 'base'), 6) AS delta FROM v GROUP BY ALL""")
def effect_grid(spark, sf_dir):
    """A metric before and after by slice and family; a missing arm leaves the difference null."""
    doc_id = F.col("doc_id")
    d = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left").where(~((F.col("lang") == "fr") & (doc_id % 2 == 1)))
    v = d.groupBy(F.col("source").alias("slice"), F.col("lang").alias("family"), F.when(doc_id % 2 == 0, "base").otherwise("sft").alias("arm")).agg(F.avg("quality").alias("value"))
    return P.effect_grid(v, ["slice", "family"], "arm", "base", "sft").select("slice", "family", *(F.round(c, 6).alias(c) for c in ("before", "after", "delta")))


@query("""
    WITH a AS (SELECT lang AS model, list_filter([CASE WHEN doc_id % 2 = 0 THEN 'supported' END, CASE WHEN doc_id % 3 = 0 THEN 'unsupported' END, CASE WHEN doc_id % 5 = 0 THEN 'contradicted' END, CASE WHEN doc_id % 7 = 0 THEN 'partially_supported' END], lambda x: x IS NOT NULL) AS l FROM documents),
    f AS (SELECT model, CAST(list_contains(l, 'unsupported') AS INT) AS u, CAST(len(l) > 0 AND len(list_filter(l, lambda x: x <> 'supported')) = 0 AS INT) AS s, CAST(list_contains(l, 'contradicted') AS INT) AS c, CAST(list_contains(l, 'partially_supported') AS INT) AS p, CAST(len(l) = 0 AS INT) AS z FROM a)
    SELECT model, count(*) AS n, round(avg(u), 6) AS any_unsupported, round(avg(s), 6) AS fully_supported, round(avg(c), 6) AS any_contradicted, round(avg(p), 6) AS any_partial, round(avg(z), 6) AS no_factual_claims FROM f GROUP BY model""")
def faithfulness_rates(spark, sf_dir):
    """Rates of answers by what their claims are."""
    doc_id = F.col("doc_id")
    labels = F.filter(F.array(F.when(doc_id % 2 == 0, "supported"), F.when(doc_id % 3 == 0, "unsupported"), F.when(doc_id % 5 == 0, "contradicted"), F.when(doc_id % 7 == 0, "partially_supported")), lambda x: x.isNotNull())
    f = P.faithfulness(_docs(spark, sf_dir).select(F.col("lang").alias("model"), labels.alias("labels")), ["model"])
    return f.select("model", "n", *(F.round(c, 6).alias(c) for c in ("any_unsupported", "fully_supported", "any_contradicted", "any_partial", "no_factual_claims")))


PRIME = bootstrap.PRIME


def _squares_sql(name: str, source: str, seed: int, slot: str, keep: str) -> str:
    """Steps ``name0`` to ``name2``: the remainders of :func:`bootstrap.remainder` for the slots of ``source``."""
    first = f"(b * 48271 + ({slot}) % {PRIME} * 16807 + {seed % PRIME + 1}) % {PRIME}"
    steps = [f"{name}0 AS (SELECT {keep}, (x * x + 12345) % {PRIME} AS x FROM (SELECT {keep}, {first} AS x FROM {source}))"]
    steps += [f"{name}{i + 1} AS (SELECT {keep}, (x * x + {add}) % {PRIME} AS x FROM {name}{i})" for i, add in enumerate((67891, 24683))]
    return ", ".join(steps)


def _draw_sql(seed: int, units: str, b: int) -> str:
    """Draws of ``b`` replicates over the rows of ``units(i, n, ...)``: counts by block, then places within blocks."""
    return f"""
        k AS (SELECT max(n) AS n, least({bootstrap.MOST_BLOCK}, greatest({bootstrap.LEAST_BLOCK}, CAST(ceil(max(n) / {bootstrap.BLOCKS}.0) AS BIGINT))) AS size FROM {units}),
        sl AS (SELECT r.b, s.i FROM (SELECT unnest(range({b})) AS b) r, {units} s), {_squares_sql("x", "sl", seed, "i", "b, i")},
        c AS (SELECT b, x * k.n // {PRIME} // k.size AS blk, count(*) AS m FROM x2, k GROUP BY ALL),
        dr AS (SELECT b, blk, unnest(range(m)) AS t FROM c), tl AS (SELECT dr.*, (k.n + k.size - 1) // k.size AS blocks FROM dr, k), {_squares_sql("y", "tl", seed + bootstrap.WITHIN, "t * blocks + blk", "b, blk")},
        drawn AS (SELECT y2.b, u.* FROM y2, k JOIN {units} u ON u.i = blk * k.size + x * least(k.size, k.n - blk * k.size) // {PRIME})"""


def _interval_sql(variant: str, units: str, statistic: str, lo: str, hi: str) -> str:
    b, seed, _ = bootstrap.VARIANTS[variant]
    return f"""WITH u AS ({units}), {_draw_sql(seed, "u", b)}, st AS (SELECT b, {statistic} AS v FROM drawn GROUP BY b), o AS (SELECT list_sort(list(v)) AS s FROM st WHERE v IS NOT NULL AND NOT isnan(v))
        SELECT round(s[{lo} + 1], 6) AS lo, round(s[{hi} + 1], 6) AS hi, CAST(len(s) AS INTEGER) AS kept FROM o"""


UNITS = "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n, quality::DOUBLE AS v, toxic::DOUBLE AS w, doc_id FROM labels"


def _interval(df, variant):
    return df.select(F.lit(variant).alias("variant"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "kept")


@query(" UNION ALL ".join(f"SELECT '{v}' AS variant, * FROM ({_interval_sql(v, UNITS, 'avg(v)', lo, hi)})" for v, lo, hi in (("metric", "25", "975"), ("reporting_mean", "49", "1949"), ("paired_correctness", "CAST(floor(len(s) * 0.025) AS INT)", "least(CAST(floor(len(s) * 0.975) AS INT), len(s) - 1)"))))
def bootstrap_ci(spark, sf_dir):
    """Intervals of mean quality by variant."""
    q = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("v"))
    parts = [_interval(bootstrap.interval(q, "doc_id", F.avg("v"), name), name) for name in ("metric", "reporting_mean", "paired_correctness")]
    return parts[0].union(parts[1]).union(parts[2])


@query(_interval_sql("parse_rate", "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n, (toxic - quality)::DOUBLE AS v FROM labels", "avg(v)", "124", "4874"))
def bootstrap_parse_rate(spark, sf_dir):
    """Interval of the difference of two parse rates over the same questions."""
    q = table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") - F.col("quality")).cast("double").alias("v"))
    return _interval(bootstrap.interval(q, "doc_id", F.avg("v"), "parse_rate"), "").drop("variant")


KAPPA_SQL = "CASE WHEN abs((sum(a*a) + sum(c*c) - 2.0 * sum(a) * sum(c) / count(*)) / 4) < 1e-12 THEN 1.0 ELSE 1 - (sum((a-c)*(a-c)) / 4.0) / ((sum(a*a) + sum(c*c) - 2.0 * sum(a) * sum(c) / count(*)) / 4) END"


@query(_interval_sql("kappa", "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n, doc_id % 3 AS a, (doc_id + quality) % 3 AS c FROM labels", KAPPA_SQL, "CAST(floor(len(s) * 0.025) AS INT)", "least(CAST(floor(len(s) * 0.975) AS INT), len(s) - 1)"))
def bootstrap_kappa(spark, sf_dir):
    """Interval of weighted kappa over resampled pairs."""
    doc_id = F.col("doc_id")
    p = table(spark, sf_dir, "labels").select("doc_id", (doc_id % 3).alias("a"), ((doc_id + F.col("quality")) % 3).alias("c"))
    return _interval(bootstrap.interval(p, "doc_id", M.weighted_kappa_of("a", "c"), "kappa"), "").drop("variant")


@query(f"""
    WITH p AS (SELECT d.lang || '/' || d.source AS grp, l.quality::DOUBLE AS x, l.toxic::DOUBLE AS y FROM labels l JOIN documents d USING (doc_id) WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL AND d.lang IS NOT NULL AND d.source IS NOT NULL),
    g AS (SELECT grp, sum(y - x) AS d, count(*) AS c FROM p GROUP BY grp), u AS (SELECT row_number() OVER (ORDER BY grp) - 1 AS i, count(*) OVER () AS n, d, c FROM g),
    {_draw_sql(bootstrap.VARIANTS["paired_group"][1], "u", bootstrap.VARIANTS["paired_group"][0])}, st AS (SELECT b, sum(d) / sum(c) AS v FROM drawn GROUP BY b), o AS (SELECT list_sort(list(v)) AS s FROM st)
    SELECT round((SELECT sum(d) / sum(c) FROM g), 6) AS difference, (SELECT count(*) FROM g) AS groups, round(s[101], 6) AS lo, round(s[3901], 6) AS hi FROM o""")
def bootstrap_paired_groups(spark, sf_dir):
    """Difference of two labels' means, resampling whole groups of documents: those of a language and a source."""
    docs = table(spark, sf_dir, "documents").where("lang IS NOT NULL AND source IS NOT NULL").select("doc_id", F.concat_ws("/", "lang", "source").alias("grp"))
    pairs = table(spark, sf_dir, "labels").join(docs, "doc_id").select("grp", F.col("quality").cast("double").alias("x"), F.col("toxic").cast("double").alias("y"))
    return bootstrap.paired_groups(pairs, "grp", "x", "y").select(F.round("difference", 6).alias("difference"), "groups", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


def _composite_sql(p: str) -> str:
    return f"""(0.5 * coalesce(sum(CASE WHEN a THEN {p}c END) / nullif(count(CASE WHEN a THEN {p}c END), 0), 0) + 0.3 * coalesce(sum({p}s) / nullif(sum({p}t), 0), 0)
        + 0.2 * (coalesce(count(*) FILTER (NOT a AND {p}r) / nullif(count(*) FILTER (NOT a), 0), 1) + 1 - coalesce(count(*) FILTER (a AND {p}r) / nullif(count(*) FILTER (a), 0), 0)) / 2)"""


@query(f"""
    WITH u AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n, doc_id % 4 <> 0 AS a, doc_id % 6 = 0 AS xr, quality::DOUBLE AS xc, doc_id % 3 AS xs, 2 AS xt, doc_id % 5 = 0 AS yr, toxic::DOUBLE AS yc, doc_id % 2 AS ys, 2 AS yt FROM labels),
    {_draw_sql(0, "u", 1000)}, st AS (SELECT b, {_composite_sql("x")} - {_composite_sql("y")} AS v FROM drawn GROUP BY b), o AS (SELECT list_sort(list(v)) AS s, avg(CAST(v > 0 AS INT)) AS p FROM st)
    SELECT (SELECT count(*) FROM labels) AS n, round(p, 6) AS p_above, round(s[26], 6) AS lo, round(s[976], 6) AS hi FROM o""")
def bootstrap_paired_composite(spark, sf_dir):
    """How often one row's composite is above another's over the same questions, and the interval of the difference."""
    doc_id = F.col("doc_id")
    labels = table(spark, sf_dir, "labels")
    units = labels.select(
        "doc_id", (doc_id % 4 != 0).alias("answerable"), (doc_id % 6 == 0).alias("x_refused"), F.col("quality").cast("double").alias("x_corr_item"), (doc_id % 3).alias("x_n_sup"), F.lit(2).alias("x_n_tot"),
        (doc_id % 5 == 0).alias("y_refused"), F.col("toxic").cast("double").alias("y_corr_item"), (doc_id % 2).alias("y_n_sup"), F.lit(2).alias("y_n_tot"),
    )
    got = bootstrap.probability_above(units, "doc_id", M.composite("x_") - M.composite("y_"))
    return got.select("n", *(F.round(c, 6).alias(c) for c in ("p_above", "lo", "hi")))


@query("""
    WITH v AS (SELECT doc_id AS task, n AS vote, CASE WHEN doc_id % 5 = 0 THEN 'x' || n ELSE 'm' END AS model FROM labels, (SELECT unnest([1, 2, 3]) AS n)),
    w AS (SELECT task, CASE WHEN task % 11 = 0 AND vote = 3 THEN 2 WHEN task % 7 = 0 AND vote = 2 THEN 9 ELSE vote END AS vote, model FROM v)
    SELECT * FROM (SELECT task, CASE WHEN bool_or(vote NOT IN (1, 2, 3)) THEN 'invalid_vote_index' WHEN count(DISTINCT vote) < count(*) THEN 'duplicate_vote' WHEN count(DISTINCT model) > 1 THEN 'mixed_judges' END AS problem FROM w GROUP BY task) WHERE problem IS NOT NULL""")
def vote_set_gate(spark, sf_dir):
    """Tasks whose votes may not be merged."""
    doc_id = F.col("doc_id")
    t, v = F.col("task"), F.col("v")
    rows = table(spark, sf_dir, "labels").select(doc_id.alias("task"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("v"))
    vote = F.when((t % 11 == 0) & (v == 3), 2).when((t % 7 == 0) & (v == 2), 9).otherwise(v)
    return V.vote_set_problem(rows.select("task", vote.alias("vote"), F.when(t % 5 == 0, F.concat(F.lit("x"), v.cast("string"))).otherwise("m").alias("model")))


@query("""
    WITH c AS (SELECT doc_id, ['one', 'two'] AS cites, CASE WHEN doc_id % 7 = 0 THEN ['one'] WHEN doc_id % 5 = 0 THEN ['two', 'six'] ELSE ['two', 'one'] END AS said, CASE WHEN doc_id % 3 = 0 THEN 'zz' ELSE 'a b' END AS span, CASE WHEN doc_id % 4 = 0 THEN ' ' ELSE 'c d' END AS ev FROM documents)
    SELECT doc_id, CASE WHEN len(said) <> 2 THEN 'count' WHEN list_sort(said) <> list_sort(cites) THEN 'citations' WHEN span = 'zz' THEN 'not_verbatim' WHEN ev = ' ' THEN 'support_without_evidence' END AS problem FROM c""")
def citation_assessments(spark, sf_dir):
    """The first rule that an assessment of citations breaks."""
    doc_id = F.col("doc_id")
    span, ev = F.when(doc_id % 3 == 0, "zz").otherwise("a b"), F.when(doc_id % 4 == 0, " ").otherwise("c d")
    one = lambda name: F.struct(F.lit(name).alias("citation"), span.alias("answer_span"), ev.alias("evidence_span"), F.lit(0.5).alias("support"))
    said = F.when(doc_id % 7 == 0, F.array(one("one"))).when(doc_id % 5 == 0, F.array(one("two"), one("six"))).otherwise(F.array(one("two"), one("one")))
    rows = _docs(spark, sf_dir).select("doc_id", F.array(F.lit("one"), F.lit("two")).alias("cites"), said.alias("said"))
    return rows.select("doc_id", V.citation_problem(F.col("cites"), F.col("said"), F.lit("x a b y"), F.lit("b c d e")).alias("problem"))


@query("""
    SELECT doc_id, contains(regexp_replace(lower(replace(replace(t, '’', ''''), '—', '-')), '[ \\t\\r\\n*_#|•·]+', ' ', 'g'), 'i don''t know - sorry') AS shown FROM
    (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Well. I don’t  know — SORRY.' WHEN 1 THEN 'I don’t know — sorry, ' ELSE text END AS t FROM documents)""")
def shown_refusals(spark, sf_dir):
    """Refusals for display, whatever the case, quotes and dashes."""
    doc_id = F.col("doc_id")
    t = F.when(doc_id % 3 == 0, "Well. I don’t know — SORRY.").when(doc_id % 3 == 1, F.lit("I don’t know — sorry, ")).otherwise(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", R.shows_refusal(t, ["I don't know - sorry."]).alias("shown"))


@query("""
    WITH t AS (SELECT doc_id, regexp_extract_all(['Gold', 'cover', 'Platinum'][doc_id % 3 + 1] || ' ' || substr(['x Premier Gold ', 'Admiral Gold or Gold '][doc_id % 2 + 1] || text, 1, 400), '\\b(Admiral Platinum|Admiral Gold|Platinum|Gold|Essential|Standard|Premier|Premium)\\b', 1) AS t FROM documents)
    SELECT doc_id, array_to_string(list_sort(list_distinct(t)), ',') AS tiers FROM t""")
def tier_tags(spark, sf_dir):
    """Sorted tier names in a title and the first 400 characters of a text."""
    doc_id = F.col("doc_id")
    text = F.concat(_pick(doc_id % 2, "x Premier Gold ", "Admiral Gold or Gold "), "text")
    return _docs(spark, sf_dir).select("doc_id", F.array_join(X.tiers(_pick(doc_id, "Gold", "cover", "Platinum"), text), ",").alias("tiers"))


@query("""SELECT doc_id, list_filter([lang, CASE WHEN doc_id % 3 = 0 THEN 'owner' END, source], lambda x: x IS NOT NULL AND x NOT IN ('en', 'de', 'src1')) [1] AS first_extra FROM documents""")
def extra_field_gate(spark, sf_dir):
    """The first field that a permission does not cover."""
    doc_id = F.col("doc_id")
    fields = F.filter(F.array("lang", F.when(doc_id % 3 == 0, "owner"), "source"), lambda x: x.isNotNull())
    return _docs(spark, sf_dir).select("doc_id", F.get(gates.extra_fields(fields, ["en", "de", "src1"]), F.lit(0)).alias("first_extra"))


@query("""
    WITH a AS (SELECT source, count(*) AS n FROM documents GROUP BY source), b AS (SELECT source, count(*) AS n FROM documents WHERE doc_id % 100 <> 7 GROUP BY source)
    SELECT source, a.n AS n_left, b.n AS n_right FROM a FULL JOIN b USING (source) WHERE a.n IS DISTINCT FROM b.n""")
def grouped_count_gate(spark, sf_dir):
    """Sources whose rows differ in number between two tables: the symmetric difference of populations."""
    doc_id = F.col("doc_id")
    docs = _docs(spark, sf_dir)
    return gates.grouped_counts_differ(docs, docs.where(doc_id % 100 != 7), "source")


@query("""
    WITH u AS (SELECT event_id, event_type, value, epoch_us(ts) AS us, CAST(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles' AS DATE) AS day FROM events),
    w AS (SELECT *, count(*) OVER m AS n_minute, sum(value) OVER m AS t_minute, count(*) OVER (PARTITION BY event_type, day ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_day, min(us) OVER m AS oldest
          FROM u WINDOW m AS (PARTITION BY event_type ORDER BY us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW))
    SELECT event_id, n_minute < 4 AND n_day < 60 AND t_minute + 50 <= 900 AS admitted,
           CASE WHEN n_minute >= 4 THEN oldest // 1000000 + 61 WHEN n_day >= 60 THEN CAST(epoch((day + INTERVAL 1 DAY)::TIMESTAMP AT TIME ZONE 'America/Los_Angeles') AS BIGINT) + 1 WHEN t_minute + 50 > 900 THEN oldest // 1000000 + 86401 ELSE us // 1000000 END AS again_at FROM w""")
def quota_admission(spark, sf_dir):
    """Whether a request after each event fits its hour, day and tokens, and from when it may be tried again."""
    from pyspark.sql import Window

    e = Q.rolling_usage(table(spark, sf_dir, "events"), "event_type", "ts", "value", 3600)
    ts = F.col("ts").cast("timestamp")
    e = e.withColumn("us", F.unix_micros(ts)).withColumn("day", Q.calendar_day(F.col("ts")))
    n_day = F.count("*").over(Window.partitionBy("event_type", "day").orderBy("us").rangeBetween(Window.unboundedPreceding, 0))
    e = e.withColumn("oldest", F.floor(F.col("oldest_window") / 1_000_000)).withColumn("n_day", n_day)
    now = F.floor(F.col("us") / 1_000_000)
    ask = F.lit(50)
    wait = Q.wait_until(now, F.col("n_window") >= 4, F.col("oldest"), F.col("n_day") >= 60, Q.day_reset(F.col("ts")), F.col("tokens_window") + ask > 900, F.col("oldest"))
    return e.select("event_id", Q.admits(F.col("n_window"), F.col("n_day"), F.col("tokens_window"), ask, 4, 60, 900.0).alias("admitted"), wait.alias("again_at"))


@query("""
    WITH s AS (SELECT source, avg(quality) AS q FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)
    SELECT (SELECT source FROM s WHERE q IS NOT NULL ORDER BY q DESC, source LIMIT 1) AS best, (SELECT source FROM s WHERE q IS NOT NULL ORDER BY q, source LIMIT 1) AS worst""")
def best_and_worst(spark, sf_dir):
    """The best and the worst source by mean quality."""
    d = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return M.extremes(d.groupBy("source").agg(F.avg("quality").alias("q")), "source", "q")


@query("""
    WITH m AS (SELECT doc_id, 'Answer in the form [A, B]. ' || lang || '. Else reply exactly.' AS s FROM documents)
    SELECT doc_id, replace(replace(s, 'in the form [A, B].', 'with the identifiers supplied.'), 'reply exactly', 'say that the evidence is insufficient') AS prompt FROM m""")
def adapted_prompts(spark, sf_dir):
    """Prompts with clauses replaced literally, each of which has to occur."""
    s = F.concat(F.lit("Answer in the form [A, B]. "), "lang", F.lit(". Else reply exactly."))
    return _docs(spark, sf_dir).select("doc_id", X.adapt(s, [("in the form [A, B].", "with the identifiers supplied."), ("reply exactly", "say that the evidence is insufficient")]).alias("prompt"))


@query("SELECT doc_id, array_to_string([source, lang], ',') AS names FROM documents")
def ordered_distinct(spark, sf_dir):
    """Values without repeats in the order in which they first come."""
    return _docs(spark, sf_dir).select("doc_id", F.array_join(F.array_distinct(F.array("source", "lang", "source", "lang")), ",").alias("names"))


@query("""
    WITH t AS (SELECT user_id, sum(value) AS cost FROM events WHERE event_type = 'click' GROUP BY user_id)
    SELECT user_id, round(cost, 4) AS cost FROM t WHERE cost <= 900 AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 150) ORDER BY round(cost, 4), user_id LIMIT 20""")
def cheapest_first(spark, sf_dir):
    """The twenty cheapest tasks that nothing blocks, ties by id: a top-k report."""
    e = table(spark, sf_dir, "events")
    costs = e.where("event_type = 'click'").groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("cost"))
    return V.eligible(costs, "user_id", [e.where("event_type = 'purchase' and value > 150")], "cost", 900.0).orderBy("cost", "user_id").limit(20)


@query(f"""
    WITH c AS (SELECT conv_id, turn, '--- Extract ' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) || ': ' || trim('[' || role || ', d, Section ' || turn || ', p.' || turn || '] ' || CASE WHEN turn % 2 = 0 THEN '' ELSE 'Title' END) || chr(10) || text AS b FROM conversations WHERE conv_id % 5 <> 0),
    x AS (SELECT conv_id, string_agg(b, chr(10) || chr(10) ORDER BY turn) AS t FROM c GROUP BY conv_id), a AS (SELECT DISTINCT conv_id FROM conversations)
    SELECT a.conv_id, sha256('Extracts:' || chr(10) || coalesce(t, '{X.NO_EXTRACTS}') || '. /no_think') AS system, 'Q' || a.conv_id AS question FROM a LEFT JOIN x USING (conv_id)""")
def context_messages(spark, sf_dir):
    """Messages with numbered extracts, or a placeholder where there are none."""
    c = table(spark, sf_dir, "conversations")
    turn = F.col("turn")
    chunk = F.struct(turn, F.col("role").alias("insurer"), F.lit("d").alias("doc_short"), turn.cast("string").alias("section_id"), turn.alias("page"), F.when(turn % 2 != 0, "Title").alias("section_title"), "text")
    rows = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.when(F.col("conv_id") % 5 != 0, chunk))).alias("chunks"))
    m = X.build_messages("Extracts:\n{context}.", F.concat(F.lit("Q"), F.col("conv_id").cast("string")), F.col("chunks"))
    return rows.select("conv_id", m.alias("m")).select("conv_id", F.sha2(F.col("m")[0]["content"], 256).alias("system"), F.col("m")[1]["content"].alias("question"))


@query("""
    WITH s AS (SELECT source, avg(quality) AS q, avg(quality) - 0.5 AS d FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)
    SELECT source, CASE WHEN q IS NULL THEN 'N/A' ELSE printf('%.1f%%', 100 * q) END AS share, CASE WHEN d IS NULL THEN '—' ELSE printf('%+.3f', d) END AS change, CASE WHEN q IS NULL THEN 'Pending' ELSE printf('%.6f', q) END AS value FROM s""")
def report_formats(spark, sf_dir):
    """Shares, signed changes and decimals, with a word where a value is missing."""
    d = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left").groupBy("source").agg(F.avg("quality").alias("q"))
    return d.select("source", X.percent(F.col("q")).alias("share"), X.signed(F.col("q") - 0.5).alias("change"), X.decimals(F.col("q")).alias("value"))


def _judged(spark, sf_dir):
    """Documents of all sources as questions in two arms, with a type, scores and refusals."""
    doc_id = F.col("doc_id")
    d = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("arm", F.explode(F.array(F.lit("base"), F.lit("sft"))))
    sft = F.col("arm") == "sft"
    score = F.when(~sft | (doc_id % 5 != 0), F.when(sft, F.col("toxic") / 2.0).otherwise(F.col("quality") / 1.0))
    return d.select(
        "doc_id", F.col("lang").alias("model"), "arm", (doc_id % 4 != 0).alias("answerable"), (doc_id % F.when(sft, 6).otherwise(7) == 0).alias("abstention"), score.alias("correctness"),
        F.when(doc_id % 3 != 0, (doc_id % 2) / 1.0).alias("evidence_support"), (doc_id % 9 == 0).alias("unsupported_material_claim"), F.when(doc_id % 4 != 3, _pick(doc_id, "limit", "scope", "excess", "x")).alias("question_type"),
    )


JUDGED_SQL = """
    j AS (SELECT doc_id, lang AS model, arm, doc_id % 4 <> 0 AS a, doc_id % CASE WHEN arm = 'sft' THEN 6 ELSE 7 END = 0 AS r, CASE WHEN arm = 'base' THEN quality::DOUBLE WHEN doc_id % 5 <> 0 THEN toxic / 2.0 END AS c,
          CASE WHEN doc_id % 3 <> 0 THEN doc_id % 2 END AS e, CAST(doc_id % 9 = 0 AS INT) AS u, coalesce(['limit', 'scope', 'excess', NULL][doc_id % 4 + 1], 'unspecified') AS t
          FROM documents LEFT JOIN labels USING (doc_id), (SELECT unnest(['base', 'sft']) AS arm))"""


@query(f"""
    WITH {JUDGED_SQL}, p AS (SELECT *, unnest(list_filter([CASE WHEN a THEN 'answerable' ELSE 'unanswerable' END, CASE WHEN a AND NOT r THEN 'answerable_attempts' END], lambda x: x IS NOT NULL)) AS population FROM j)
    SELECT model, arm, population, count(*) AS eligible_n, count(c) AS scored_n, round(avg(c), 6) AS mean_correctness, CASE WHEN count(c) = 0 THEN 'unjudged' ELSE 'preliminary_unvalidated' END AS status FROM p GROUP BY ALL""")
def answerability_strata(spark, sf_dir):
    """Correctness of answerable, unanswerable and attempted questions."""
    s = P.answerability_strata(_judged(spark, sf_dir), ["model", "arm"])
    return s.withColumn("mean_correctness", F.round("mean_correctness", 6))


@query(f"""
    WITH {JUDGED_SQL}
    SELECT model, arm, t AS question_type, count(*) AS population_n, count(c) AS judged_n, round(avg(c), 6) AS mean_correctness, CASE WHEN count(c) = 0 THEN 'unjudged' ELSE 'preliminary_unvalidated' END AS status FROM j GROUP BY ALL""")
def question_types(spark, sf_dir):
    """Correctness by type of question."""
    return P.question_types(_judged(spark, sf_dir), ["model", "arm"]).withColumn("mean_correctness", F.round("mean_correctness", 6))


@query(f"""
    WITH {JUDGED_SQL}, k AS (SELECT doc_id FROM j WHERE c IS NOT NULL GROUP BY doc_id HAVING count(DISTINCT arm) = 2), m AS (SELECT * FROM j WHERE c IS NOT NULL AND doc_id IN (SELECT doc_id FROM k))
    SELECT arm, count(*) AS population_n, count(*) FILTER (a) AS answerable_n, round(avg(c), 6) AS mean_correctness, round(avg(e), 6) AS mean_reference_support, count(e) AS reference_support_judged_n,
           round(avg(u) FILTER (e IS NOT NULL OR r), 6) AS unsupported_material_claim_rate, count(*) FILTER (e IS NOT NULL OR r) AS unsupported_claim_judged_n, round(avg(r::INT) FILTER (a), 6) AS unnecessary_refusal_rate, round(avg(r::INT) FILTER (NOT a), 6) AS correct_refusal_rate
    FROM m GROUP BY arm""")
def matched_pilot(spark, sf_dir):
    """Both arms over the questions scored in both."""
    m = P.matched_summary(_judged(spark, sf_dir), "doc_id", "arm", 2)
    kinds = {f.name: f.dataType.simpleString() for f in m.schema.fields}
    return m.select(*(F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c) for c in m.columns))


@query("""
    WITH v AS (SELECT doc_id AS task, n AS vote, CASE WHEN (doc_id + n) % 7 <> 0 THEN [0, 1, 2][(doc_id * n + quality) % 3 + 1] END AS s FROM labels, (SELECT unnest([1, 2, 3]) AS n)),
    w AS (SELECT task, max(s) FILTER (vote = 1) AS a, max(s) FILTER (vote = 2) AS b, max(s) FILTER (vote = 3) AS c FROM v GROUP BY task),
    p AS (SELECT 1 AS vote_a, 2 AS vote_b, a AS x, b AS y FROM w UNION ALL SELECT 1, 3, a, c FROM w UNION ALL SELECT 2, 3, b, c FROM w),
    k AS (SELECT * FROM p WHERE x IS NOT NULL AND y IS NOT NULL),
    m AS (SELECT vote_a, vote_b, count(*) AS n, avg(CAST(x = y AS INT)) AS same, sum((x - y) * (x - y)) / 4.0 AS o, (sum(x * x) + sum(y * y) - 2.0 * sum(x) * sum(y) / count(*)) / 4 AS e, min(least(x, y)) < max(greatest(x, y)) AS spread FROM k GROUP BY ALL)
    SELECT vote_a, vote_b, n AS paired_scored_n, round(same, 6) AS exact_agreement, round(CASE WHEN spread THEN CASE WHEN abs(e) < 1e-12 THEN 1.0 ELSE 1 - o / e END END, 6) AS kappa FROM m""")
def repeat_agreement(spark, sf_dir):
    """Agreement of repeated votes on the same tasks."""
    t, v = F.col("task"), F.col("vote")
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("task"), "quality", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("vote"))
    votes = rows.select("task", "vote", F.when((t + v) % 7 != 0, ((t * v + F.col("quality")) % 3) / 2.0).alias("correctness"))
    return P.repeat_agreement(votes).select("vote_a", "vote_b", "paired_scored_n", F.round("exact_agreement", 6).alias("exact_agreement"), F.round("kappa", 6).alias("kappa"))


def _two_judges(spark, sf_dir):
    x = F.col("doc_id") + F.substring("model", 2, 1).cast("int") * 7
    cells = _cells(spark, sf_dir)
    return cells.select(
        *CELLS, "doc_id", "answerable", "responded", "refused", "n_cited", "n_resolved", (x % 11 != 0).alias("answer_present"), ((x % 13) / 4.0).alias("seconds"),
        F.when(x % 5 != 0, F.when(x % 7 != 0, (x % 3) / 2.0)).alias("p_correctness"), F.when(x % 4 != 0, F.when(x % 7 != 0, (x % 2) / 1.0)).alias("q_correctness"), F.when(x % 8 != 0, (x % 2) / 1.0).alias("p_support"),
        F.when(x % 9 != 0, (x % 3) / 2.0).alias("q_support"), (x % 5 != 0).alias("p_voted"), (x % 4 != 0).alias("q_voted"),
    )


JUDGES_SQL = f"""{CELLS_SQL},
    t AS (SELECT *, CASE WHEN x % 5 <> 0 AND x % 7 <> 0 THEN (x % 3) / 2.0 END AS pc, CASE WHEN x % 4 <> 0 AND x % 7 <> 0 THEN (x % 2) / 1.0 END AS qc, CASE WHEN x % 8 <> 0 THEN (x % 2) / 1.0 END AS ps, CASE WHEN x % 9 <> 0 THEN (x % 3) / 2.0 END AS qs FROM i)"""


@query(f"""
    WITH {JUDGES_SQL}, s AS (SELECT * FROM t WHERE responded)
    SELECT model, condition, count(*) AS responses, 76 - count(*) AS missing_responses, count(*) FILTER (refused OR cited > 0) AS parsed_responses, count(*) FILTER (x % 11 = 0) AS final_answer_failures,
           count(*) FILTER (answerable AND refused) AS unnecessary_refusals, count(*) FILTER (NOT answerable AND refused) AS appropriate_refusals, round(CASE WHEN count(*) = 76 THEN count(*) FILTER (answerable AND refused) / 67.0 END, 6) AS false_refusal_rate,
           round(count(*) FILTER (NOT answerable AND refused) / nullif(count(*) FILTER (refused), 0), 6) AS refusal_correctness,
           round(CASE WHEN count(*) = 76 THEN 0.5 * ((67 - count(*) FILTER (answerable AND refused)) / 67.0 + count(*) FILTER (NOT answerable AND refused) / 9.0) END, 6) AS balanced_abstention,
           round(sum(least(cited, x % 3)) FILTER (condition = 'base-rag') / nullif(sum(cited) FILTER (condition = 'base-rag'), 0), 6) AS citation_resolution, CAST(sum(cited) FILTER (condition = 'base-rag') AS BIGINT) AS citation_denominator,
           round(avg(pc), 6) AS p_correctness, count(pc) AS p_correctness_scored, round(avg(ps), 6) AS p_reference_support, round(avg(qc), 6) AS q_correctness, count(qc) AS q_correctness_scored, round(avg(qs), 6) AS q_reference_support,
           count(*) FILTER (pc IS NOT NULL AND qc IS NOT NULL) AS judge_paired_denominator, round(avg(CAST(pc = qc AS INT)) FILTER (pc IS NOT NULL AND qc IS NOT NULL), 6) AS correctness_agreement, round(sum((x % 13) / 4.0), 6) AS inference_seconds
    FROM s GROUP BY model, condition""")
def run_summary(spark, sf_dir):
    """Responses, refusals, citations, time and two judges' scores of every cell over all questions."""
    s = P.run_summary(_two_judges(spark, sf_dir), CELLS, ["p", "q"], 67, 9, F.col("condition") == "base-rag")
    kinds = {f.name: f.dataType.simpleString() for f in s.schema.fields}
    return s.select(*(F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c) for c in s.columns))


@query(f"""
    WITH {JUDGES_SQL}
    SELECT model, condition, doc_id FROM t WHERE x % 5 <> 0 AND x % 4 <> 0 AND (pc IS DISTINCT FROM qc OR ps IS DISTINCT FROM qs)""")
def judge_disagreements(spark, sf_dir):
    """Questions on which two judges differ."""
    return P.judge_disagreements(_two_judges(spark, sf_dir), ["p", "q"], ["correctness", "support"]).select(*CELLS, "doc_id")


@query("""
    WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0),
    s AS (SELECT query_id, vec_id, round(list_cosine_similarity(CAST(q AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS score FROM q, embeddings WHERE query_id <> vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s),
    f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (vec_id * 37) % 101 DESC, rank) AS final_rank FROM r WHERE rank <= 24)
    SELECT query_id, vec_id, CAST(final_rank AS INTEGER) AS final_rank, true AS reranked FROM f WHERE final_rank <= 6""")
def model_rerank(spark, sf_dir):
    """The first six of every query's pool by a model that is made once a task."""
    from millrace.operators import retrieval
    from millrace.plans.corpus_queries import _vectors

    pool = retrieval.top_k(*_vectors(spark, sf_dir))
    return retrieval.rerank_with(pool, lambda: lambda rows: [(r["vec_id"] * 37) % 101 for r in rows]).select("query_id", "vec_id", "final_rank", "reranked")
