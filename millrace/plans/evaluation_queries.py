"""Queries over answers, votes and metrics, derived from the label and conversation tables by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import gates
from millrace.operators import metrics as M
from millrace.operators import refusal as R
from millrace.operators import retrieval
from millrace.operators import votes as V
from millrace.operators.packing import pack_batches
from millrace.plans.registry import query
from millrace.session import table

REFUSAL = "The documents I have do not answer that."


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as answers: a sixth each bare refusals, with prose, with a citation, long, none, prose and citation."""
    text = F.regexp_replace("text", "[^A-Za-z ]", "")
    kind = F.col("doc_id") % 6
    cite = F.concat(F.lit(" [Acme, Wording, Section A1, p."), (F.col("doc_id") % 7).cast("string"), F.lit("]"))
    s = F.lit(REFUSAL)
    answer = (
        F.when(kind == 0, s).when(kind == 1, F.concat(s, F.lit(" "), text)).when(kind == 2, F.concat(s, cite)).when(kind == 3, F.concat(s, F.lit(" 12. 34"))).when(kind == 4, text).otherwise(F.concat(text, s, cite))
    )
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), answer.alias("text"), (F.col("doc_id") % 4 != 0).alias("answerable"))


ANSWERS_SQL = f"""
    answers AS (SELECT doc_id AS id, doc_id % 4 <> 0 AS answerable, CASE doc_id % 6 WHEN 0 THEN s WHEN 1 THEN s || ' ' || t WHEN 2 THEN s || c WHEN 3 THEN s || ' 12. 34' WHEN 4 THEN t ELSE t || s || c END AS text
        FROM (SELECT doc_id, '{REFUSAL}' AS s, regexp_replace(text, '[^A-Za-z ]', '', 'g') AS t, ' [Acme, Wording, Section A1, p.' || (doc_id % 7) || ']' AS c FROM documents))"""
CITE_SQL = r"""\[\s*["'']?\s*([^,\[\]"'']+?)\s*,\s*["'']?([^,\[\]]+?)\s*,\s*([^,\[\]]+?)\s*,\s*p\.?\s*(\d+)[^\]]*\]"""
READ_SQL = f"""
    read AS (SELECT *, contains(text, '{REFUSAL.rstrip(" .")}') AS loose, regexp_matches(text, '{CITE_SQL}') AS cited,
        regexp_matches(replace(replace(regexp_replace(text, '{CITE_SQL}', ' ', 'g'), '{REFUSAL}', ' '), '{REFUSAL.rstrip(" .")}', ' '), '[A-Za-z]') AS prose FROM answers)"""


@query(f"""
    WITH {ANSWERS_SQL}, {READ_SQL},
    g AS (SELECT answerable, unnest([{{'r': 'A', 'x': loose AND NOT (prose AND cited)}}, {{'r': 'B', 'x': loose AND NOT prose}}, {{'r': 'C', 'x': loose AND NOT (prose OR cited)}}]) AS m FROM read)
    SELECT m.r AS reading, count(*) FILTER (answerable AND m.x) AS over_refusals, count(*) FILTER (NOT answerable AND m.x) AS refusals_ok,
           count(*) FILTER (answerable) AS ans_n, count(*) FILTER (NOT answerable) AS unans_n FROM g GROUP BY 1""")
def refusal_readings(spark, sf_dir):
    """Refusals by reading, for answerable questions and others."""
    return R.reading_grid(_answers(spark, sf_dir), REFUSAL)


@query(f"""
    WITH {ANSWERS_SQL}, {READ_SQL},
    g AS (SELECT r.*, m FROM read r, (SELECT unnest([1.0, 1.1, 1.25, 1.5, 2.0, 3.0, 4.0, 'inf'::DOUBLE]) AS m))
    SELECT m AS multiple, count(*) FILTER (answerable AND loose AND NOT cited AND length(trim(text)) <= m * {len(REFUSAL)}) AS over_refusals,
           count(*) FILTER (NOT answerable AND loose AND NOT cited AND length(trim(text)) <= m * {len(REFUSAL)}) AS refusals_ok FROM g GROUP BY 1""")
def refusal_lengths(spark, sf_dir):
    """Strict refusals by how long an answer may be."""
    return R.length_grid(_answers(spark, sf_dir), REFUSAL)


@query(f"""
    WITH {ANSWERS_SQL}, {READ_SQL}
    SELECT count(*) FILTER (answerable) AS ans_n, count(*) FILTER (NOT answerable) AS unans_n, count(*) FILTER (answerable AND loose) AS n_loose_over,
           count(*) FILTER (answerable AND loose AND prose) AS n_recovered, count(*) FILTER (NOT answerable AND loose) AS n_loose_ok,
           count(*) FILTER (NOT answerable AND loose AND prose) AS n_lost FROM read""")
def refusal_reclassified(spark, sf_dir):
    """What the default reading recovers and loses against the loose rule."""
    return R.reclassify(_answers(spark, sf_dir), REFUSAL)


@query(f"""
    WITH {ANSWERS_SQL}, {READ_SQL},
    x AS (SELECT count(*) FILTER (answerable) AS n, CAST(count(*) FILTER (answerable AND NOT loose) AS DOUBLE) AS a, CAST(count(*) FILTER (answerable AND NOT (loose AND NOT prose)) AS DOUBLE) AS b,
          count(*) FILTER (answerable AND loose AND prose) AS u FROM read),
    y AS (SELECT round(a / n, 6) AS a_lo, round((a + u) / n, 6) AS a_hi, round(b / n, 6) AS b_lo, round((b + u) / n, 6) AS b_hi FROM x)
    SELECT a_lo, a_hi, b_lo, b_hi, round(a_lo - b_hi, 6) AS gap_lo, round(a_hi - b_lo, 6) AS gap_hi,
           CASE WHEN round(a_lo - b_hi, 6) > 0 THEN 'positive' WHEN round(a_hi - b_lo, 6) < 0 THEN 'negative' ELSE 'indeterminate' END AS sign FROM y""")
def interval_metrics(spark, sf_dir):
    """Answer rates under two rules with unjudged items as 0 and as 1, and the interval of their difference."""
    a = _answers(spark, sf_dir)
    loose, now, ans = R.loose(F.col("text"), REFUSAL), R.refuses(F.col("text"), REFUSAL), F.col("answerable")
    x = a.agg(F.count_if(ans).alias("n"), F.count_if(ans & ~loose).alias("a"), F.count_if(ans & ~now).alias("b"), F.count_if(ans & loose & ~now).alias("u"))
    (a_lo, a_hi), (b_lo, b_hi) = (R.score_bounds(F.col(c), F.col("n"), F.col("u")) for c in ("a", "b"))
    y = x.select(a_lo.alias("a_lo"), a_hi.alias("a_hi"), b_lo.alias("b_lo"), b_hi.alias("b_hi"))
    gap = R.gap_bounds(F.col("a_lo"), F.col("a_hi"), F.col("b_lo"), F.col("b_hi"))
    return y.withColumn("g", gap).select("a_lo", "a_hi", "b_lo", "b_hi", F.col("g.lo").alias("gap_lo"), F.col("g.hi").alias("gap_hi"), F.col("g.sign").alias("sign"))


@query(f"""
    WITH {ANSWERS_SQL},
    c AS (SELECT id, generate_subscripts(p, 1) - 1 AS occurrence, unnest(p) AS page FROM (SELECT id, regexp_extract_all(text || text, '{CITE_SQL}', 4) AS p FROM answers)),
    k AS (SELECT id, CAST(page AS INTEGER) AS page, occurrence, id % 5 AS known FROM c)
    SELECT id AS answer_id, CAST(occurrence AS INTEGER) AS occurrence, page, abs(page - known) <= 1 AS supported FROM k""")
def citation_support(spark, sf_dir):
    """Support of every citation occurrence, within a page, by either name of the document."""
    a = _answers(spark, sf_dir).select(F.col("id").alias("answer_id"), F.concat("text", "text").alias("text"))
    name = F.when(F.col("answer_id") % 2 == 0, "Wording").otherwise("other")
    context = a.select("answer_id", F.lit("ACME").alias("insurer"), name.alias("doc_short"), F.lit("x/Wording.pdf").alias("filename"), F.lit("Section A1").alias("section_id"), (F.col("answer_id") % 5).cast("int").alias("page"))
    found = retrieval.resolve_citations(a, context)
    return found.select("answer_id", "occurrence", F.regexp_extract("citation", X.CITATION, 4).cast("int").alias("page"), "supported")


@query(f"""
    WITH {ANSWERS_SQL}
    SELECT id, len(regexp_extract_all(text, '{CITE_SQL}')) AS n_citations, trim(regexp_replace(text, '{CITE_SQL}', ' ', 'g')) AS rest FROM answers""")
def citation_strip(spark, sf_dir):
    """Citations counted and taken out."""
    return _answers(spark, sf_dir).select("id", X.count_citations(F.col("text")).cast("long").alias("n_citations"), F.trim(X.strip_citations(F.col("text"))).alias("rest"))


def _votes(spark, sf_dir, malformed: bool = False):
    """Three votes on every labelled document; if ``malformed``, some break the schema."""
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("vote"))
    d, v, q, t = (F.col(c) for c in ("doc_id", "vote", "quality", "toxic"))
    scores = F.array(((d + v) % 3).cast("int"), ((d + v * q) % 3).cast("int"), (t * 2).cast("int"))
    if malformed:
        scores = F.when(d % 11 == 0, F.slice(scores, 1, 2)).when(d % 13 == 0, F.array(F.lit(3), F.lit(0), F.lit(1))).otherwise(scores)
    contradiction = (d + v) % 4 == 0
    if malformed:
        contradiction = F.when(d % 17 != 0, contradiction)
    return rows.select(d.alias("task"), "vote", scores.alias("fact_scores"), contradiction.alias("contradiction"), F.array(*(F.concat(F.lit(f"f{i}v"), v.cast("string")) for i in range(3))).alias("evidence_spans"))


VOTES_SQL = """
    votes AS (SELECT doc_id AS task, v AS vote, [(doc_id + v) % 3, (doc_id + v * quality) % 3, toxic * 2] AS s, (doc_id + v) % 4 = 0 AS contradiction, quality, toxic FROM labels, (SELECT unnest([1, 2, 3]) AS v))"""


@query("""
    SELECT doc_id AS task, v AS vote, CASE WHEN doc_id % 11 = 0 THEN 'arity' WHEN doc_id % 13 = 0 THEN 'range' WHEN doc_id % 17 = 0 THEN 'contradiction_type' END AS problem
    FROM labels, (SELECT unnest([1, 2, 3]) AS v)""")
def vote_validity(spark, sf_dir):
    """The first rule that each vote breaks."""
    v = _votes(spark, sf_dir, malformed=True)
    return v.select("task", "vote", V.vote_problem(F.col("fact_scores"), F.lit(3), F.col("contradiction"), F.col("evidence_spans")).alias("problem"))


@query(f"""
    WITH {VOTES_SQL},
    f AS (SELECT task, vote, unnest([1, 2, 3]) AS i, unnest(s) AS score FROM votes),
    m AS (SELECT task, i, CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY score) AS INTEGER) AS score, count(DISTINCT score) AS k FROM f GROUP BY task, i),
    c AS (SELECT m.task, m.i, min(m.score) AS score, min(m.k) AS k, min(f.vote) AS carrier FROM m JOIN f ON f.task = m.task AND f.i = m.i AND f.score = m.score GROUP BY m.task, m.i),
    h AS (SELECT task, count(*) AS n_votes, count(*) FILTER (contradiction) AS n_true FROM votes GROUP BY task)
    SELECT c.task, n_votes, string_agg(CAST(score AS VARCHAR), ',' ORDER BY i) AS scores, string_agg('f' || (i - 1) || 'v' || carrier, ',' ORDER BY i) AS spans,
           n_true * 2 >= n_votes AS contradiction, count(*) FILTER (k > 1) AS n_facts_disagreed FROM c JOIN h ON h.task = c.task GROUP BY c.task, n_votes, n_true""")
def vote_merge(spark, sf_dir):
    """Lower medians, their carriers and majority contradiction of three votes."""
    m = V.merge_votes(_votes(spark, sf_dir))
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return m.select("task", "n_votes", join(F.col("fact_scores")).alias("scores"), F.array_join("evidence_spans", ",").alias("spans"), "contradiction", "n_facts_disagreed")


@query(f"""
    WITH {VOTES_SQL},
    f AS (SELECT task, unnest([1, 2, 3]) AS i, unnest(s) AS score FROM votes), m AS (SELECT task, i, count(DISTINCT score) AS k FROM f GROUP BY task, i)
    SELECT count(*) AS n_facts, count(*) FILTER (k > 1) AS n_disagreed, count(DISTINCT task) AS n_tasks, round(count(*) FILTER (k > 1) / count(*), 6) AS rate FROM m""")
def vote_disagreement(spark, sf_dir):
    """Facts that votes disagree on, with both denominators."""
    d = V.disagreement_rate(V.merge_votes(_votes(spark, sf_dir)))
    return d.select("n_facts", "n_disagreed", "n_tasks", F.round("rate", 6).alias("rate"))


def _semantic(spark, sf_dir):
    v = _votes(spark, sf_dir)
    d, n = F.col("task"), F.col("vote")
    half = lambda x: F.get(F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0)), x.cast("int"))
    return v.select(
        "task", "vote", "fact_scores", "evidence_spans",
        F.when((d + n) % 7 != 0, F.when(d % 3 == 0, F.lit(1.0)).otherwise(half((d * n) % 3))).alias("correctness"),
        F.when(d % 5 != 0, half((d + n) % 3)).alias("evidence_support"),
        F.get(F.array(*(F.lit(c) for c in V.CATEGORIES)), ((d + F.when(d % 4 == 0, n).otherwise(0)) % 6).cast("int")).alias("category"),
        ((d + n) % 5 == 0).alias("materially_incorrect"), ((d * n) % 4 == 0).alias("unsupported_material_claim"), (F.col("contradiction") & (d % 2 == 0)).alias("contradiction"), ((d + n) % 9 == 0).alias("needs_human_review"),
        F.array(F.get(F.array(*(F.lit(c) for c in V.FLAGS)), ((d + n) % 6).cast("int"))).alias("uncertainty_flags"),
        F.array(F.lit("b"), F.concat(F.lit("a"), (n % 2).cast("string"))).alias("material_conditions"), F.lit("judge").alias("model"),
    )


@query("""
    WITH v AS (SELECT doc_id AS task, n AS vote, quality, toxic, CASE WHEN (doc_id + n) % 7 <> 0 THEN CASE WHEN doc_id % 3 = 0 THEN 1.0::DOUBLE ELSE [0.0, 0.5, 1.0][(doc_id * n) % 3 + 1]::DOUBLE END END AS c, CASE WHEN doc_id % 5 <> 0 THEN [0.0, 0.5, 1.0][(doc_id + n) % 3 + 1]::DOUBLE END AS e,
         ['correct_abstention', 'incorrect_abstention', 'correct_answer', 'incorrect_unsupported_answer', 'incorrect_answer', 'uncertain'][(doc_id + CASE WHEN doc_id % 4 = 0 THEN n ELSE 0 END) % 6 + 1] AS category,
         (doc_id + n) % 5 = 0 AS mi, (doc_id * n) % 4 = 0 AS um, (doc_id + n) % 4 = 0 AND doc_id % 2 = 0 AS ct, (doc_id + n) % 9 = 0 AS nr,
         ['ambiguous_evidence', 'missing_reference', 'conflicting_passages', 'unsupported_gold_assumption', 'borderline', 'incomplete_output'][(doc_id + n) % 6 + 1] AS flag,
         [(doc_id + n) % 3, (doc_id + n * quality) % 3, toxic * 2] AS facts FROM labels, (SELECT unnest([1, 2, 3]) AS n)),
    -- a fact's merged score is the middle one of three
    f AS (SELECT task, k, list_sort(list(facts[k]))[2] AS score, min(facts[k]) <> max(facts[k]) AS split FROM v, (SELECT unnest([1, 2, 3]) AS k) GROUP BY task, k),
    fm AS (SELECT task, string_agg(CAST(score AS VARCHAR), ',' ORDER BY k) AS fact_scores, count(*) FILTER (split) AS n_split, min(score) < 2 AS low FROM f GROUP BY task),
    -- any null among three scores makes the merged score null
    m AS (SELECT task, CASE WHEN bool_or(c IS NULL) THEN NULL ELSE list_sort(list(c))[2] END AS c, CASE WHEN bool_or(e IS NULL) THEN NULL ELSE list_sort(list(e))[2] END AS e,
          sum(ct::INT) >= 2 AS ct, sum(mi::INT) >= 2 AS mi, sum(um::INT) >= 2 AS um, bool_or(nr) AS nr, mode(category) AS top, max(cnt) AS most, count(DISTINCT category) AS kinds, string_agg(DISTINCT flag, ',' ORDER BY flag) AS flags,
          count(DISTINCT coalesce(CAST(c AS VARCHAR), '?')) > 1 OR count(DISTINCT coalesce(CAST(e AS VARCHAR), '?')) > 1 OR bool_or(ct) <> bool_and(ct) OR bool_or(mi) <> bool_and(mi) OR bool_or(um) <> bool_and(um) AS differ
          FROM (SELECT *, count(*) OVER (PARTITION BY task, category) AS cnt FROM v) GROUP BY task),
    s AS (SELECT m.*, fact_scores, n_split, low, CASE WHEN ct AND c IS NOT NULL THEN 0 ELSE c END AS score FROM m JOIN fm USING (task)),
    i AS (SELECT *, coalesce(score = 1 AND task % 4 <> 0 AND task % 6 <> 0 AND low, false) AS odd FROM s)
    SELECT task, CAST(3 AS BIGINT) AS n_votes, fact_scores, n_split AS n_facts_disagreed, CASE WHEN NOT odd THEN score END AS correctness, e AS evidence_support, CASE WHEN most >= 2 THEN top ELSE 'uncertain' END AS category, ct AS contradiction,
           mi AS materially_incorrect, um AS unsupported_material_claim, odd AS fact_overall_inconsistency, nr OR kinds > 1 OR odd AS needs_human_review, differ OR n_split > 0 AS disagreement, flags, 'a0,a1,b' AS conditions, 'three_vote' AS protocol FROM i""")
def semantic_merge(spark, sf_dir):
    """Three semantic votes merged: a null score stays null, a category needs a strict majority, a full score with a low
    fact is inconsistent."""
    tasks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("task"), (F.col("doc_id") % 4 != 0).alias("gold_answerable"), (F.col("doc_id") % 6 == 0).alias("deterministic_abstention"))
    m = V.merge_semantic(_semantic(spark, sf_dir), tasks)
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return m.withColumn("fact_scores", join(F.col("fact_scores"))).withColumn("flags", join(F.col("uncertainty_flags"))).withColumn("conditions", join(F.col("material_conditions"))).drop("uncertainty_flags", "material_conditions")


@query("""
    WITH r AS (SELECT user_id, event_type, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events)
    SELECT user_id, event_type, event_id, value FROM r WHERE n = 1""")
def first_write_wins(spark, sf_dir):
    """The first event of every user and type."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return V.first_write(e, ["user_id", "event_type"], ["event_id"])


@query("""
    WITH t AS (SELECT user_id, CASE WHEN event_type = 'purchase' THEN 1 WHEN event_type = 'signup' THEN 2 WHEN event_type = 'click' THEN 3 END AS k, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type)
    SELECT user_id, arg_min(event_type, k) AS event_type, arg_min(event_id, k) AS event_id FROM t WHERE k IS NOT NULL GROUP BY user_id""")
def priority_select(spark, sf_dir):
    """One event type of every user by priority, its first event."""
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
    return V.by_priority(e, "user_id", "event_type", ["purchase", "signup", "click"])


@query("""
    SELECT user_id, arg_max(event_type, event_id) AS status, count(*) AS attempts, arg_max(event_type, event_id) IN ('in_flight', 'transport_uncertain', 'response_saved') AS unknown FROM events GROUP BY user_id""")
def latest_state(spark, sf_dir):
    """The last state of every user's history."""
    return V.latest_state(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


@query("""
    WITH t AS (SELECT DISTINCT user_id FROM events), p AS (SELECT user_id, sum(value) AS cost FROM events WHERE event_type = 'click' GROUP BY user_id)
    SELECT t.user_id FROM t LEFT JOIN p USING (user_id) WHERE coalesce(cost, 1e20) <= 900 AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 150)""")
def dispatch_eligible(spark, sf_dir):
    """Users that nothing blocks and whose cost is known and low."""
    e = table(spark, sf_dir, "events")
    costs = e.where("event_type = 'click'").groupBy("user_id").agg(F.sum("value").alias("cost"))
    tasks = e.select("user_id").distinct().join(costs, "user_id", "left")
    return V.eligible(tasks, "user_id", [e.where("event_type = 'purchase' and value > 150")], "cost", 900.0).select("user_id")


@query("""SELECT evaluation_id, lang FROM (SELECT printf('e%06d', row_number() OVER (ORDER BY doc_id) - 1) AS evaluation_id, lang FROM documents)""")
def blinded_tasks(spark, sf_dir):
    """Tasks with allowed columns and opaque ids."""
    return V.blinded(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ["lang"], ["doc_id"])[0]


@query("""
    SELECT conv_id, count(*) AS n_turns, bool_and(CASE WHEN role = 'system' THEN turn = 0 ELSE true END) AS system_first,
           string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id""")
def role_sequence_gate(spark, sf_dir):
    """Role sequences of conversations."""
    c = table(spark, sf_dir, "conversations")
    roles = F.sort_array(F.collect_list(F.struct("turn", "role")))
    ok = F.bool_and(F.when(F.col("role") == "system", F.col("turn") == 0).otherwise(True))
    return c.groupBy("conv_id").agg(F.count("*").alias("n_turns"), ok.alias("system_first"), F.array_join(roles["role"], ">").alias("roles"))


@query("""
    SELECT a.conv_id, a.turn AS turn_a, b.turn AS turn_b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn AND a.role = b.role WHERE b.turn - a.turn > 2""")
def conversation_pairs(spark, sf_dir):
    """Pairs of a conversation's turns of one role that no neighbour covers."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    a, b = c.withColumnRenamed("turn", "turn_a"), c.withColumnRenamed("turn", "turn_b")
    return a.join(b, ["conv_id", "role"]).where("turn_a < turn_b and turn_b - turn_a > 2").select("conv_id", "turn_a", "turn_b")


@query("""
    SELECT conv_id, sha256(string_agg('[' || role || ', turn, Section ' || turn || ', p.' || turn || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY turn)) AS rendered FROM conversations GROUP BY conv_id""")
def message_render(spark, sf_dir):
    """Conversations rendered with a header for each turn."""
    c = table(spark, sf_dir, "conversations")
    head = X.chunk_header(F.col("role"), F.lit("turn"), F.col("turn").cast("string"), F.col("turn"), F.lit(""))
    parts = F.sort_array(F.collect_list(F.struct("turn", F.concat(head, F.lit("\n"), F.col("text")).alias("t"))))
    return c.groupBy("conv_id").agg(F.sha2(F.array_join(parts["t"], "\n\n"), 256).alias("rendered"))


@query("""
    SELECT source, count(*) AS n_docs, count(quality) AS quality_n, round(avg(quality), 6) AS quality_mean, CAST(coalesce(sum(quality), 0) AS DOUBLE) AS quality_sum, round(count(quality) / count(*), 6) AS coverage
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def label_coverage(spark, sf_dir):
    """Mean quality of labelled documents with its denominator: missing is not zero."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    mean, total, n = M.mean_triple(F.col("quality"), "quality")
    return d.groupBy("source").agg(F.count("*").alias("n_docs"), n, F.round(F.avg("quality"), 6).alias("quality_mean"), total.cast("double").alias("quality_sum"), F.round(F.count("quality") / F.count("*"), 6).alias("coverage"))


@query("""
    WITH p AS (SELECT quality AS a, 1 - toxic AS b FROM labels), n AS (SELECT count(*) AS n, count(*) FILTER (a = b) AS s FROM p),
    e AS (SELECT sum(x.c * y.c) AS s FROM (SELECT a AS v, count(*) AS c FROM p GROUP BY a) x JOIN (SELECT b AS v, count(*) AS c FROM p GROUP BY b) y USING (v))
    SELECT n.n, round(n.s / n.n, 6) AS observed, round(e.s / (n.n * n.n), 6) AS expected, round((n.s / n.n - e.s / (n.n * n.n)) / (1 - e.s / (n.n * n.n)), 6) AS kappa FROM n, e""")
def label_kappa(spark, sf_dir):
    """Agreement of quality and non-toxicity beyond chance."""
    p = table(spark, sf_dir, "labels").select(F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b"))
    k = M.cohen_kappa(p, "a", "b")
    return k.select("n", *(F.round(c, 6).alias(c) for c in ("observed", "expected", "kappa")))


@query("""
    WITH p AS (SELECT doc_id % 3 AS a, (doc_id + quality) % 3 AS b FROM labels), n AS (SELECT count(*) AS n FROM p),
    r AS (SELECT a, count(*) AS c FROM p GROUP BY a), s AS (SELECT b, count(*) AS c FROM p GROUP BY b),
    o AS (SELECT sum(pow(a - b, 2) / 4) AS o FROM p), e AS (SELECT sum(r.c * s.c * pow(a - b, 2) / 4) AS e FROM r, s)
    SELECT n, round(1 - o / (e / n), 6) AS kappa FROM n, o, e""")
def quality_weighted_kappa(spark, sf_dir):
    """Quadratic-weighted agreement of two derived scores."""
    p = table(spark, sf_dir, "labels").select((F.col("doc_id") % 3).alias("a"), ((F.col("doc_id") + F.col("quality")) % 3).alias("b"))
    return M.weighted_kappa(p, "a", "b").select("n", F.round("kappa", 6).alias("kappa"))


def _items(spark, sf_dir):
    """Labelled documents as judged items of their source."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    n = F.col("doc_id")
    answerable, refused = n % 4 != 0, n % 6 == 0
    corr = M.item_correctness(answerable, refused, n % 13 == 0, F.when(F.col("quality").isNotNull(), F.array((n % 3).cast("int"), (F.col("quality") * 2).cast("int"))))
    return d.select("doc_id", "source", "lang", "quality", answerable.alias("answerable"), refused.alias("refused"), corr.alias("corr_item"), (n % 3).alias("n_sup"), F.lit(2).alias("n_tot"), F.col("quality").isNotNull().alias("judged"))


ITEMS_SQL = """
    items AS (SELECT doc_id, source, lang, quality, doc_id % 4 <> 0 AS answerable, doc_id % 6 = 0 AS refused, doc_id % 3 AS n_sup, 2 AS n_tot,
              CASE WHEN doc_id % 4 <> 0 THEN CASE WHEN doc_id % 6 = 0 THEN 0.0 WHEN quality IS NULL THEN NULL WHEN doc_id % 13 = 0 THEN 0.0 ELSE (doc_id % 3 + quality * 2) / 4.0 END END::DOUBLE AS c
              FROM documents LEFT JOIN labels USING (doc_id)),
    m AS (SELECT source, count(*) AS n_items, count(c) AS n_scored, coalesce(sum(c) / nullif(count(c), 0), 0) AS correctness, coalesce(sum(n_sup) / nullif(sum(n_tot), 0), 0) AS citation_support,
          (coalesce(count(*) FILTER (NOT answerable AND refused) / nullif(count(*) FILTER (NOT answerable), 0), 1) + 1 - coalesce(count(*) FILTER (answerable AND refused) / nullif(count(*) FILTER (answerable), 0), 0)) / 2 AS abstention
          FROM items GROUP BY source)"""


@query(f"""
    WITH {ITEMS_SQL}
    SELECT source, n_items, n_scored, round(correctness, 6) AS correctness, round(citation_support, 6) AS citation_support, round(abstention, 6) AS abstention,
           round(0.5 * correctness + 0.3 * citation_support + 0.2 * abstention, 6) AS composite FROM m""")
def metric_wide(spark, sf_dir):
    """Metrics of every source, one row each."""
    m = M.row_metrics(_items(spark, sf_dir), "source")
    return m.select("source", "n_items", "n_scored", *(F.round(c, 6).alias(c) for c in ("correctness", "citation_support", "abstention", "composite")))


@query(f"""
    WITH {ITEMS_SQL}
    SELECT source, 'correctness' AS metric, round(correctness, 6) AS value FROM m UNION ALL SELECT source, 'citation_support', round(citation_support, 6) FROM m
    UNION ALL SELECT source, 'abstention', round(abstention, 6) FROM m""")
def metric_long(spark, sf_dir):
    """The same metrics, one row for each."""
    return M.to_long(metric_wide(spark, sf_dir), ["source"], ["correctness", "citation_support", "abstention"])


@query(f"""
    WITH {ITEMS_SQL}
    SELECT source FROM m ORDER BY round(0.5 * correctness + 0.3 * citation_support + 0.2 * abstention, 6) DESC, source DESC LIMIT 1""")
def best_source(spark, sf_dir):
    """The best source by composite: a top-k report."""
    return M.ranked_board(metric_wide(spark, sf_dir), "source", "composite", F.lit(True)).limit(1).select("source")


@query("""
    WITH i AS (SELECT doc_id, quality IS NOT NULL AS judged, list_filter([CASE WHEN doc_id % 4 <> 0 AND doc_id % 6 = 0 THEN 'over_refusal' END, CASE WHEN quality = 0 THEN 'low_quality' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS f
               FROM documents JOIN labels USING (doc_id)),
    e AS (SELECT unnest(f) AS category FROM i)
    SELECT c AS category, CASE WHEN (SELECT bool_and(judged) FROM i) THEN count(e.category) END AS n FROM (SELECT unnest(['over_refusal', 'low_quality', 'toxic', 'never']) AS c) LEFT JOIN e ON e.category = c GROUP BY c""")
def error_taxonomy(spark, sf_dir):
    """Documents by error category, 0 where none has it."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    n = F.col("doc_id")
    flags = F.filter(F.array(F.when((n % 4 != 0) & (n % 6 == 0), "over_refusal"), F.when(F.col("quality") == 0, "low_quality"), F.when(F.col("toxic") == 1, "toxic")), lambda x: x.isNotNull())
    return M.taxonomy(d.select(flags.alias("categories"), F.col("quality").isNotNull().alias("judged")), ["over_refusal", "low_quality", "toxic", "never"])


@query("""
    WITH i AS (SELECT unnest(list_filter(['full', CASE WHEN lang = 'en' THEN 'en' END], lambda x: x IS NOT NULL)) AS slice, quality FROM documents LEFT JOIN labels USING (doc_id))
    SELECT slice, count(*) AS n, count(quality) AS n_judged, round(avg(quality), 6) AS quality FROM i GROUP BY slice""")
def population_slices(spark, sf_dir):
    """The full population and a slice of it, rows counting in both."""
    i = M.slices(_items(spark, sf_dir), F.col("lang") == "en", "en")
    return i.groupBy("slice").agg(F.count("*").alias("n"), F.count("quality").alias("n_judged"), F.round(F.avg("quality"), 6).alias("quality"))


@query("""
    WITH b AS (SELECT doc_id, quality AS before, CASE WHEN doc_id % 5 <> 0 THEN toxic END AS after FROM labels)
    SELECT CASE WHEN after - before IS NULL THEN 'pending' WHEN after > before THEN 'improves' WHEN after < before THEN 'worsens' ELSE 'unchanged' END AS change, count(*) AS n, CAST(sum(after - before) AS BIGINT) AS delta FROM b GROUP BY 1""")
def paired_delta(spark, sf_dir):
    """Changes between two conditions of the same documents; a missing score is pending."""
    labels = table(spark, sf_dir, "labels")
    before = labels.select("doc_id", F.col("quality").alias("v"))
    after = labels.select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("toxic")).alias("v"))
    return M.paired_changes(before, after, "doc_id", "v").groupBy("change").agg(F.count("*").alias("n"), F.sum("delta").cast("long").alias("delta"))


@query("""
    WITH g AS (SELECT doc_id, m FROM (SELECT doc_id FROM documents), (SELECT unnest(['a', 'b']) AS m)),
    r AS (SELECT doc_id, 'a' AS m, n_chars / 100.0 AS s FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 'b', n_chars / 50.0 FROM documents)
    SELECT g.m, count(*) AS n_items, count(s) AS n_responses, count(quality) AS n_judged, round(avg(quality), 6) AS correctness, round(median(s), 6) AS median_seconds, round(max(s), 6) AS max_seconds, round(count(quality) / count(*), 6) AS coverage
    FROM g LEFT JOIN r USING (doc_id, m) LEFT JOIN (SELECT doc_id, 'a' AS m, quality FROM labels) v USING (doc_id, m) GROUP BY g.m""")
def condition_summary(spark, sf_dir):
    """Conditions over all items, answered or not, judged or not."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    grid = docs.select("doc_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("m"))
    r = docs.where("doc_id % 3 <> 0").select("doc_id", F.lit("a").alias("m"), (F.col("n_chars") / 100.0).alias("seconds"))
    r = r.union(docs.select("doc_id", F.lit("b").alias("m"), (F.col("n_chars") / 50.0).alias("seconds")))
    s = M.condition_summary(grid, r, labels.select("doc_id", F.lit("a").alias("m"), F.col("quality").alias("correctness")), ["m"], "doc_id")
    return s.select("m", "n_items", "n_responses", "n_judged", *(F.round(c, 6).alias(c) for c in ("correctness", "median_seconds", "max_seconds", "coverage")))


@query("""
    SELECT event_type AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY event_type""")
def status_frequency(spark, sf_dir):
    """Counts and shares of event types."""
    return M.frequency(table(spark, sf_dir, "events"), "event_type").select("value", "n", F.round("share", 6).alias("share"))


@query("""
    SELECT doc_id FROM (SELECT doc_id, 'q' AS arm, quality AS v FROM labels UNION ALL SELECT doc_id, 't', CASE WHEN doc_id % 3 <> 0 THEN toxic END FROM labels) WHERE v IS NOT NULL GROUP BY doc_id HAVING count(DISTINCT arm) = 2""")
def scored_in_all_arms(spark, sf_dir):
    """Documents with a score in both arms."""
    labels = table(spark, sf_dir, "labels")
    arms = labels.select("doc_id", F.lit("q").alias("arm"), F.col("quality").alias("v")).union(labels.select("doc_id", F.lit("t").alias("arm"), F.when(F.col("doc_id") % 3 != 0, F.col("toxic")).alias("v")))
    return M.scored_in_all(arms, "doc_id", "arm", "v", 2)


@query("""
    SELECT 'orphan_labels' AS gate, count(*) AS violations FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
    UNION ALL SELECT 'unlabelled', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT 'duplicate_ids', count(*) FROM (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1)
    UNION ALL SELECT 'wrong_length', count(*) FROM documents WHERE n_chars <> length(text)""")
def population_gates(spark, sf_dir):
    """Violations of population equality, unique keys and stored lengths."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    gap = gates.unequal_populations(docs, labels, "doc_id")
    count = lambda df, name: df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("gate"), "violations")
    out = count(gap.where("missing_from = 'left'"), "orphan_labels").union(count(gap.where("missing_from = 'right'"), "unlabelled"))
    out = out.union(count(gates.duplicate_keys(docs, "doc_id"), "duplicate_ids"))
    return out.union(count(gates.breaches(docs, {"length": F.col("n_chars") == F.length("text")}), "wrong_length"))


@query("""
    SELECT doc_id, left(sha256('{"condition": "' || lang || '", "model": "' || source || '", "qid": "' || doc_id || '"}'), 24) AS id FROM documents""")
def content_ids(spark, sf_dir):
    """Content-hash identities."""
    return table(spark, sf_dir, "documents").select("doc_id", X.digest24(("model", F.col("source")), ("condition", F.col("lang")), ("qid", F.col("doc_id"))).alias("id"))


@query("""
    WITH RECURSIVE t AS (SELECT CAST(doc_id AS VARCHAR) AS key, doc_id, source, strlen(text) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS round FROM documents),
    p AS (SELECT *, CAST('0x' || substr(sha256(key), 1, 7) AS BIGINT) % 2 AS shard FROM t),
    o AS (SELECT *, row_number() OVER (PARTITION BY round, shard ORDER BY key) AS k FROM p),
    f AS (SELECT round, shard, k, doc_id, source, size, 0 AS batch, 1 AS held, size AS bytes FROM o WHERE k = 1
          UNION ALL SELECT o.round, o.shard, o.k, o.doc_id, o.source, o.size, CASE WHEN f.held = 10 OR f.bytes + o.size > 175000 THEN f.batch + 1 ELSE f.batch END,
                           CASE WHEN f.held = 10 OR f.bytes + o.size > 175000 THEN 1 ELSE f.held + 1 END, CASE WHEN f.held = 10 OR f.bytes + o.size > 175000 THEN o.size ELSE f.bytes + o.size END
          FROM f JOIN o ON o.round = f.round AND o.shard = f.shard AND o.k = f.k + 1)
    SELECT doc_id, source, CAST(size AS INTEGER) AS size, round || '-' || shard || '-' || batch AS batch FROM f""")
def batch_pack(spark, sf_dir):
    """Documents in judging batches: ten at most, one of each source, bounded bytes; a larger one is a batch alone."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.octet_length("text").alias("size"))
    return pack_batches(docs, "doc_id", "source", "size", shards=2, oversized="alone").select("doc_id", "source", "size", "batch")


_VOTED = """
    SELECT d.doc_id, d.n_chars AS n, l.quality = 1 AS answerable, l.toxic = 1 AS abstains, d.text, left(d.text, 200) AS ref, d.lang <> 'de' AS complete, d.n_chars < 9000 AS ended,
        CASE d.n_chars % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.0 END AS c, CASE WHEN l.toxic = 1 AND d.n_chars % 8 > 0 THEN NULL WHEN d.n_chars % 3 = 0 THEN 1.0 WHEN d.n_chars % 3 = 1 THEN 0.5 ELSE 0.0 END AS s,
        d.n_chars % 4 = 2 AS wrong, d.n_chars % 5 = 0 AS claim, d.n_chars % 7 = 0 AS contra, d.n_chars % 9 > 2 AS review, d.n_chars % 3 AS f1,
        left(d.text, 30) AS e1, CASE WHEN d.n_chars % 19 = 0 THEN 'not said anywhere' ELSE substr(d.text, 11, 20) END AS e2,
        CASE WHEN d.n_chars % 23 = 0 THEN ['invented'] WHEN d.n_chars % 10 < 8 THEN [left(d.text, 20)] ELSE [] END AS refs,
        CASE WHEN l.toxic = 1 AND d.n_chars % 8 <> 3 THEN CASE WHEN l.quality = 1 THEN 'incorrect_abstention' ELSE 'correct_abstention' END WHEN d.n_chars % 29 = 0 THEN 'other' ELSE 'correct_answer' END AS cat,
        CASE WHEN d.n_chars % 31 = 0 THEN 'sure' WHEN d.n_chars % 9 > 6 THEN 'low' ELSE 'high' END AS conf,
        CASE WHEN d.n_chars % 37 = 0 THEN ['odd'] WHEN d.n_chars % 12 = 5 THEN ['borderline'] WHEN d.n_chars % 17 = 0 THEN ['missing_reference'] WHEN d.n_chars >= 9000 AND d.n_chars % 2 = 0 THEN ['incomplete_output'] ELSE [] END AS flags, left(d.text, 10) AS why
    FROM documents d JOIN labels l ON l.doc_id = d.doc_id"""
_CATEGORY_SQL, _FLAG_SQL, _SEVERE_SQL = ("(" + ", ".join(f"'{x}'" for x in names) + ")" for names in (V.CATEGORIES, V.FLAGS, V.SEVERE))
_VOTE_RULES = [
    ("ungrounded_span", "contains(text, e1) AND (f1 = 0 OR trim(e1, ' ') <> '') AND contains(text, e2) AND trim(e2, ' ') <> ''"),
    ("invented_reference", "len(refs) = 0 OR (trim(refs[1], ' ') <> '' AND contains(ref, refs[1]))"),
    ("category", f"cat IN {_CATEGORY_SQL} AND conf IN ('high', 'medium', 'low')"),
    ("reason", f"len(list_filter(flags, lambda x: x NOT IN {_FLAG_SQL})) = 0 AND trim(why, ' ') <> ''"),
    ("material_error_scores_zero", "NOT (wrong OR contra) OR c IS NOT DISTINCT FROM 0.0"),
    ("contradicted_support", "NOT contra OR s IS NULL OR s = 0"),
    ("unsupported_full_support", "NOT (claim AND s IS NOT DISTINCT FROM 1.0)"),
    ("refusal_scores", "NOT (abstains AND answerable) OR c IS NULL OR c = 0"),
    ("refusal_support", "NOT abstains OR s IS NULL"),
    ("missing_reference_scored", "complete OR (abstains AND NOT answerable) OR (c IS NULL AND s IS NULL)"),
    ("support_without_span", "coalesce(s, 0) = 0 OR len(refs) > 0"),
    ("absent_support_unflagged", "s IS DISTINCT FROM 0.0 OR len(refs) > 0 OR claim OR contra"),
    ("severe_flag_scored", f"len(list_filter(flags, lambda x: x IN {_SEVERE_SQL})) = 0 OR (c IS NULL AND s IS NULL)"),
    ("uncertainty_needs_review", "NOT (c IS NULL OR len(flags) > 0 OR conf = 'low') OR review"),
    ("incomplete_unflagged", "ended OR list_contains(flags, 'incomplete_output')"),
    ("abstention_category", "NOT abstains OR cat = 'uncertain' OR cat = CASE WHEN answerable THEN 'incorrect_abstention' ELSE 'correct_abstention' END"),
]


@query(f"SELECT doc_id, CASE {' '.join(f'''WHEN NOT coalesce({rule}, false) THEN '{name}' ''' for name, rule in _VOTE_RULES)} END AS problem FROM ({_VOTED})")
def semantic_vote_rules(spark, sf_dir):
    """The first cross-field rule that a vote on a labelled document breaks, of votes made from its length, labels and text."""
    n, t = F.col("n_chars"), F.col("text")
    toxic, quality = F.col("toxic") == 1, F.col("quality") == 1
    none = F.array().cast("array<string>")
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    category = F.when(toxic & (n % 8 != 3), F.when(quality, "incorrect_abstention").otherwise("correct_abstention")).when(n % 29 == 0, "other").otherwise("correct_answer")
    flags = F.when(n % 37 == 0, F.array(F.lit("odd"))).when(n % 12 == 5, F.array(F.lit("borderline"))).when(n % 17 == 0, F.array(F.lit("missing_reference")))
    flags = flags.when((n >= 9000) & (n % 2 == 0), F.array(F.lit("incomplete_output"))).otherwise(none)
    vote = F.struct(
        F.col("doc_id").cast("string").alias("evaluation_id"), F.when(n % 4 == 0, 1.0).when(n % 4 == 1, 0.5).when(n % 4 == 2, 0.0).alias("correctness"),
        F.when(toxic & (n % 8 > 0), F.lit(None).cast("double")).when(n % 3 == 0, 1.0).when(n % 3 == 1, 0.5).otherwise(0.0).alias("evidence_support"),
        (n % 4 == 2).alias("materially_incorrect"), (n % 5 == 0).alias("unsupported_material_claim"), (n % 7 == 0).alias("contradiction"), (n % 9 > 2).alias("needs_human_review"),
        F.array((n % 3).cast("int"), F.lit(1)).alias("fact_scores"), F.array(F.substring(t, 1, 30), F.when(n % 19 == 0, "not said anywhere").otherwise(F.substring(t, 11, 20))).alias("evidence_spans"),
        F.when(n % 23 == 0, F.array(F.lit("invented"))).when(n % 10 < 8, F.array(F.substring(t, 1, 20))).otherwise(none).alias("reference_spans"), category.alias("abstention_category"),
        F.when(n % 31 == 0, "sure").when(n % 9 > 6, "low").otherwise("high").alias("judge_confidence"), flags.alias("uncertainty_flags"), F.substring(t, 1, 10).alias("reason"))
    task = F.struct(
        F.col("doc_id").cast("string").alias("evaluation_id"), F.array("lang", "text").alias("key_facts"), F.array(F.struct(F.substring(t, 1, 200).alias("text"))).alias("reference_evidence"), t.alias("model_answer"),
        quality.alias("gold_answerable"), toxic.alias("deterministic_abstention"), (F.col("lang") != "de").alias("reference_complete"), (n < 9000).alias("output_complete"))
    return rows.select("doc_id", vote.alias("v"), task.alias("t")).select("doc_id", V.first_breach(V.semantic_rules()).alias("problem"))
