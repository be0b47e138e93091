"""Curation gates as rules: eligibility, leakage, technical and later exclusions, evidence and reference packages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import names_a_model, norm_key, template_key
from millrace.operators.decontam import cited_chunks, fuzzy_pairs, reasons
from millrace.operators.gates import breaches

# Review outcomes that count as verified, and those that settle an unanswerable question.
VERIFIED = ("verified", "council_verified", "council_adjudicated")
SETTLED = ("council_verified", "council_adjudicated")
LIKE_QUESTION = 0.85
#: Evidence outcomes of an answer.
ALL, SOME, NONE, UNASSESSABLE = "all_gold_quotes_located", "some_gold_quotes_located", "no_gold_quotes_located", "unassessable"


def of_split(rows: DataFrame, split: str | None, version: str, defaults: Mapping[str, str]) -> DataFrame:
    """Rows of a split; without one, of the version's default split; of ``all``, every row."""
    wanted = split or defaults.get(version)
    return rows if not wanted or wanted == "all" else rows.where(F.col("split") == wanted)


def ineligible(records: DataFrame, product: str, split: str = "train") -> DataFrame:
    """Records that may not be exported, with the rules they break: the gate passes if there are none.

    ``records``: product, split, validation_status, unresolved_citations (array), screen_passed.
    """
    rules = {
        "product": F.col("product") == product,
        "split": F.col("split") == split,
        "status": F.col("validation_status") == "accepted",
        "unresolved_citations": F.coalesce(F.size("unresolved_citations"), F.lit(0)) <= 0,
        "screen": F.col("screen_passed"),
    }
    return breaches(records, rules)


def held_out(rows: DataFrame, name: str, excluded: Sequence[str]) -> DataFrame:
    """Rows that name an excluded party, whatever the case: the gate passes if there are none."""
    return rows.where(F.lower(F.trim(F.col(name))).isin(*(e.lower() for e in excluded)))


def seed_leakage(seeds: DataFrame, forbidden: DataFrame, blocked: DataFrame) -> DataFrame:
    """``seeds`` with all reasons why one may not be trained on, sorted; none means that it may.

    ``seeds``: id, split, question, gold_answer, review_status; ``forbidden``: id, question, gold_answer; ``blocked``:
    id. Questions overlap if they are equal or nearly so, answers if they are equal, both after normalisation.
    """
    mine = seeds.select("id", norm_key(F.col("question")).alias("q"), norm_key(F.col("gold_answer")).alias("a"))
    theirs = forbidden.select(F.col("id").alias("other"), norm_key(F.col("question")).alias("q"), norm_key(F.col("gold_answer")).alias("a"))
    near = fuzzy_pairs(mine, "id", "q", theirs, "other", "q", LIKE_QUESTION).select(F.col("a").alias("id"))
    same = mine.join(theirs.select("q").distinct(), "q", "left_semi").select("id")
    marks = {
        "question_overlap": near.union(same),
        "answer_overlap": mine.join(theirs.select("a").distinct(), "a", "left_semi").select("id"),
        "forbidden_id": forbidden.select("id"),
        "test_or_dev_intent_cluster": blocked.select("id"),
    }
    rows = seeds
    for name, ids in marks.items():
        rows = rows.join(ids.distinct().withColumn(f"_{name}", F.lit(True)), "id", "left")
    rules = {name: F.col(f"_{name}").isNotNull() for name in marks}
    rules["not_seed"] = ~F.col("split").eqNullSafe("seed")
    rules["unverified"] = ~F.coalesce(F.col("review_status").isin(*VERIFIED), F.lit(False))
    return reasons(rows, rules).drop(*(f"_{name}" for name in marks))


def protected_hits(rows: DataFrame, key: str, pages: str, protected: DataFrame) -> DataFrame:
    """Keys of rows with evidence on a protected page; ``pages`` is an array of structs of doc and page (text).

    Pages are compared as text, as they are written.
    """
    cited = rows.select(key, F.explode(pages).alias("e")).select(key, F.col("e.doc").alias("doc"), F.col("e.page").cast("string").alias("page"))
    wanted = protected.select("doc", F.col("page").cast("string").alias("page")).distinct()
    return cited.join(wanted, ["doc", "page"], "left_semi").select(key).distinct()


def technical_reasons(rows: DataFrame, known_questions: DataFrame, protected: DataFrame) -> DataFrame:
    """``rows`` with the reasons of deterministic gates, sorted: their own (``gate_reasons``) and three more.

    ``rows``: id, question, answerability, abstention_reason, evidence (structs of doc, page), gate_reasons;
    ``known_questions``: question; ``protected``: doc, page.
    """
    known = known_questions.select(norm_key(F.col("question")).alias("_q")).distinct().withColumn("_known", F.lit(True))
    hit = protected_hits(rows, "id", "evidence", protected).withColumn("_hit", F.lit(True))
    found = rows.withColumn("_q", norm_key(F.col("question"))).join(known, "_q", "left").join(hit, "id", "left")
    rules = {
        "normalised_duplicate_question": F.col("_known").isNotNull(),
        "protected_supporting_page_overlap": F.col("_hit").isNotNull(),
        "missing_abstention_reason": (F.col("answerability") == "unanswerable") & (F.coalesce(F.trim("abstention_reason"), F.lit("")) == ""),
    }
    out = reasons(found, rules)
    own = F.coalesce(F.col("gate_reasons"), F.array().cast("array<string>"))
    return out.withColumn("reasons", F.array_sort(F.array_union(own, F.col("reasons")))).drop("_q", "_known", "_hit")


def after_acceptance(rows: DataFrame, protected: DataFrame) -> DataFrame:
    """New accepted rows under later exclusions: any reason turns the status to ``needs_review`` and is added to the others.

    ``rows``: id, question, answerability, evidence, status, reasons, is_new, screened, absence_verified. Other rows stay
    as they are; their questions count for repeated templates all the same.
    """
    hit = protected_hits(rows, "id", "evidence", protected).withColumn("_hit", F.lit(True))
    keyed = rows.withColumn("_key", template_key(F.col("question")))
    repeated = keyed.groupBy("_key").agg(F.count("*").alias("_n"))
    found = keyed.join(repeated, "_key").join(hit, "id", "left").withColumnRenamed("reasons", "_old")
    rules = {
        "training_semantic_screen_required": ~F.coalesce(F.col("screened"), F.lit(False)),
        "protected_supporting_page_overlap": F.col("_hit").isNotNull(),
        "full_document_insufficiency_review_required": (F.col("answerability") == "unanswerable") & ~F.coalesce(F.col("absence_verified"), F.lit(False)),
        "repeated_question_template_review": F.col("_n") > 1,
    }
    open_ = F.col("is_new") & (F.col("status") == "accepted")
    out = reasons(found, {name: open_ & rule for name, rule in rules.items()})
    out = out.withColumn("status", F.when(F.size("reasons") > 0, "needs_review").otherwise(F.col("status")))
    old = F.coalesce(F.col("_old"), F.array().cast("array<string>"))
    return out.withColumn("reasons", F.when(F.size("reasons") > 0, F.array_sort(F.array_union(old, F.col("reasons")))).otherwise(F.col("_old"))).drop("_key", "_n", "_hit", "_old")


def reason_patterns(decisions: DataFrame, patterns: Mapping[str, Sequence[str]], column: str = "reasons") -> DataFrame:
    """Rows with a reason that holds one of each pattern's words; a row may count for several patterns, once for each."""
    holds = lambda words: F.exists(F.coalesce(F.col(column), F.array().cast("array<string>")), lambda r: F.lower(r).rlike("|".join(words)))
    counted = decisions.agg(*(F.count_if(holds(words)).alias(name) for name, words in patterns.items()))
    return counted.unpivot([], list(patterns), "pattern", "n")


def calibrated(votes: DataFrame, fixtures: DataFrame) -> DataFrame:
    """``fixtures`` with ``passed``: whether a vote gives the expected score and a category that fits the fixture.

    A fixture that abstains needs its own abstention category and no support score; another needs none of both
    categories. A fixture without a vote fails.
    """
    v = votes.select("evaluation_id", F.col("correctness").alias("_c"), F.col("evidence_support").alias("_e"), F.col("abstention_category").alias("_k"), F.lit(True).alias("_seen"))
    both = fixtures.join(v, "evaluation_id", "left")
    wanted = F.when(F.col("gold_answerable"), "incorrect_abstention").otherwise("correct_abstention")
    category = F.when(F.col("deterministic_abstention"), F.col("_e").isNull() & (F.col("_k") == wanted)).otherwise(~F.col("_k").isin("correct_abstention", "incorrect_abstention"))
    passed = F.coalesce(F.col("_seen") & F.col("_c").eqNullSafe(F.col("expected")) & category, F.lit(False))
    return both.withColumn("passed", passed).drop("_c", "_e", "_k", "_seen")


def bundle_problems(rows: DataFrame, key: str, content: str, expected: str, n_rows: int) -> DataFrame:
    """``(problem, n)`` of a training bundle against its manifest: rows, keys and content hashes; empty if it is unchanged."""
    counts = rows.agg(
        F.when(F.count("*") != n_rows, F.abs(F.count("*") - n_rows)).otherwise(0).alias("row_count"),
        (F.count("*") - F.countDistinct(key)).alias("duplicate_key"),
        F.count_if(~F.sha2(F.col(content), 256).eqNullSafe(F.lower(expected))).alias("hash_mismatch"),
    )
    return counts.unpivot([], ["row_count", "duplicate_key", "hash_mismatch"], "problem", "n").where("n > 0")


def evidence_presence(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(answer_id, status, found, total)``: how many of an answer's gold quotes its chunks hold, on any page.

    ``citations``: answer_id, occurrence, filename, insurer, quote (null for an answer without any); ``chunks``:
    answer_id, chunk_id, filename, insurer, text. Without citations, or with a blank quote, nothing can be assessed.
    """
    c = citations.withColumn("cite_id", F.struct("answer_id", "occurrence")).withColumn("filename", F.concat_ws("\n", F.col("answer_id").cast("string"), "filename"))
    k = chunks.withColumn("filename", F.concat_ws("\n", F.col("answer_id").cast("string"), "filename")).withColumn("page", F.lit(0))
    held = cited_chunks(c.withColumn("page", F.lit("0")), k, band=None).select("cite_id").distinct().withColumn("held", F.lit(True))
    blank = F.col("occurrence").isNull() | (F.coalesce(norm_key(F.col("quote")), F.lit("")) == "")
    by = c.withColumn("blank", blank).join(held, "cite_id", "left").groupBy("answer_id")
    out = by.agg(F.bool_or("blank").alias("blank"), F.count("held").alias("found"), F.count("occurrence").alias("total"))
    found = F.when(F.col("blank"), F.lit(0).cast("long")).otherwise(F.col("found"))
    status = F.when(F.col("blank"), UNASSESSABLE).when(F.col("found") == F.col("total"), ALL).when(F.col("found") > 0, SOME).otherwise(NONE)
    return out.select("answer_id", status.alias("status"), found.alias("found"), "total")


def reference_package(gold: DataFrame, citations: DataFrame, chunks: DataFrame, contexts: DataFrame) -> DataFrame:
    """``(qid, chunk_ids, from_context, complete)``: the chunks that a question is judged against.

    ``gold``: qid, answerable, review_status; ``citations``: qid, occurrence, filename, section; ``chunks``: chunk_id,
    position, filename, section; ``contexts``: qid, chunk_id, position. Cited chunks come in the order of citations, a
    chunk once; the package is complete if there are citations and each has a chunk. An unanswerable question without any
    takes its context instead, and is complete if a council settled it.
    """
    section = lambda name: F.col(name).cast("string")
    c = citations.select("qid", "occurrence", "filename", section("section").alias("section"))
    k = chunks.select("chunk_id", "position", "filename", section("section").alias("section"))
    met = c.join(k, ["filename", "section"], "left")
    whole = met.groupBy("qid", "occurrence").agg(F.count("chunk_id").alias("n")).groupBy("qid").agg((F.min("n") > 0).alias("all_met"))
    first = met.where("chunk_id is not null").groupBy("qid", "chunk_id").agg(F.min(F.struct("occurrence", "position")).alias("at"))
    cited = first.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("at", "chunk_id")))["chunk_id"].alias("cited"))
    around = contexts.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("position", "chunk_id")))["chunk_id"].alias("around"))
    rows = gold.join(whole, "qid", "left").join(cited, "qid", "left").join(around, "qid", "left")
    none = F.array().cast(rows.schema["cited"].dataType)
    fallback = ~F.col("answerable") & F.col("cited").isNull()
    ids = F.coalesce(F.when(fallback, F.col("around")).otherwise(F.col("cited")), none)
    settled = F.coalesce(F.col("review_status").isin(*SETTLED), F.lit(False))
    complete = F.when(fallback, (F.size(ids) > 0) & settled).otherwise(F.coalesce("all_met", F.lit(False)))
    return rows.select("qid", ids.alias("chunk_ids"), fallback.alias("from_context"), complete.alias("complete"))


def evidence_decomposition(items: DataFrame, statuses: Sequence[str] = (ALL, SOME, NONE, UNASSESSABLE)) -> DataFrame:
    """Answerable items by evidence status: correctness only where all are judged; statuses without items count 0.

    ``items``: answerable, status, corr_item, refused.
    """
    by = items.where("answerable").groupBy("status").agg(
        F.count("*").alias("n"), F.count("corr_item").alias("scored"), F.avg("corr_item").alias("mean"), F.count_if("refused").alias("over_refusals")
    )
    names = items.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    rows = names.join(by, "status", "left").na.fill(0, ["n", "scored", "over_refusals"])
    return rows.select(
        "status", "n", F.when((F.col("n") > 0) & (F.col("scored") == F.col("n")), F.col("mean")).alias("correctness"), (F.col("n") - F.col("scored")).alias("unjudged"),
        "over_refusals", F.try_divide("over_refusals", "n").alias("over_refusal_rate"),
    )


def evidence_counts(records: DataFrame) -> DataFrame:
    """Distinct questions, insurers, documents and sections of ``records(question, evidence)``, in one pass.

    ``evidence``: structs of insurer, source_id, section. Records without evidence count for their question.
    """
    rows = records.select(norm_key(F.col("question")).alias("q"), F.explode_outer("evidence").alias("e"))
    section = F.when(F.col("e").isNotNull(), F.struct("e.source_id", "e.section"))
    return rows.agg(
        F.countDistinct("q").alias("unique_questions"), F.countDistinct("e.insurer").alias("insurers"), F.countDistinct("e.source_id").alias("source_documents"), F.countDistinct(section).alias("evidence_sections")
    )


def unnamed(rows: DataFrame, text: str, names: Sequence[str], action: str = "raise") -> DataFrame:
    """Rows whose text does not name the model that wrote it: others are left out, or an error where blinding is audited."""
    named = F.coalesce(names_a_model(F.col(text), names), F.lit(False))
    if action == "skip":
        return rows.where(~named)
    return rows.withColumn(text, F.when(named, F.raise_error(F.lit("a text names its model"))).otherwise(F.col(text)))


def question_clusters(records: DataFrame, question: str, label: str) -> DataFrame:
    """``(size, clusters, mixed)``: clusters of equal questions by size, and those whose rows differ in ``label``."""
    clusters = records.groupBy(norm_key(F.col(question)).alias("q")).agg(F.count("*").alias("size"), F.countDistinct(label).alias("labels"))
    return clusters.where("size > 1").groupBy("size").agg(F.count("*").alias("clusters"), F.count_if(F.col("labels") > 1).alias("mixed"))


def latest_checkpoints(members: DataFrame, complete: DataFrame) -> DataFrame:
    """``members(model, phase, step, ...)`` of the latest step of each model and phase; complete models are left out.

    Members that belong to no checkpoint (a null step) are kept.
    """
    latest = F.max("step").over(Window.partitionBy("model", "phase"))
    open_ = members.where("step is not null").join(complete.select("model").distinct(), "model", "left_anti")
    kept = open_.withColumn("_latest", latest).where("step = _latest").drop("_latest")
    return kept.select(*members.columns).unionByName(members.where("step is null"))


#: Rows of a group that meet in one task; larger groups are compared in tiles.
TILE_ROWS = 2048


def uncovered_pairs(rows: DataFrame, group: str, order: str, covered: Sequence[str]) -> DataFrame:
    """``(group, a, b)``: pairs of a group, first to last, of which neither lists the other in a ``covered`` array.

    A group of more than :data:`TILE_ROWS` rows is dealt into parts, and every two parts, or one with itself, are a
    key of their own: no task joins more than two parts, however large a group is. That there is a row a pair is the
    feature; what is shuffled is a row a part.
    """
    c = [F.col(n).alias(f"_{i}") for i, n in enumerate(covered)]
    held = rows.select(F.col(group).alias("group"), F.col(order).alias("at"), *c)
    large = held.groupBy("group").agg(F.ceil(F.count("*") / TILE_ROWS).cast("int").alias("parts")).where("parts > 1")  # a row a large group
    held = held.join(large, "group", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    held = held.withColumn("part", F.pmod(F.xxhash64("at"), F.col("parts")).cast("int"))
    tiled = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiled = tiled.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other"))
    side = lambda s: tiled.select("group", "low", "high", F.col("at").alias(s), F.col("part").alias(f"{s}_part"), *(F.col(f"_{i}").alias(f"{s}_{i}") for i in range(len(c))))
    known = F.lit(False)
    for i in range(len(c)):
        known = known | F.coalesce(F.array_contains(f"a_{i}", F.col("b")), F.lit(False)) | F.coalesce(F.array_contains(f"b_{i}", F.col("a")), F.lit(False))
    # two rows of one part meet in that part's own tile only
    once = (F.col("low") == F.col("high")) | (F.col("a_part") != F.col("b_part"))
    return side("a").join(side("b"), ["group", "low", "high"]).where((F.col("a") < F.col("b")) & once & ~known).select("group", "a", "b")
