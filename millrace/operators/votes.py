"""Judge votes: validation, merging, selection and agreement."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.numbering import number_rows

# Fixed values of the vote schema.
CATEGORIES = ("correct_abstention", "incorrect_abstention", "correct_answer", "incorrect_unsupported_answer", "incorrect_answer", "uncertain")
FLAGS = ("ambiguous_evidence", "missing_reference", "conflicting_passages", "unsupported_gold_assumption", "borderline", "incomplete_output")
SEVERE = FLAGS[:4]
UNKNOWN_STATES = ("in_flight", "transport_uncertain", "response_saved")


def vote_problem(scores: Column, n_facts: Column, contradiction: Column, spans: Column | None = None) -> Column:
    """The first of ``arity``, ``range``, ``contradiction_type`` and ``spans_arity`` that a vote breaks; null if valid.

    Scores are integers as declared by the schema: a JSON boolean reads as null there, which is out of range.
    """
    bad_score = F.exists(scores, lambda x: x.isNull() | ~x.isin(0, 1, 2))
    reason = F.when(scores.isNull() | (F.size(scores) != n_facts), "arity").when(bad_score, "range").when(contradiction.isNull(), "contradiction_type")
    return reason if spans is None else reason.when(spans.isNotNull() & (F.size(spans) != n_facts), "spans_arity")


def merge_votes(votes: DataFrame, min_valid: int = 2) -> DataFrame:
    """One row per task of valid ``votes(task, vote, fact_scores, contradiction[, evidence_spans])``.

    A fact's score is the lower median, carried by the lowest vote that has it; ties of contradiction are true. Tasks
    with fewer than ``min_valid`` votes have ``enough`` false and null results: they must not be published.
    """
    spans = F.col("evidence_spans") if "evidence_spans" in votes.columns else F.lit(None).cast("array<string>")
    v = votes.select("task", "vote", "fact_scores", "contradiction", spans.alias("spans"))
    facts = v.select("task", "vote", "spans", F.posexplode("fact_scores").alias("fact", "score"))
    per_fact = facts.groupBy("task", "fact").agg(
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY score)").cast("int").alias("score"),
        F.countDistinct("score").alias("n_scores"),
        F.array_sort(F.collect_list(F.struct("vote", "score", F.coalesce(F.get("spans", F.col("fact")), F.lit("")).alias("span")))).alias("cast"),
    )
    carried = F.filter("cast", lambda c: c["score"] == F.col("score"))
    per_fact = per_fact.withColumn("span", carried[0]["span"])
    merged = per_fact.groupBy("task").agg(
        F.array_sort(F.collect_list(F.struct("fact", "score", "span"))).alias("facts"), F.count_if(F.col("n_scores") > 1).alias("n_facts_disagreed")
    )
    heads = v.groupBy("task").agg(F.count("*").alias("n_votes"), F.count_if("contradiction").alias("n_true"))
    out = heads.join(merged, "task", "left").withColumn("enough", F.col("n_votes") >= min_valid)
    only = lambda c: F.when(F.col("enough"), c)
    return out.select(
        "task",
        "n_votes",
        "enough",
        only(F.col("facts.score")).alias("fact_scores"),
        only(F.col("facts.span")).alias("evidence_spans"),
        only(F.col("n_true") * 2 >= F.col("n_votes")).alias("contradiction"),
        only(F.when(F.col("n_true") * 2 == F.col("n_votes"), "contradiction_tie_to_true")).alias("tie_break"),
        only(F.col("n_facts_disagreed")).alias("n_facts_disagreed"),
    )


def semantic_rules(v: str = "v", t: str = "t") -> Mapping[str, Column]:
    """Cross-field rules of a semantic vote against its task, in order; the first that is not true is its reason."""
    c = lambda name: F.col(f"{v}.{name}")
    k = lambda name: F.col(f"{t}.{name}")
    blank = lambda s: F.trim(s) == ""
    score_ok = lambda s: s.isNull() | s.isin(0.0, 0.5, 1.0)
    reference = F.array_join(F.transform(k("reference_evidence"), lambda e: e["text"]), "\n")
    spans_ok = F.forall(
        F.zip_with(c("evidence_spans"), c("fact_scores"), lambda s, f: F.struct(s.alias("s"), f.alias("f"))),
        lambda x: F.contains(k("model_answer"), x["s"]) & ((x["f"] == 0) | ~blank(x["s"])),
    )
    abstains, answerable = k("deterministic_abstention"), k("gold_answerable")
    scored = c("correctness").isNotNull() | c("evidence_support").isNotNull()
    has = lambda flags: F.arrays_overlap(c("uncertainty_flags"), F.array(*(F.lit(f) for f in flags)))
    zero = c("correctness").eqNullSafe(F.lit(0.0))
    expected = F.when(answerable, "incorrect_abstention").otherwise("correct_abstention")
    return {
        "id": c("evaluation_id") == k("evaluation_id"),
        "score": score_ok(c("correctness")) & score_ok(c("evidence_support")),
        "boolean": F.concat(*(c(n).cast("string") for n in ("materially_incorrect", "unsupported_material_claim", "contradiction", "needs_human_review"))).isNotNull(),
        "fact_arity": (F.size(c("fact_scores")) == F.size(k("key_facts"))) & ~F.exists(c("fact_scores"), lambda x: x.isNull() | ~x.isin(0, 1, 2)),
        "span_arity": F.size(c("evidence_spans")) == F.size(c("fact_scores")),
        "ungrounded_span": spans_ok,
        "invented_reference": F.forall(c("reference_spans"), lambda s: ~blank(s) & F.contains(reference, s)),
        "category": c("abstention_category").isin(*CATEGORIES) & c("judge_confidence").isin("high", "medium", "low"),
        "reason": (F.size(F.array_except(c("uncertainty_flags"), F.array(*(F.lit(f) for f in FLAGS)))) == 0) & ~blank(c("reason")),
        "material_error_scores_zero": ~(c("materially_incorrect") | c("contradiction")) | zero,
        "contradicted_support": ~c("contradiction") | c("evidence_support").isNull() | (c("evidence_support") == 0),
        "unsupported_full_support": ~(c("unsupported_material_claim") & c("evidence_support").eqNullSafe(F.lit(1.0))),
        "refusal_scores": ~(abstains & answerable) | c("correctness").isNull() | (c("correctness") == 0),
        "refusal_support": ~abstains | c("evidence_support").isNull(),
        "missing_reference_scored": k("reference_complete") | (abstains & ~answerable) | ~scored,
        "support_without_span": ~F.coalesce(c("evidence_support").isin(0.5, 1.0), F.lit(False)) | (F.size(c("reference_spans")) > 0),
        "absent_support_unflagged": ~c("evidence_support").eqNullSafe(F.lit(0.0)) | (F.size(c("reference_spans")) > 0) | c("unsupported_material_claim") | c("contradiction"),
        "severe_flag_scored": ~has(SEVERE) | ~scored,
        "uncertainty_needs_review": ~(c("correctness").isNull() | (F.size(c("uncertainty_flags")) > 0) | (c("judge_confidence") == "low")) | c("needs_human_review"),
        "incomplete_unflagged": k("output_complete") | has(("incomplete_output",)),
        "abstention_category": ~abstains | c("abstention_category").isin("uncertain") | (c("abstention_category") == expected),
    }


def first_breach(rules: Mapping[str, Column]) -> Column:
    """Name of the first rule that is not true; null if all are."""
    reason = None
    for name, ok in rules.items():
        bad = ~F.coalesce(ok, F.lit(False))
        reason = F.when(bad, name) if reason is None else reason.when(bad, name)
    return reason


def citation_problem(citations: Column, assessed: Column, answer: Column, evidence: Column) -> Column:
    """Assessments must be of the same citation occurrences, quote verbatim and support positively only with evidence."""
    names = F.transform(assessed, lambda a: a["citation"])
    verbatim = F.forall(assessed, lambda a: F.contains(answer, a["answer_span"]) & F.contains(evidence, a["evidence_span"]))
    backed = F.forall(assessed, lambda a: ~F.coalesce(a["support"] > 0, F.lit(False)) | (F.trim(a["evidence_span"]) != ""))
    return (
        F.when(F.size(assessed) != F.size(citations), "count").when(F.array_sort(names) != F.array_sort(citations), "citations").when(~verbatim, "not_verbatim").when(~backed, "support_without_evidence")
    )


IDENTITY = ("provider", "model", "revision", "transport_version")


def vote_set_problem(votes: DataFrame, most: int = 3) -> DataFrame:
    """``(task, problem)`` of tasks whose votes may not be merged: the first of a repeated vote, a vote number that is
    none, and several judges (as far as their columns are there)."""
    judge = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in IDENTITY if c in votes.columns]
    by = votes.groupBy("task").agg(
        (F.count("*") > F.countDistinct("vote")).alias("repeated"),
        F.bool_or(F.coalesce(~F.col("vote").between(1, most), F.lit(True))).alias("unknown"),
        (F.countDistinct(F.struct(*judge)) > 1 if judge else F.lit(False)).alias("mixed"),
    )
    problem = F.when(F.col("unknown"), "invalid_vote_index").when(F.col("repeated"), "duplicate_vote").when(F.col("mixed"), "mixed_judges")
    return by.select("task", problem.alias("problem")).where("problem is not null")


def merge_semantic(votes: DataFrame, tasks: DataFrame, required: int = 3) -> DataFrame:
    """One row per task with at least ``required`` votes: nothing that a judge left out is filled in.

    ``votes``: task, vote, fact_scores, evidence_spans, correctness, evidence_support, category, materially_incorrect,
    unsupported_material_claim, contradiction, needs_human_review, uncertainty_flags, material_conditions, and the
    judge's identity; ``tasks``: task, gold_answerable, deterministic_abstention.

    Scores are lower medians, null if a vote is; flags hold from half of the votes on; a category needs more than half.
    A contradiction makes correctness 0. Full correctness of an answered, answerable question with a fact below 2 is
    inconsistent: it becomes null and is reviewed. Votes that :func:`vote_set_problem` names fail the whole merge.
    """
    bad = vote_set_problem(votes)
    facts = merge_votes(votes, min_valid=required).select("task", "fact_scores", F.col("n_facts_disagreed").alias("n_facts_disagreed"))
    med = lambda c: F.when(F.count("*") == F.count(c), F.element_at(F.array_sort(F.collect_list(c)), F.ceil(F.count(c) / 2).cast("int")))
    half = lambda c: F.count_if(c) * 2 >= F.count("*")
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    differ = F.lit(False)
    for c in ("correctness", "evidence_support", "contradiction", "unsupported_material_claim", "materially_incorrect"):
        differ = differ | (F.countDistinct(F.coalesce(F.col(c).cast("string"), F.lit("null"))) > 1)
    base = votes.groupBy("task").agg(
        F.count("*").alias("n_votes"),
        med("correctness").alias("median"),
        med("evidence_support").alias("evidence_support"),
        half(F.col("contradiction")).alias("contradiction"),
        half(F.col("materially_incorrect")).alias("materially_incorrect"),
        half(F.col("unsupported_material_claim")).alias("unsupported_material_claim"),
        F.bool_or("needs_human_review").alias("asked"),
        F.countDistinct("category").alias("n_categories"),
        differ.alias("differ"),
        union("uncertainty_flags").alias("uncertainty_flags"),
        union("material_conditions").alias("material_conditions"),
    )
    counts = votes.groupBy("task", "category").agg(F.count("*").alias("n"))
    top = counts.groupBy("task").agg(F.max_by("category", "n").alias("top"), F.max("n").alias("top_n"))
    rows = base.join(top, "task").join(facts, "task").join(tasks.select("task", "gold_answerable", "deterministic_abstention"), "task").join(bad, "task", "left")
    rows = rows.withColumn("n_votes", F.when(F.col("problem").isNotNull(), F.raise_error(F.concat_ws(": ", F.col("task").cast("string"), "problem"))).otherwise(F.col("n_votes")))
    rows = rows.where(F.col("n_votes") >= required)
    score = F.when(F.col("contradiction") & F.col("median").isNotNull(), F.lit(0.0)).otherwise(F.col("median"))
    low_fact = F.exists("fact_scores", lambda x: x < 2)
    rows = rows.withColumn("score", score).withColumn(
        "inconsistent", F.coalesce((F.col("score") == 1) & F.col("gold_answerable") & ~F.col("deterministic_abstention") & low_fact, F.lit(False))
    )
    return rows.select(
        "task",
        "n_votes",
        "fact_scores",
        "n_facts_disagreed",
        F.when(~F.col("inconsistent"), F.col("score")).alias("correctness"),
        "evidence_support",
        F.when(F.col("top_n") * 2 > F.col("n_votes"), F.col("top")).otherwise("uncertain").alias("category"),
        "contradiction",
        "materially_incorrect",
        "unsupported_material_claim",
        F.col("inconsistent").alias("fact_overall_inconsistency"),
        (F.col("asked") | (F.col("n_categories") > 1) | F.col("inconsistent")).alias("needs_human_review"),
        (F.col("differ") | (F.col("n_facts_disagreed") > 0)).alias("disagreement"),
        "uncertainty_flags",
        "material_conditions",
        F.when(F.col("n_votes") == 3, "three_vote").otherwise("preliminary_single_vote").alias("protocol"),
    )


def first_write(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of every key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def by_priority(rows: DataFrame, key: str, provider: str, priority: Sequence[str]) -> DataFrame:
    """One row per key from the provider that comes first in ``priority``; others are never chosen."""
    rank = F.array_position(F.array(*(F.lit(p) for p in priority)), F.col(provider))
    best = rows.withColumn("_rank", rank).where("_rank > 0")
    value = F.struct(*(F.col(c) for c in rows.columns))
    return best.groupBy(key).agg(F.min_by(value, "_rank").alias("r")).select("r.*")


def latest_state(history: DataFrame, key: str, seq: str, status: str) -> DataFrame:
    """The last status of every key, and whether its outcome is unknown."""
    last = history.groupBy(key).agg(F.max_by(status, seq).alias("status"), F.count("*").alias("attempts"))
    return last.withColumn("unknown", F.col("status").isin(*UNKNOWN_STATES))


def eligible(tasks: DataFrame, key: str, blockers: Sequence[DataFrame], cost: str, limit: float) -> DataFrame:
    """Tasks that no blocker covers and whose cost is known and within the limit."""
    out = tasks
    for b in blockers:
        out = out.join(b.select(key).distinct(), key, "left_anti")
    return out.where(F.coalesce(F.col(cost).cast("double"), F.lit(1e20)) <= limit)


def disagreement_rate(merged: DataFrame) -> DataFrame:
    """Facts that votes disagreed on, over facts and over tasks."""
    return merged.agg(
        F.sum(F.size("fact_scores")).alias("n_facts"),
        F.sum("n_facts_disagreed").alias("n_disagreed"),
        F.count("*").alias("n_tasks"),
        F.try_divide(F.sum("n_facts_disagreed").cast("double"), F.sum(F.size("fact_scores"))).alias("rate"),
    )


def blinded(records: DataFrame, allowed: Sequence[str], order: Sequence[str], form: str = "e%06d") -> tuple[DataFrame, DataFrame]:
    """Tasks with allowed columns and opaque ids, and the table that maps ids to the rest."""
    numbered = number_rows(records, order, "_n").withColumn("evaluation_id", F.format_string(form, "_n")).drop("_n")
    return numbered.select("evaluation_id", *allowed), numbered.drop(*allowed)
