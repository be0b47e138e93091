"""Report tables: metrics with numerator, denominator, interval and definition, and summaries of cells."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.metrics import claim_flags, weighted_kappa_of

#: What each metric means; a metric's place here is its place in a report.
DEFINITIONS: Mapping[str, str] = {
    "correctness": "mean of scores that are not null; missing and uncertain ones are left out, not zero",
    "reference_support": "mean of reference support scores that are not null",
    "citation_support": "mean support of assessed citations, where there is retrieval",
    "parse_rate": "answers that refuse or hold a readable citation, over the population",
    "citation_resolution": "citations that resolve against what was retrieved, over all citations",
    "appropriate_refusal_rate": "unanswerable questions that were refused, over all unanswerable ones",
    "false_refusal_rate": "answerable questions that were refused, over all answerable ones",
    "refusal_correctness": "appropriate refusals over all refusals",
    "balanced_abstention": "half the answerable questions answered plus half the unanswerable ones refused, as rates",
    "coverage": "questions with an accepted judgement, over the population",
}


def report_cells(items: DataFrame, keys: Sequence[str], retrieves: Column, answerable_n: int, unanswerable_n: int) -> DataFrame:
    """Numerators and denominators of every metric by cell.

    ``items``, a row a question and cell: answerable, responded, refused, n_cited, n_resolved, judged, correctness,
    reference_support, citation_sum, citation_n. A cell is available once every question has a response; until then all
    its values are null and its denominators 0.
    """
    population = answerable_n + unanswerable_n
    said, ok = F.col("responded"), F.col("judged")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    cells = items.withColumn("_retrieves", retrieves).groupBy(*keys).agg(
        (count(said) == population).alias("available"),
        F.bool_or("_retrieves").alias("_r"),
        count(ok).alias("judged"),
        F.coalesce(F.sum(F.when(ok, F.col("correctness"))), F.lit(0.0)).alias("c"),
        F.count(F.when(ok, F.col("correctness"))).alias("c_n"),
        F.coalesce(F.sum(F.when(ok, F.col("reference_support"))), F.lit(0.0)).alias("e"),
        F.count(F.when(ok, F.col("reference_support"))).alias("e_n"),
        F.coalesce(F.sum(F.when(ok, F.col("citation_sum"))), F.lit(0.0)).alias("s"),
        F.coalesce(F.sum(F.when(ok, F.col("citation_n"))), F.lit(0)).alias("s_n"),
        count(said & (F.col("refused") | (F.col("n_cited") > 0))).alias("parse"),
        F.coalesce(F.sum(F.when(said, F.col("n_resolved"))), F.lit(0)).alias("resolved"),
        F.coalesce(F.sum(F.when(said, F.col("n_cited"))), F.lit(0)).alias("cited"),
        count(said & ~F.col("answerable") & F.col("refused")).alias("good"),
        count(said & F.col("answerable") & F.col("refused")).alias("bad"),
    )
    r = F.col("_r")
    parts = {
        "correctness": (F.col("c"), F.col("c_n")),
        "reference_support": (F.col("e"), F.col("e_n")),
        "citation_support": (F.when(r, F.col("s")).otherwise(0.0), F.when(r, F.col("s_n")).otherwise(0)),
        "parse_rate": (F.col("parse"), F.lit(population)),
        "citation_resolution": (F.when(r, F.col("resolved")).otherwise(0), F.when(r, F.col("cited")).otherwise(0)),
        "appropriate_refusal_rate": (F.col("good"), F.lit(unanswerable_n)),
        "false_refusal_rate": (F.col("bad"), F.lit(answerable_n)),
        "refusal_correctness": (F.col("good"), F.col("good") + F.col("bad")),
        "balanced_abstention": ((answerable_n - F.col("bad")) * unanswerable_n + F.col("good") * answerable_n, F.lit(2 * answerable_n * unanswerable_n)),
        "coverage": (F.col("judged"), F.lit(population)),
    }
    metric = [
        F.struct(F.lit(name).alias("metric"), F.when(F.col("available"), n.cast("double")).alias("numerator"), F.when(F.col("available"), d.cast("long")).otherwise(0).alias("denominator"), F.lit(DEFINITIONS[name]).alias("definition"))
        for name, (n, d) in parts.items()
    ]
    return cells.select(*keys, "available", "judged", F.explode(F.array(*metric)).alias("m")).select(*keys, "available", "judged", "m.*")


def report_long(cells: DataFrame, keys: Sequence[str], intervals: DataFrame | None = None) -> DataFrame:
    """A row a cell and metric: value, numerator, denominator, bounds where ``intervals(keys, metric, lo, hi)`` has them."""
    value = F.when(F.col("denominator") > 0, F.col("numerator") / F.col("denominator"))
    rows = cells.withColumn("value", value)
    if intervals is None:
        return rows.withColumn("ci_low", F.lit(None).cast("double")).withColumn("ci_high", F.lit(None).cast("double"))
    bounds = intervals.select(*keys, "metric", F.col("lo").alias("ci_low"), F.col("hi").alias("ci_high"))
    return rows.join(bounds, [*keys, "metric"], "left")


def report_wide(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a cell with its metrics as columns, in the order of :data:`DEFINITIONS`."""
    return long.groupBy(*keys).pivot("metric", list(DEFINITIONS)).agg(F.first("value"))


def wide_differs(wide: DataFrame, long: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Cells and metrics whose wide and long values differ, or that only one form has; nulls are equal."""
    a = wide.unpivot(list(keys), list(metrics), "metric", "wide").withColumn("_a", F.lit(True))
    b = long.select(*keys, "metric", F.col("value").alias("long")).withColumn("_b", F.lit(True))
    both = a.join(b, [*keys, "metric"], "full_outer")
    return both.where(F.col("_a").isNull() | F.col("_b").isNull() | ~F.col("wide").eqNullSafe(F.col("long"))).select(*keys, "metric", "wide", "long")


def semantic_summary(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Correctness, refusals, citations and latency by cell, every rate over what it can be measured on.

    ``items``: answerable, abstention, correctness, citation_count, resolved_citation_count, latency_seconds, parse_success.
    """
    a, r, c = F.col("answerable"), F.col("abstention"), F.col("correctness")
    share = lambda hit, n: F.try_divide(F.count_if(hit).cast("double"), n)
    good, bad = share(~a & r, F.count_if(~a)), share(a & r, F.count_if(a))
    return items.groupBy(*keys).agg(
        F.count("*").alias("population_n"),
        F.count(c).alias("judged_n"),
        F.count_if(c.isNull()).alias("pending_or_uncertain_n"),
        F.avg(c).alias("mean_correctness"),
        (100 * share(c == 1, F.count(c))).alias("fully_correct_pct"),
        (100 * share(c == 0.5, F.count(c))).alias("partial_pct"),
        (100 * share(c == 0, F.count(c))).alias("incorrect_pct"),
        F.count_if(a & r).alias("unnecessary_refusal_n"),
        bad.alias("unnecessary_refusal_rate"),
        F.count_if(~a & r).alias("correct_refusal_n"),
        good.alias("correct_refusal_rate"),
        (0.5 * (1 - bad + good)).alias("balanced_abstention"),
        F.coalesce(F.sum("citation_count"), F.lit(0)).alias("citation_n"),
        F.try_divide(F.sum("resolved_citation_count").cast("double"), F.sum("citation_count")).alias("citation_resolution"),
        F.avg("latency_seconds").alias("mean_latency_seconds"),
        F.avg(F.col("parse_success").cast("double")).alias("parse_rate"),
        F.when(F.count(c) == 0, "unjudged").otherwise("preliminary_unvalidated").alias("status"),
    )


def benchmark_summary(responses: DataFrame, model: str, condition: str) -> DataFrame:
    """Rates and mean latency by model and condition, with the peak memory of the whole model over all its conditions.

    ``responses``: answerable, refused, citation_count, resolved_citation_count, parse_success, latency_seconds, peak_gib.
    """
    a, r = F.col("answerable"), F.col("refused")
    bad, good = F.try_divide(F.count_if(a & r).cast("double"), F.count_if(a)), F.try_divide(F.count_if(~a & r).cast("double"), F.count_if(~a))
    by = responses.groupBy(model, condition).agg(
        F.count("*").alias("n"),
        bad.alias("unnecessary_refusal_rate"),
        good.alias("correct_refusal_rate"),
        (0.5 * (good + 1 - bad)).alias("balanced_abstention"),
        F.try_divide(F.sum("resolved_citation_count").cast("double"), F.sum("citation_count")).alias("citation_resolution"),
        F.avg(F.col("parse_success").cast("double")).alias("parse_rate"),
        F.avg("latency_seconds").alias("mean_latency_seconds"),
        F.max("peak_gib").alias("_peak"),
    )
    return by.withColumn("peak_gib", F.max("_peak").over(Window.partitionBy(model))).drop("_peak")


def failure_categories(histories: DataFrame, by: str, least: int = 3) -> DataFrame:
    """``(by, kind, category, n)`` over attempt histories: statuses, validation errors, and last errors of exhausted tasks.

    ``histories``: a row a task, ``attempts`` an array of structs of status and validation_error. A task is exhausted if
    its last attempt is invalid and it had at least ``least``.
    """
    last = F.element_at("attempts", -1)
    spent = (F.size("attempts") >= least) & (last["status"] == "known_invalid")
    every = F.transform("attempts", lambda a: F.struct(F.lit("state").alias("kind"), a["status"].alias("category")))
    errors = F.transform(F.filter("attempts", lambda a: F.coalesce(a["validation_error"], F.lit("")) != ""), lambda a: F.struct(F.lit("error").alias("kind"), a["validation_error"].alias("category")))
    final = F.when(spent, F.array(F.struct(F.lit("exhausted").alias("kind"), F.coalesce(last["validation_error"], F.lit("unknown")).alias("category")))).otherwise(F.slice(every, 1, 0))
    known = histories.where(F.size("attempts") > 0)
    rows = known.select(by, F.explode(F.concat(every, errors, final)).alias("x"))
    return rows.groupBy(by, F.col("x.kind").alias("kind"), F.col("x.category").alias("category")).agg(F.count("*").alias("n"))


def effect_grid(values: DataFrame, keys: Sequence[str], arm: str, before: str, after: str) -> DataFrame:
    """``before``, ``after`` and their difference by key; a missing arm leaves its value and the difference null."""
    wide = values.groupBy(*keys).agg(*(F.max(F.when(F.col(arm) == a, F.col("value"))).alias(name) for a, name in ((before, "before"), (after, "after"))))
    return wide.withColumn("delta", F.col("after") - F.col("before"))


def faithfulness(answers: DataFrame, keys: Sequence[str], labels: str = "labels") -> DataFrame:
    """Rates of answers with unsupported, contradicted, partly supported or no claims, and of fully supported ones."""
    flags = answers.select(*keys, F.size(labels).alias("_n"), claim_flags(F.col(labels)).alias("f"), F.exists(labels, lambda x: x == "partially_supported").alias("_partial"))
    rate = lambda c: F.avg(c.cast("double"))
    return flags.groupBy(*keys).agg(
        F.count("*").alias("n"), rate(F.col("f.unsupported")).alias("any_unsupported"), rate((F.col("_n") > 0) & F.col("f.faithful")).alias("fully_supported"),
        rate(F.col("f.contradicted")).alias("any_contradicted"), rate(F.col("_partial")).alias("any_partial"), rate(F.col("_n") == 0).alias("no_factual_claims"),
    )


def _status(scored: Column) -> Column:
    return F.when(scored == 0, "unjudged").otherwise("preliminary_unvalidated")


def answerability_strata(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Correctness by cell and population: answerable, unanswerable, and answerable questions that were attempted.

    ``items``: answerable, abstention, correctness. Populations overlap; a cell without one has no row for it.
    """
    a = F.col("answerable")
    populations = F.array(F.when(a, "answerable").otherwise("unanswerable"), F.when(a & ~F.col("abstention"), "answerable_attempts"))
    rows = items.withColumn("population", F.explode(F.filter(populations, lambda x: x.isNotNull())))
    n = F.count("correctness")
    return rows.groupBy(*keys, "population").agg(F.count("*").alias("eligible_n"), n.alias("scored_n"), F.avg("correctness").alias("mean_correctness"), _status(n).alias("status"))


def question_types(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Correctness by cell and type of question; questions without one are ``unspecified``."""
    n = F.count("correctness")
    rows = items.withColumn("question_type", F.coalesce("question_type", F.lit("unspecified")))
    return rows.groupBy(*keys, "question_type").agg(F.count("*").alias("population_n"), n.alias("judged_n"), F.avg("correctness").alias("mean_correctness"), _status(n).alias("status"))


def matched_summary(items: DataFrame, item: str, arm: str, arms: int) -> DataFrame:
    """Every arm over the same questions, those scored in all of them: complete cases are never compared across samples.

    ``items``: answerable, abstention, correctness, evidence_support, unsupported_material_claim.
    """
    scored = items.where(F.col("correctness").isNotNull())
    common = scored.groupBy(item).agg(F.countDistinct(arm).alias("_n")).where(F.col("_n") == arms).select(item)
    a, r = F.col("answerable"), F.col("abstention").cast("double")
    claims = F.col("evidence_support").isNotNull() | F.col("abstention")
    return scored.join(common, item, "left_semi").groupBy(arm).agg(
        F.count("*").alias("population_n"),
        F.count_if(a).alias("answerable_n"),
        F.avg("correctness").alias("mean_correctness"),
        F.avg("evidence_support").alias("mean_reference_support"),
        F.count("evidence_support").alias("reference_support_judged_n"),
        F.avg(F.when(claims, F.col("unsupported_material_claim").cast("double"))).alias("unsupported_material_claim_rate"),
        F.count_if(claims).alias("unsupported_claim_judged_n"),
        F.avg(F.when(a, r)).alias("unnecessary_refusal_rate"),
        F.avg(F.when(~a, r)).alias("correct_refusal_rate"),
    )


def repeat_agreement(votes: DataFrame, pairs: Sequence[tuple[int, int]] = ((1, 2), (1, 3), (2, 3))) -> DataFrame:
    """``(vote_a, vote_b, paired_scored_n, exact_agreement, kappa)`` of repeated votes on the same tasks.

    ``votes``: task, vote, correctness of 0, 0.5 or 1. Kappa is quadratic-weighted, and null where all scores are equal.
    """
    numbers = sorted({n for pair in pairs for n in pair})
    wide = votes.groupBy("task").agg(*(F.max(F.when(F.col("vote") == n, (F.col("correctness") * 2).cast("int"))).alias(f"v{n}") for n in numbers))
    both = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"v{a}").alias("x"), F.col(f"v{b}").alias("y")) for a, b in pairs))).alias("p")
    rows = wide.select(both).select("p.*").withColumn("ok", F.col("x").isNotNull() & F.col("y").isNotNull())
    some = F.col("ok")
    low, high = F.min(F.when(some, F.least("x", "y"))), F.max(F.when(some, F.greatest("x", "y")))
    return rows.groupBy(F.col("a").alias("vote_a"), F.col("b").alias("vote_b")).agg(
        F.count_if(some).alias("paired_scored_n"),
        F.avg(F.when(some, (F.col("x") == F.col("y")).cast("double"))).alias("exact_agreement"),
        F.when(low < high, weighted_kappa_of("x", "y")).alias("kappa"),
    )


def run_summary(grid: DataFrame, keys: Sequence[str], judges: Sequence[str], answerable_n: int, unanswerable_n: int, retrieves: Column) -> DataFrame:
    """One row a cell over all questions: responses, refusals, citations, time, and what each of two judges gave.

    ``grid``, a row a question and cell: answerable, responded, refused, n_cited, n_resolved, answer_present, seconds, and
    for each judge ``<judge>_correctness`` and ``<judge>_support``. Refusal rates are null until every question has a
    response; judges are compared on the questions that both scored.
    """
    said, a = F.col("responded"), F.col("answerable")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    population = answerable_n + unanswerable_n
    bad, good, n = count(said & a & F.col("refused")), count(said & ~a & F.col("refused")), count(said)
    full = n == population
    x, y = (F.when(said, F.col(f"{j}_correctness")) for j in judges)
    both = x.isNotNull() & y.isNotNull()
    cited = F.sum(F.when(said & retrieves, F.col("n_cited")))
    scores = [
        c
        for j, v in zip(judges, (x, y), strict=True)
        for c in (F.avg(v).alias(f"{j}_correctness"), F.count(v).alias(f"{j}_correctness_scored"), F.avg(F.when(said, F.col(f"{j}_support"))).alias(f"{j}_reference_support"))
    ]
    return grid.groupBy(*keys).agg(
        n.alias("responses"),
        (F.lit(population) - n).alias("missing_responses"),
        count(said & (F.col("refused") | (F.col("n_cited") > 0))).alias("parsed_responses"),
        count(said & ~F.col("answer_present")).alias("final_answer_failures"),
        bad.alias("unnecessary_refusals"),
        good.alias("appropriate_refusals"),
        F.when(full, bad / float(answerable_n)).alias("false_refusal_rate"),
        F.try_divide(good.cast("double"), bad + good).alias("refusal_correctness"),
        F.when(full, 0.5 * ((answerable_n - bad) / float(answerable_n) + good / float(unanswerable_n))).alias("balanced_abstention"),
        F.try_divide(F.sum(F.when(said & retrieves, F.col("n_resolved"))).cast("double"), cited).alias("citation_resolution"),
        cited.alias("citation_denominator"),
        *scores,
        F.count_if(both).alias("judge_paired_denominator"),
        F.avg(F.when(both, (x == y).cast("double"))).alias("correctness_agreement"),
        F.sum(F.when(said, F.col("seconds"))).alias("inference_seconds"),
    )


def judge_disagreements(grid: DataFrame, judges: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Rows that both judges voted on and whose ``<judge>_<field>`` differ in any field; nulls are equal."""
    first, second = judges
    differ = F.lit(False)
    for f in fields:
        differ = differ | ~F.col(f"{first}_{f}").eqNullSafe(F.col(f"{second}_{f}"))
    return grid.where(F.col(f"{first}_voted") & F.col(f"{second}_voted") & differ)
