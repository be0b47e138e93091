"""Metrics with explicit denominators: a missing score is never a zero, an empty population never a number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import safe_ratio

# Weights of the composite score.
WEIGHTS = {"correctness": 0.5, "citation_support": 0.3, "abstention": 0.2}


def item_correctness(answerable: Column, refused: Column, contradiction: Column, scores: Column) -> Column:
    """Of an answerable item: 0 if refused or contradicted, else the mean fact score over 2; null without scores."""
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores) / 2
    scored = F.when(F.size(scores) > 0, F.when(F.coalesce(contradiction, F.lit(False)), 0.0).otherwise(mean))
    return F.when(answerable, F.when(refused, F.lit(0.0)).otherwise(scored))


def row_measures(prefix: str = "") -> dict[str, Column]:
    """Aggregates over a row's items: answerable, refused, corr_item, n_sup, n_tot, with ``prefix`` before all but the
    first. Empty groups of items count 0, 0, 1 and 1, as boards have it."""
    a, c = F.col("answerable"), lambda name: F.col(f"{prefix}{name}")
    corr = F.when(a, c("corr_item"))
    refuse = safe_ratio(F.count_if(~a & c("refused")), F.count_if(~a), 1.0)
    answer = 1 - safe_ratio(F.count_if(a & c("refused")), F.count_if(a), 0.0)
    return {
        "correctness": safe_ratio(F.sum(corr), F.count(corr), 0.0),
        "citation_support": safe_ratio(F.sum(c("n_sup")), F.sum(c("n_tot")), 0.0),
        "abstention": (refuse + answer) / 2,
    }


def composite(prefix: str = "") -> Column:
    """The weighted score of a row as one aggregate."""
    return sum((x * WEIGHTS[name] for name, x in row_measures(prefix).items()), F.lit(0.0))


def row_metrics(items: DataFrame, by: str | Sequence[str]) -> DataFrame:
    """Correctness, citation support, abstention and composite per row of a board."""
    keys = [by] if isinstance(by, str) else list(by)
    scored = F.count(F.when(F.col("answerable"), F.col("corr_item"))).alias("n_scored")
    return items.groupBy(*keys).agg(F.count("*").alias("n_items"), scored, *(x.alias(name) for name, x in row_measures().items()), composite().alias("composite"))


def mean_triple(x: Column, prefix: str) -> list[Column]:
    """Mean, sum and count of what is not null: null, 0 and 0 where nothing is."""
    return [F.avg(x).alias(f"{prefix}_mean"), F.coalesce(F.sum(x), F.lit(0.0)).alias(f"{prefix}_sum"), F.count(x).alias(f"{prefix}_n")]


def complete_rate(hit: Column, item: Column, population: int) -> Column:
    """A rate over a fixed population, null until all of it has answered."""
    return F.when(F.countDistinct(item) == population, F.count_if(hit) / F.lit(float(population)))


def condition_summary(grid: DataFrame, responses: DataFrame, votes: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """Every cell of ``grid`` over all items, answered or not, judged or not.

    ``grid`` has the keys and the item, ``responses`` them and ``seconds``, ``votes`` them and ``correctness``.
    """
    on = [*keys, item]
    full = grid.join(responses.withColumn("responded", F.lit(True)), on, "left").join(votes.select(*on, "correctness"), on, "left")
    return full.groupBy(*keys).agg(
        F.count("*").alias("n_items"),
        F.count("responded").alias("n_responses"),
        F.count("correctness").alias("n_judged"),
        F.avg("correctness").alias("correctness"),
        F.expr("percentile(seconds, 0.5)").alias("median_seconds"),
        F.max("seconds").alias("max_seconds"),
        (F.count("correctness") / F.count("*")).alias("coverage"),
    )


def to_long(wide: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per metric; the inverse is a pivot."""
    return wide.unpivot(list(keys), list(metrics), "metric", "value")


def to_wide(long: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return long.groupBy(*keys).pivot("metric", list(metrics)).agg(F.first("value"))


def cohen_kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Unweighted kappa of complete pairs; null where chance agreement is 1."""
    cells = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("n"))
    # marginals of a few labels: products of sums over the cells
    rows, cols = cells.groupBy("x").agg(F.sum("n").alias("rx")), cells.groupBy(F.col("y").alias("x")).agg(F.sum("n").alias("cy"))
    chance = rows.join(cols, "x").agg(F.sum(F.col("rx") * F.col("cy")).alias("s"))
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same"))
    k = total.crossJoin(chance)  # one row by one row
    po, pe = F.col("same") / F.col("n"), F.coalesce(F.col("s"), F.lit(0)) / (F.col("n") * F.col("n"))
    return k.select(F.coalesce("n", F.lit(0).cast("long")).alias("n"), po.alias("observed"), pe.alias("expected"), F.when(pe != 1, (po - pe) / (1 - pe)).alias("kappa"))


def weighted_kappa_of(a: str, b: str, k: int = 3) -> Column:
    """Quadratic-weighted kappa of complete pairs of scores 0..k-1 as one aggregate: the chance part needs the marginals'
    first two moments only. 1 where nothing can disagree, NaN without pairs."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y, n = F.when(both, F.col(a)), F.when(both, F.col(b)), F.count_if(both)
    expected = (F.sum(x * x) + F.sum(y * y) - 2.0 * F.sum(x) * F.sum(y) / n) / (k - 1) ** 2
    observed = F.sum((x - y) * (x - y)) / (k - 1) ** 2
    return F.when(n == 0, F.lit(float("nan"))).when(F.abs(expected) < 1e-12, F.lit(1.0)).otherwise(1 - observed / expected)


def weighted_kappa(pairs: DataFrame, a: str, b: str, k: int = 3) -> DataFrame:
    """:func:`weighted_kappa_of` of a table, with its number of complete pairs."""
    return pairs.agg(F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias("n"), weighted_kappa_of(a, b, k).alias("kappa"))


def frequency(df: DataFrame, column: str, array: bool = False) -> DataFrame:
    """Counts and shares of values; of an array's elements, which overlap."""
    n = df.agg(F.count("*").alias("_n"))
    values = df.select(F.explode(column).alias("value")) if array else df.select(F.col(column).alias("value"))
    return values.groupBy("value").agg(F.count("*").alias("n")).crossJoin(n).select("value", "n", (F.col("n") / F.col("_n")).alias("share"))


def taxonomy(items: DataFrame, categories: Sequence[str], judged: str = "judged", flags: str = "categories") -> DataFrame:
    """Count of every category, 0 where none has it; null for all while any item is unjudged."""
    complete = items.agg(F.bool_and(judged).alias("complete"))
    names = items.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    counts = items.select(F.explode(flags).alias("category")).groupBy("category").agg(F.count("*").alias("c"))
    out = names.join(counts, "category", "left").crossJoin(complete)
    return out.select("category", F.when(F.col("complete"), F.coalesce("c", F.lit(0).cast("long"))).alias("n"))


def slices(items: DataFrame, in_slice: Column, name: str) -> DataFrame:
    """Rows once for the full population and again for a slice of it."""
    return items.withColumn("slice", F.explode(F.filter(F.array(F.lit("full"), F.when(in_slice, F.lit(name))), lambda x: x.isNotNull())))


def paired_changes(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """``improves``, ``unchanged``, ``worsens`` or ``pending`` by key, and the difference."""
    both = before.select(key, F.col(value).alias("before")).join(after.select(key, F.col(value).alias("after")), key)
    delta = F.col("after") - F.col("before")
    change = F.when(delta.isNull(), "pending").when(delta > 0, "improves").when(delta < 0, "worsens").otherwise("unchanged")
    return both.select(key, "before", "after", delta.alias("delta"), change.alias("change"))


def scored_in_all(scores: DataFrame, item: str, arm: str, value: str, arms: int) -> DataFrame:
    """Items with a score in every arm."""
    return scores.where(F.col(value).isNotNull()).groupBy(item).agg(F.countDistinct(arm).alias("n")).where(F.col("n") == arms).select(item)


def ranked_board(rows: DataFrame, key: str, score: str, eligible: Column) -> DataFrame:
    """Eligible rows from the best down; at ties the larger key first."""
    return rows.where(eligible).orderBy(F.desc(score), F.desc(key))


def claim_flags(labels: Column) -> Column:
    """Faithfulness of a list of claim labels."""
    return F.struct(
        F.forall(labels, lambda x: x == "supported").alias("faithful"),
        F.exists(labels, lambda x: x == "contradicted").alias("contradicted"),
        F.exists(labels, lambda x: x == "unsupported").alias("unsupported"),
    )


def throughput(events: DataFrame, ts: str, remaining: int | None = None) -> DataFrame:
    """Rows an hour between the first and last event, and the hours that ``remaining`` rows take at that rate."""
    span = F.unix_timestamp(F.max(ts)) - F.unix_timestamp(F.min(ts))
    out = events.agg(F.count("*").alias("n"), safe_ratio(F.count("*") * 3600, span).alias("per_hour"))
    return out if remaining is None else out.withColumn("eta_hours", F.try_divide(F.lit(float(remaining)), F.col("per_hour")))


def extremes(rows: DataFrame, key: str, score: str) -> DataFrame:
    """``(best, worst)`` keys by score; rows without a score are neither, and at ties the smaller key is taken."""
    some = rows.where(F.col(score).isNotNull())
    return some.agg(F.min_by(key, F.struct((-F.col(score)).alias("s"), F.col(key))).alias("best"), F.min_by(key, F.struct(F.col(score).alias("s"), F.col(key))).alias("worst"))
