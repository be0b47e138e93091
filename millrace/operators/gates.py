"""Gates: queries whose result must be empty, and the exception raised when it is not.

A gate never drops rows. It returns the violations as a DataFrame; :func:`require_empty` raises with a few of them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class GateError(ValueError):
    """A gate found violations."""


def require_empty(violations: DataFrame, what: str, show: int = 5) -> None:
    found = violations.take(show)
    if found:
        raise GateError(f"{what}: {[r.asDict() for r in found]}")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """An empty population is an error and never a zero."""
    if df.isEmpty():
        raise GateError(f"{what}: empty population")
    return df


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def missing_keys(df: DataFrame, *keys: str) -> DataFrame:
    bad = F.lit(False)
    for k in keys:
        bad = bad | F.col(k).isNull() | (F.col(k).cast("string") == "")
    return df.where(bad)


def unequal_populations(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Keys that one side has and the other has not, with the side that lacks them."""
    a = left.select(*keys).distinct().withColumn("in_left", F.lit(True))
    b = right.select(*keys).distinct().withColumn("in_right", F.lit(True))
    both = a.join(b, list(keys), "full_outer")
    gone = both.where("in_left is null or in_right is null")
    return gone.select(*keys, F.when(F.col("in_left").isNull(), "left").otherwise("right").alias("missing_from"))


def breaches(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows with the names of the rules they break, first to last; a rule that is null is broken."""
    failed = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())), lambda x: x.isNotNull())
    return df.withColumn("reasons", failed).where(F.size("reasons") > 0)


def not_preserved(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Rows of ``previous`` that ``current`` lacks or has changed."""
    return previous.exceptAll(current.select(*previous.columns))


def incomplete_modes(df: DataFrame, item: str, mode: str, wanted: Sequence[str]) -> DataFrame:
    """Items that do not have every mode exactly once."""
    seen = df.groupBy(item).agg(F.array_sort(F.collect_list(mode)).alias("modes"))
    return seen.where(F.col("modes") != F.array(*(F.lit(m) for m in sorted(wanted))))


def metric_breaches(metrics: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Long metrics that are out of range or differ from their numerator over denominator."""
    off = F.abs(F.col("value") - F.try_divide(F.col("numerator"), F.col("denominator").cast("double"))) > tolerance
    return metrics.where(F.col("value").isNotNull() & (off | ~F.col("value").between(0, 1) | (F.col("denominator") == 0)))


def drifted(committed: DataFrame, live: DataFrame, keys: Sequence[str], value: str, tolerance: float = 1e-6) -> DataFrame:
    """Keys whose values moved by more than ``tolerance``, appeared or went."""
    a, b = committed.select(*keys, F.col(value).alias("committed")), live.select(*keys, F.col(value).alias("live"))
    both = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), list(keys), "full_outer")
    moved = F.abs(F.col("committed") - F.col("live")) > tolerance
    gone = F.col("a").isNull() | F.col("b").isNull() | (F.col("committed").isNull() != F.col("live").isNull())
    return both.where(moved | gone).select(*keys, "committed", "live")


def leaked_points(report: DataFrame, points: Sequence[str], count_key: str = "n_recovered_unjudged") -> DataFrame:
    """Blocks with a lower bound that also carry a scalar point estimate, unless their unjudged count is integer 0.

    ``report`` has a row for each leaf: ``path`` of its object, ``key``, ``value`` and ``type``.
    """
    blocks = report.groupBy("path").agg(
        F.bool_or(F.endswith("key", F.lit("_lower"))).alias("bounded"),
        F.coalesce(F.bool_or((F.col("key") == count_key) & (F.col("type") == "int") & (F.col("value") == "0")), F.lit(False)).alias("settled"),
        F.array_sort(F.collect_list(F.when(F.col("key").isin(*points) & F.col("type").isin("int", "double"), F.col("key")))).alias("points"),
    )
    return blocks.where("bounded and not settled and size(points) > 0").select("path", "points")


def extra_fields(fields: Column, allowed: Sequence[str]) -> Column:
    """Fields that a permission does not cover."""
    return F.array_except(fields, F.array(*(F.lit(a) for a in allowed)))


def grouped_counts_differ(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Groups whose row counts differ: the multiset form of population equality."""
    left, right = a.groupBy(*keys).agg(F.count("*").alias("n_left")), b.groupBy(*keys).agg(F.count("*").alias("n_right"))
    both = left.join(right, list(keys), "full_outer")
    return both.where(~F.col("n_left").eqNullSafe(F.col("n_right")))
