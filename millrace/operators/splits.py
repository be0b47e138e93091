"""Deterministic samples and splits: order by a hash of seed and key, the same in every engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(key: Column, seed: int | str) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def sample(df: DataFrame, key: str, n: int, seed: int | str) -> DataFrame:
    """``n`` rows in hash order: a top-k, without a full sort."""
    return df.withColumn("_o", hash_order(F.col(key), seed)).orderBy("_o", key).limit(n).drop("_o")


def grouped_split(rows: DataFrame, group: str, seed: int | str, share: float = 0.1) -> DataFrame:
    """``side`` of every row: whole groups in hash order go to ``validation`` until it has its share; it may overshoot.

    A group goes there if the rows of groups before it are fewer than ``max(1, round(share * n))``. Prefix sums are
    taken over 256 hash buckets and within a bucket, so no task orders all groups.
    """
    groups = rows.groupBy(group).agg(F.count("*").alias("size")).withColumn("o", hash_order(F.col(group), seed))
    groups = groups.withColumn("bucket", F.substring("o", 1, 2))
    buckets = groups.groupBy("bucket").agg(F.sum("size").alias("held"))
    buckets = buckets.withColumn("before", F.sum("held").over(Window.orderBy("bucket")) - F.col("held")).withColumn(
        "target", F.greatest(F.lit(1.0), F.round(F.lit(share) * F.sum("held").over(Window.partitionBy())))
    )
    within = Window.partitionBy("bucket").orderBy("o", group)
    placed = groups.withColumn("inside", F.sum("size").over(within) - F.col("size")).join(buckets.drop("held"), "bucket")
    side = F.when(F.col("before") + F.col("inside") < F.col("target"), "validation").otherwise("train")
    return rows.join(placed.select(group, side.alias("side")), group)


def milestones(rows: DataFrame, key: str, frozen_order: str, sizes: list[int]) -> DataFrame:
    """Nested prefixes: rows of the frozen baseline in their order, then new keys sorted; a row per prefix it is in."""
    w = Window.orderBy(F.col(frozen_order).isNull(), frozen_order, key)
    top = rows.orderBy(F.col(frozen_order).isNull(), frozen_order, key).limit(max(sizes))
    placed = top.withColumn("position", F.row_number().over(w))
    return placed.withColumn("milestone", F.explode(F.array(*(F.lit(s) for s in sizes)))).where("position <= milestone")


def round_robin(rows: DataFrame, stratum: str, key: str, n: int) -> DataFrame:
    """``n`` rows, one of each stratum in turn, strata and keys in order."""
    w = Window.partitionBy(stratum).orderBy(key)
    return rows.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n).orderBy("turn", stratum, key).limit(n)


def one_per_stratum(rows: DataFrame, strata: list[str], key: str) -> DataFrame:
    return rows.groupBy(*strata).agg(F.min(key).alias(key))


def disjoint_holdout(rows: DataFrame, item: str, bucket: str, any_of: list[str], and_also: str, n: int, seed: int | str) -> DataFrame:
    """Items that have a bucket of ``any_of`` and ``and_also``; ``n`` of them in hash order are held out."""
    both = rows.groupBy(item).agg(F.bool_or(F.col(bucket).isin(*any_of)).alias("x"), F.bool_or(F.col(bucket) == and_also).alias("y")).where("x and y").select(item)
    held = sample(both, item, n, seed).withColumn("held_out", F.lit(True))
    return rows.join(held, item, "left").withColumn("held_out", F.coalesce("held_out", F.lit(False)))
