"""Bootstrap intervals: resamples are multinomial counts split down blocks of units, drawn in place.

A resample of n units draws n times with replacement. Each draw first picks a block of units, by integer arithmetic of
seed, replicate and slot; only the counts of (replicate, block) are shuffled. Each block's units are one row, where as
many draws of a replicate as fell to the block pick units by the same arithmetic of another seed, and what they pick is
aggregated where it stands: no draw is shuffled or joined, and the cost is linear in units and replicates. Any engine
repeats the draws. Variants differ in unit, replicates and which order statistics bound the interval, and stay
separate: they are entries of :data:`VARIANTS`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.numbering import number_rows

# Replicates, seed, and indices of the bounds as functions of the number of kept replicates.
VARIANTS: dict[str, tuple[int, int, Callable[[int], tuple[int, int]]]] = {
    "metric": (1000, 0, lambda n: (int(0.025 * 1000), int(0.975 * 1000))),
    "paired_composite": (1000, 0, lambda n: (int(0.025 * 1000), int(0.975 * 1000))),
    "paired_group": (4000, 20261020, lambda n: (100, 3900)),
    "parse_rate": (5000, 20261020, lambda n: (124, 4874)),
    "paired_correctness": (2000, 0, lambda n: (int(0.025 * n), min(int(0.975 * n), n - 1))),
    "reporting_mean": (2000, 20261102, lambda n: (int(0.025 * 1999), int(0.975 * 1999))),
    "kappa": (2000, 0, lambda n: (int(0.025 * n), int(0.975 * n))),
}
#: Up to here units are numbered in one task.
MAX_UNITS = 100_000
#: Units of a block: the least, the most, and how many blocks are aimed at in between.
LEAST_BLOCK, MOST_BLOCK, BLOCKS = 1024, 65_536, 256
#: A prime below 2^31: squares of remainders fit 64 bits.
PRIME = 2_147_483_629
#: What the seed of the draws within blocks adds to the seed.
WITHIN = 1_013_904_223


def block_size(n: int) -> int:
    return min(MOST_BLOCK, max(LEAST_BLOCK, -(-n // BLOCKS)))


def remainder(seed: int, b: Column, slot: Column) -> Column:
    """A number below :data:`PRIME` for a replicate's slot: squares modulo a prime, three times."""
    x = F.pmod(b * 48_271 + F.pmod(slot.cast("long"), F.lit(PRIME)) * 16_807 + seed % PRIME + 1, F.lit(PRIME))
    for add in (12_345, 67_891, 24_683):
        x = F.pmod(x * x + add, F.lit(PRIME))
    return x


def draw(seed: int, b: Column, slot: Column, n: int) -> Column:
    """The place among ``n`` that a slot draws."""
    x = remainder(seed, b, slot)
    if n < 1 << 31:
        return F.call_function("div", x * n, F.lit(PRIME)).cast("long")
    # more units than remainders: a second draw gives the low part
    y = F.pmod(x * 69_621 + F.pmod(slot, F.lit(1 << 20)), F.lit(1 << 31))
    return F.pmod(x * (1 << 31) + y, F.lit(n))


def replicates(units: DataFrame, order: str, statistic: Column, b: int, seed: int) -> DataFrame:
    """``(b, stat)``: the statistic of every resample of ``units`` with replacement; ``statistic`` aggregates its columns."""
    n = units.count()
    spark = units.sparkSession
    if n == 0:
        return spark.createDataFrame([], "b long, stat double")
    if n > MAX_UNITS:
        numbered = number_rows(units, [order], "_i")
    else:
        numbered = units.withColumn("_i", F.row_number().over(Window.orderBy(order)) - 1)
    size = block_size(n)
    blocks = -(-n // size)
    div = lambda x, k: F.call_function("div", x, F.lit(k)).cast("long")
    slot = (F.col("id") % n).cast("int" if n < 1 << 31 else "long")
    grid = spark.range(b * n).select(F.expr(f"id div {n}L").alias("b"), slot.alias("slot"))
    counts = grid.select("b", div(draw(seed, F.col("b"), F.col("slot"), n), size).alias("block")).groupBy("block", "b").agg(F.count("*").alias("m"))
    counts = counts.groupBy("block").agg(F.collect_list(F.struct("b", "m")).alias("counts"))  # b at most
    held = numbered.select(div(F.col("_i"), size).alias("block"), F.struct("_i", *units.columns).alias("unit"))
    held = held.groupBy("block").agg(F.sort_array(F.collect_list("unit")).alias("units"))  # a block at most
    drawn = held.join(counts, "block").select("block", "units", F.explode("counts").alias("c"))
    drawn = drawn.select("block", "units", F.col("c.b").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("c.m") - 1)).alias("t"))
    place = F.call_function("div", remainder(seed + WITHIN, F.col("b"), F.col("t") * blocks + F.col("block")) * F.size("units"), F.lit(PRIME)).cast("int")
    return drawn.select("b", F.get("units", place).alias("u")).select("b", "u.*").groupBy("b").agg(statistic.alias("stat"))


def interval(units: DataFrame, order: str, statistic: Column, variant: str) -> DataFrame:
    """``(lo, hi, kept)`` of a variant: order statistics of what is not null; nulls if nothing is."""
    b, seed, bounds = VARIANTS[variant]
    stats = replicates(units, order, statistic, b, seed).where("stat is not null and not isnan(stat)")
    got = stats.agg(F.array_sort(F.collect_list("stat")).alias("s"))  # at most b values
    lo, hi = bounds(b)
    if variant in ("paired_correctness", "kappa"):
        n = F.size("s")
        at = lambda q: F.least(F.floor(n * q).cast("int"), n - 1)
        return got.select(F.get("s", at(0.025)).alias("lo"), F.get("s", at(0.975)).alias("hi"), n.alias("kept"))
    return got.select(F.get("s", F.lit(lo)).alias("lo"), F.get("s", F.lit(hi)).alias("hi"), F.size("s").alias("kept"))


def probability_above(units: DataFrame, order: str, difference: Column, variant: str = "paired_composite") -> DataFrame:
    """``(n, p_above, lo, hi)``: how often the resampled difference of two rows is above 0, and its interval.

    Both rows are resampled together: a unit holds what either says of one question. Without units the share is a half.
    """
    b, seed, bounds = VARIANTS[variant]
    got = replicates(units, order, difference, b, seed).agg(F.avg((F.col("stat") > 0).cast("double")).alias("p"), F.array_sort(F.collect_list("stat")).alias("s"))  # b values
    lo, hi = bounds(b)
    n = units.agg(F.count("*").alias("n"))
    none = F.lit(0.0)
    return n.crossJoin(got).select("n", F.coalesce("p", F.lit(0.5)).alias("p_above"), F.coalesce(F.get("s", F.lit(lo)), none).alias("lo"), F.coalesce(F.get("s", F.lit(hi)), none).alias("hi"))


def paired_groups(pairs: DataFrame, group: str, before: str, after: str) -> DataFrame:
    """Difference of means over groups of questions, with an interval only if there are at least two groups."""
    sums = pairs.where(F.col(before).isNotNull() & F.col(after).isNotNull()).groupBy(group).agg(F.sum(F.col(after) - F.col(before)).alias("d"), F.count("*").alias("n"))
    whole = sums.agg((F.sum("d") / F.sum("n")).alias("difference"), F.count("*").alias("groups"))
    ci = interval(sums, group, F.sum("d") / F.sum("n"), "paired_group")
    both = whole.crossJoin(ci)  # one row by one row
    enough = F.col("groups") >= 2
    return both.select("difference", "groups", F.when(enough, F.col("lo")).alias("lo"), F.when(enough, F.col("hi")).alias("hi"))
