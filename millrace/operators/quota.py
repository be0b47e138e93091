"""Rolling and calendar quotas over event ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rolling_usage(events: DataFrame, by: str, ts: str, tokens: str, seconds: int) -> DataFrame:
    """Requests and tokens of ``(now - seconds, now]`` at every event, and the oldest's time in microseconds: the lower bound is strict.

    Time is cut in buckets as long as the window. An event is a row of its own bucket and, where it leaves the window, a
    row of the next one: the window at an event holds what came in its bucket until then, and what of the bucket before
    is still to leave. Both are running aggregates, one forwards and one backwards, so the cost does not depend on how
    many events a window holds, and a busy owner is as many tasks as it has buckets. Events without a time have nulls.
    """
    length = seconds * 1_000_000
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    e = events.withColumn("_us", micros).withColumn("_bucket", F.floor(F.col("_us") / length))
    nothing = F.lit(None).cast("long")
    places = F.when(F.col("_us").isNull(), F.array(F.struct(nothing.alias("bucket"), nothing.alias("at"), F.lit(True).alias("own"))))
    both = F.array(F.struct(F.col("_bucket").alias("bucket"), F.col("_us").alias("at"), F.lit(True).alias("own")), F.struct((F.col("_bucket") + 1).alias("bucket"), (F.col("_us") + length).alias("at"), F.lit(False).alias("own")))
    e = e.withColumn("_place", F.explode(places.otherwise(both))).select("*", F.col("_place.bucket").alias("_in"), F.col("_place.at").alias("_at"), F.col("_place.own").alias("_own"))
    rows = Window.partitionBy(by, "_in")
    came, leaving = rows.orderBy("_at").rangeBetween(Window.unboundedPreceding, 0), rows.orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, -1)
    own = lambda x: F.when(F.col("_own"), x)
    old = lambda x: F.when(~F.col("_own"), x)
    n = F.count(own(F.lit(1))).over(came) + F.count(old(F.lit(1))).over(leaving)
    here, before = F.sum(own(F.col(tokens))).over(came), F.sum(old(F.col(tokens))).over(leaving)
    oldest = F.least(F.min(own(F.col("_us"))).over(came), F.min(old(F.col("_us"))).over(leaving))
    timed = F.col("_us").isNotNull()
    out = e.withColumn("n_window", F.when(timed, n)).withColumn("tokens_window", F.when(timed, F.coalesce(here + before, here, before))).withColumn("oldest_window", F.when(timed, oldest))
    return out.where("_own").drop("_us", "_bucket", "_place", "_in", "_at", "_own")


def admits(n_window: Column, n_day: Column, tokens_window: Column, ask: Column, rpm: int, rpd: int, tpm: float) -> Column:
    """Whether a request of ``ask`` tokens fits after what the last minute and the day hold."""
    return (n_window < rpm) & (n_day < rpd) & (tokens_window + ask <= tpm)


def wait_until(now: Column, minute_full: Column, oldest_in_minute: Column, day_full: Column, day_reset: Column, tokens_full: Column, oldest_in_day: Column) -> Column:
    """Epoch second at which a refused request may be tried again, ``now`` if it fits: the first rule that refuses.

    The minute's rule waits for its oldest request to leave, the day's for its reset, the tokens' for the oldest request
    of 24 hours to leave, each with a second to spare.
    """
    return F.when(minute_full, oldest_in_minute + 61).when(day_full, day_reset + 1).when(tokens_full, oldest_in_day + 86_401).otherwise(now)


def day_reset(ts: Column, zone: str = "America/Los_Angeles") -> Column:
    """Epoch second at which the local day of a UTC timestamp ends."""
    midnight = F.date_add(calendar_day(ts, zone), 1).cast("timestamp")
    return F.unix_timestamp(F.to_utc_timestamp(midnight, zone))


def calendar_day(ts: Column, zone: str = "America/Los_Angeles") -> Column:
    """The local day of a UTC timestamp."""
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), zone))


def daily_usage(events: DataFrame, by: str, ts: str, tokens: str, zone: str = "America/Los_Angeles") -> DataFrame:
    return events.groupBy(by, calendar_day(F.col(ts), zone).alias("day")).agg(F.count("*").alias("n"), F.sum(tokens).alias("tokens"))


def remaining(limit: Column | float, used: Column) -> Column:
    return F.greatest(F.lit(0), (limit if isinstance(limit, Column) else F.lit(limit)) - used)


def capacity(slots: Column, tokens: Column, cost: Column) -> Column:
    """Requests that slots and tokens still allow."""
    return F.least(slots, F.floor(F.try_divide(tokens, cost)))


def overlaps(intervals: DataFrame, key: str, owner: str, start: str, end: str, bucket_seconds: int = 3600) -> DataFrame:
    """Pairs of intervals of different owners that overlap.

    Intervals are dealt to the time buckets that they touch and joined by bucket; a pair is reported in the bucket
    where the later one starts, so it comes once and no interval meets all others.
    """
    t = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    step = bucket_seconds * 1_000_000
    i = intervals.select(key, owner, t(start).alias("s"), t(end).alias("e")).where("s < e")
    i = i.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("s") / step), F.floor((F.col("e") - 1) / step))))
    a, b = i.select(*(F.col(c).alias(f"{c}_a") for c in i.columns)), i.select(*(F.col(c).alias(f"{c}_b") for c in i.columns))
    later = F.greatest("s_a", "s_b")
    on = (F.col("bucket_a") == F.col("bucket_b")) & (F.col(f"{key}_a") < F.col(f"{key}_b")) & (F.col(f"{owner}_a") != F.col(f"{owner}_b"))
    pairs = a.join(b, on).where((later < F.least("e_a", "e_b")) & (F.floor(later / step) == F.col("bucket_a")))
    return pairs.select(F.col(f"{key}_a").alias("a"), F.col(f"{key}_b").alias("b"))
