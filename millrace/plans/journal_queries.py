"""Queries over event ledgers: quotas, calendars, overlaps, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import metrics as M
from millrace.operators import quota as Q
from millrace.plans.registry import query
from millrace.session import scratch_path, table
from millrace.sources import readers as R
from millrace.streaming import journals as J
from millrace.streaming import stateful as S


@query("""
    SELECT event_id, count(*) OVER w AS n_window, round(sum(value) OVER w, 4) AS tokens_window FROM (SELECT *, epoch_us(ts) AS us FROM events)
    WINDOW w AS (PARTITION BY event_type ORDER BY us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW)""")
def rolling_quota(spark, sf_dir):
    """Requests and tokens of the hour up to every event; the hour's start is excluded."""
    u = Q.rolling_usage(table(spark, sf_dir, "events"), "event_type", "ts", "value", 3600)
    return u.select("event_id", "n_window", F.round("tokens_window", 4).alias("tokens_window"))


@query("""
    SELECT event_type, CAST(ts - INTERVAL 8 HOUR AS DATE) AS day, count(*) AS n, round(sum(value), 4) AS tokens FROM events GROUP BY ALL""")
def calendar_quota(spark, sf_dir):
    """Usage by local day."""
    u = Q.daily_usage(table(spark, sf_dir, "events"), "event_type", "ts", "value")
    return u.select("event_type", "day", "n", F.round("tokens", 4).alias("tokens"))


@query("""
    WITH d AS (SELECT event_type, CAST(ts - INTERVAL 8 HOUR AS DATE) AS day, count(*) AS n, sum(value) AS t FROM events GROUP BY ALL)
    SELECT event_type, day, greatest(0, 80 - n) AS slots, least(greatest(0, 80 - n), CAST(floor(greatest(0, 5000 - t) / 50) AS BIGINT)) AS capacity FROM d""")
def quota_capacity(spark, sf_dir):
    """Requests that a day's slots and tokens still allow."""
    u = Q.daily_usage(table(spark, sf_dir, "events"), "event_type", "ts", "value")
    slots, tokens = Q.remaining(80, F.col("n")), Q.remaining(F.lit(5000.0), F.col("tokens"))
    return u.select("event_type", "day", slots.cast("long").alias("slots"), Q.capacity(slots.cast("long"), tokens, F.lit(50.0)).alias("capacity"))


@query("""
    WITH i AS (SELECT event_id, event_type, ts AS s, ts + INTERVAL 90 SECOND AS e FROM events)
    SELECT a.event_id AS a, b.event_id AS b FROM i a JOIN i b ON a.event_id < b.event_id AND a.event_type <> b.event_type AND greatest(a.s, b.s) < least(a.e, b.e)""")
def interval_overlap(spark, sf_dir):
    """Events of different types that run at the same time."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", (F.col("ts") + F.expr("INTERVAL 90 SECOND")).alias("e"))
    return Q.overlaps(e, "event_id", "event_type", "ts", "e", bucket_seconds=90)


@query("""
    SELECT event_type, count(*) AS n, round(count(*) * 3600.0 / (epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts)))), 6) AS per_hour FROM events GROUP BY event_type""")
def event_throughput(spark, sf_dir):
    """Events an hour by type."""
    e = table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    span = F.unix_timestamp(F.max("t")) - F.unix_timestamp(F.min("t"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.count("*") * 3600.0 / span, 6).alias("per_hour"))


@query("""SELECT count(*) AS n, round(count(*) * 3600.0 / (epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts)))), 6) AS per_hour FROM events""")
def total_throughput(spark, sf_dir):
    """Events an hour."""
    t = M.throughput(table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp")), "t")
    return t.select("n", F.round("per_hour", 6).alias("per_hour"))


def _drain(spark, df, mode: str):
    """Run a streaming frame to its end into a table of the shared folder and read that."""
    out = scratch_path(spark, "stream")

    def put(batch, epoch):
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    q = df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


def _stream(spark, sf_dir):
    batch = table(spark, sf_dir, "events")
    return spark.readStream.schema(batch.schema).option("pathGlobFilter", "events*").parquet(sf_dir if not sf_dir.endswith("/") else sf_dir[:-1])


@query("""
    SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def tumbling_counts(spark, sf_dir):
    """Hourly counts in batch form."""
    e = table(spark, sf_dir, "events")
    w = e.groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start"))
    return w.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""
    SELECT event_type, s AS start, count(*) AS n FROM (SELECT event_type, ts, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM events) GROUP BY ALL""")
def sliding_counts(spark, sf_dir):
    """Counts of one-hour windows that slide by half an hour."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type", F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("""
    WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, session""")
def session_counts(spark, sf_dir):
    """Sessions with gaps of six hours."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("""
    SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL
    HAVING time_bucket(INTERVAL 1 HOUR, any_value(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stream_windows(spark, sf_dir):
    """Hourly counts as a stream with a watermark: windows that it has closed."""
    s = _stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    out = _drain(spark, J.windowed_counts(s, "ts", "event_type", "1 hour").select("event_type", F.col("w.start").alias("start"), "n", "total"), "append")
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query("SELECT event_type, min(event_id) AS event_id FROM events GROUP BY event_type")
def stream_first_of_type(spark, sf_dir):
    """A stream without repeated keys, appended once: the first event of each type by id."""
    s = _stream(spark, sf_dir).groupBy("event_type").agg(F.min("event_id").alias("event_id"))
    return _drain(spark, s, "complete").select("event_type", "event_id")


@query("""
    WITH h AS (SELECT CAST(user_id AS VARCHAR) AS task, event_id, CASE event_type WHEN 'view' THEN 'in_flight' WHEN 'click' THEN 'response_saved' WHEN 'purchase' THEN 'success' WHEN 'signup' THEN 'in_flight' WHEN 'logout' THEN 'request_rejected' ELSE 'known_invalid' END AS s FROM events),
    e AS (SELECT task, min(event_id) AS ended FROM h WHERE s IN ('success', 'known_invalid', 'request_rejected') GROUP BY task),
    k AS (SELECT h.* FROM h LEFT JOIN e USING (task) WHERE ended IS NULL OR event_id <= ended),
    g AS (SELECT task, arg_max(s, event_id) AS status, CAST(count(*) FILTER (s = 'in_flight') AS INTEGER) AS attempts FROM k GROUP BY task)
    SELECT task, status, attempts, status NOT IN ('success', 'known_invalid', 'request_rejected', 'in_flight', 'transport_uncertain', 'response_saved') AND attempts < 3 AS replay FROM g""")
def stream_attempts(spark, sf_dir):
    """Attempt states of every user's history, kept by a stateful stream."""
    states = F.create_map(*(F.lit(x) for x in ("view", "in_flight", "click", "response_saved", "purchase", "success", "signup", "in_flight", "logout", "request_rejected")))
    s = _stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("task"), F.col("event_id").alias("seq"), F.coalesce(states[F.col("event_type")], F.lit("known_invalid")).alias("status"))
    return _drain(spark, J.attempt_states(s), "update").select("task", "status", "attempts", "replay")


@query("""
    WITH RECURSIVE e AS (SELECT event_id, event_type AS owner, epoch_us(ts) AS us, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts), event_id) AS k FROM events),
    s AS (SELECT owner, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS event_id, false AS ok, CAST(NULL AS BIGINT) AS again, CAST([] AS BIGINT[]) AS held FROM (SELECT DISTINCT owner FROM e)
          UNION ALL SELECT owner, k, event_id, len(h) < 3, CASE WHEN len(h) < 3 THEN us ELSE h[1] + 21600000000 END, CASE WHEN len(h) < 3 THEN list_append(h, us) ELSE h END
          FROM (SELECT e.owner, e.k, e.event_id, e.us, list_filter(s.held, lambda x: x > e.us - 21600000000) AS h FROM s JOIN e ON e.owner = s.owner AND e.k = s.k + 1))
    SELECT event_id, owner, ok AS admitted, again AS again_at FROM s WHERE k > 0""")
def stream_admissions(spark, sf_dir):
    """Requests that a rolling limit of three in six hours admits, as a stream whose state is what each owner was granted last."""
    s = _stream(spark, sf_dir).select("event_id", F.col("event_type").alias("owner"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.lit(1.0).alias("tokens"))
    out = scratch_path(spark, "admissions")
    J.admissions(s, out, f"{out}-state", 21_600, 3, 1e9).awaitTermination()
    return J.admitted(spark, out)


#: Appends of these events were torn: half a line, and the next event on a line of its own.
_TORN = "event_type = 'purchase' AND value > 120"
_TORN_SQL = f"""
    WITH t AS (SELECT CAST(ts AS DATE) AS day, min(event_id) FILTER ({_TORN}) AS tear FROM events GROUP BY day)
    SELECT event_id, user_id, event_type, value FROM events JOIN t ON t.day = CAST(ts AS DATE) WHERE tear IS NULL OR event_id < tear"""
_EVENT = "event_id long, user_id long, event_type string, value double"


def _journals(spark, sf_dir: str, path: str, days: str = "true") -> str:
    """The events of every day as a journal of JSON lines, with torn ones."""
    line = F.to_json(F.struct("event_id", "user_id", "event_type", "value", "props"))
    torn = F.when(F.expr(_TORN), F.substring(line, F.lit(1), (F.length(line) / 2).cast("int"))).otherwise(line)
    rows = table(spark, sf_dir, "events").where(days).select(F.to_date("ts").alias("day"), "event_id", torn.alias("value"))
    rows.repartition("day").sortWithinPartitions("day", "event_id").select("day", "value").write.partitionBy("day").mode("append").text(path)
    return path


@query(_TORN_SQL)
def torn_journal(spark, sf_dir):
    """Daily journals read in ranges of 32 kB, each up to its first torn line."""
    return R.read_torn(spark, _journals(spark, sf_dir, scratch_path(spark, "journals")), _EVENT, split_bytes=32 << 10).select("event_id", "user_id", "event_type", "value")


@query(_TORN_SQL)
def stream_torn_journal(spark, sf_dir):
    """The same journals followed as a stream: half of a month, then a restart and the rest, in batches of bounded bytes."""
    path, out = scratch_path(spark, "journals"), scratch_path(spark, "followed")
    for days in ("day(ts) <= 15", "day(ts) > 15"):
        _journals(spark, sf_dir, path, days)
        q = J.append_before_tears(path, out, f"{out}-state", spark, split_bytes=32 << 10, max_bytes=4 << 20)
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    rows = spark.read.schema("file string, offset long, line string, batch long").parquet(out)
    return rows.select(F.from_json("line", _EVENT).alias("r")).select("r.event_id", "r.user_id", "r.event_type", "r.value")


@query("""
    SELECT CAST(user_id AS VARCHAR) || ' ' || event_type AS task, min(event_id) AS seq, sha256(arg_min(props, event_id)) AS reply_sha256 FROM events GROUP BY user_id, event_type""")
def stream_replies_once(spark, sf_dir):
    """The first reply of every user and type, recorded once: all events come twice, the second time after a restart."""
    events = table(spark, sf_dir, "events")
    source, out = scratch_path(spark, "replies"), scratch_path(spark, "recorded")
    for _ in range(2):
        events.write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        replies = stream.select(S.identity("user_id", "event_type").alias("identity"), F.col("event_id").alias("seq"), F.col("props").alias("reply"))
        S.record_replies(replies, out, f"{out}-state").awaitTermination()
    done = spark.read.schema("identity string, seq long, reply_sha256 string, batch long").parquet(f"{out}/successes")
    names = events.select(S.identity("user_id", "event_type").alias("identity"), F.concat_ws(" ", F.col("user_id").cast("string"), "event_type").alias("task")).distinct()
    return done.join(names, "identity").select("task", "seq", "reply_sha256")


#: Runs of the barrier query: a type's events of a day, paused after 5 or two hours, stopped 15 minutes before 20 hours.
_EVERY, _MOST, _STOP = 5, 7_200_000, (72_000 - 900) * 1000


@query(f"""
    WITH RECURSIVE e AS (SELECT event_type || ' ' || CAST(CAST(ts AS DATE) AS VARCHAR) AS run, epoch_us(ts) // 1000 AS t FROM events),
    o AS (SELECT run, t, row_number() OVER (PARTITION BY run ORDER BY t) AS k, min(t) OVER (PARTITION BY run) AS launch FROM e
          UNION ALL SELECT run, (SELECT epoch_us(max(ts)) // 1000 FROM events) AS t, count(*) + 1 AS k, min(t) AS launch FROM e GROUP BY run),
    z AS (SELECT run, max(k) AS ends FROM o GROUP BY run),
    s AS (SELECT run, CAST(0 AS BIGINT) AS k, launch AS l, launch AS last, CAST(0 AS BIGINT) AS f, CAST(0 AS BIGINT) AS n, false AS stopped, CAST(NULL AS BIGINT) AS b1, CAST(0 AS BIGINT) AS n1, CAST(NULL AS BIGINT) AS b2, CAST(0 AS BIGINT) AS n2, CAST(NULL AS BIGINT) AS b3 FROM o WHERE k = 1
          UNION ALL SELECT run, k, l, CASE WHEN hit THEN t ELSE last1 END, CASE WHEN NOT stopped1 AND m = 0 THEN t ELSE f END, CASE WHEN stopped1 OR hit THEN 0 WHEN closing THEN m ELSE m + 1 END, stopped1, b1, n1, CASE WHEN NOT stopped AND stopped1 THEN l + {_STOP} END, m, CASE WHEN hit THEN t END
          FROM (SELECT *, NOT stopped1 AND NOT closing AND (m + 1 >= {_EVERY} OR greatest(last1 + {_MOST}, CASE WHEN m = 0 THEN t ELSE f END) <= t) AS hit
                FROM (SELECT s.run, o.k, o.t, s.l, s.f, s.stopped, o.k = z.ends AS closing, s.stopped OR o.t >= s.l + {_STOP} AS stopped1,
                      CASE WHEN due THEN greatest(s.last + {_MOST}, s.f) END AS b1, s.n AS n1, CASE WHEN due THEN greatest(s.last + {_MOST}, s.f) ELSE s.last END AS last1, CASE WHEN due THEN 0 ELSE s.n END AS m
                      FROM (SELECT s.*, o.t AS at, NOT s.stopped AND s.n > 0 AND greatest(s.last + {_MOST}, s.f) <= least(o.t, s.l + {_STOP}) AS due FROM s JOIN o ON o.run = s.run AND o.k = s.k + 1) s
                      JOIN o ON o.run = s.run AND o.k = s.k + 1 JOIN z ON z.run = s.run)))
    SELECT run, 'barrier' AS kind, b1 AS at_ms, n1 AS results FROM s WHERE b1 IS NOT NULL
    UNION ALL SELECT run, 'stop', b2, n2 FROM s WHERE b2 IS NOT NULL
    UNION ALL SELECT x.run, 'barrier', x.b3, y.m FROM s x JOIN (SELECT run, k, CASE WHEN b1 IS NOT NULL THEN 1 ELSE 0 END AS q, lag(n) OVER (PARTITION BY run ORDER BY k) AS p, CASE WHEN b1 IS NOT NULL THEN 1 ELSE 1 + lag(n) OVER (PARTITION BY run ORDER BY k) END AS m FROM s) y ON y.run = x.run AND y.k = x.k WHERE x.b3 IS NOT NULL""")
def stream_barriers(spark, sf_dir):
    """Pauses and the stop of every type's daily run, by counters and timers of a stream."""
    rows = _stream(spark, sf_dir).select(F.concat_ws(" ", "event_type", F.to_date("ts").cast("string")).alias("run"), F.col("ts").cast("timestamp").alias("ts"))
    with S.keyed_state(spark):
        out = _drain(spark, S.barriers(rows, every=_EVERY, most_seconds=_MOST / 1000), "append")
    return out.select("run", "kind", F.unix_millis("at").alias("at_ms"), "results")


#: Events as work of a user's queue: views and clicks add items, sign-ups and errors ask, purchases end an item.
_WORK = "CASE WHEN event_type IN ('view', 'click') THEN 'item' WHEN event_type = 'purchase' THEN 'done' ELSE 'ask' END"
_WORKER = "CASE WHEN event_type = 'signup' OR (event_type = 'purchase' AND value < 30) THEN 'one' ELSE 'two' END"


@query(f"""
    WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS queue, event_id AS seq, {_WORK} AS kind, {_WORKER} AS worker, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
    s AS (SELECT DISTINCT queue, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seq, '' AS worker, CAST([] AS BIGINT[]) AS free, CAST([] AS BIGINT[]) AS one, CAST([] AS BIGINT[]) AS two, CAST([] AS BIGINT[]) AS given FROM e
          UNION ALL SELECT queue, k, seq, worker, CASE WHEN kind = 'item' THEN list_append(free, seq) ELSE free[1 + len(fresh):] END,
                CASE WHEN worker = 'one' THEN now ELSE one END, CASE WHEN worker = 'two' THEN now ELSE two END, CASE WHEN kind = 'ask' THEN now[1:2] ELSE CAST([] AS BIGINT[]) END
          FROM (SELECT *, CASE kind WHEN 'item' THEN held WHEN 'done' THEN held[2:] ELSE held || fresh END AS now
                FROM (SELECT *, CASE WHEN kind = 'ask' THEN free[1:greatest(0, 2 - len(held))] ELSE CAST([] AS BIGINT[]) END AS fresh
                      FROM (SELECT e.queue, e.k, e.seq, e.kind, e.worker, s.free, s.one, s.two, CASE WHEN e.worker = 'one' THEN s.one ELSE s.two END AS held FROM s JOIN e ON e.queue = s.queue AND e.k = s.k + 1))))
    SELECT queue, seq, worker, CAST(unnest(given) AS VARCHAR) AS item FROM s WHERE len(given) > 0""")
def stream_assignments(spark, sf_dir):
    """Two workers ask for items of users' queues; the stream restarts in the middle of the month and no owner changes."""
    events = table(spark, sf_dir, "events")
    source, out = scratch_path(spark, "work"), scratch_path(spark, "assigned")
    for k, days in enumerate(("day(ts) <= 15", "day(ts) > 15")):
        events.where(days).write.mode("append").parquet(source)
        rows = spark.readStream.schema(events.schema).parquet(source).select(
            F.col("user_id").cast("string").alias("queue"), F.col("event_id").alias("seq"), F.expr(_WORK).alias("kind"), F.expr(_WORKER).alias("worker"),
            F.when(F.expr(_WORK) == "item", F.col("event_id").cast("string")).alias("item"), F.lit(2).alias("n"))

        def put(batch, epoch):
            batch.write.mode("overwrite").parquet(f"{out}/batch={epoch}")

        with S.keyed_state(spark):
            q = S.assignments(rows).writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(S.ASSIGNED + ", batch long").parquet(out).select("queue", "seq", "worker", "item")


@query("""
    WITH a AS (SELECT event_id, ts, (day(ts) - 1) // 6 + CASE WHEN event_type = 'error' AND value > 60 THEN 1 ELSE 0 END AS part FROM events),
    m AS (SELECT part, max(max(ts)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 2 HOUR AS w FROM a GROUP BY part)
    SELECT event_id, coalesce(ts < w, false) AS late FROM a JOIN m USING (part)""")
def stream_quarantine(spark, sf_dir):
    """Large errors arrive with the next six days' events: those behind the watermark are quarantined, no row is lost."""
    events = table(spark, sf_dir, "events")
    part = F.expr("(day(ts) - 1) div 6 + CASE WHEN event_type = 'error' AND value > 60 THEN 1 ELSE 0 END")
    source, out = scratch_path(spark, "arrivals"), scratch_path(spark, "quarantine")
    for k in range(7):
        events.where(part == k).write.mode("append").parquet(source)
        J.quarantine_late(spark.readStream.schema(events.schema).parquet(source), "ts", out, f"{out}-state", "2 hours").awaitTermination()
    return spark.read.schema("event_id long, late boolean, batch long").parquet(f"{out}/rows").select("event_id", "late")
