"""Streams: replies recorded once by a join; with keyed state and timers, barriers and deadlines of runs, exclusive assignment.

State lives in Spark's state store, by key: a batch reads the keys that it meets and nothing of the history, and a
restart goes on from the checkpoint. A batch that is repeated after a crash starts from the state before it, so its
rows are the same again, and sinks write them over. Rows of a key are taken in the order of ``seq`` (or time) within a
batch; batches follow each other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries started within keep their state in RocksDB, which these operators need; others keep theirs as they were."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


# --- replies recorded once ---

REPLIES = "identity string, seq long, reply string"


def identity(*parts: str) -> F.Column:
    """What a reply is cached by: a digest of task, provider, model and protocol. Parts cannot run into each other."""
    return F.sha2(F.to_json(F.struct(*(F.col(p).cast("string").alias(p) for p in parts)), {"ignoreNullFields": "false"}), 256)


def first_replies(replies: DataFrame) -> DataFrame:
    """The first reply of each identity in ``replies(identity, seq, reply)``."""
    first = F.min(F.struct("seq", "reply")).alias("first")
    return replies.where("seq IS NOT NULL").groupBy("identity").agg(first).select("identity", "first.*")


def record_replies(replies: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Record the first reply of every identity, ever: the raw reply is stored before its success is.

    A batch leaves out the identities that batches before it recorded, whose names alone it reads. It writes
    ``path/replies/batch=n``, reads it back, and writes ``path/successes/batch=n`` with the digest of what it read; both
    replace what an earlier attempt of the batch left. A success therefore has its reply, and a crash between the two
    leaves a reply without success, which the repeated batch completes.
    """

    def put(batch: DataFrame, epoch: int) -> None:
        raw, spark = f"{path}/replies/batch={epoch}", batch.sparkSession
        fresh = batch
        if epoch:  # a batch's replies stand before the next one begins
            known = spark.read.schema(f"{REPLIES}, batch long").parquet(f"{path}/replies").where(F.col("batch") < epoch)
            fresh = batch.join(known.select(F.col("identity").alias("known")), F.col("identity").eqNullSafe(F.col("known")), "left_anti")
        first_replies(fresh).write.mode("overwrite").parquet(raw)
        stored = spark.read.schema(REPLIES).parquet(raw)
        stored.select("identity", "seq", F.sha2("reply", 256).alias("reply_sha256")).write.mode("overwrite").parquet(f"{path}/successes/batch={epoch}")

    return replies.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# --- barriers and the deadline of a run ---

BARRIERS = "run string, kind string, at timestamp, results long"


class _Barriers(StatefulProcessor):
    def __init__(self, every: int, most_seconds: float, length: float, margin: float):
        self.every, self.most, self.stop = every, int(most_seconds * 1000), int((length - margin) * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "launch long, last long, first long, results long, stopped boolean")

    def _due(self, last: int, first: int) -> int:
        """When a run with results pauses by time: so long after the last barrier, or with its first result if that comes later."""
        return max(last + self.most, first)

    def _settle(self, state: list, until: int, out: list) -> None:
        """Barriers and the stop that fall before ``until``, or on it."""
        launch, last, first, results, stopped = state
        if stopped:
            return
        end = launch + self.stop
        if results and self._due(last, first) <= min(until, end):
            last = self._due(last, first)
            out.append(("barrier", last, results))
            results = 0
        if until >= end:
            out.append(("stop", end, results))
            results, stopped = 0, True
        state[:] = [launch, last, first, results, stopped]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = sorted(t for frame in rows for t in frame["ms"].tolist())
        state = list(self.clock.get()) if self.clock.exists() else [times[0], times[0], 0, 0, False]
        out: list[tuple] = []
        for t in times:
            self._settle(state, t, out)
            if state[4]:
                break
            launch, last, first, results, _ = state
            first, results = (first, results + 1) if results else (t, 1)
            if results >= self.every or self._due(last, first) <= t:
                out.append(("barrier", t, results))
                last, results = t, 0
            state[:] = [launch, last, first, results, False]
        yield from self._keep(key, state, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, out = list(self.clock.get()), []
        # all that the watermark has passed, as a timer set now would wait for another batch
        self._settle(state, max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()), out)
        yield from self._keep(key, state, out)

    def _keep(self, key, state: list, out: list) -> Iterator[pd.DataFrame]:
        self.clock.update(tuple(state))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        launch, last, first, results, stopped = state
        if not stopped:
            end = launch + self.stop
            self.handle.registerTimer(min(self._due(last, first), end) if results else end)
        if out:
            at = pd.to_datetime([o[1] for o in out], unit="ms")
            yield pd.DataFrame({"run": [key[0]] * len(out), "kind": [o[0] for o in out], "at": at, "results": [o[2] for o in out]})

    def close(self) -> None:
        pass


def barriers(results: DataFrame, every: int = 5, most_seconds: float = 300.0, length: float = 72_000.0, margin: float = 900.0, delay: str = "0 seconds") -> DataFrame:
    """When runs pause for a checkpoint, and when they stop: ``(run, kind, at, results)`` of ``results(run, ts)``.

    A run is launched by its first result, which fixes its deadline, ``length`` seconds on, for good. It pauses after
    ``every`` results, or ``most_seconds`` after the last pause if there is any result since; it stops ``margin``
    seconds before the deadline, and later results do not count. Pauses that no result brings about come from timers,
    once the watermark, ``delay`` behind the latest result, has passed them. Times are whole milliseconds.
    """
    rows = results.withWatermark("ts", delay).withColumn("ms", F.unix_millis("ts"))
    return rows.groupBy("run").transformWithStateInPandas(_Barriers(every, most_seconds, length, margin), BARRIERS, "append", "EventTime")


# --- exclusive assignment ---

ASSIGNED = "queue string, seq long, worker string, item string"


#: Free items of one row of state.
FREE = 256
#: Items that the first level of what a queue knows has room for, and about so many in a bucket of any level.
KNOWN = 64


class _Queue:
    """A queue's state during a batch: what is read is kept, and what changed is written once at the end.

    Free items lie in rows of ``FREE``. Known items are in levels of 1, 4, 16, ... buckets by their hash, each level
    four times the one before; the last one grows. So a batch reads few rows of a long queue and never all of it.
    """

    def __init__(self, state: _Assign):
        self.state = state
        ends = state.ends.get()
        self.new = ends is None
        self.head, self.tail, self.count = ends or (0, 0, 0)
        self.begin, self.stored = self.head, self.tail
        self.blocks: dict[int, list] = {}
        self.buckets: dict[tuple[int, int], dict] = {}
        self.workers: dict[str, list] = {}
        self.changed: dict[tuple, None] = {}

    def _read(self, rows, key: tuple) -> list:
        row = None if self.new else rows.getValue(key)
        return list(row[-1]) if row is not None else []

    def _block(self, at: int) -> list:
        block = at // FREE
        if block not in self.blocks:
            self.blocks[block] = self._read(self.state.items, (block,)) if block * FREE < self.stored else []
        return self.blocks[block]

    def _bucket(self, level: int, item: str) -> tuple[tuple[int, int], dict]:
        key = (level, zlib.crc32((item or "").encode()) % 4**level)
        if key not in self.buckets:
            self.buckets[key] = dict.fromkeys(self._read(self.state.known, key))
        return key, self.buckets[key]

    def add(self, item: str) -> None:
        level, room = 0, KNOWN
        while True:
            key, bucket = self._bucket(level, item)
            if item in bucket:  # an item comes once
                return
            if self.count < room:
                break
            level += 1
            room += KNOWN * 4**level
        bucket[item] = None
        self._block(self.tail).append(item)
        self.changed |= {("known", key): None, ("items", self.tail // FREE): None}
        self.tail, self.count = self.tail + 1, self.count + 1

    def next(self) -> str:
        item = self._block(self.head)[self.head % FREE]
        self.head += 1
        return item

    def held(self, worker: str) -> list:
        if worker not in self.workers:
            self.workers[worker] = self._read(self.state.owned, (worker,))
        return self.workers[worker]

    def write(self) -> None:
        for kind, key in self.changed:
            if kind == "known":
                self.state.known.updateValue(key, (list(self.buckets[key]),))
            elif kind == "owned":
                self.state.owned.updateValue((key,), (self.workers[key],))
            elif (key + 1) * FREE > self.head:
                self.state.items.updateValue((key,), (self.blocks[key],))
        for block in range(self.begin // FREE, self.head // FREE):  # rows whose items all have owners
            if block * FREE < self.stored:
                self.state.items.removeKey((block,))
        self.state.ends.update((self.head, self.tail, self.count))


class _Assign(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ends = handle.getValueState("ends", "head long, tail long, known long")  # places of the first free item and of the next one
        self.items = handle.getMapState("items", "block long", "items array<string>")
        self.owned = handle.getMapState("owned", "worker string", "items array<string>")
        self.known = handle.getMapState("known", "level int, bucket long", "items array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("seq", kind="stable")
        queue = _Queue(self)
        out: list[tuple] = []
        for seq, kind, worker, item, n in zip(frame["seq"], frame["kind"], frame["worker"], frame["item"], frame["n"], strict=True):
            if kind == "item":
                queue.add(item)
                continue
            held = queue.held(worker)
            if kind == "done":
                done = item if item is not None and item in held else held[0] if item is None and held else None
                if done is not None:
                    held.remove(done)
            else:
                while len(held) < int(n) and queue.head < queue.tail:  # what a worker has comes before what is free
                    held.append(queue.next())
                out += [(int(seq), worker, x) for x in held[: int(n)]]
            queue.changed["owned", worker] = None
        queue.write()
        if out:
            yield pd.DataFrame({"queue": [key[0]] * len(out), "seq": [o[0] for o in out], "worker": [o[1] for o in out], "item": [o[2] for o in out]})

    def close(self) -> None:
        pass


def assignments(rows: DataFrame) -> DataFrame:
    """Items that workers get: ``(queue, seq, worker, item)`` of ``rows(queue, seq, kind, worker, item, n)``.

    ``item`` adds an item to a queue, once for good; ``ask`` gives a worker up to ``n`` items, those that it already has
    first and then free ones in order; ``done`` ends an item of the worker's, the oldest if none is named. An item has
    one owner ever: asking again, also after a restart, gives the same items and never another worker's. Queues are
    independent, so work is spread by queue.
    """
    return rows.groupBy("queue").transformWithStateInPandas(_Assign(), ASSIGNED, "append", "None")
