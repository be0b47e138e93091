"""Stateful streams over made rows: restarts, repeated batches, timers."""

import copy
import hashlib
import random
import shutil
from datetime import datetime, timedelta
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.streaming import journals as J
from millrace.streaming import stateful as S

DAY = datetime(2024, 1, 1)


def append(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def forget_last_commit(checkpoint):
    """As if the driver died after the last batch wrote, before it was committed."""
    commits = sorted((p for p in Path(checkpoint, "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    commits[-1].unlink()
    commits[-1].with_name(f".{commits[-1].name}.crc").unlink(missing_ok=True)


def test_replies_are_recorded_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        S.record_replies(spark.readStream.schema(S.REPLIES).parquet(source), out, f"{out}-state").awaitTermination()
        read = lambda name: sorted(map(tuple, spark.read.parquet(f"{out}/{name}").drop("batch").collect()))
        return read("replies"), read("successes")

    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    append(spark, source, [("a", 2, "late"), ("a", 1, "one"), ("b", 5, "two")], S.REPLIES)
    assert run() == ([("a", 1, "one"), ("b", 5, "two")], [("a", 1, digest("one")), ("b", 5, digest("two"))])
    append(spark, source, [("a", 0, "again"), ("c", 9, "three"), ("c", 9, "three")], S.REPLIES)
    expected = ([("a", 1, "one"), ("b", 5, "two"), ("c", 9, "three")], [("a", 1, digest("one")), ("b", 5, digest("two")), ("c", 9, digest("three"))])
    assert run() == expected
    # the reply of the last batch was stored, its success was not, and the batch was not committed
    forget_last_commit(f"{out}-state")
    shutil.rmtree(f"{out}/successes/batch=1")
    assert run() == expected


def test_first_replies_are_found_without_python(spark):
    """An aggregate finds them, not a Python call for every identity; rows of no sequence are no replies."""
    got = S.first_replies(spark.createDataFrame([("a", 2, "late"), ("a", 1, "one"), (None, 5, "two"), ("c", None, "x")], S.REPLIES))
    assert sorted(map(tuple, got.collect()), key=str) == [("a", 1, "one"), (None, 5, "two")]
    assert "Python" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "Pandas" not in plan


def test_an_identity_binds_all_of_its_parts(spark):
    rows = spark.createDataFrame([("a", "b c"), ("a b", "c"), ("a", None), (None, "a"), ("a", "")], "x string, y string")
    assert rows.select(S.identity("x", "y").alias("i")).distinct().count() == 5


def plain_barriers(times, every, most, stop, until):
    """All pauses and the stop of one run by a clock of whole seconds that also ticks where nothing happens."""
    launch, last, count, out, results = times[0], times[0], 0, [], list(times)
    for t in range(launch, until + 1):
        if t == launch + stop:
            if count and t - last >= most:
                out.append(("barrier", t, count))
                count = 0
            out.append(("stop", t, count))
            return out
        if count and t - last >= most:
            out.append(("barrier", t, count))
            last, count = t, 0
        while results and results[0] == t:
            results.pop(0)
            count += 1
            if count >= every or t - last >= most:
                out.append(("barrier", t, count))
                last, count = t, 0
    return out


@pytest.mark.parametrize("cut", [4, 30])
def test_barriers_and_the_deadline(spark, tmp_path, cut):
    """The same pauses and stop however the results fall in batches, with a restart between all of them."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    runs = {"a": [0, 1, 2, 3, 4, 5, 400, 401, 900, 901, 902, 903, 904, 905, 906], "b": [10, 2000, 2001, 2310, 5000, 5001], "c": [5990]}
    rows = sorted((t, r) for r, ts in runs.items() for t in ts)

    def put(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    for k in range(0, len(rows), cut):
        append(spark, source, [(r, DAY + timedelta(seconds=t)) for t, r in rows[k : k + cut]], "run string, ts timestamp")
        stream = S.barriers(spark.readStream.schema("run string, ts timestamp").parquet(source), length=5000.0, margin=500.0)
        with S.keyed_state(spark):
            q = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
        q.awaitTermination()
    got = spark.read.schema(S.BARRIERS + ", batch long").parquet(out).select("run", "kind", F.unix_seconds("at").alias("at"), "results").collect()
    start = spark.createDataFrame([(DAY,)], "t timestamp").select(F.unix_seconds("t")).first()[0]
    expected = {(r, *x) for r, ts in runs.items() for x in plain_barriers(ts, 5, 300, 4500, 5990)}
    assert len(got) == len(expected) and {(r.run, r.kind, r.at - start, r.results) for r in got} == expected


def test_assigned_items_keep_their_owner(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "queue string, seq long, kind string, worker string, item string, n int"

    def put(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    def run(rows):
        append(spark, source, [("q", *r) for r in rows], schema)
        with S.keyed_state(spark):
            q = S.assignments(spark.readStream.schema(schema).parquet(source)).writeStream.foreachBatch(put).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
        q.awaitTermination()
        return [(r.seq, r.worker, r.item) for r in spark.read.schema(S.ASSIGNED + ", batch long").parquet(out).orderBy("seq", "item").collect()]

    items = [(i, "item", None, str(i), None) for i in range(8)] + [(8, "item", None, "3", None)]
    a = [(10, "a", "0"), (10, "a", "1"), (10, "a", "2")]
    b = [(11, "b", "3"), (11, "b", "4"), (11, "b", "5")]
    assert run([*items, (10, "ask", "a", None, 3), (11, "ask", "b", None, 3)]) == a + b
    # after a restart a worker that asks again has the same items; what is done is not handed out again
    again = [(12, w, i) for _, w, i in a]
    assert run([(12, "ask", "a", None, 3)]) == a + b + again
    rest = [(14, "a", "1"), (14, "a", "2"), (14, "a", "6"), (15, "b", "3"), (15, "b", "4"), (15, "b", "5"), (15, "b", "7"), (17, "b", "4"), (17, "b", "5"), (17, "b", "7")]
    later = [(13, "done", "a", "0", None), (14, "ask", "a", None, 3), (15, "ask", "b", None, 9), (16, "done", "b", None, None), (17, "ask", "b", None, 9), (18, "done", "a", "5", None)]
    got = run(later)
    assert got == a + b + again + rest
    forget_last_commit(f"{out}-state")
    assert run([(19, "item", None, "0", None), (20, "ask", "c", None, 5)]) == got  # nothing is free, and no item comes twice
    owners = {}
    for _, worker, item in got:
        assert owners.setdefault(item, worker) == worker


def test_late_rows_are_kept_apart(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "i int, ts timestamp"

    def run(rows):
        append(spark, source, [(i, None if h is None else DAY + timedelta(hours=h)) for i, h in rows], schema)
        J.quarantine_late(spark.readStream.schema(schema).parquet(source), "ts", out, f"{out}-state", "2 hours").awaitTermination()
        rows = spark.read.schema(schema + ", late boolean, batch long").parquet(f"{out}/rows").collect()
        return sorted(r.i for r in rows if not r.late), sorted(r.i for r in rows if r.late)

    assert run([(1, 5), (2, 10), (3, 0)]) == ([1, 2, 3], [])
    assert run([(4, 7), (5, 8), (6, None), (7, 3)]) == ([1, 2, 3, 5], [4, 6, 7])
    assert run([(8, 9), (9, 7)]) == ([1, 2, 3, 5, 8], [4, 6, 7, 9])  # the watermark does not go back
    forget_last_commit(f"{out}-state")
    assert run([(10, 20)]) == ([1, 2, 3, 5, 8, 10], [4, 6, 7, 9])


@pytest.mark.parametrize("cut", [7, 60])
def test_admissions_go_on_after_a_restart(spark, tmp_path, cut):
    """Any batches admit what one pass over all requests does; a repeated batch changes nothing; rows pass in small pieces."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "event_id long, owner string, us long, tokens double"
    rows = [(i, "ab"[i % 3 == 0], i * 7_000_000 // 2, float(i % 4)) for i in range(60)]
    held, expected = {"a": [], "b": []}, []
    for i, owner, us, tokens in rows:
        now = [(u, t) for u, t in held[owner] if u > us - 30_000_000]
        ok = len(now) < 3 and sum(t for _, t in now) + tokens <= 5
        expected.append((i, owner, ok, us if ok else (now[0][0] if now else us) + 30_000_000))
        held[owner] = now + [(us, tokens)] * ok
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        for k in range(0, len(rows), cut):
            append(spark, source, rows[k : k + cut], schema)
            J.admissions(spark.readStream.schema(schema).parquet(source), out, f"{out}-state", 30, 3, 5.0).awaitTermination()
        assert sorted(map(tuple, J.admitted(spark, out).collect())) == expected
        forget_last_commit(f"{out}-state")
        J.admissions(spark.readStream.schema(schema).parquet(source), out, f"{out}-state", 30, 3, 5.0).awaitTermination()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(map(tuple, J.admitted(spark, out).collect())) == expected


class _HeldState:
    """State variables in memory that count calls."""

    def __init__(self):
        self.calls, self.maps, self.values = 0, {}, {}

    def getValueState(self, name, schema):
        state = self

        class Value:
            def exists(self):
                state.calls += 1
                return name in state.values

            def get(self):
                state.calls += 1
                return state.values.get(name)

            def update(self, value):
                state.calls += 1
                state.values[name] = value

        return Value()

    def getMapState(self, name, key, schema):
        state, held = self, self.maps.setdefault(name, {})

        class Map:
            def containsKey(self, k):
                state.calls += 1
                return k in held

            def getValue(self, k):
                state.calls += 1
                return copy.deepcopy(held.get(k))

            def updateValue(self, k, v):
                state.calls += 1
                held[k] = copy.deepcopy(v)

            def removeKey(self, k):
                state.calls += 1
                del held[k]

        return Map()


def test_assignment_reads_and_writes_few_rows_of_state():
    """A long queue over many batches against plain lists: items come once, and calls are fewer than events."""
    rng = random.Random(4)
    state, processor = _HeldState(), S._Assign()
    processor.init(state)
    known, free, held, expected, got, events = set(), [], {"a": [], "b": [], "c": []}, [], [], 0
    for batch in range(12):
        rows = []
        for k in range(500):
            seq, kind, worker = batch * 500 + k, rng.choice(["item"] * 5 + ["ask"] * 2 + ["done"] * 3), rng.choice("abc")
            item = str(rng.randrange(3000)) if kind == "item" or (kind == "done" and rng.random() < 0.3) else None
            if kind == "done" and item and held[worker]:
                item = rng.choice(held[worker])
            n = rng.randint(1, 40)
            rows.append((seq, kind, None if kind == "item" else worker, item, n))
            if kind == "item":
                if item not in known:
                    known.add(item)
                    free.append(item)
            elif kind == "done":
                if item in held[worker]:
                    held[worker].remove(item)
                elif item is None and held[worker]:
                    held[worker].pop(0)
            else:
                more = max(0, n - len(held[worker]))
                held[worker] += free[:more]
                free = free[more:]
                expected += [(seq, worker, x) for x in held[worker][:n]]
        rng.shuffle(rows)
        events += len(rows)
        frame = pd.DataFrame(rows, columns=["seq", "kind", "worker", "item", "n"])
        for out in processor.handleInputRows(("q",), iter([frame[:200], frame[200:]]), None):
            got += list(zip(out["seq"], out["worker"], out["item"], strict=True))
    assert len(known) > 1500 and got == expected
    assert state.calls < events / 2
