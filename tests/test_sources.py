import io
import json
import random
import tarfile

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from millrace.operators.gates import GateError
from millrace.sources import readers, writers
from millrace.streaming import journals


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_jsonl_scans(spark, tmp_path):
    p = put(tmp_path / "a.jsonl", '{"x": 1}\nnot json\n{"x": 3}\n')
    assert sorted(r.x for r in readers.read_jsonl_skipping(spark, p, "x int").collect()) == [1, 3]
    with pytest.raises((PySparkException, Py4JJavaError), match="MALFORMED_RECORD"):
        readers.read_jsonl(spark, p, "x int").collect()
    assert readers.read_jsonl(spark, str(tmp_path / "none.jsonl"), "x int", missing_ok=True).count() == 0
    with pytest.raises(PySparkException):
        readers.read_jsonl(spark, str(tmp_path / "none.jsonl"), "x int").count()


def test_torn_tail_drops_what_follows(spark, tmp_path):
    put(tmp_path / "j/a.jsonl", '{"x": 1}\n{"x": 2\n{"x": 3}\n')
    put(tmp_path / "j/b.jsonl", '{"x": 4}\n{"x": 5}')
    put(tmp_path / "j/c.jsonl", "")
    got = readers.read_torn(spark, str(tmp_path / "j"), "x int").collect()
    assert sorted(r.x for r in got) == [1, 4, 5]
    cut = spark.createDataFrame([("a\nb",), ("a\n",), ("a",)], "t string").select(readers.complete_lines(F.col("t")))
    assert [r[0] for r in cut.collect()] == ["a\n", "a\n", ""]


def test_one_journal_is_many_tasks(spark, tmp_path):
    """Ranges of a few bytes, lines longer than ranges, blank and broken lines, no line feed at the end."""
    rng = random.Random(8)
    for k in range(16):
        lines = [json.dumps({"x": i, "pad": "é" * rng.choice([0, 3, 200])}, ensure_ascii=False) for i in range(40)]
        for _ in range(rng.randrange(3)):
            lines.insert(rng.randrange(5, 41), rng.choice(['{"x": 1', "", "   ", "nope", '{"x": 1}{"x": 2}', '{"x": 1}, {"x": 2}', '{"x": 1} ]', '{"x": 0, "x": 7}', '{"x": 1}}']))
        put(tmp_path / f"j/{k}.jsonl", "\n".join(lines) + rng.choice(["", "\n"]))
    put(tmp_path / "j/_hidden.jsonl", "not read")
    expected = []
    for p in sorted((tmp_path / "j").glob("[0-9]*.jsonl")):
        at = 0
        for line in p.read_bytes().split(b"\n"):
            if line.strip():
                try:
                    expected.append((p.name, at, json.loads(line)["x"]))
                except json.JSONDecodeError:
                    break
            at += len(line) + 1
    for split in (700, 1 << 20):
        got = readers.read_torn(spark, str(tmp_path / "j"), "x int", split_bytes=split)
        assert sorted((r.file.rpartition("/")[2], r.offset, r.x) for r in got.collect()) == sorted(expected), split
    lines = readers.journal_lines(spark, str(tmp_path / "j/3.jsonl"), split_bytes=100)
    assert lines.rdd.getNumPartitions() > 10 and lines.count() > 0


def test_complete_lines_only(spark, tmp_path):
    put(tmp_path / "j/a.jsonl", '{"x": 1}\n{"x": 2}')
    put(tmp_path / "j/b.jsonl", '{"x": 3}')
    put(tmp_path / "j/c.jsonl", "")
    read = lambda complete: sorted(r.x for r in readers.read_torn(spark, str(tmp_path / "j"), "x int", complete=complete).collect())
    assert read(False) == [1, 2, 3] and read(True) == [1]


def test_a_followed_journal_goes_on_where_it_stopped(spark, tmp_path):
    """Files that grow in the middle of a line, tear, and come new; a restart between; every line before a tear once."""
    folder, out, state = tmp_path / "j", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()

    def write(name, text):
        with (folder / name).open("a") as f:
            f.write(text)

    def follow(**options):
        q = journals.append_before_tears(str(folder), out, state, spark, split_bytes=11, **options)
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        rows = spark.read.schema("file string, offset long, line string, batch long").parquet(out).collect()
        assert len({(r.file, r.offset) for r in rows}) == len(rows)
        return sorted(json.loads(r.line)["x"] for r in rows)

    write("a", '{"x": 1}\n{"x": 2}\n{"x"')
    write("b", '{"x": 10}\n{"x": 11\n{"x": 12}\n')
    assert follow() == [1, 2, 10]
    write("a", ': 3}\n{"x": 4}')  # the last line is not ended yet
    write("b", '{"x": 13}\n')  # after the tear
    write("c", '{"x": 20}\n')
    assert follow(max_bytes=6) == [1, 2, 3, 10, 20]
    write("a", "\nbroken\n")
    write("c", '{"x": 21}\n')
    assert follow() == [1, 2, 3, 4, 10, 20, 21]
    write("a", '{"x": 5}\n')
    assert follow(max_bytes=3) == [1, 2, 3, 4, 10, 20, 21]


def test_identity_from_file_names(spark, tmp_path):
    put(tmp_path / "v/shard_3_v2.jsonl", '{"x": 1}\n')
    put(tmp_path / "v/notes.jsonl", '{"x": 9}\n')
    got = readers.read_named(spark, str(tmp_path / "v"), r"shard_(\d+)_v(\d+)\.jsonl", ["shard", "vote"], "x int").collect()
    assert [(r.x, r.shard, r.vote) for r in got] == [(1, 3, 2)]


def test_csv_round_trips(spark, tmp_path):
    rows = [(1, 'a "quoted"\nline', ["x", None], None), (2, None, [], 0.5), (3, "", None, float("inf"))]
    df = spark.createDataFrame(rows, "i int, t string, a array<string>, d double")
    again = writers.write_lossless_csv(df, str(tmp_path / "lossless"))
    assert again.schema == df.schema or [f.dataType for f in again.schema] == [f.dataType for f in df.schema]
    with pytest.raises(PySparkException):
        writers.write_lossless_csv(df, str(tmp_path / "lossless"))  # nothing is overwritten
    nested = spark.createDataFrame([(1, ((2, "y"), {"b": 1, "a": 2}))], "i int, s struct<z:struct<q:int,p:string>,m:map<string,int>>")
    assert writers.flat(nested).first().s == '{"m":{"a":2,"b":1},"z":{"p":"y","q":2}}'
    writers.write_csv(nested, str(tmp_path / "c"), quote_all=True)
    back = readers.read_csv(spark, str(tmp_path / "c"), "i int, s string", {"s": "z struct<q:int>"}).first()
    assert back.s.z.q == 2


def test_union_keeps_first_seen_order(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3, 4)], "z int, x int")
    got = writers.union_columns([a, b])
    assert got.columns == ["x", "y", "z"] and got.count() == 2


def test_snapshots_are_verified(spark, tmp_path):
    df = spark.range(5).toDF("i")
    assert writers.write_snapshot(df, str(tmp_path), "v1").count() == 5
    with pytest.raises(PySparkException):
        writers.write_snapshot(df, str(tmp_path), "v1")
    assert writers.read_snapshot(spark, str(tmp_path), "v1").count() == 5
    spark.range(6).toDF("i").write.mode("overwrite").parquet(str(tmp_path / "v1"))
    with pytest.raises(GateError):
        writers.read_snapshot(spark, str(tmp_path), "v1")
    with pytest.raises(GateError):
        writers.write_vectors(df, str(tmp_path / "vec"), 6)
    assert writers.markdown_table(spark.createDataFrame([(None, 0.5, "a|b")], "n int, d double, t string")).splitlines()[2] == "| N/A | 0.500 | a\\|b |"


def test_fingerprints_count_repeated_rows(spark):
    """A repeated row swapped for another repeated row is seen, order and partitions are not."""
    frame = lambda rows: spark.createDataFrame(rows, "a int, t string, m map<string,int>")
    x, y, z = (1, "x", {"k": 1, "l": 2}), (2, None, None), (3, "", {})
    mark = writers.fingerprint(frame([x, x, y, z]))
    assert mark == writers.fingerprint(frame([z, x, y, x]).repartition(3)) and mark[0] == 4
    for other in ([y, y, x, z], [x, x, z, z], [x, y, z], [x, x, y, y]):
        assert mark != writers.fingerprint(frame(other))
    assert writers.fingerprint(frame([x, x, y, y, z])) != writers.fingerprint(frame([z, z, y, y, x]))
    assert writers.fingerprint(frame([])) == (0, 0, 0)


def test_archives(spark, tmp_path):
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as tar:
        for name, data in (("keep/a.json", b"one"), ("skip/b.bin", b"two")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    (tmp_path / "x.tar.gz").write_bytes(buffer.getvalue())
    [r] = readers.read_tar_members(spark, str(tmp_path / "x.tar.gz"), r"keep/.*").collect()
    import hashlib

    assert (r.member, bytes(r.content), r.sha256) == ("keep/a.json", b"one", hashlib.sha256(b"one").hexdigest())


def test_document_fallback_and_layout(spark, tmp_path):
    (tmp_path / "d.bin").write_bytes(b"x")
    pages = readers.read_documents(spark, str(tmp_path / "d.bin"), lambda b: [("short", "r" * 300), ("m" * 250, "r" * 300), ("", "r" * 150)]).orderBy("page").collect()
    assert [r.text[0] if r.text else "" for r in pages] == ["r", "m", ""]
    s = "doc_id string, page int, x0 double, x1 double, y0 double, width double, size double, text string"
    blocks = [("d", 1, 60.0, 95.0, 5.0, 100.0, 8.0, "right"), ("d", 1, 5.0, 40.0, 50.0, 100.0, 8.0, "left low"), ("d", 1, 5.0, 40.0, 10.0, 100.0, 10.0, "left top"), ("d", 1, 5.0, 95.0, 1.0, 100.0, 18.0, "title")]
    assert readers.layout_order(spark.createDataFrame(blocks, s)).first().text == "## title\n### left top\nleft low\nright"


def test_embedding_client_is_batched(spark):
    def client():
        return lambda texts: [[float(len(t)), float(len(texts))] for t in texts]

    got = readers.embed(spark.createDataFrame([("a",), ("bb",), (None,)], "t string").coalesce(1), "t", client, batch=2).collect()
    assert [r.embedding[0] for r in got] == [18.0, 19.0, 17.0]


def run(stream, mode, tmp_path, name):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()


def test_attempt_states(spark, tmp_path):
    put(tmp_path / "in/a.json", "\n".join(f'{{"task": "{t}", "seq": {i}, "status": "{s}"}}' for t, i, s in [
        ("done", 1, "in_flight"), ("done", 3, "in_flight"), ("done", 2, "success"), ("open", 1, "in_flight"), ("again", 1, "in_flight"), ("again", 2, "failed"), ("spent", 1, "in_flight"), ("spent", 2, "failed"), ("spent", 3, "in_flight"), ("spent", 4, "failed"), ("spent", 5, "in_flight"), ("spent", 6, "failed")]))
    s = spark.readStream.schema("task string, seq long, status string").json(str(tmp_path / "in"))
    run(journals.attempt_states(s), "update", tmp_path, "attempts")
    got = {r.task: (r.status, r.attempts, r.replay) for r in spark.table("attempts").collect()}
    assert got == {"done": ("success", 1, False), "open": ("in_flight", 1, False), "again": ("failed", 1, True), "spent": ("failed", 3, False)}


def test_append_once(spark, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for name, rows in (("1.json", '{"k": 1}\n{"k": 1}\n{"k": 2}'), ("2.json", '{"k": 2}\n{"k": 3}')):
        put(tmp_path / "src" / name, rows)
        s = spark.readStream.schema("k int").option("maxFilesPerTrigger", 1).json(str(tmp_path / "src"))
        journals.append_once(s, out, ["k"], state).awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_late_rows_and_assignment(spark):
    df = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-03")], "id int, t string").withColumn("ts", F.to_timestamp("t"))
    fresh, late = journals.split_late(df, "ts", "2024-01-02")
    assert [r.id for r in fresh.collect()] == [2] and [r.id for r in late.collect()] == [1]
    got = journals.assign(spark.range(6).toDF("id"), spark.range(2).toDF("id"), "w", 2).collect()
    assert [(r.id, r.owner) for r in got] == [(2, "w"), (3, "w")]
    assert journals.once(spark.createDataFrame([(1,), (1,), (2,)], "k int"), "k").count() == 2


def test_a_read_has_a_bounded_number_of_ranges(spark, tmp_path, monkeypatch):
    """Ranges grow with the journals, and every line is read once."""
    from millrace.sources import journal_lines

    monkeypatch.setattr(journal_lines, "MOST_RANGES", 10)
    for k in range(3):
        (tmp_path / f"{k}.jsonl").write_bytes(b"".join(b'{"n": %d}\n' % n for n in range(200)))
    parts = journal_lines._Reader({"path": str(tmp_path), "splitBytes": "11"}).partitions()
    assert len(parts) <= 10 + 3
    lines = [line for p in parts for _, line in journal_lines.lines_of(p.path, p.lo, p.hi, p.size)]
    assert sorted(lines) == sorted(b'{"n": %d}' % n for n in range(200) for _ in range(3))


def test_a_batch_of_a_stream_has_few_ranges_and_is_read_once(spark, tmp_path, monkeypatch):
    """Short ranges are joined up to a buffer, every line is in one of them, and a task reads few bytes beyond its own."""
    from millrace.sources import journal_lines

    folder = tmp_path / "j"
    folder.mkdir()
    for k in range(2):
        (folder / f"{k}.jsonl").write_bytes(b"".join(b'{"n": %d}\n' % n for n in range(100_000, 200_000)))
    size = (folder / "0.jsonl").stat().st_size
    for most in (1 << 20, 1 << 16):
        monkeypatch.setattr(journal_lines, "BUFFER", most)
        stream = journal_lines._Stream({"path": str(folder), "splitBytes": "4096"})
        parts = stream.partitions({}, stream.latestOffset())
        assert len(parts) <= max(6, 2 * -(-size // most))
        lines = [line for p in parts for _, line in journal_lines.lines_of(p.path, p.lo, p.hi, p.size)]
        assert sorted(lines) == sorted(b'{"n": %d}' % n for n in range(100_000, 200_000) for _ in range(2))
    scans = spark.sparkContext.accumulator(0)
    real = readers.first_tears

    def counted(lines):
        return real(lines.mapInArrow(seen, lines.schema))

    def seen(batches):
        scans.add(1)
        yield from batches

    monkeypatch.setattr(journals, "first_tears", counted)
    held = []
    monkeypatch.setattr(journals, "before_tears", lambda lines, tears: held.append(lines.storageLevel.useMemory) or readers.before_tears(lines, tears))
    q = journals.append_before_tears(str(folder), str(tmp_path / "out"), str(tmp_path / "state"), spark, split_bytes=4096)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert held == [True] and 0 < scans.value <= 7
    assert spark.read.schema("file string, offset long, line string, batch long").parquet(str(tmp_path / "out")).count() == 200_000
