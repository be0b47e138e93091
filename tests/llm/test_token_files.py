"""Token files against the library, and the coder by round trips."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import token_files as T
from millrace.session import scratch_path

SCHEMA = "text string, doc_id long, ids string, start int, row int"


def little(ids):
    return np.array(ids, "<u4").tobytes()


def library(rows):
    """What the contract says, by the library alone: documents in order, their starts, sizes and checksums."""
    tokenizer = Tokenizer.from_file(T.default_tokenizer())
    out = [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows]
    out.sort(key=lambda x: (x[0] is not None, x[0] or 0))
    start, found = 0, []
    for i, ids in out:
        found.append((i, start, len(ids), zlib.crc32(little(ids))))
        start += len(ids)
    return found


def odd_texts():
    rng = random.Random(5)
    parts = ["the", "Erou,", "Ción.", "İ.", "é!", "á.", "ΑΣ.", "<|endoftext|>", "<|ENDOFTEXT|>", "don't", "'s", "IT'S!", "\x0b", "\x1c", "\x85", "　", "12.5", "a..b", "ŉs", "ǅ,", "ẞ?", "ª.", "क़.", "🙂.", "\x00", "漢字,", "\n", "\t"]
    return ["".join(p + rng.choice(["", " ", "  ", "\n"]) for p in rng.choices(parts, k=rng.randrange(1, 40))) for _ in range(300)]


def test_equals_the_library(spark):
    texts = [None, "", " \n ", "one", "w" * 5000, "word " * 3000, *odd_texts()]
    rows = [(t, 1000 - i if i % 90 != 7 else None, "x", 1, 2) for i, t in enumerate(texts)] + [("same row", 5, "", 0, 0)] * 40
    rows = [r for r in rows if r[1] is not None or r[0] == texts[7]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    files = T.write_tokens(df, scratch_path(spark, "test"), T.default_tokenizer(), file_ids=2000)
    assert len(files) > 3 and sum(f.n_docs for f in files) == len(rows)
    got = T.read_tokens(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == library([(r[1], r[0]) for r in rows])


def test_long_texts_in_parts(monkeypatch):
    rng = random.Random(6)
    text = " ".join(rng.choice(odd_texts()) for _ in range(200)) + "x" * 900
    tokenizer = Tokenizer.from_file(T.default_tokenizer())
    monkeypatch.setattr(T, "LONG_TEXT", 300)
    ids, at = T.WordEncoder(T.default_tokenizer(), 1).encode(pa.array([text]))
    assert ids.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1] and at.tolist() == [0, len(ids)]


def test_kept_pieces_are_forgotten_and_clashes_seen(monkeypatch):
    texts = odd_texts()
    tokenizer = Tokenizer.from_file(T.default_tokenizer())
    expected = [i for t in texts for i in [*tokenizer.encode(t, add_special_tokens=False).ids, 1]]
    monkeypatch.setattr(T, "MOST_PIECES", 50)
    encoder = T.WordEncoder(T.default_tokenizer(), 1)
    assert [i for k in range(0, 300, 20) for i in encoder.encode(pa.array(texts[k : k + 20]))[0].tolist()] == expected
    monkeypatch.setattr(T, "_marks", lambda data, start, end, f=T._marks: (f(data, start, end)[0] | np.uint64(2**64 - 4), f(data, start, end)[1]))
    assert T.WordEncoder(T.default_tokenizer(), 1).encode(pa.array(texts))[0].tolist() == expected


def test_whole_texts_where_pieces_hold_spaces(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([(1, "a b  c"), (2, ""), (3, None)], "doc_id long, text string")
    got = T.read_tokens(spark, T.write_tokens(df, scratch_path(spark, "test"), path, end_id=50256, apart=False)).collect()
    ids = Tokenizer.from_file(path).encode("a b  c", add_special_tokens=False).ids
    assert {r.doc_id: bytes(r.ids) for r in got} == {1: little([*ids, 50256]), 2: little([50256]), 3: little([50256])}


def test_no_rows_and_equal_ids(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert T.read_tokens(spark, T.write_tokens(empty, scratch_path(spark, "test"), T.default_tokenizer())).count() == 0
    one_id = spark.createDataFrame([(f"text number {i % 7}", 3, "", 0, 0) for i in range(400)], SCHEMA)
    files = T.write_tokens(one_id, scratch_path(spark, "test"), T.default_tokenizer(), file_ids=500)
    assert len(files) > 1  # one id does not meet in one task
    got = T.read_tokens(spark, files).orderBy("start").collect()
    assert len(got) == 400 and all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))


@pytest.mark.parametrize("kind", ["zipf", "one", "few", "every"])
def test_blocks_give_any_range_back(kind):
    rng, size = np.random.default_rng(4), 3 * T.BLOCK + 1234
    weights = {"zipf": 1 / np.arange(1, 5001), "one": np.eye(1, 9)[0], "few": np.array([0.5, 0, 0.5, 1e-9]), "every": np.ones(49408)}[kind]
    ids = rng.choice(len(weights), size, p=weights / weights.sum()).astype(np.uint32)
    ids[:3] = np.flatnonzero(weights)[-1]
    table = T.Table.load(T.Table.of(np.bincount(ids, minlength=len(weights))).dump())
    raw = memoryview(b"".join(T.encode_ids(table, ids)))
    blocks, at = [], 0
    while at < len(raw):
        block, at = T._block(raw, at)
        blocks.append(block)
    assert len(blocks) == 4
    for lo, hi in [(0, size), (0, 1), (size - 1, size), (T.CHECKPOINT - 1, T.CHECKPOINT + 1), (T.BLOCK - 3, 2 * T.BLOCK + 7), (5, 5)]:
        assert (T.decode_blocks(table, blocks, lo, hi, table.slots) == ids[lo:hi]).all()
    if kind == "zipf":
        p = np.bincount(ids) / size
        entropy = -(p[p > 0] * np.log2(p[p > 0])).sum() * size / 8
        assert len(raw) < 1.06 * entropy


def test_rare_ids_keep_a_slot():
    counts = np.array([10**13, 0, 1, 1, 10**9, *[1] * 40_000])
    table = T.Table.of(counts)
    assert ((table.freq > 0) == (counts > 0)).all() and table.freq.sum() == 1 << table.scale


def test_documents_over_many_segments_and_damage(spark, monkeypatch):
    """A document longer than segments is read whole by one task; a changed byte is an error and not another text."""
    table = T.Table.of(np.bincount(np.arange(5000) % 50))
    folder = T.qualified(spark, scratch_path(spark, "test"))
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/table", compression=None) as out:
        out.write(table.dump())
    monkeypatch.setattr(T, "SEGMENT", 1000)
    docs = [(1, 10), (2, 5000), (None, 1), (3, 990), (4, 3000), (5, 1)]
    with fs.open_output_stream(f"{root}/part", compression=None) as out:
        writer = T._SegmentWriter(out, table)
        for doc_id, n in docs:
            writer.add(doc_id, (np.arange(n) % 50).astype(np.uint32))
        writer.close()

    def read():
        batch = [pa.RecordBatch.from_pylist([{"path": f"{folder}/part", "size": writer.size, "base": 100, "segment": k}]) for k in range(len(writer.listed))]
        return [r for b in T._reader(iter(batch)) for r in b.to_pylist()]

    start = 100
    for got, (doc_id, n) in zip(read(), docs, strict=True):
        assert (got["doc_id"], got["start"], got["n_tokens"], got["ids"]) == (doc_id, start, n, little(np.arange(n) % 50))
        start += n
    raw = bytearray(fs.open_input_file(f"{root}/part").read())
    for at in random.Random(2).sample(range(len(T.MAGIC) + 40, len(raw) - T.TAIL.size), 60):
        changed = raw.copy()
        changed[at] ^= 0x11
        with fs.open_output_stream(f"{root}/part", compression=None) as out:
            out.write(bytes(changed))
        with pytest.raises(ValueError):
            read()
