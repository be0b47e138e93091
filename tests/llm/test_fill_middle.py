"""Fill-in-middle against a plain version."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.llm import fill_middle as M
from millrace.llm.words import text_bytes

SCHEMA = "text string, doc_id long, n string, output int, h1 int"


def plain_version(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    n = len(units)
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def hostile():
    rng = random.Random(3)
    parts = ["a", "PSM", "<", ">", "<P", "<S", "M>", " ", "\n", "\x00", "é", "漢字", "🙂", "é", "1", "<<P", "P>"]
    texts = [None, "", "a", "<", "é", "<P", "P>", "<P>", "x<S>y", "<<M>", "<m>", "< P>", "🙂" * 5000, "w" * 300_000, "a " * 200_000 + "<M>", "é<" * 3000]
    return texts + ["".join(rng.choices(parts, k=rng.randrange(1, 60))) for _ in range(400)]


def test_equals_a_plain_version(spark):
    rows = [(t, i if i % 50 else None, "clash", 1, 2) for i, t in enumerate(hostile())] + [("same row", 7, "", 0, 0)] * 3
    df = spark.createDataFrame(rows, SCHEMA)
    got = M.fill_in_middle(df).withColumn("again", M.restore(F.col("output"), F.col("form"))).collect()
    key = lambda r: [str(x) for x in r]
    expected = [(i, *plain_version(i, t), t or "") for t, i, *_ in rows]
    assert sorted(([*r] for r in got), key=key) == sorted(([*r] for r in expected), key=key)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert M.fill_in_middle(df.limit(0)).count() == 0


def test_shares_of_forms_are_parameters(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"))
    assert {r.form for r in M.fill_in_middle(df, plain_percent=0, spm_percent=100).collect()} == {"spm"}
    assert {r.form for r in M.fill_in_middle(df, plain_percent=100).collect()} == {"plain"}


def test_no_text_of_a_batch_sees_another():
    """A sentinel, a run of letters or a code point never goes on in the next text, and steps of the scan leave no seam."""
    texts = ["<", "P>", "<P", ">", "ab", "cd", "", "é", "<S>"]
    data, offsets = text_bytes(pa.array(texts))
    alone = np.concatenate([M.scan(*text_bytes(pa.array([t]))) for t in texts])
    assert (M.scan(data, offsets) == alone).all()
    step, M._STEP = M._STEP, 1
    try:
        assert (M.scan(data, offsets) == alone).all()
    finally:
        M._STEP = step
