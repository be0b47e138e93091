"""Mixing, and the pipeline's stages."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm.mixing import Plan, mix, permute, slots_needed, targets, unpermute, word_count

DOCS = "doc_id long, text string, source string, size string"


@pytest.mark.parametrize("n", [1, 2, 3, 10, 257, 4096])
def test_permutations(n):
    p = permute(np.arange(n), n, 1, 2, 3)
    assert sorted(p.tolist()) == list(range(n)) and (unpermute(p, n, 1, 2, 3) == np.arange(n)).all()


def test_targets():
    assert targets([100, 100, 100], (3, 1, 2)) == [200.0, 83.33333333333333, 166.66666666666666]
    assert targets([0, 10], (3, 1)) == [0.0, 15.0] and targets([]) == [] and targets([0, 0]) == [0.0, 0.0]
    sizes = [random.Random(i).randint(0, 500) for i in range(40)]
    out = targets(sizes)
    assert all(t <= 2 * s + 1e-9 for t, s in zip(out, sizes, strict=True)) and abs(sum(out) - 1.5 * sum(sizes)) < 1e-6


def test_slots_hold_what_is_wanted():
    for size in (1, 5, 64, 65, 130, 1000):
        for words in range(0, 2 * size + 1, max(1, size // 7)):
            blocks = -(-size // 64)
            held = 0
            for epoch, slots, last in slots_needed(words, size, 64, 9, 0):
                of = [min(64, size - 64 * b) for b in permute(np.arange(slots), blocks, 9, 0, epoch).tolist()]
                held += sum(of) if not last else sum(of[:-1]) + last
                assert not last or last <= of[-1]
            assert held == words


def plain_permutation(n, seed, source, epoch):
    """The same permutation in plain integers."""
    full = 2**64 - 1

    def scramble(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & full
        x = (x ^ x >> 27) * 0x94D049BB133111EB & full
        return x ^ x >> 31

    salt = 0x9E3779B97F4A7C15
    key = scramble((scramble((scramble(seed * salt & full) + source) & full) * salt + epoch) & full)
    half = 1
    while 4**half < n:
        half += 1

    def step(x):
        left, right = x >> half, x & ((1 << half) - 1)
        for r in range(4):
            f = scramble(((right + key) * salt + r) & full) >> 32 & ((1 << half) - 1)
            left, right = right, left ^ f
        return left << half | right

    out = []
    for x in range(n):
        x = step(x)
        while x >= n:
            x = step(x)
        out.append(x)
    return out


def test_mix_equals_a_plain_implementation(spark):
    """Streams, blocks, permutations and cuts, one word at a time."""
    rng = random.Random(12)
    rows = [(i if i % 9 else None, " ".join(f"w{k}" for k in range(rng.randint(0, 40))), rng.choice(["a", "b", None]), "") for i in range(90)]
    df = spark.createDataFrame(rows, DOCS)
    seed, block, shard, per_bucket = 77, 8, 5, 4
    hashed = df.select(F.xxhash64(F.lit(seed), "doc_id", "text"), "doc_id", word_count(F.col("text")), "source").collect()
    buckets = max(8, len(rows) // per_bucket) if per_bucket >= 9 else max(8, len(rows) // 9)
    names = sorted({r[3] for r in hashed}, key=lambda x: (x is None, x or ""))
    sizes = [sum(r[2] for r in hashed if r[3] == s) for s in names]
    expected, slots = {}, []
    streams = []
    for k, (name, want) in enumerate(zip(names, targets(sizes), strict=True)):
        own = sorted((r for r in hashed if r[3] == name), key=lambda r: (r[0] % buckets, r[0], r[1] is not None, r[1] or 0, r[2]))
        streams.append([(r[1], r[0], i) for r in own for i in range(r[2])])
        n, left, epoch = -(-sizes[k] // block), round(want), 0
        while left > 0:
            for b in plain_permutation(n, seed, k, epoch):
                take = min(left, len(streams[k][b * block : (b + 1) * block]))
                if take:
                    slots.append((k, epoch, b, take))
                    left -= take
            epoch += 1
    places = plain_permutation(len(slots), seed, sum(1 for _ in {(k, e) for k, e, *_ in slots}), 1 << 32)
    for place, i in enumerate(places):
        k, epoch, b, take = slots[i]
        for doc, h, word in streams[k][b * block : b * block + take]:
            expected.setdefault((doc, h), []).append((epoch, word, place, place // shard))
    got = {}
    rows = mix(df.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text")), block_words=block, shard_slots=shard, docs_per_bucket=per_bucket, seed=seed).where("words > 0").collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).extend((r.epoch, r["first"] + i, r.slot, r.shard) for i in range(r.words))
    for (doc, _), words in expected.items():
        got.setdefault(doc, []).extend(words)
    assert {d: sorted(w) for d, w in by.items()} == {d: sorted(w) for d, w in got.items()}


def test_plans_of_billions_of_slots():
    plan = Plan([(0, 0, 3_000_000_000, 0, 3_000_000_000), (1, 0, 1_500_000_000, 0, 1_500_000_000), (1, 1, 500_000_000, 7, 1_500_000_000), (2, 0, 10, 0, 10)])
    assert plan.total == 5_000_000_010
    parts = [plan.deal(at, at + 20_000, 3) for at in (0, 2_500_000_000, plan.total - 20_000)]
    for k, epoch, block, upto in parts:
        share = np.bincount(k, minlength=3) / len(k)
        assert abs(share[0] - 0.6) < 0.02 and abs(share[1] - 0.4) < 0.02  # a draw of the multinomial
        assert (block < plan.blocks[0]).all() and (block >= 0).all() and not upto.any() and set(epoch[k == 0]) == {0}
    keys = {(int(a), int(b), int(c)) for k, e, blocks, _ in parts for a, b, c in zip(k, e, blocks, strict=True)}
    assert len(keys) == 60_000  # no block twice in an epoch


def taken(df, **kw):
    rows = mix(df, block_words=8, shard_slots=5, docs_per_bucket=4, **kw)
    return rows.groupBy("doc_id", "source", "bucket", "place").agg(F.first("size").alias("size"), F.first("target").alias("target"), F.sum("words").alias("taken")).collect()


def test_mix_meets_targets_and_reruns_agree(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, "", " \n", "w " * rng.randint(1, 90), " x" * 3, "a\x0bb\x1cc"]), rng.choice(["b", "a", None, "hot", "hot", "hot"]), "x") for i in range(400)]
    rows += [rows[7]] * 3 + [(None, "n " * i, "hot", "x") for i in range(9)]
    df = spark.createDataFrame(rows, DOCS)
    got = taken(df.repartition(5))
    assert len(got) == len(rows)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    sizes = sorted(((i, count(t)) for i, t, *_ in rows), key=order)
    assert sorted(((r.doc_id, r["size"]) for r in got), key=order) == sizes and all(r.taken <= 2 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source, [0, r.target])[0] += r.taken
    assert all(abs(t - w) <= 0.5 for t, w in by.values())
    again = taken(df.repartition(3))
    key = lambda rs: sorted(((r.doc_id, r.taken) for r in rs), key=order)
    assert key(got) == key(again)


def test_mix_of_an_empty_table(spark):
    assert taken(spark.createDataFrame([], DOCS)) == []
    assert [r.taken for r in taken(spark.createDataFrame([(1, None, None, ""), (2, "", "a", "")], DOCS))] == [0, 0]


def documents(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(6, 60))) + rng.choice(["", " a.b@c.de", " +1 (843) 555-7672"]), "en", rng.choice(["s1", "s2", None]), 0) for i in range(60)]
    rows += [(100, rows[5][1], "en", "s1", 0), (101, rows[5][1] + " w1", "en", "s2", 0), (102, None, None, "s1", 0), (103, "", "de", None, 0), rows[9], (104, "long " * 30_000, "en", "s2", 0), (None, "no id", "en", "s1", 0), (None, "no id", "en", "s1", 0), (None, "w1 " * 30, "en", "s1", 0), (None, "w2 " * 70, "en", "s1", 0), (105, "one text of this id", "en", "s1", 0), (105, "another text that has it", "en", "s1", 0)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, toxicity_score string")
    return df, rows


def test_stages(spark, tmp_path):
    import corpus_pipeline as P
    from millrace.llm.sentencepiece import default_model

    df, rows = documents(spark)
    spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(60)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(P.STAGES)
    assert list(stages) == ["toxicity", "ngram_jaccard", "pii", "mixing", "sentencepiece"]
    clean = stages["toxicity"](spark, df, str(tmp_path))
    assert clean.columns == list(P.COLUMNS)
    unique = stages["ngram_jaccard"](spark, df, str(tmp_path))
    ids = [r.doc_id for r in unique.collect()]
    assert ids.count(None) == 3 and ids.count(105) == 2 and 100 not in ids  # of two equal texts without an id one stays and ids.count(9) == 1 and {5, 102, 103, 104} <= set(ids)
    safe = stages["pii"](spark, df, str(tmp_path))
    got = safe.collect()
    assert len(got) == len(rows) and not any("@" in (r.text or "") or "555" in (r.text or "") for r in got)
    assert all(r.n_chars == len(r.text or "") for r in got) and [r.text for r in got if r.doc_id == 102] == [None]
    mixed = stages["mixing"](spark, unique, str(tmp_path)).collect()
    text = {}
    for r in unique.collect():
        text.setdefault(r.doc_id, []).append((r.text or "").split())
    assert mixed and all(r.text.split() for r in mixed)
    for r in mixed:  # a row's words are those of one text of its id, none more than its epochs allow
        assert any(set(r.text.split()) <= set(words) and len(r.text.split()) <= len(words) for words in text[r.doc_id])
    held = lambda rows, w: sum(r.text.split().count(w) for r in rows if r.doc_id is None)
    assert held(mixed, "w1") <= 60 and held(mixed, "w2") <= 140
    total = sum(len((r.text or "").split()) for r in unique.collect())
    assert abs(sum(len(r.text.split()) for r in mixed) - 1.5 * total) <= 3
    if os.path.exists(default_model()):
        assert all(r.round_trip for r in stages["sentencepiece"](spark, df, str(tmp_path)).collect())
    for name, stage in P.STAGES:
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0, name
