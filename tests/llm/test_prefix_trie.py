"""The prefix trie against one built node by node in plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from millrace.llm import prefix_trie as P

SCHEMA = "key string, conv_id long, turn long, role string, text string, n int, e string"


def turn_hash(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[: 2 * P.HASH]


def plain_trie(rows):
    convs = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            convs.setdefault(conv_id, []).append((turn is not None, turn or 0, turn_hash(role or "", text or ""), role or "", text or ""))
    convs = {c: [t[3:] for t in sorted(ts)] for c, ts in convs.items()}
    nodes = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        full = (*convs.get(base, [])[:h], *own[h:])
        for d in range(len(full) + 1):
            node = nodes.setdefault(full[:d], {"members": [], "ends": []})
            node["members"].append(c)
        nodes[full]["ends"].append(c)
    for node in nodes.values():
        node.update(children=0, leaves=0, saved=0)
    for path in sorted(nodes, key=len, reverse=True):
        node = nodes[path]
        node["leaves"] = node["leaves"] or 1
        node["saved"] += (len(node["members"]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0)
        if path:
            parent = nodes[path[:-1]]
            parent["children"] += 1
            parent["leaves"] += node["leaves"]
            parent["saved"] += node["saved"]
    out = []
    for path, n in nodes.items():
        ends = hashlib.sha256(",".join(map(str, sorted(n["ends"]))).encode()).hexdigest()
        out.append((min(n["members"]), len(path), min(nodes[path[:-1]]["members"]) if path else None, len(n["members"]), n["children"], n["leaves"], n["saved"], ends))
    return out


def made(seed, n, turns, words, ids=range(1, 400)):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(list(ids), n):
        for t in range(rng.randrange(0, turns)):
            rows.append((c, t, rng.choice(["user", "assistant"]), " ".join(["w"] * rng.randrange(words))))
    return rows


CASES = {
    "shared": made(1, 200, 9, 3),
    "unlike": made(2, 90, 5, 50),
    "equal": [(c, t, "user", "same text") for c in range(0, 4000, 7) for t in range(3)],
    "negative": made(3, 60, 6, 2, range(-90, 90)),
    "long": [(c, t, "user", "a b") for c in (40, 41, 47) for t in range(3000)] + [(41, 3000, "user", "end")],
    "hostile": [
        (None, 0, "user", "no conversation"), (1, None, None, None), (1, 3, "user", "x"), (1, 3, "user", "x"), (1, 3, "user", "y"), (2, 5, "", ""), (2, 5, "u", "ser"), (3, 5, "us", "er"),
        (20, 1, "user", ""), (20, 0, "user", "漢 字"), (21, 0, "user", "漢 字"), (22, 0, "user", "\x0b"), (25, 0, "a\nb", "c"), (9_000_000_000_000_000_000, 0, "user", "q"), (-21, 1, "user", "z" * 100_000),
    ],
    "one": [(7, 0, "user", "hello")],
    "none": [],
}


@pytest.mark.parametrize("case", CASES)
def test_equals_a_plain_trie(spark, case):
    rows = [("clash", *r, 1, "x") for r in CASES[case]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3) if rows else spark.createDataFrame([], SCHEMA)
    # many small ranges, so that cuts fall between conversations that share turns
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = [tuple(r) for r in P.prefix_trie(df).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    key = lambda r: [str(x) for x in r]
    assert sorted(got, key=key) == sorted(plain_trie(CASES[case]), key=key)


def walked(cuts, seqs):
    """Nodes by ranges cut at the given places, the top of their shared points, and expansion, without Spark."""
    import pyarrow as pa

    rows = []
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        cut = lambda k: seqs[k][0][: P.HASH * P.shared_turns(seqs[k - 1][0], seqs[k][0])] if 0 < k < len(seqs) else b""
        walk = P.Walk(rows.append, top=False)
        for key, words, conv_id in seqs[a:b]:
            walk.add(key, words, max(P.shared_turns(key, cut(a)), P.shared_turns(key, cut(b))), conv_id, 1, f"end{conv_id}")
        walk.end()
    sent = {}
    for kind, conv_id, _, n, children, leaves, saved, ends, words, _, ref in rows:
        if kind == 2:
            old = sent.setdefault(ref, [words, conv_id, 0, None, 0, 0, 0])
            ids = [x for x in (old[1], conv_id) if x is not None]
            sent[ref] = [words, min(ids, default=None), old[2] + n, old[3] or ends, old[4] + leaves, old[5] + saved, old[6] + children]
    tops = []
    walk = P.Walk(tops.append, top=True)
    for ref in sorted(sent):
        words, conv_id, n, ends, leaves, saved, children = sent[ref]
        walk.add(ref, np.frombuffer(words, "<i4"), 0, conv_id, n, ends, leaves, saved, children)
    walk.end()
    parent = {r[10]: r[1] for r in tops}
    for r in rows:
        if r[0] == 1:
            r[9] = parent[r[10]]
    edges = [r for r in rows if r[0] != 2] + tops
    batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in edges], f.type) for i, f in enumerate(P._EDGE)], schema=P._EDGE)
    return sorted((tuple(x.values()) for b in P._expand(iter([batch])) for x in b.to_pylist()), key=str), edges


def test_any_cuts_give_the_same_tree():
    """Every way of cutting the sorted sequences in ranges, through shared trunks, ends and branches."""
    rng = random.Random(9)
    for _ in range(60):
        paths = sorted({tuple(rng.choices("ab", k=rng.randrange(0, 7))) for _ in range(rng.randrange(1, 12))})
        seqs = [(b"".join(t.encode() * P.HASH for t in p), np.array([ord(t) % 7 for t in p], np.int32), i) for i, p in enumerate(paths)]
        whole, _ = walked([0, len(seqs)], seqs)
        for _ in range(8):
            inner = sorted(rng.sample(range(1, len(seqs)), rng.randrange(0, len(seqs)))) if len(seqs) > 1 else []
            assert walked([0, *inner, len(seqs)], seqs)[0] == whole


def test_points_are_branches_ends_and_leaves_only():
    """Ten sequences of 500 turns with one trunk make a tree of edges, not of turns."""
    seqs = [(b"t" * P.HASH * 400 + bytes([i]) * P.HASH * 100, np.ones(500, np.int32), i) for i in range(10)]
    nodes, edges = walked([0, 10], seqs)
    assert len(nodes) == 1 + 400 + 10 * 100 and len(edges) == 1 + 1 + 10


def test_a_task_sends_sequences_in_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(P, "PIECE_CHARS", 50)
    ids = list(range(-300, 700))
    sent = [r for b in P._pieces(iter([pa.RecordBatch.from_pydict({"e": ["x"] * 1000, "conv_id": ids})])) for r in b.to_pylist()]
    assert len(sent) > 50
    (got,) = [r for b in P._digests(iter([pa.RecordBatch.from_pylist(sent[i : i + 9]) for i in range(0, len(sent), 9)])) for r in b.to_pylist()]
    assert got == {"e": "x", "min_id": -300, "n": 1000, "ends": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()}
