"""The two similarity joins against brute force on small, hostile tables."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.graph import connected_components
from millrace.llm import near_vectors as nv
from millrace.llm.near_vectors import near_vectors
from millrace.llm.ngram_join import PERCENT, Trie, jaccard_classes, least_difference, parity_sketch

DOCS = "doc_id long, text string, component_id string, n int"


def components(ids, links):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_jaccard_classes_equal_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    texts = [None, "", " \n", "one", "ONE", "one two", "One Two", "Ä ä ö", "ä Ä ö"]
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.choice([5, 6, 9, 30, 120, 400]))
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 6])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 12))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append("  ".join(copy))
    texts += [f"{passage} {' '.join(rng.choices(vocabulary, k=rng.choice([3, 12, 40])))}" for _ in range(60)]  # a passage that many share
    texts += [passage] * 40 + [" ".join(rng.choices(vocabulary, k=20_000))] * 2
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    sets = {i: shingle_set(t) for i, t, *_ in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= PERCENT * len(sets[a] | sets[b])]
    expected = components(sets, links)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(spark.createDataFrame(rows, DOCS).repartition(7)).collect()}
    assert got == {i: (len(sets[i]), expected[i]) for i in sets}


def test_jaccard_repeated_rows_and_empty_table(spark):
    text = "a b c d e f g h i j"
    df = spark.createDataFrame([(3, text, "", 0), (3, text, "", 0), (9, text, "", 0), (4, None, "", 0), (4, None, "", 0), (None, text, "", 0)], DOCS)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id) for r in jaccard_classes(df).collect())
    assert got == [(-1, 6, None), (3, 6, 3), (3, 6, 3), (4, 0, 4), (4, 0, 4), (9, 6, 3)]
    assert jaccard_classes(df.limit(0)).count() == 0


def test_trie_finds_what_all_comparisons_find():
    rng = np.random.default_rng(2)
    base = rng.integers(1, 2**63, 300).astype(np.uint64)
    sets = []
    for _ in range(40):
        keep = rng.random(300) > rng.random() * 0.4
        sets.append(np.concatenate([base[keep], rng.integers(1, 2**63, rng.integers(0, 60)).astype(np.uint64)]))
    trie = Trie(sets)
    for probe in sets[:10]:
        p = set(probe.tolist())
        want = [i for i, s in enumerate(sets) if 100 * len(p & set(s.tolist())) >= PERCENT * len(p | set(s.tolist()))]
        assert sorted(trie.matches(probe)) == want


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 300)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.3], rng.integers(0, 2**63, rng.integers(0, 90)).astype(np.uint64)]))
        assert least_difference(parity_sketch(a), parity_sketch(b)) <= len(set(a.tolist()) ^ set(b.tolist()))


def test_near_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = []
    for label in (0, 1):
        for _ in range(12):
            centre = rng.standard_normal(16)
            for _ in range(rng.integers(1, 14)):
                rows.append((len(rows), (centre + rng.standard_normal(16) * 0.12).tolist(), label, "clash"))
    dense = rng.standard_normal(16)
    for _ in range(150):  # more links than a window is wide
        rows.append((len(rows), (dense + rng.standard_normal(16) * 0.05).tolist(), 1, ""))
    rows += [(len(rows) + i, rows[0][1], 0, "") for i in range(30)]  # copies
    n = len(rows)
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16, [1.0, 2.0], [2.0, 4.0]]
    rows += [(n + i, v, 0, "") for i, v in enumerate(odd)] + [(None, rows[0][1], 0, ""), (n + 20, rows[0][1], None, ""), (n + 21, [3.0 * x for x in rows[0][1]], 0, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df.repartition(5), window=8).collect()}
    assert got.pop(None) == (0, None, True)
    rows = [r for r in rows if r[0] is not None]
    links = []
    good = [(i, np.array(v), lab) for i, v, lab, _ in rows if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    for x, (i, u, a) in enumerate(good):
        for j, v, b in good[x + 1 :]:
            if a == b and len(u) == len(v) and u @ v / np.sqrt(u @ u) / np.sqrt(v @ v) >= 0.93:
                links.append((i, j))
    expected = components([r[0] for r in rows], links)
    degree = {r[0]: sum(r[0] in x for x in links) for r in rows}
    assert got == {i: (degree[i], expected[i], expected[i] == i) for i in expected}
    assert near_vectors(df.limit(0)).count() == 0


def test_cells_count_what_all_comparisons_count(spark, monkeypatch):
    """Components over many cells: settled at once where they are dense, vector by vector where they are chains."""
    monkeypatch.setattr(nv, "CELL", 16)
    rng = np.random.default_rng(6)
    rows, centre = [], rng.standard_normal(24)
    for _ in range(90):  # all linked
        rows.append((centre + rng.standard_normal(24) * 0.02).tolist())
    angle = np.linspace(0, 2.6, 120)  # a chain: neighbours are linked, ends are not
    rows += [[float(np.cos(a)), float(np.sin(a)), *[0.0] * 22] for a in angle]
    rows += [rows[3]] * 5 + [(rng.standard_normal(24)).tolist() for _ in range(20)]
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(rows)], "vec_id long, embedding array<float>, label int")
    x = np.array(rows, dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.93
    expected = components(range(len(rows)), zip(*np.nonzero(near)))
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(df, window=8).collect()}
    assert got == {i: (int(near[i].sum()) - 1, expected[i]) for i in range(len(rows))}


def test_rounded_vectors_bound_every_cosine():
    rng = np.random.default_rng(5)
    for size in (2, 16, 300):
        x = rng.standard_normal((60, size)) * rng.choice([1e-3, 1, 1e5], (60, 1))
        x[::3] = x[0] + rng.standard_normal((20, size)) * 0.2 * np.abs(x[0]).max()
        raw = pa.array([bytes([8]) + r.tobytes() for r in x], pa.binary())
        [batch] = nv._tiny(iter([pa.RecordBatch.from_arrays([raw], names=["raw"])]))
        q, error = nv._from_tiny(batch.column("tiny").to_pylist())
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        slack = error[:, None] + error + 3 * error[:, None] * error + 1e-12
        assert (np.abs(q @ q.T - u @ u.T) <= slack).all() and slack.max() < 0.1


def test_centres_are_means_of_all_vectors(spark, monkeypatch):
    rng = np.random.default_rng(12)
    vectors = rng.standard_normal((600, 6)) + 1
    rows = [(i, v.tolist(), i % 2 if i < 595 else 7) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(nv, "SAMPLE", 50, raising=False)
    monkeypatch.setattr(nv, "SUMS", 64, raising=False)  # sums go on more than once a task
    held, write = {}, nv.materialize

    def kept(frame, name):
        out = write(frame, name)
        if name == "groups":
            held.update({r.label: np.frombuffer(r.centre) for r in out.collect()})
        return out

    monkeypatch.setattr(nv, "materialize", kept)
    near_vectors(df.repartition(3))
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for label in (0, 1):
        mean = units[:595][np.arange(595) % 2 == label].mean(axis=0)
        assert np.allclose(held[label], mean, rtol=0, atol=1e-8)
    assert not held[7].any()  # too few to be centred


def test_passes_find_planted_pairs(spark):
    """Recall of pairs at the threshold, among vectors without direction and among vectors that share one."""
    rng = np.random.default_rng(8)
    rows, planted = [], []
    for label, shared in ((0, 0.0), (1, 0.8)):
        x = rng.standard_normal((4000, 32))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        axis = np.zeros(32)
        axis[0] = 1
        x = np.sqrt(1 - shared) * x + np.sqrt(shared) * axis
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for k in range(300):
            side = rng.standard_normal(32)
            side -= (side @ x[k]) * x[k]
            side /= np.linalg.norm(side)
            planted.append((len(rows) + k, len(rows) + 4000 + k))
            x = np.concatenate([x, (0.935 * x[k] + np.sqrt(1 - 0.935**2) * side)[None]])
        rows += [(len(rows) + i, v.tolist(), label) for i, v in enumerate(x)]
    got = {r.vec_id: r.component_id for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    for side in (planted[:300], planted[300:]):
        assert np.mean([got[a] == got[b] for a, b in side]) >= 0.95
    n, shared = F.col("n"), F.col("s")
    counts = spark.createDataFrame([(40, 0.0), (4000, 0.0), (10**6, 0.0), (10**6, 0.8), (10**9, 0.0), (100, 0.95)], "n long, s double").select(nv.passes_needed(n, shared, 48)).collect()
    assert [r[0] for r in counts] == [1, 8, 27, 461, 101, 8]


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (2000, 2001), (2001, 2000)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {i: c for i, c in components({x for e in edges for x in e}, edges).items() if i in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
