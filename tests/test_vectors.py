"""Top-k in cells against all comparisons, and how much the bounds leave out."""

import numpy as np
import pyarrow as pa
import pytest

from millrace.operators import retrieval, vector_cells as VC


def made(seed=0, n=3000, d=24, groups=30):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d))
    return (centres[rng.integers(0, groups, n)] + 0.15 * rng.normal(size=(n, d))).astype(np.float32)


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, None if v is None else [float(c) for c in v]) for i, v in enumerate(x)], "id long, v array<float>")


def test_equals_all_comparisons(spark, monkeypatch):
    """Clustered vectors, ties, copies, zeros, nulls and another length; few rows a block, so that cells have many."""
    monkeypatch.setattr(VC, "BLOCK_ROWS", 40)
    x = list(made())
    x += [x[5]] * 12 + [np.zeros(24), None, np.full(24, np.nan)] + [np.array([1.0, k]) for k in range(9)]
    df = table(spark, x)
    q = table(spark, [x[i] for i in (0, 5, 17, 900)] + [np.zeros(24), np.array([1.0, 2.5]), -x[3]], first=10_000)
    queries = q.selectExpr("id AS query_id", "v AS q").union(df.where("id IN (5, 44)").selectExpr("id", "v"))
    vectors = df.selectExpr("id AS vec_id", "v")
    key = lambda r: (r.query_id, r["rank"])
    got, want = (sorted((tuple(r) for r in f(queries, vectors, k=10).select("query_id", "vec_id", "score", "rank").collect())) for f in (VC.top_k_in_cells, retrieval.top_k))
    assert got == want and len({r[0] for r in got}) == 8 and key
    assert VC.top_k_in_cells(queries.limit(0), vectors).count() == 0 and VC.top_k_in_cells(queries, vectors.limit(0)).count() == 0


def test_bounds_leave_most_blocks_out(spark):
    x = made(1, 4000)
    vectors = table(spark, x).selectExpr("id AS vec_id", "v")
    centres = VC.find_centres(vectors)
    cells = VC.build_cells(vectors, centres).where("size = 24").collect()
    unit = lambda m: m / np.sqrt((m * m).sum(axis=1, keepdims=True))
    q, all_ = unit(x[::200].astype(float)), unit(x.astype(float))
    kth = np.sort(q @ all_.T, axis=1)[:, -11]
    share = VC.share_skipped(q, kth, centres[24], np.array([c.cell for c in cells]), np.array([c.radius for c in cells]))
    assert share > 0.8


@pytest.mark.parametrize("held", [1 << 20, 64])
def test_a_task_sends_the_nearest_of_all_its_blocks(monkeypatch, held):
    """However many blocks a task meets, it sends about k rows a query if it may hold them; sent early, none is lost."""
    monkeypatch.setattr(retrieval, "HELD_ROWS", held)
    monkeypatch.setattr(retrieval, "QUERY_ROWS", 3)
    rng = np.random.default_rng(3)
    unit = lambda n: (x := rng.standard_normal((n, 8))) / np.sqrt((x * x).sum(axis=1, keepdims=True))
    q, v = unit(10), unit(600)
    rows = [{"qids": np.arange(1000, 1010).tobytes(), "qunits": q.tobytes(), "ids": np.arange(i, i + 30).tobytes(), "units": v[i : i + 30].tobytes(), "size": 8} for i in range(0, 600, 30)]
    out = [r for b in retrieval._nearest(5, 6)(iter([pa.RecordBatch.from_pylist(rows)])) for r in b.to_pylist()]
    for i, scores in enumerate(q @ v.T):
        best = set(np.argsort(-scores)[:5].tolist())
        assert best <= {r["vec_id"] for r in out if r["query_id"] == 1000 + i}
    assert len(out) < 60 or held == 64
