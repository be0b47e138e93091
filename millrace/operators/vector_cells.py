"""Exact top-k by cosine over stored vectors, with cells that bounds rule out.

Centres come from a bounded, documented sample; every vector belongs to the cell of its nearest centre. A block of a
cell knows its farthest vector, so by the triangle inequality no vector of it is nearer to a query than the query is to
the centre, less that radius. A first pass finds each query's k-th best score within its own cell; the second pass
multiplies a query with those blocks alone whose bound can reach it. The result is that of comparing everything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.retrieval import BLOCK, POOL, SENT_BYTES, Best, _blocks, best_of
from millrace.session import bounded_batches, materialize

#: Centres of a vector length, the rows in hash order that they are found on, and rounds of moving them.
CENTRES, SAMPLE_ROWS, ROUNDS = 64, 8192, 4
#: Vectors of a block of a cell.
BLOCK_ROWS = 1024
CELLS = "cell int, size int, radius double, ids binary, units binary"
#: What rounding may add to a distance on the unit sphere.
SLACK = 1e-6


def find_centres(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Unit centres by vector length, from at most :data:`SAMPLE_ROWS` vectors, by a few rounds of means."""
    sample = vectors.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS)
    held: dict[int, list[np.ndarray]] = {}
    for batch in _blocks(iter(sample.toArrow().to_batches())):
        for size, units in zip(batch.column("size").to_pylist(), batch.column("units").to_pylist(), strict=True):
            held.setdefault(size, []).append(np.frombuffer(units).reshape(-1, size))
    out = {}
    for size, parts in held.items():
        x = np.concatenate(parts)
        if not len(x):
            continue
        centres = x[np.linspace(0, len(x) - 1, min(CENTRES, len(x))).astype(int)].copy()
        for _ in range(ROUNDS):
            near = np.argmax(x @ centres.T, axis=1)
            for k in range(len(centres)):
                mean = x[near == k].sum(axis=0)
                length = np.sqrt(mean @ mean)
                if length > 0:
                    centres[k] = mean / length
        out[size] = centres
    return out


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def build_cells(vectors: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """``vectors(vec_id, v)`` as blocks of cells; a length without a centre is one cell that nothing rules out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            for ids, size, units in zip(*(b.column(c).to_pylist() for c in ("ids", "size", "units")), strict=True):
                ids, x = np.frombuffer(ids, np.int64), np.frombuffer(units).reshape(-1, size)
                if not len(ids):
                    continue
                known = centres.get(size)
                far = _apart(x, known) if known is not None else np.full((len(x), 1), 2.0)
                cell = np.argmin(far, axis=1)
                own = far[np.arange(len(x)), cell]
                order = np.lexsort((own, cell))  # near and far vectors of a cell are blocks of their own
                starts = np.flatnonzero(np.append(True, cell[order][1:] != cell[order][:-1]))
                for lo, hi in zip(starts, np.append(starts[1:], len(order)), strict=True):
                    for at in range(lo, hi, BLOCK_ROWS):
                        some = order[at : min(at + BLOCK_ROWS, hi)]
                        row = {"cell": int(cell[some[0]]) if known is not None else -1, "size": size, "radius": float(own[some].max()), "ids": ids[some].tobytes(), "units": x[some].tobytes()}
                        yield pa.RecordBatch.from_pylist([row], pa.schema([("cell", pa.int32()), ("size", pa.int32()), ("radius", pa.float64()), ("ids", pa.binary()), ("units", pa.binary())]))

    return materialize(vectors.select("vec_id", "v").mapInArrow(run, CELLS), "cells")


def _search(centres: dict[int, np.ndarray], k: int, digits: int, first: bool):
    margin = 2 * 10.0**-digits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k, margin)
        for batch in batches:
            names = ("qids", "qunits", "kth", "cell", "size", "radius", "ids", "units")
            for row in range(batch.num_rows):
                qids, qunits, kth, cell, size, radius, ids, units = (batch.column(c)[row].as_py() for c in names)
                qi, q, vi = np.frombuffer(qids, np.int64), np.frombuffer(qunits).reshape(-1, size), np.frombuffer(ids, np.int64)
                known = centres.get(size)
                if first:  # each query's own cell only
                    need = np.argmax(q @ known.T, axis=1) == cell if known is not None else np.ones(len(qi), bool)
                elif known is None:
                    need = np.ones(len(qi), bool)
                else:
                    nearest = np.maximum(_apart(q, known[cell][None, :])[:, 0] - radius - SLACK, 0)
                    need = 1 - nearest**2 / 2 >= np.frombuffer(kth) - margin
                if not need.any():
                    continue
                qi, v = qi[need], np.frombuffer(units).reshape(-1, size)
                for a, b, raw in best_of(qi, q[need], vi, v, k, margin):
                    yield from best.add(qi[a], vi[b], raw)
        yield from best.rest()

    return run


def _asked(queries: DataFrame) -> DataFrame:
    """Blocks of queries; ``kth`` is each query's score to beat."""
    return queries.select("query_id", "q").mapInArrow(_blocks, BLOCK).select(F.col("ids").alias("qids"), F.col("size").alias("qsize"), F.col("units").alias("qunits"))


def top_k_in_cells(queries: DataFrame, vectors: DataFrame, k: int = POOL, digits: int = 6) -> DataFrame:
    """As :func:`millrace.operators.retrieval.top_k`: the ``k`` nearest vectors of every query by cosine, ties by id.

    Queries are a stated set; they are sent to the blocks while they have :data:`SENT_BYTES` at most and dealt out
    beyond. The first pass gives a score a query: no more than the queries' number is joined back.
    """
    bounded_batches(queries.sparkSession)
    centres = find_centres(vectors)
    cells = build_cells(vectors, centres)
    asked = materialize(_asked(queries), "queries")
    sent = (asked.agg(F.sum(F.octet_length("qunits"))).first()[0] or 0) <= SENT_BYTES

    def search(asked: DataFrame, first: bool) -> DataFrame:
        pairs = cells.join(F.broadcast(asked) if sent else asked, cells.size == asked.qsize)
        return pairs.mapInArrow(_search(centres, k, digits, first), "query_id long, vec_id long, raw double")

    def ranked(found: DataFrame) -> DataFrame:
        scored = found.select("query_id", "vec_id", F.round("raw", digits).alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return scored.withColumn("rank", rank).where(F.col("rank") <= k)

    none = F.lit(b"").alias("kth")
    own = ranked(search(asked.select("*", none), True)).where(F.col("rank") == k).select("query_id", F.col("score").alias("kth_score"))

    def with_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for qids, qsize, qunits, known in zip(*(b.column(c).to_pylist() for c in ("qids", "qsize", "qunits", "known")), strict=True):
                scores = {x["query_id"]: x["kth_score"] for x in known or []}
                kth = np.array([scores.get(i, -2.0) for i in np.frombuffer(qids, np.int64).tolist()])
                yield pa.RecordBatch.from_pydict({"qids": [qids], "qsize": pa.array([qsize], pa.int32()), "qunits": [qunits], "kth": [kth.tobytes()]})

    # a score a query; a block of queries takes those of its own
    numbered = asked.withColumn("block", F.xxhash64("qids", "qsize"))
    ids = numbered.mapInArrow(_ids_of_blocks, "block long, query_id long")
    by_block = ids.join(own, "query_id").groupBy("block").agg(F.collect_list(F.struct("query_id", "kth_score")).alias("known"))
    ready = materialize(numbered.join(by_block, "block", "left").mapInArrow(with_scores, "qids binary, qsize int, qunits binary, kth binary"), "asked")
    return ranked(search(ready, False))


def _ids_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for block, qids in zip(b.column("block").to_pylist(), b.column("qids").to_pylist(), strict=True):
            ids = np.frombuffer(qids, np.int64)
            yield pa.RecordBatch.from_pydict({"block": pa.array([block] * len(ids), pa.int64()), "query_id": pa.array(ids)})


def share_skipped(queries: np.ndarray, kth: np.ndarray, centres: np.ndarray, cell: np.ndarray, radius: np.ndarray) -> float:
    """The share of pairs of a query and a block that the bound rules out."""
    nearest = np.maximum(_apart(queries, centres[cell]) - radius - SLACK, 0)
    return float((1 - nearest**2 / 2 < kth[:, None]).mean())
