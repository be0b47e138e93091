"""Connected components as repeated DataFrame joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import discard, materialize


#: Rows of one file of a round's tables: few small files, and as many as there are rows for.
ROWS_A_FILE = 500_000


def star_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star forest with the components of the edges ``a``, ``b``: middles (the smallest ids) and leaves."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(ids))
    return ids[label[keep]], ids[keep]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace a task's edges by star forests with the same components, holding about ROWS_A_FILE edges at a time."""
    held_a, held_b, held = [], [], 0

    def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        held_a.append(batch.column(0).to_numpy(zero_copy_only=False))
        held_b.append(batch.column(1).to_numpy(zero_copy_only=False))
        held += batch.num_rows
        if held >= 2 * ROWS_A_FILE:
            a, b = star_forest(np.concatenate(held_a), np.concatenate(held_b))
            if len(a) > ROWS_A_FILE:  # a forest that stays large goes on as it is
                yield out(a, b)
                a, b = a[:0], b[:0]
            held_a, held_b, held = [a], [b], len(a)
    if held:
        yield out(*star_forest(np.concatenate(held_a), np.concatenate(held_b)))


def _settled(edges: DataFrame) -> bool:
    """Whether edges are star forests: no middle is a leaf and no leaf has two middles."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("middle"), F.lit(0).alias("leaf"))
    ends = ends.union(edges.select("b", F.lit(0), F.lit(1)))
    per = ends.groupBy("x").agg(F.max("middle").alias("middle"), F.sum("leaf").alias("leaf"))
    return per.where("leaf > 1 or (leaf > 0 and middle > 0)").isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; the component is its smallest node.

    Edges are first reduced to star forests task by task, so a dense group of m nodes sends on about m edges per task
    and not m squared. Rounds follow until every component is one star: forests of what fits a task, then large and
    small stars across tasks, each written to the shared folder. Every neighbourhood is reduced by a ``min`` aggregate with map-side combine and joined back from
    a written table, so no task gathers one node's neighbours and a hub's edges can be split. Loops and nulls are
    ignored; an empty input gives an empty result.
    """
    pairs = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    pairs = pairs.where(F.col("a") != F.col("b"))
    cur = materialize(pairs.mapInArrow(_forest, "a long, b long").distinct(), "edges")
    files = 1 + cur.count() // ROWS_A_FILE  # a round's tables have at most about as many rows
    for _ in range(max_rounds):
        if _settled(cur):
            break
        merged = materialize(cur.coalesce(files).mapInArrow(_forest, "a long, b long").distinct().coalesce(files), "edges")
        discard(cur)
        cur = merged
        if files == 1 or _settled(cur):  # one task has seen all edges
            break
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).union(cur.select(F.col("b"), F.col("a")))
        # written first: a join of two plain exchanges is one whose skewed side can be split; and merged, as files that
        # are small by compression would be sent through the driver whole
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).coalesce(files), "low")
        large = both.where("v > u").join(low.hint("merge"), "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        # small star: every node and its lower neighbours point at the lowest of these
        down = materialize(large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).coalesce(files), "down")
        lowest = materialize(down.groupBy("u").agg(F.min("v").alias("m")).coalesce(files), "low")
        small = down.join(lowest.hint("merge"), "u").select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b"))
        new = materialize(small.where("a <> b").distinct().coalesce(files), "edges")
        discard(cur, low, down, lowest)
        cur = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = cur.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return roots.union(cur.select(F.col("b").alias("node"), F.col("a").alias("component")))
