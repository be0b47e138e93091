"""Embedding near-duplicates by sorted projection passes.

Each pass hashes vectors by random hyperplanes and sorts them lexicographically by the concatenated bits, within their
label; every vector is compared with the next ``window`` in that order, in blocks that overlap by a window. Pairs of
cosine at least the threshold are links, and links of all passes are united.

A pass finds a pair at the threshold with probability p^b: a hyperplane leaves such a pair on one side with
probability p, and a window of w among n vectors needs about b = log2(n / w) equal bits. Every label has as many passes
as :data:`RECALL` asks for at its own n and p. Vectors are hashed relative to the centre of their label, the mean of
all its different vectors, since hyperplanes through the origin do not part vectors that all point one way; p is that
of centred pairs, so dense labels have more passes.

What a pass moves are vectors in a byte a component, with the exact length of what rounding took off. That bounds
every cosine: pairs that the bound settles are links or none, and the few between are decided on the vectors
themselves. Passes run :data:`GROUP` at a time, so shuffled data is a few times the input at any number of passes.

Windows are bounded, so a dense group shows only some of its links to them, and a block sends on a star forest of the
links it found. Links make components, and a component's link counts are then completed: members are laid out in cells
of ``CELL`` vectors, each cell is compared with itself, and two cells of one component by their centres and radii
first, which settles most pairs of cells at once (all linked, or none); only the others are compared vector by vector.
A component's links are therefore all counted and no pair list of a group is ever made. Equal vectors are collapsed
first and counted by their number.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without a label, link
with nothing and are their own component; vectors of different lengths never link; repeated rows count as copies; rows
that share an id are one node; a row without an id has no component and is kept; an empty table gives an empty result; other columns are not read. Cosines are computed
in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.graph import connected_components, star_forest
from millrace.operators.numbering import number_rows
from millrace.session import bounded_batches, discard, materialize

COSINE = 0.93
#: Probability with which a pair at the threshold is to be found by some pass.
RECALL = 0.99
LEAST_PASSES = 8
BITS = 32
WINDOW_SIZE = 48
BLOCK = 2048
#: Passes that run together.
GROUP = 8
CELL = 512
#: A label needs a few vectors to be centred. Components are summed in whole units, so that any order gives the same sum.
LEAST_CENTRED, UNIT = 8, 1 << 30
#: Bytes of sums that a task holds before it sends them on.
SUMS = 4 << 20
SEED = 7


def _rows_of(batch: pa.RecordBatch | pa.Table, name: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of equal length and their vectors as a matrix; vectors are bytes of 4 or 8 byte floats, led by that number."""
    held = batch.column(name).to_pylist()
    sizes = np.array([len(x) * 2 + (x[0] == 8) for x in held], dtype=np.int64)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        kind = "<f8" if held[rows[0]][0] == 8 else "<f4"
        flat = np.frombuffer(b"".join([held[i][1:] for i in rows]), dtype=kind)
        yield rows, flat.reshape(len(rows), -1)


def _units(x: np.ndarray) -> np.ndarray:
    """Rows at length 1, in double precision."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _tiny(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors in a byte a component: scale, length of the rounding error, components."""
    for batch in batches:
        out: list[bytes] = [b""] * batch.num_rows
        for rows, x in _rows_of(batch, "raw"):
            x = _units(x)
            scale = np.abs(x).max(axis=1, keepdims=True) / 127
            q = np.rint(x / scale).astype(np.int8)
            error = x - q * scale
            head = np.concatenate([scale, np.sqrt((error * error).sum(axis=1, keepdims=True))], axis=1)
            for i, h, v in zip(rows.tolist(), head, q, strict=True):
                out[i] = h.tobytes() + v.tobytes()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "tiny"])


def _from_tiny(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rounded unit vectors and the lengths of their errors."""
    flat = np.frombuffer(b"".join(held), dtype=np.uint8).reshape(len(held), -1)
    head = np.ascontiguousarray(flat[:, :16]).view(np.float64)
    return flat[:, 16:].view(np.int8) * head[:, :1], head[:, 1]


def _usable(kind: str):
    """Ids, labels and vectors as bytes; rows that link with nothing are left out."""
    head = bytes([np.dtype(kind).itemsize])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, lists = batch.columns
            begin = lists.offsets.to_numpy()
            size = np.diff(begin)
            flat = lists.values.to_numpy(zero_copy_only=False).astype(kind)  # null components become NaN
            ok = (lists.is_valid().to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(zero_copy_only=False) & labels.is_valid().to_numpy(zero_copy_only=False)
            keep, raw = [], []
            for n in np.unique(size[ok & (size > 0)]):
                rows = np.flatnonzero(ok & (size == n))
                x = flat[begin[rows][:, None] + np.arange(n)] + 0  # -0.0 becomes 0.0
                good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                keep += rows[good].tolist()
                raw += [head + r.tobytes() for r in x[good]]
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(rows), labels.take(rows), pa.array(raw, pa.binary())], names=["id", "label", "raw"])

    return read


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers and sums of the unit vectors of a task, by label: one row a label where labels are few."""
    held: dict[tuple[int, int], tuple[int, np.ndarray]] = {}

    def out() -> pa.RecordBatch:
        keys, values = list(held), list(held.values())
        columns = [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int32()), pa.array([n for n, _ in values], pa.int64()), pa.array([x.tobytes() for _, x in values], pa.binary())]
        held.clear()
        return pa.RecordBatch.from_arrays(columns, names=["label", "size", "n", "total"])

    for batch in batches:
        labels, sizes = batch.column("label").to_numpy(), batch.column("size").to_numpy()
        for rows, x in _rows_of(batch, "raw"):
            rows, x = rows[order := np.argsort(labels[rows], kind="stable")], np.rint(_units(x) * UNIT).astype(np.int64)[order]
            of, first, count = np.unique(labels[rows], return_index=True, return_counts=True)
            size = int(sizes[rows[0]])
            for label, n, total in zip(of.tolist(), count.tolist(), np.add.reduceat(x, first, axis=0), strict=True):
                before, sums = held.get((label, size), (0, 0))
                held[label, size] = before + n, sums + total
        if sum(x.nbytes for _, x in held.values()) > SUMS:
            yield out()
    yield out()


def _centre(table: pa.Table) -> pa.Table:
    """The number of a label's vectors and their mean unit vector."""
    n = int(table.column("n").to_numpy().sum())
    total = np.frombuffer(b"".join(table.column("total").to_pylist()), dtype=np.int64).reshape(table.num_rows, -1).sum(axis=0)
    mean = total / UNIT / n if n >= LEAST_CENTRED else np.zeros(len(total))
    return pa.table({"label": table.column("label")[:1], "size": table.column("size")[:1], "n": pa.array([n], pa.int64()), "centre": pa.array([mean.tobytes()], pa.binary()), "shared": [float(mean @ mean)]})


def passes_needed(n: Column, shared: Column, window: int, recall: float = RECALL) -> Column:
    """Passes that find a pair at the threshold among ``n`` vectors whose mean cosine is ``shared``."""
    centred = (F.lit(COSINE) - shared) / (1 - shared)
    side = F.when(shared < COSINE, 1 - F.acos(centred) / np.pi).otherwise(1.0)
    hit = F.pow(side, F.greatest(F.lit(0.0), F.log2(n / window)))
    need = F.when(hit < 1, F.ceil(F.log(F.lit(1 - recall)) / F.log(1 - hit))).otherwise(1)
    return F.when(n <= window + 1, 1).otherwise(F.greatest(F.lit(LEAST_PASSES), need)).cast("int")


def _codes(seed: int):
    """A row for each pass of a vector: its sort key, big-endian bits of its hyperplane sides."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = (np.uint64(1) << np.arange(BITS, dtype=np.uint64)[::-1]).astype(np.float64)
        for batch in batches:
            node, label, size, passes = (batch.column(c).to_numpy() for c in ("node", "label", "size", "passes"))
            centres = batch.column("centre").to_pylist()
            for rows, x in _rows_of(batch, "raw"):
                x = _units(x) - np.frombuffer(b"".join([centres[i] for i in rows]), dtype=np.float64).reshape(len(rows), -1)
                for p in range(int(passes[rows].max(initial=0))):
                    some = passes[rows] > p
                    at = rows[some]
                    planes = np.random.default_rng([seed, x.shape[1], p]).standard_normal((x.shape[1], BITS))
                    keys = ((x[some] @ planes > 0) @ weights).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), p, np.int32)), pa.array(label[at]), pa.array(size[at]), pa.array(keys), pa.array(node[at])], names=["pass", "label", "size", "key", "node"]
                    )

    return code


def _windows(window: int):
    def compare(table: pa.Table) -> pa.Table:
        """Links within a window in the block's order as a star forest (``sure``), and pairs that rounding leaves open;
        a pair belongs to its first vector's home, and what the forest joins already is left open no more."""
        table = table.sort_by("rank")
        node, home, tiny = table.column("node").to_numpy(), table.column("home").to_numpy(), table.column("tiny").to_pylist()
        order = np.stack([table.column(c).to_numpy() for c in ("pass", "label", "size")])
        cuts = np.concatenate([[0], np.flatnonzero((order[:, 1:] != order[:, :-1]).any(axis=0)) + 1, [len(node)]])
        found, open_ = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi - lo < 2:
                continue
            x, error = _from_tiny(tiny[lo:hi])
            for k in range(1, min(window, len(x) - 1) + 1):
                near = np.einsum("ij,ij->i", x[:-k], x[k:])
                a, b = error[:-k], error[k:]
                slack = a + b + 3 * a * b + 1e-12
                own = home[lo : hi - k]
                sure = lo + np.flatnonzero((near - slack >= COSINE) & own)
                maybe = lo + np.flatnonzero((near + slack >= COSINE) & (near - slack < COSINE) & own)
                found.append(np.stack([node[sure], node[sure + k]], axis=1))
                open_.append(np.stack([node[maybe], node[maybe + k]], axis=1))
        pairs, rest = np.concatenate(found), np.concatenate(open_)
        middle, leaf = star_forest(pairs[:, 0], pairs[:, 1])
        if len(rest):
            of = dict(zip(leaf.tolist(), middle.tolist(), strict=True))
            rest = np.array([p for p in np.unique(rest, axis=0).tolist() if of.get(p[0], p[0]) != of.get(p[1], p[1])], dtype=np.int64).reshape(-1, 2)
        sure = np.arange(len(middle) + len(rest)) < len(middle)
        return pa.table({"a": np.concatenate([middle, rest[:, 0]]), "b": np.concatenate([leaf, rest[:, 1]]), "sure": sure})

    return compare


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose vectors themselves are links."""
    for batch in batches:
        x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
        keep = []
        for a, b in zip(x, y, strict=True):
            u, v = (_units(np.frombuffer(r[1:], dtype="<f8" if r[0] == 8 else "<f4")[None])[0] for r in (a, b))
            keep.append(bool(u @ v >= COSINE))
        some = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(some), batch.column("b").filter(some)], names=["a", "b"])


def _found(ranked: DataFrame, unique: DataFrame, window: int) -> DataFrame:
    """``(a, b)``: links of some passes, enough of them to join what they join."""
    home = ranked.withColumn("block", F.floor(F.col("rank") / BLOCK)).withColumn("home", F.lit(True))
    # the first vectors of a block end the windows of the block before
    lent = home.where((F.col("rank") % BLOCK < window) & (F.col("block") > 0)).withColumn("block", F.col("block") - 1).withColumn("home", F.lit(False))
    blocks = home.union(lent).join(unique.select("node", "tiny"), "node")
    pairs = materialize(blocks.groupBy("block").applyInArrow(_windows(window), "a long, b long, sure boolean").distinct(), "found")
    open_ = pairs.where("not sure").select("a", "b")
    open_ = open_.join(unique.select(F.col("node").alias("a"), F.col("raw").alias("x")), "a").join(unique.select(F.col("node").alias("b"), F.col("raw").alias("y")), "b")
    links = materialize(pairs.where("sure").select("a", "b").union(open_.mapInArrow(_decide, "a long, b long")), "links")
    discard(pairs)
    return links


def _within(table: pa.Table) -> pa.Table:
    """Links inside one cell: of each vector, the copies that it links with, its own included."""
    node, component, copies = (table.column(c).to_numpy() for c in ("node", "component", "copies"))
    count = np.zeros(len(node), dtype=np.int64)
    for rows, x in _rows_of(table, "raw"):
        x = _units(x)
        near = (x @ x.T >= COSINE) & (component[rows][:, None] == component[rows])
        near[np.arange(len(rows)), np.arange(len(rows))] = True
        count[rows] = near @ copies[rows]
    return pa.table({"node": node, "n": count})


def _summary(table: pa.Table) -> pa.Table:
    """Of a component's part in a cell: its direction, the largest angle to that, and its copies."""
    _, x = next(_rows_of(table, "raw"))
    x = _units(x)
    mean = x.mean(axis=0)
    length = np.sqrt(mean @ mean)
    mean = mean / length if length > 0 else x[0]
    radius = float(np.arccos(np.clip((x @ mean).min(), -1, 1)))
    return pa.table({"component": table.column("component")[:1], "size": table.column("size")[:1], "cell": table.column("cell")[:1], "centre": pa.array([mean.tobytes()], pa.binary()), "radius": [radius], "held": [int(table.column("copies").to_numpy().sum())]})


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of cells: ``all`` true if every vector of one links with every vector of the other; none are left out."""
    edge, margin = np.arccos(COSINE), 1e-6
    for batch in batches:
        x, y = (batch.column(c).to_pylist() for c in ("x", "y"))
        apart = np.array([np.arccos(np.clip(np.frombuffer(a) @ np.frombuffer(b), -1, 1)) for a, b in zip(x, y, strict=True)], dtype=np.float64)
        reach = batch.column("rx").to_numpy() + batch.column("ry").to_numpy()
        every, some = apart + reach < edge - margin, apart - reach < edge + margin
        keep = pa.array(some)
        yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(keep) for c in ("component", "size", "i", "j", "hx", "hy")), pa.array(every[some])], names=["component", "size", "i", "j", "hx", "hy", "every"])


def _across(table: pa.Table) -> pa.Table:
    """Links of two cells of one component: of each vector, the copies that it links with in the other cell."""
    side, node, copies = (table.column(c).to_numpy() for c in ("side", "node", "copies"))
    _, x = next(_rows_of(table, "raw"))
    x = _units(x)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    near = x[left] @ x[right].T >= COSINE
    return pa.table({"node": np.concatenate([node[left], node[right]]), "n": np.concatenate([near @ copies[right], near.T @ copies[left]]).astype(np.int64)})


def _link_counts(parts: DataFrame, unique: DataFrame, first_codes: DataFrame) -> DataFrame:
    """``(node, n)``: copies that every vector of a component links with, its own included.

    Cells are runs of one order by component and first projection, whatever the components' sizes: a small component
    shares a cell with others, a large one has many.
    """
    members = parts.join(unique.select("node", "raw", "copies", "size"), "node").join(first_codes, "node", "left")
    placed = number_rows(members, ["component", "key", "node"], "at")
    members = placed.withColumn("cell", F.floor(F.col("at") / CELL)).select("component", "size", "node", "raw", "copies", "cell")
    members = materialize(members, "cells")
    discard(placed)
    whole = ["component", "size"]  # ids that repeat may join vectors of different lengths
    within = members.groupBy("cell").applyInArrow(_within, "node long, n long")
    spread = members.groupBy(*whole).agg(F.min("cell").alias("lo"), F.max("cell").alias("hi")).where("lo < hi").select(*whole)
    parted = members.join(spread, whole, "left_semi")
    cells = materialize(parted.groupBy(*whole, "cell").applyInArrow(_summary, "component long, size int, cell long, centre binary, radius double, held long"), "summaries")
    x = cells.select(*whole, F.col("cell").alias("i"), F.col("centre").alias("x"), F.col("radius").alias("rx"), F.col("held").alias("hx"))
    y = cells.select(*whole, F.col("cell").alias("j"), F.col("centre").alias("y"), F.col("radius").alias("ry"), F.col("held").alias("hy"))
    pairs = x.join(y, whole).where("i < j").mapInArrow(_settle, "component long, size int, i long, j long, hx long, hy long, every boolean")
    pairs = materialize(pairs, "cell-pairs")
    every = pairs.where("every")
    every = every.select(*whole, F.col("i").alias("cell"), F.col("hy").alias("n")).union(every.select(*whole, "j", "hx")).groupBy(*whole, "cell").agg(F.sum("n").alias("n"))
    at_once = members.join(every, [*whole, "cell"]).select("node", "n")
    open_ = pairs.where("not every").select(*whole, "i", "j")
    left = members.join(open_.withColumn("cell", F.col("i")), [*whole, "cell"]).withColumn("side", F.lit(0))
    right = members.join(open_.withColumn("cell", F.col("j")), [*whole, "cell"]).withColumn("side", F.lit(1))
    across = left.union(right).select(*whole, "i", "j", "side", "node", "raw", "copies").groupBy(*whole, "i", "j").applyInArrow(_across, "node long, n long")
    counted = materialize(within.union(at_once).union(across).groupBy("node").agg(F.sum("n").alias("n")), "counts")
    discard(members, cells, pairs)
    return counted


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", window: int = WINDOW_SIZE, seed: int = SEED, recall: float = RECALL) -> DataFrame:
    """``(id, n_links, component_id, kept)`` for every row of ``vectors``."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    element = vectors.schema[vector_col].dataType.elementType
    narrow = isinstance(element, T.FloatType)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<float>" if narrow else "array<double>").alias("v"))
    usable = materialize(rows.mapInArrow(_usable("<f4" if narrow else "<f8"), "id long, label long, raw binary"), "usable")
    unique = usable.groupBy("label", "raw").agg(F.min("id").alias("node"), F.count("*").alias("copies")).withColumn("size", F.octet_length("raw"))
    unique = materialize(unique.mapInArrow(_tiny, "label long, raw binary, node long, copies long, size int, tiny binary"), "vectors")

    sums = unique.select("label", "size", "raw").mapInArrow(_sums, "label long, size int, n long, total binary")
    groups = sums.groupBy("label", "size").applyInArrow(_centre, "label long, size int, n long, centre binary, shared double")
    groups = materialize(groups.select("label", "size", "centre", passes_needed(F.col("n"), F.col("shared"), window, recall).alias("passes")), "groups")

    codes = unique.select("node", "label", "size", "raw").join(groups, ["label", "size"])
    codes = materialize(codes.mapInArrow(_codes(seed), "pass int, label long, size int, key long, node long"), "codes")
    passes = groups.agg(F.max("passes")).first()[0] or 0
    found = []
    for first in range(0, passes, GROUP):
        some = codes.where((F.col("pass") >= first) & (F.col("pass") < first + GROUP))
        # no task holds a label or a dense group: rows are dealt by ranges of the whole order, ids included
        ranked = number_rows(some, ["pass", "label", "size", "key", "node"], "rank").drop("key")
        found.append(_found(ranked, unique, window))
        discard(ranked)
    links = reduce(DataFrame.union, found).distinct() if found else spark.createDataFrame([], "a long, b long")
    parts = materialize(connected_components(links), "parts")
    counted = _link_counts(parts, unique, codes.where("pass = 0").groupBy("node").agg(F.min("key").alias("key")))

    linked = unique.join(counted, "node", "left").join(parts, "node", "left")
    linked = linked.select("label", "raw", F.col("node"), (F.coalesce("n", "copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    named = usable.join(linked, ["label", "raw"]).select("id", "n_links", "component_id")
    # rows that share an id take the largest count and the smallest component
    named = named.groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = rows.select("id").join(named, "id", "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    out = materialize(out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id"))), "classes")
    discard(usable, unique, groups, codes, *found, parts, counted)
    return out


def op2_near_vectors(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of :func:`near_vectors` over all ``embeddings``."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
