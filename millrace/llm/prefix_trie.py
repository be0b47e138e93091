"""The prefix trie of conversations, built as a Patricia tree over sorted sequences.

Every conversation becomes a sequence of turns: a 16-byte hash and the words of each turn. Distinct sequences are sorted
and cut in ranges; a task walks its ranges in order with a stack and makes points only where sequences branch, end or
are leaves, joined by compressed edges whose totals (members, leaves, saved words) are added up as points close. What
ranges share, prefixes of the sequences beside a cut, is no task's own: each range sends what hangs below such a prefix
as one row, and the same walk over those rows builds the top of the tree. At last each edge is expanded: all nodes
within it have its members, and their saved words are suffix sums along the edge.

What grows with the data is spread over tasks: the top has rows by ranges and shared depth, not by conversations.
Equal sequences, however many, are one; the ids of their members are sorted in ranges and joined in pieces before one
task streams a node's pieces through SHA-256.

Defined cases: a null role or text is empty; a null turn comes first; rows with equal turns are ordered by the hash of
role and text; repeated rows are turns; rows without a conv_id belong to no conversation and are left out; ``%`` keeps
the sign of the conversation id; an empty table has no node; other columns are not read. A conversation's hashes and
counts are one row (20 bytes a turn), its texts are not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import bounded_batches, discard, materialize

WORD = "[^\\x20\\x09-\\x0D]+"
HASH = 16
#: Conversations of a block share the head of the first one.
BLOCK, MOST_HEAD = 20, 4
EMPTY = hashlib.sha256(b"").hexdigest()
PIECE_CHARS = 1 << 20
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: kind 0: an edge; 1: an edge below a shared point; 2: what hangs below a shared point. ref: that point's sequence.
EDGE = "kind int, conv_id long, above long, n long, children long, leaves long, saved long, ends string, words binary, parent_id long, ref binary"
_EDGE = pa.schema(
    [(n, {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in EDGE.split(", "))]
)


# --- sequences ---


def head_size(conv_id: Column) -> Column:
    """Turns that a conversation takes from the first one of its block."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % MOST_HEAD).cast("int")


def sequences(rows: DataFrame) -> DataFrame:
    """``(conv_id, hashes, words)`` of ``rows(conv_id, turn, role, text)``: hashes as 32 hexadecimal digits a turn."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = rows.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"),
        F.struct(
            F.col("turn"),
            F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * HASH).alias("h"),
            F.regexp_count(text, F.lit(WORD)).alias("w"),
        ).alias("t"),
    )
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return grouped.select("conv_id", F.col("t.h").alias("hashes"), F.col("t.w").alias("words"))


def rebuild(convs: DataFrame) -> DataFrame:
    """``(conv_id, e, key, words)``: the head of the block's first conversation, then the own turns after as many."""
    heads = convs.where(F.col("conv_id") % BLOCK == 0).select(
        F.col("conv_id").alias("base"), F.slice("hashes", 1, MOST_HEAD - 1).alias("head"), F.slice("words", 1, MOST_HEAD - 1).alias("head_words")
    )
    own = convs.withColumn("h", head_size(F.col("conv_id"))).withColumn("base", F.col("conv_id") - F.col("conv_id") % BLOCK)
    joined = own.join(heads, "base", "left")

    def both(head: str, tail: str, kind: str) -> Column:
        first = F.slice(F.coalesce(F.col(head), F.array().cast(kind)), F.lit(1), F.col("h"))
        return F.concat(first, F.slice(F.col(tail), F.col("h") + 1, F.greatest(F.size(tail) - F.col("h"), F.lit(0))))

    key = F.unhex(F.array_join(both("head", "hashes", "array<string>"), ""))
    return joined.select("conv_id", F.sha2(key, 256).alias("e"), key.alias("key"), both("head_words", "words", "array<int>").alias("words"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joined ids of runs of equal sequences in rows sorted by sequence and id."""
    rows: list[tuple] = []
    e, ids, held, chars = None, [], 0, 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({k: [r[i] for r in rows] for i, k in enumerate(("e", "first", "n", "ids"))})

    for b in batches:
        for name, conv_id in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if ids and (name != e or chars > PIECE_CHARS):
                rows.append((e, int(ids[0]), len(ids), ",".join(ids)))
                held += chars
                ids, chars = [], 0
                if held > PIECE_CHARS or len(rows) > 8192:
                    yield batch()
                    rows, held = [], 0
            e = name
            ids.append(str(conv_id))
            chars += len(ids[-1]) + 1
    if ids:
        rows.append((e, int(ids[0]), len(ids), ",".join(ids)))
    if rows:
        yield batch()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a sequence of pieces sorted by sequence and first id; a piece is forgotten once it is hashed."""
    e, first, n, digest = None, None, 0, None
    for b in batches:
        rows = []
        for name, at, count, ids in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if digest is None or name != e:
                if digest is not None:
                    rows.append((e, first, n, digest.hexdigest()))
                e, first, n, digest = name, at, 0, hashlib.sha256()
            else:
                digest.update(b",")
            n += count
            digest.update(ids.encode())
        if rows:
            yield pa.RecordBatch.from_pydict({k: [r[i] for r in rows] for i, k in enumerate(("e", "min_id", "n", "ends"))})
    if digest is not None:
        yield pa.RecordBatch.from_pydict({"e": [e], "min_id": [first], "n": [n], "ends": [digest.hexdigest()]})


def members(rebuilt: DataFrame) -> DataFrame:
    """``(e, min_id, n, ends)`` of each distinct sequence: its smallest member, their count and the hash of all ids."""
    sort = rebuilt.select("e", "conv_id").repartitionByRange("e", "conv_id").sortWithinPartitions("e", "conv_id")
    pieces = sort.mapInArrow(_pieces, "e string, first long, n long, ids string")
    return pieces.repartition("e").sortWithinPartitions("e", "first").mapInArrow(_digests, "e string, min_id long, n long, ends string")


# --- the walk ---


def shared_turns(a: bytes, b: bytes, most: int | None = None) -> int:
    """Leading turns that two sequences have in common, ``most`` at most."""
    n = min(len(a), len(b)) // HASH
    n = n if most is None else min(n, most)
    if n <= 0 or a[: n * HASH] == b[: n * HASH]:
        return max(n, 0)
    low, high = 0, n  # the first low turns are equal, the first high ones are not
    while high - low > 1:
        middle = (low + high) // 2
        if a[low * HASH : middle * HASH] == b[low * HASH : middle * HASH]:
            low = middle
        else:
            high = middle
    return low


class _Point:
    """A branch, end or leaf point whose subtree is being walked."""

    __slots__ = ("depth", "key", "words", "shared", "conv_id", "n", "leaves", "saved", "children", "ends", "waiting")

    def __init__(self, depth: int, key: bytes, words: np.ndarray, shared: bool):
        self.depth, self.key, self.words, self.shared = depth, key, words, shared
        self.conv_id, self.n, self.leaves, self.saved, self.children, self.ends = None, 0, 0, 0, 0, None
        self.waiting: list[list] = []  # edges below, until the smallest member is known

    def take(self, conv_id: int | None, n: int, leaves: int, saved: int, children: int) -> None:
        if conv_id is not None and (self.conv_id is None or conv_id < self.conv_id):
            self.conv_id = conv_id
        self.n += n
        self.leaves += leaves
        self.saved += saved
        self.children += children


class Walk:
    """Builds the compressed tree of sequences given in order; ``put`` gets its rows of :data:`EDGE`.

    ``shared`` turns of a sequence are those that another range may have too. Points there keep only what hangs
    directly below them and send it on.
    """

    def __init__(self, put: Callable[[list], None], top: bool):
        self.put, self.top = put, top
        self.stack = [_Point(0, b"", np.zeros(0, np.int32), not top)]
        self.before, self.shared = b"", 0

    def _row(self, kind: int, p: _Point, above: int, words: np.ndarray, ref: bytes | None) -> list:
        return [kind, p.conv_id, above, p.n, p.children, p.leaves, p.saved, p.ends, words.astype("<i4").tobytes(), None, ref]

    def _settle(self, p: _Point) -> None:
        for row in p.waiting:
            row[9] = p.conv_id
            self.put(row)
        p.waiting = []

    def _send(self, p: _Point) -> None:
        if p.n or p.children:
            self.put(self._row(2, p, 0, p.words[: p.depth], p.key[: p.depth * HASH]))

    def _attach(self, p: _Point, parent: _Point) -> None:
        if p.shared:
            self._send(p)
            return
        if not p.children:
            p.leaves = 1
        words = p.words[parent.depth : p.depth]
        row = self._row(1 if parent.shared else 0, p, parent.depth, words, parent.key[: parent.depth * HASH] if parent.shared else None)
        if self.top:
            row[10] = p.key[: p.depth * HASH]  # edges of ranges look their parents up by it
        self._settle(p)
        parent.take(p.conv_id, p.n, p.leaves, p.saved + (p.n - 1) * int(words.sum(dtype=np.int64)), 1)
        if parent.shared:
            self.put(row)
        else:
            parent.waiting.append(row)

    def _close(self, depth: int) -> None:
        while self.stack[-1].depth > depth:
            p = self.stack.pop()
            if self.stack[-1].depth < depth:
                self.stack.append(_Point(depth, p.key, p.words, not self.top and depth <= self.shared))
            self._attach(p, self.stack[-1])

    def add(self, key: bytes, words: np.ndarray, shared: int, conv_id: int | None, n: int, ends: str | None, leaves: int = 0, saved: int = 0, children: int = 0) -> None:
        depth = shared_turns(self.before, key)
        self._close(depth)
        size = len(key) // HASH
        words = words.copy()  # not a view of a whole batch
        if not self.top and self.stack[-1].depth < shared < size:
            self.stack.append(_Point(shared, key, words, True))
        if self.stack[-1].depth < size:
            self.stack.append(_Point(size, key, words, not self.top and size <= shared))
        p = self.stack[-1]
        p.take(conv_id, n, leaves, saved, children)
        p.ends = p.ends or ends
        self.before, self.shared = key, shared

    def end(self) -> None:
        self._close(0)
        root = self.stack[0]
        if not self.top:
            self._send(root)
        elif root.n:
            if not root.children:
                root.leaves = 1
            row = self._row(0, root, -1, np.zeros(1, np.int32), b"")
            self._settle(root)
            self.put(row)


class _Rows:
    """Rows of :data:`EDGE` as batches of bounded size."""

    def __init__(self):
        self.rows: list[list] = []
        self.held = 0

    def put(self, row: list) -> None:
        self.rows.append(row)
        self.held += 100 + len(row[8]) + len(row[10] or b"")

    def full(self) -> bool:
        return self.held > 1 << 20

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in self.rows], f.type) for i, f in enumerate(_EDGE)], schema=_EDGE)
        self.rows, self.held = [], 0
        return out


def _words(column: pa.Array) -> Iterator[np.ndarray]:
    flat, at = column.flatten().to_numpy(zero_copy_only=False).astype(np.int32), column.offsets.to_numpy()
    at = at - at[0]
    return (flat[at[i] : at[i + 1]] for i in range(len(column)))


def _ranges(edges_of: dict[int, tuple[bytes, bytes]]):
    """Walks ranges; ``edges_of`` a range: what its first sequence shares with the range before, its last with the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, walk, part = _Rows(), None, None
        for b in batches:
            parts, keys, n, ids, ends = (b.column(i).to_pylist() for i in (0, 1, 3, 4, 5))
            for i, words in enumerate(_words(b.column(2))):
                if walk is None or parts[i] != part:
                    if walk is not None:
                        walk.end()
                    part, walk = parts[i], Walk(rows.put, top=False)
                    left, right = edges_of[part]
                shared = max(shared_turns(keys[i], left), shared_turns(keys[i], right))
                walk.add(keys[i], words, shared, ids[i], n[i], ends[i])
                if rows.full():
                    yield rows.batch()
        if walk is not None:
            walk.end()
        if rows.rows:
            yield rows.batch()

    return run


def _top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = _Rows()
    walk = None
    for b in batches:
        keys, words, *rest = (b.column(i).to_pylist() for i in range(b.num_columns))
        for key, w, conv_id, n, ends, leaves, saved, children in zip(keys, words, *rest, strict=True):
            walk = walk or Walk(rows.put, top=True)
            walk.add(key, np.frombuffer(w, "<i4"), 0, conv_id, n, ends, leaves, saved, children)
            if rows.full():
                yield rows.batch()
    if walk is not None:
        walk.end()
    if rows.rows:
        yield rows.batch()


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All nodes of edges: those within one have its members, one child and suffix sums of saved words."""
    for b in batches:
        number = {n: b.column(n).to_numpy(zero_copy_only=False) for n in ("conv_id", "above", "n", "children", "leaves", "saved")}
        words = [np.frombuffer(w, "<i4") for w in b.column("words").to_pylist()]
        parents, ends = b.column("parent_id"), b.column("ends").fill_null(EMPTY).to_pylist()
        lo = 0
        while lo < b.num_rows:
            hi, total = lo, 0
            while hi < b.num_rows and (hi == lo or total + len(words[hi]) <= 1 << 16):
                total += len(words[hi])
                hi += 1
            size = np.array([len(w) for w in words[lo:hi]], np.int64)
            end = np.cumsum(size)
            begin, owner = end - size, np.repeat(np.arange(hi - lo), size)
            upto = np.concatenate([[0], np.cumsum(np.concatenate(words[lo:hi]), dtype=np.int64)])
            at = np.arange(total)
            first, last = at == begin[owner], at == end[owner] - 1
            part = {n: x[lo:hi][owner] for n, x in number.items()}
            parent = pa.array(part["conv_id"])
            parent = pc.if_else(pa.array(first), parents.slice(lo, hi - lo).take(pa.array(owner)), parent)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part["conv_id"]),
                    pa.array(part["above"] + 1 + at - begin[owner]),
                    parent,
                    pa.array(part["n"]),
                    pa.array(np.where(last, part["children"], 1)),
                    pa.array(part["leaves"]),
                    pa.array(part["saved"] + (part["n"] - 1) * (upto[end[owner]] - upto[at])),
                    pa.array([ends[lo + o] if x else EMPTY for o, x in zip(owner.tolist(), last.tolist(), strict=True)]),
                ],
                names=[x.split()[0] for x in NODE.split(", ")],
            )
            lo = hi


def prefix_trie(rows: DataFrame) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations ``rows(conv_id, turn, role, text)``; columns: :data:`NODE`.

    The driver gets the first and last sequence of every range, no more.
    """
    bounded_batches(rows.sparkSession)
    convs = materialize(sequences(rows), "turns")
    rebuilt = materialize(rebuild(convs), "rebuilt")
    distinct = rebuilt.groupBy("e").agg(F.first("key").alias("key"), F.first("words").alias("words"))
    seqs = distinct.join(members(rebuilt), "e").select("key", "words", "n", "min_id", "ends")
    seqs = materialize(seqs.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "sequences")
    bounds = sorted(seqs.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last")).collect())
    cuts = [b"", *(bytes(b.first)[: HASH * shared_turns(bytes(a.last), bytes(b.first))] for a, b in zip(bounds, bounds[1:], strict=False)), b""]
    edges_of = {b.part: (cuts[i], cuts[i + 1]) for i, b in enumerate(bounds)}
    ranges = seqs.select("part", "key", "words", "n", "min_id", "ends").repartition("part").sortWithinPartitions("part", "key")
    edges = materialize(ranges.mapInArrow(_ranges(edges_of), EDGE), "edges")
    shared = edges.where("kind = 2").groupBy(F.col("ref").alias("key"))
    shared = shared.agg(F.first("words"), F.min("conv_id"), F.sum("n"), F.max("ends"), F.sum("leaves"), F.sum("saved"), F.sum("children"))
    top = materialize(shared.repartition(1).sortWithinPartitions("key").mapInArrow(_top, EDGE), "top")
    discard(convs, rebuilt, seqs)
    # Spark sends the shared points to all tasks by their size, or deals a hot one's edges out
    points = top.select("ref", F.col("conv_id").alias("parent"))
    below = edges.where("kind = 1").join(points, "ref", "left").withColumn("parent_id", F.col("parent"))
    names = ["conv_id", "above", "n", "children", "leaves", "saved", "ends", "words", "parent_id"]
    every = edges.where("kind = 0").select(names).unionByName(below.select(names)).unionByName(top.select(names))
    return every.mapInArrow(_expand, NODE)


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The contract's nodes of all ``conversations``."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
