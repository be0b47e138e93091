"""N-gram Jaccard join: exact similarity classes of texts on word shingles.

Sets are ordered by one global order of shingles, rare before frequent. Similar sets share a shingle in their
prefixes, so prefixes propose pairs; bounds that never lose a pair (sizes, positions, parity sketches) drop most of
them, and a trie of ordered sets decides the rest: a probe walks it once, sets that begin alike share their partial
overlap, and a subtree is left as soon as the remaining lengths cannot reach the threshold.

How it stays linear where many texts are alike:

* equal sets are collapsed first, by a 128-bit signature of the set, with map-side combine;
* frequent shingles are found by counting all of them (blobs of 32-bit remainders dealt by the leading bits) and come
  last in the order, so a passage that many texts share is in the prefix only of texts that consist of it;
* round 1 compares every set with one pivot of each shingle (linear in entries): the set whose prefix has the largest
  share of frequent shingles, as the text that a group's copies were made from has, and then the smallest id; round 2
  proposes only pairs that round 1 left in different components. All links inside a component are implied, so no class
  is expanded in pairs.

The order only speeds things up: results are exact for any order. What is broadcast is the list of frequent shingles
(``MAX_FREQUENT`` at most, the most frequent ones: an ordering hint) and a bit set of the candidates' ids, of
``MAX_ID_BITS`` at most. Beyond some ten million candidates that set is full, and a round shingles and deals texts that
are in no pair: at worst every text once a round, which is linear in the input; memory stays as it is. Buckets grow in
number with the texts and not in size.

Defined cases: null, empty and blank texts have an empty set and are linked with nothing; a text with fewer words than
a shingle has one shingle, its whole sequence; repeated rows are rows of one class; rows that share an id are one node;
a row without an id is linked with nothing and has no component; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.graph import connected_components
from millrace.llm.words import _M1, chunks, mix64, shingles, split_words
from millrace.session import bounded_batches, discard, materialize

#: Similarity in percent: 100 * intersection >= 80 * union.
PERCENT = 80
WORDS = 5
#: A shingle in at least this many texts may be listed as frequent; at most so many are listed.
FREQUENT = 32
MAX_FREQUENT = 1 << 18
#: Bits of the set of ids whose shingles are fetched for the trie, 16 a candidate; false positives only cost time.
LEAST_ID_BITS, MAX_ID_BITS = 1 << 18, 1 << 26
#: Bits of the sketches that the join of round 2 tests.
SMALL_BITS = 512
#: Sets in one trie.
TRIE_SETS = 256


def prefix_length(n: np.ndarray) -> np.ndarray:
    """Leading shingles of which two similar sets share one: n - ceil(n * t) + 1."""
    return n - -(-n * PERCENT // 100) + 1


def overlap_needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least intersection of similar sets of sizes a and b."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def hash_buckets(docs: DataFrame, text_col: str) -> int:
    """A power of two so that a bucket holds a few MB of remainders; by the texts' size, not by a plan's estimate."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return 1 << max(4, (size >> 22).bit_length())


def _count_blobs(bits: int, words: int, flush: int = 3 << 19):
    """Map side of the shingle count: remainders of hashes, a blob for each leading ``bits`` bits."""
    shift = np.uint64(64 - bits)

    def out(parts: list[np.ndarray]) -> pa.RecordBatch:
        h = np.sort(np.concatenate(parts))
        bucket = (h >> shift).astype(np.int32)
        rest = ((h << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
        edges = np.flatnonzero(np.diff(bucket)) + 1
        at = np.concatenate([[0], edges, [len(h)]]).astype(np.int64)
        blob = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at * 4), pa.py_buffer(rest)])
        return pa.RecordBatch.from_arrays([pa.array(bucket[at[:-1]]), blob.cast(pa.binary())], names=["bucket", "blob"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in chunks(batches, 0):
            h, _ = shingles(split_words(batch.column(0), lower=True), words)
            parts.append(h)
            held += len(h)
            if held >= flush:
                yield out(parts)
                parts, held = [], 0
        if held:
            yield out(parts)

    return count


def _frequent(bits: int, least: int, most: int):
    """Reduce side: leading 32 + ``bits`` bits and count of a bucket's frequent shingles."""

    def reduce(table: pa.Table) -> pa.Table:
        blobs = table.column("blob").combine_chunks()
        rest = np.sort(np.concatenate([np.frombuffer(b.as_buffer(), dtype=np.uint32) for b in blobs]))
        at = np.flatnonzero(np.concatenate([[True], rest[1:] != rest[:-1]]))
        n = np.diff(np.append(at, len(rest)))
        keep = np.flatnonzero(n >= least)
        if len(keep) > most:
            keep = np.sort(keep[np.lexsort((rest[at[keep]], -n[keep]))[:most]])
        bucket = np.int64(table.column("bucket")[0].as_py())
        return pa.table({"head": (bucket << np.int64(32)) | rest[at[keep]].astype(np.int64), "n": n[keep].astype(np.int64)})

    return reduce


def frequent_shingles(docs: DataFrame, text_col: str, buckets: int, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted leading bits of frequent shingles, their counts, and how many bits to shift a hash by to compare."""
    bits = buckets.bit_length() - 1
    blobs = docs.select(text_col).mapInArrow(_count_blobs(bits, words), "bucket int, blob binary")
    blobs = blobs.repartition(-(-buckets // BUCKETS_A_TASK), "bucket")  # tasks grow in number and not in size
    listed = blobs.groupBy("bucket").applyInArrow(_frequent(bits, FREQUENT, max(16, MAX_FREQUENT // buckets)), "head long, n long")
    table = listed.orderBy(F.desc("n"), "head").limit(MAX_FREQUENT).toArrow()
    head, n = (table.column(c).to_numpy() for c in ("head", "n"))
    order = np.argsort(head.astype(np.uint64))
    return head.astype(np.uint64)[order], n[order], 32 - bits


class Order:
    """The global order: shingles not listed as frequent by hash, then the listed ones by count and hash."""

    def __init__(self, head: np.ndarray, n: np.ndarray, shift: int) -> None:
        self.head, self.n, self.shift = head, n, np.uint64(shift)

    def counts(self, h: np.ndarray) -> np.ndarray:
        """0 for shingles that are not listed."""
        if not len(self.head):
            return np.zeros(len(h), dtype=np.int64)
        key = h >> self.shift
        at = np.minimum(np.searchsorted(self.head, key), len(self.head) - 1)
        return np.where(self.head[at] == key, self.n[at], 0)

    def arrange(self, h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every set in the global order, and the number of its listed shingles."""
        n = self.counts(h)
        listed = np.add.reduceat(np.append(n > 0, False), np.minimum(offsets[:-1], len(h))).astype(np.int64) if len(offsets) > 1 else np.zeros(0, np.int64)
        listed[np.diff(offsets) == 0] = 0
        out = h.copy()
        for i in np.flatnonzero(listed):
            lo, hi = offsets[i], offsets[i + 1]
            out[lo:hi] = h[lo:hi][np.lexsort((h[lo:hi], n[lo:hi]))]
        return out, listed


def parity_sketch(h: np.ndarray) -> bytes:
    """Parities of the set's elements in about as many bits as it has elements.

    Every element of a symmetric difference flips one bit, so differing bits never exceed that difference.
    """
    bits = 1 << max(6, (max(len(h), 1) - 1).bit_length())
    spot = (h & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(spot, minlength=bits) & 1).astype(np.uint8).tobytes()


def _fold(sketch: np.ndarray, size: int) -> np.ndarray:
    while len(sketch) > size:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference of two sketched sets."""
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    size = min(len(x), len(y))
    return int(np.bitwise_count(_fold(x, size) ^ _fold(y, size)).sum())


def small_sketches(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Parities of every set in :data:`SMALL_BITS` bits, as rows of 64-bit words: a bound that a join can test."""
    n = len(offsets) - 1
    spot = np.repeat(np.arange(n), np.diff(offsets)) * SMALL_BITS + (h & np.uint64(SMALL_BITS - 1)).astype(np.int64)
    return np.packbits(np.bincount(spot, minlength=n * SMALL_BITS) & 1).view(np.int64).reshape(n, SMALL_BITS // 64)


PROFILE = "id long, n long, s1 long, s2 long, prefix array<long>, listed int, sketch binary, bits array<long>"


def _profile(order: Order, words: int):
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1):
            h, offsets = shingles(split_words(batch.column(1), lower=True), words)
            n = np.diff(offsets)
            with np.errstate(over="ignore"):
                at = np.minimum(offsets[:-1], max(len(h) - 1, 0))
                s1, s2 = (np.add.reduceat(mix64(h * _M1 + np.uint64(k)), at) if len(h) else np.zeros(len(n), np.uint64) for k in (1, 2))
            arranged, _ = order.arrange(h, offsets)
            p = np.where(n > 0, prefix_length(n), 0)
            pick = np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(p)[:-1]]), p) + np.arange(p.sum())
            prefix = arranged[pick]
            to = np.concatenate([[0], np.cumsum(p)])
            listed = np.concatenate([[0], np.cumsum(order.counts(prefix) > 0)])
            sketches = [parity_sketch(h[offsets[i] : offsets[i + 1]]) for i in range(len(n))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array(n),
                    pa.array(np.where(n > 0, s1, 0).astype(np.int64)),
                    pa.array(np.where(n > 0, s2, 0).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), pa.array(prefix.view(np.int64))),
                    pa.array((listed[to[1:]] - listed[to[:-1]]).astype(np.int32)),
                    pa.array(sketches, type=pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * (SMALL_BITS // 64)), pa.array(small_sketches(h, offsets).ravel())),
                ],
                names=[x.split()[0] for x in PROFILE.split(", ")],
            )

    return profile


#: Positions in a prefix are kept in 16 bits: a smaller position only weakens a bound.
MAX_PLACE = (1 << 16) - 1
#: Buckets that one task reduces.
BUCKETS_A_TASK = 4


def _entry_blobs(bits: int, flush: int = 1 << 20):
    """Prefix entries of shingles that are not listed: columns as blobs, dealt by the shingle's leading bits.

    A shingle is known by its bucket and 32 more bits: two that share them only propose pairs that are then dropped.
    """
    shift = np.uint64(64 - bits)

    def out(*parts: list[np.ndarray]) -> pa.RecordBatch:
        token, node, n, at, typical = (np.concatenate(x) for x in parts)
        order = np.argsort(token)
        token, node, n, at, typical = (x[order] for x in (token, node, n, at, typical))
        bucket = (token >> shift).astype(np.int32)
        token = ((token << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
        if node.min() >= 0 and node.max() < 1 << 32:
            node = node.astype(np.uint32)  # the blob's length tells which
        cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(token)]]).astype(np.int64)
        columns = [pa.array(bucket[cut[:-1]])]
        for x in (token, node, n.astype(np.uint32), np.minimum(at, MAX_PLACE).astype(np.uint16), typical.astype(np.uint16)):
            blob = pa.Array.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(cut * x.itemsize), pa.py_buffer(np.ascontiguousarray(x))])
            columns.append(blob.cast(pa.binary()))
        return pa.RecordBatch.from_arrays(columns, names=["bucket", "token", "node", "n", "at", "typical"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], [], [], []]
        count = 0
        for batch in batches:
            lists = batch.column(2)
            size = lists.value_lengths().to_numpy() - batch.column(3).to_numpy()
            begin = lists.offsets.to_numpy()[:-1]
            at = np.arange(size.sum()) - np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]), size)
            token = lists.values.to_numpy()[np.repeat(begin, size) + at].view(np.uint64)
            of = (np.repeat(batch.column(c).to_numpy(), size) for c in ("node", "n", "typical"))
            for x, y in zip(held, (token, next(of), next(of), at, next(of)), strict=True):
                x.append(y)
            count += len(token)
            if count >= flush:
                yield out(*held)
                held, count = [[], [], [], [], []], 0
        if count:
            yield out(*held)

    return deal


def _shared(table: pa.Table) -> pa.Table:
    """Entries of shingles that two or more prefixes of a bucket hold."""
    blobs = {c: [b.as_buffer() for b in table.column(c).combine_chunks()] for c in ("token", "node", "n", "at", "typical")}
    token, n, at, typical = (np.concatenate([np.frombuffer(b, dtype=t) for b in blobs[c]]) for c, t in (("token", np.uint32), ("n", np.uint32), ("at", np.uint16), ("typical", np.uint16)))
    node = np.concatenate([np.frombuffer(b, dtype=np.uint32 if b.size == t.size else np.int64).astype(np.int64) for b, t in zip(blobs["node"], blobs["token"], strict=True)])
    order = np.argsort(token)
    token = token[order]
    same = token[1:] == token[:-1]
    keep = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    order = order[keep]
    head = np.int64(table.column("bucket")[0].as_py()) << np.int64(32)
    return pa.table({"token": head | token[keep].astype(np.int64), "node": node[order], "n": n[order].astype(np.int64), "at": at[order].astype(np.int64), "typical": typical[order].astype(np.int32)})


def _close(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs that their sketches do not rule out."""
    both = pairs.join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("x")), "a")
    both = both.join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("y")), "b").select("a", "b", "na", "nb", "x", "y")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb = (batch.column(i).to_numpy() for i in range(4))
            most = na + nb - 2 * overlap_needed(na, nb)
            apart = np.array([least_difference(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)], dtype=np.int64)
            near = apart <= most
            yield pa.RecordBatch.from_arrays([pa.array(a[near]), pa.array(b[near])], names=["a", "b"])

    return both.mapInArrow(keep, "a long, b long")


class Trie:
    """Ordered sets as a trie in arrays: rows in lexicographic order, each sharing its first ``lcp`` nodes with the row before."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].tobytes())
        self.sets = [sets[i] for i in self.order]
        self.lcp = np.zeros(len(sets), dtype=np.int64)
        for i in range(1, len(sets)):
            a, b = self.sets[i - 1], self.sets[i]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            self.lcp[i] = differ[0] if len(differ) else m

    def matches(self, probe: np.ndarray, step: int = 64) -> list[int]:
        """Indices of sets similar to ``probe``."""
        held, found = np.sort(probe), []
        partial = np.zeros(1, dtype=np.int64)  # overlap of the last row's path at each depth
        reached = 0  # nodes of that path that were visited
        for i, row in enumerate(self.sets):
            need = int(overlap_needed(np.int64(len(probe)), np.int64(len(row))))
            depth = min(int(self.lcp[i]), reached)
            path = np.empty(len(row) + 1, dtype=np.int64)
            path[: depth + 1] = partial[: depth + 1]
            while depth < len(row) and path[depth] + min(len(row) - depth, len(probe) - path[depth]) >= need:
                part = row[depth : depth + step]
                at = np.minimum(np.searchsorted(held, part), len(held) - 1)
                path[depth + 1 : depth + len(part) + 1] = path[depth] + np.cumsum(held[at] == part)
                depth += len(part)
            if depth == len(row) and path[depth] >= need:
                found.append(self.order[i])
            partial, reached = path, depth
        return found


def _decide(table: pa.Table) -> pa.Table:
    """Links of one probe with the sets of one trie."""
    rows = table.to_pydict()
    sets = [np.frombuffer(x, dtype=np.uint64) for x in rows["tokens"]]
    probes = [i for i, p in enumerate(rows["probe"]) if p]
    others = [i for i, p in enumerate(rows["probe"]) if not p]
    links: set[tuple[int, int]] = set()
    if probes and others:
        trie = Trie([sets[i] for i in others])
        for p in probes:
            links |= {(rows["a"][p], rows["b"][others[k]]) for k in trie.matches(sets[p])}
    pairs = sorted(links)
    return pa.table({"a": pa.array([x for x, _ in pairs], pa.int64()), "b": pa.array([y for _, y in pairs], pa.int64())})


def _ordered_sets(order: Order, words: int, members: np.ndarray):
    bits = np.uint64(64 * len(members) - 1)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1):
            ids = batch.column(0).cast(pa.int64())
            spot = ids.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64) & bits
            wanted = (members[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1)
            keep = pa.array(wanted.astype(bool))
            ids, texts = ids.filter(keep), batch.column(1).filter(keep)
            if not len(ids):
                continue
            h, offsets = shingles(split_words(texts, lower=True), words)
            arranged, _ = order.arrange(h, offsets)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([arranged[offsets[i] : offsets[i + 1]].tobytes() for i in range(len(ids))], type=pa.binary())], names=["node", "tokens"]
            )

    return fetch


def _verify(pairs: DataFrame, docs: DataFrame, order: Order, words: int) -> DataFrame:
    """Pairs whose sets are similar, each probe against tries of its candidates."""
    spark = docs.sparkSession
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    bits = min(MAX_ID_BITS, max(LEAST_ID_BITS, 1 << (32 * pairs.count()).bit_length()))
    spot = F.pmod(F.col("node"), F.lit(bits))
    marks = nodes.groupBy(F.shiftright(spot, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(node, {bits}) & 63 as int))")).alias("m"))
    members = np.zeros(bits // 64, dtype=np.uint64)
    marked = marks.toArrow()  # MAX_ID_BITS / 64 rows at most
    members[marked.column("w").to_numpy()] = marked.column("m").to_numpy().view(np.uint64)
    sets = docs.mapInArrow(_ordered_sets(order, words, members), "node long, tokens binary").join(nodes.distinct(), "node", "left_semi")
    sets = materialize(sets.dropDuplicates(["node", "tokens"]), "sets")
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / TRIE_SETS).cast("int").alias("tries"))
    dealt = pairs.join(groups, "a").withColumn("trie", F.pmod(F.xxhash64("b"), F.col("tries")).cast("int"))
    probes = groups.select("a", F.explode(F.sequence(F.lit(0), F.col("tries") - 1)).alias("trie"))
    probes = probes.join(sets.withColumnRenamed("node", "a"), "a").select("a", "trie", F.col("a").alias("b"), "tokens", F.lit(True).alias("probe"))
    others = dealt.join(sets.withColumnRenamed("node", "b"), "b").select("a", "trie", "b", "tokens", F.lit(False).alias("probe"))
    links = materialize(probes.union(others).groupBy("a", "trie").applyInArrow(_decide, "a long, b long"), "links")
    discard(sets)
    return links


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``(id, n_shingles, component_id)`` for every row of ``docs``: the smallest id reachable by similar texts."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    buckets = hash_buckets(texts, "text")
    order = Order(*frequent_shingles(texts, "text", buckets, words))
    profiles = materialize(texts.mapInArrow(_profile(order, words), PROFILE), "profiles")
    full = profiles.where("n > 0 and id is not null")
    unique = full.groupBy("s1", "s2", "n").agg(F.min(F.struct("id", "prefix", "listed", "sketch", "bits")).alias("r"))
    unique = unique.select(F.col("r.id").alias("node"), "n", F.col("r.prefix").alias("prefix"), F.col("r.listed").alias("listed"), F.col("r.sketch").alias("sketch"), F.col("r.bits").alias("bits"), "s1", "s2")
    unique = materialize(unique, "unique")

    bits = buckets.bit_length() - 1
    typical = (F.col("listed") * 1000 / F.size("prefix")).cast("int").alias("typical")
    rare = unique.select("node", "n", "prefix", "listed", typical).mapInArrow(_entry_blobs(bits), "bucket int, token binary, node binary, n binary, at binary, typical binary")
    rare = rare.repartition(-(-buckets // BUCKETS_A_TASK), "bucket").groupBy("bucket").applyInArrow(_shared, "token long, node long, n long, at long, typical int")
    common = unique.where("listed > 0").select("node", "n", "listed", typical, F.posexplode("prefix").alias("at", "token"))
    common = common.where(F.col("at") >= F.least(F.lit(1 << 30), _prefix_size() - F.col("listed"))).select("token", "node", "n", F.col("at").cast("long").alias("at"), "typical")
    entries = materialize(rare.union(common), "entries")
    sketches = unique.select("node", "sketch")

    # round 1: every set against the most typical one, then the smallest node, of each shingle it shares
    pivots = entries.groupBy("token").agg(F.min(F.struct((-F.col("typical")).alias("rank"), "node", "n", "at")).alias("p"))
    pairs = entries.join(pivots, "token").select(
        F.col("p.node").alias("a"), F.col("node").alias("b"), F.col("p.n").alias("na"), F.col("n").alias("nb"), F.col("p.at").alias("pa"), F.col("at").alias("pb")
    )
    near = materialize(_close(_possible(pairs).where("a <> b").distinct(), sketches), "pairs")
    links = _verify(near, texts, order, words)
    parts = materialize(connected_components(links), "parts")

    # round 2: pairs of one shingle that round 1 left apart
    labelled = entries.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    split = labelled.groupBy("token").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("token")
    apart = materialize(labelled.join(split, "token", "left_semi").join(unique.select("node", "bits"), "node"), "apart")
    x = apart.select("token", F.col("node").alias("a"), F.col("n").alias("na"), F.col("at").alias("pa"), F.col("part").alias("part_a"), F.col("bits").alias("x"))
    y = apart.select("token", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("at").alias("pb"), F.col("part").alias("part_b"), F.col("bits").alias("y"))
    differ = sum((F.bit_count(F.col("x")[i].bitwiseXOR(F.col("y")[i])) for i in range(1, SMALL_BITS // 64)), F.bit_count(F.col("x")[0].bitwiseXOR(F.col("y")[0])))
    # every bound is part of the join's condition, so pairs that cannot be similar are never made
    pairs = x.join(y, "token").where("a < b and part_a <> part_b").where(differ <= F.col("na") + F.col("nb") - 2 * _overlap())
    done = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = _possible(pairs).distinct().join(done, ["a", "b"], "left_anti")
    rest = materialize(_close(rest, sketches), "pairs")
    more = _verify(rest, texts, order, words)
    parts = materialize(connected_components(links.union(more)), "parts")

    found = unique.select("s1", "s2", F.col("n").alias("n_"), "node")
    rows = profiles.select("id", "n", "s1", "s2").join(found, (profiles.s1 == found.s1) & (profiles.s2 == found.s2) & (profiles.n == found.n_), "left")
    rows = rows.select("id", "n", "node").join(parts, "node", "left")
    rows = materialize(rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "node", "id")).alias("component_id")), "classes")
    discard(profiles, unique, entries, near, apart, rest, links, more, parts)
    return rows


def _prefix_size():
    return F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1


def _overlap():
    return F.ceil((F.col("na") + F.col("nb")) * PERCENT / (100 + PERCENT))


def _possible(pairs: DataFrame) -> DataFrame:
    """Pairs that sizes and the positions of a shared shingle allow."""
    need = _overlap()
    # a shared shingle at positions pa and pb: what stands before is at most the smaller of both, plus the tails
    most = F.least(F.col("pa"), F.col("pb")) + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    sizes = (F.col("na") * 100 >= F.col("nb") * PERCENT) & (F.col("nb") * 100 >= F.col("na") * PERCENT)
    return pairs.where(sizes & (most >= need)).select("a", "b", "na", "nb")


def op3_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of :func:`jaccard_classes` over all ``documents``."""
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
