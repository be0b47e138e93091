"""Mixing sources to target weights over fixed-length token blocks.

Every source's words are one stream, in a pseudorandom document order, cut into blocks of ``block_words``; a source
fills as many output slots as its target takes. A keyed pseudorandom permutation of all slots deals them to output
shards of ``shard_slots``: the source counts of a shard are a multinomial draw given every source's total, so the
totals hold exactly, whatever the draws. A source's j-th slot maps through a pseudorandom permutation of its block
indices, one permutation an epoch, and blocks are joined by ``(source, block)``. The last slot of a source is cut to
the words still wanted, so a source's taken words equal its rounded target, and as a target stops at ``max_epochs``
times its source no document exceeds that many times its size.

A shard needs nothing but its number and the plan, a row a source and epoch, so shards are made in parallel, at any
number of slots. Offsets in a stream are prefix sums in two levels: documents fall in buckets by hash, a window runs
within a bucket and another over bucket totals, so a source with a third of all rows is no single task. Everything
random is a hash of the seed, the source and an index, or of a document's id and text: reruns agree, at any
partitioning. The driver holds a row a source, as its weights are its configuration; it is joined by broadcast up to
:data:`SENT_SOURCES` sources and by shuffle beyond.

Defined cases: a null text has size 0 and takes nothing; null is a source of its own, ordered last; rows without an id
and repeated rows are separate documents; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.words import mix64
from millrace.session import bounded_batches, materialize

WORD_GAPS = r"[\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: Up to so many sources their targets are sent to every executor.
SENT_SOURCES = 100_000
#: Slots that a task makes at a time.
SLOTS_AT_ONCE = 1 << 18


def word_count(text: Column) -> Column:
    """Number of runs of non-space characters; 0 for null."""
    parts = F.split(text, WORD_GAPS)
    first = F.when(parts[0] == "", 1).otherwise(0)
    last = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.coalesce((F.size(parts) - first - last).cast("long"), F.lit(0).cast("long"))


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> list[float]:
    """Words wanted of each source: ``share`` of all words by weight, none above ``cap`` times its size, the excess
    dealt again by weight until none is above."""
    n = len(sizes)
    weight = [float(weights[i % len(weights)]) for i in range(n)]
    total, out, free = share * sum(sizes), [0.0] * n, set(range(n))
    while free:
        left = total - sum(out[i] for i in range(n) if i not in free)
        unit = left / sum(weight[i] for i in free)
        over = {i for i in free if weight[i] * unit > cap * sizes[i]}
        for i in over:
            out[i] = cap * sizes[i]
        free -= over
        if not over:
            for i in free:
                out[i] = weight[i] * unit
            break
    return out


#: Half the bits of the smallest even width that holds n numbers.
_WIDTHS = np.array([1 << (2 * h) for h in range(32)], dtype=np.uint64)
_SALT = np.uint64(0x9E3779B97F4A7C15)
ROUNDS = 4


def _round(x: np.ndarray, key: np.ndarray, r: int, mask: np.ndarray) -> np.ndarray:
    return (mix64((x + key) * _SALT + np.uint64(r)) >> np.uint64(32)) & mask


def _feistel(x: np.ndarray, key: np.ndarray, low: np.ndarray) -> np.ndarray:
    mask = (np.uint64(1) << low) - np.uint64(1)
    left, right = x >> low, x & mask
    for r in range(ROUNDS):
        left, right = right, left ^ _round(right, key, r, mask)
    return (left << low) | right


def _unfeistel(x: np.ndarray, key: np.ndarray, low: np.ndarray) -> np.ndarray:
    mask = (np.uint64(1) << low) - np.uint64(1)
    left, right = x >> low, x & mask
    for r in reversed(range(ROUNDS)):
        left, right = right ^ _round(left, key, r, mask), left
    return (left << low) | right


def permute(index, n, seed: int, source, epoch, step=_feistel) -> np.ndarray:
    """Pseudorandom permutations of range(n) at ``index``: a Feistel network, walked until it lands below n.

    ``n``, ``source`` and ``epoch`` may be arrays: each element has its own permutation.
    """
    x, n, source, epoch = np.broadcast_arrays(*(np.asarray(v, dtype=np.int64).astype(np.uint64) for v in (index, n, source, epoch)))
    with np.errstate(over="ignore"):
        key = mix64(mix64(mix64(np.full(1, seed, np.uint64) * _SALT) + source) * _SALT + epoch)
        low = np.maximum(np.searchsorted(_WIDTHS, n), 1).astype(np.uint64)
        out = step(x, key, low)
        while len(far := np.flatnonzero(out >= n)):
            out[far] = step(out[far], key[far], low[far])
    return out.astype(np.int64)


def unpermute(index, n, seed: int, source, epoch) -> np.ndarray:
    """The inverse of :func:`permute`."""
    return permute(index, n, seed, source, epoch, _unfeistel)


def slots_needed(words: int, size: int, block: int, seed: int, source: int) -> list[tuple[int, int, int]]:
    """``(epoch, slots, words in the last slot)`` for ``words`` words of a source of ``size``; full epochs first."""
    blocks = -(-size // block)
    short = size - (blocks - 1) * block
    out = []
    for epoch in range(-(-words // size)):
        want = min(size, words - epoch * size)
        if want == size:
            out.append((epoch, blocks, 0))
            continue
        # where the short block falls decides how many slots the wanted words fill
        at = int(unpermute(np.array([blocks - 1]), blocks, seed, source, epoch)[0])
        slots = -(-want // block)
        if slots > at:
            slots = -(-(want + block - short) // block)
        held = slots * block - (block - short if slots > at else 0)
        last = (short if slots - 1 == at else block) - (held - want)
        out.append((epoch, slots, last))
    return out


class Plan:
    """Slots of every source and epoch, end to end: source, epoch, slots, words in the last slot (0: all), blocks."""

    def __init__(self, epochs: list[tuple[int, int, int, int, int]]) -> None:
        self.source, self.epoch, self.slots, self.last, self.blocks = np.array(epochs, dtype=np.int64).reshape(-1, 5).T
        self.begin = np.concatenate([[0], np.cumsum(self.slots)])

    @property
    def total(self) -> int:
        return int(self.begin[-1])

    def deal(self, first: int, upto: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What fills output slots ``first`` to ``upto``: source, epoch, block, and words to take (0: all of it)."""
        drawn = permute(np.arange(first, upto), self.total, seed, len(self.slots), 1 << 32)
        k = np.searchsorted(self.begin, drawn, side="right") - 1
        j = drawn - self.begin[k]
        block = permute(j, self.blocks[k], seed, self.source[k], self.epoch[k])
        return self.source[k], self.epoch[k], block, np.where(j == self.slots[k] - 1, self.last[k], 0)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    max_epochs: float = 2.0,
    block_words: int = 256,
    shard_slots: int = 8192,
    docs_per_bucket: int = 1024,
    seed: int = 20240607,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """The mix of ``docs``: one row per document and stretch of it that was taken.

    ``order`` names the columns whose hash orders documents, by default the id and the text. Columns: the id,
    ``source``, ``bucket`` and ``place`` (a key of the row within its source), ``size``, ``source_size``, ``target``,
    ``epoch``, ``first`` and ``words`` (the stretch, in words of the document) and ``shard``, ``slot``; a document of
    which nothing is taken has one row with null ``slot`` and ``words`` 0.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    h = F.xxhash64(F.lit(seed), *(order or (id_col, text_col)))
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), h.alias("h"))
    sized = materialize(sized, "sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("rows")).collect()  # a row a source
    per_source.sort(key=lambda r: (r.source is None, r.source or ""))
    wanted = targets([r.words for r in per_source], weights, share, max_epochs)
    rows = sum(r.rows for r in per_source)
    buckets = max(8, rows // max(docs_per_bucket, math.isqrt(rows)))  # neither level outgrows a task

    epochs = []
    for k, (r, want) in enumerate(zip(per_source, wanted, strict=True)):
        for epoch, n, last in slots_needed(int(round(want)), r.words, block_words, seed, k) if r.words else []:
            epochs.append((k, epoch, n, last, -(-r.words // block_words)))
    names = spark.createDataFrame(
        [(k, r.source, r.words, float(w)) for k, (r, w) in enumerate(zip(per_source, wanted, strict=True))], "k int, source string, source_size long, target double"
    )
    if len(per_source) <= SENT_SOURCES:
        names = names.hint("broadcast")

    placed = sized.join(names, sized.source.eqNullSafe(names.source)).drop(names.source)
    placed = placed.withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    within = Window.partitionBy("k", "bucket").orderBy("h", "id", "size")
    placed = placed.withColumn("place", F.row_number().over(within)).withColumn("upto", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    totals = sized.join(names, sized.source.eqNullSafe(names.source)).select("k", F.pmod("h", F.lit(buckets)).cast("int").alias("bucket"), "size")
    totals = totals.groupBy("k", "bucket").agg(F.sum("size").alias("held"))
    totals = totals.withColumn("before", F.sum("held").over(Window.partitionBy("k").orderBy("bucket")) - F.col("held")).drop("held")
    placed = placed.join(totals, ["k", "bucket"]).withColumn("start", F.col("before") + F.col("upto") - F.col("size"))
    placed = placed.select("id", "source", "k", "bucket", "place", "size", "source_size", "target", "start")

    some = placed.where("size > 0").withColumn(
        "block", F.explode(F.sequence((F.col("start") / block_words).cast("long"), ((F.col("start") + F.col("size") - 1) / block_words).cast("long")))
    )
    begin = F.greatest(F.col("start"), F.col("block") * block_words)
    some = some.withColumn("first", begin - F.col("start")).withColumn("offset", begin - F.col("block") * block_words)
    some = some.withColumn("held", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words) - begin)

    drawn = _slots(spark, Plan(epochs), shard_slots, seed)
    # a range's rows say nothing of the slots made from them: never broadcast by that estimate
    taken = some.join(drawn.hint("merge"), ["k", "block"])
    # a slot that is cut takes the block's first `upto` words
    taken = taken.withColumn("words", F.when(F.col("upto") == 0, F.col("held")).otherwise(F.least(F.col("held"), F.greatest(F.col("upto") - F.col("offset"), F.lit(0)))))
    taken = taken.where("words > 0").select("k", "bucket", "place", "epoch", "first", "words", "shard", "slot")
    out = placed.join(taken, ["k", "bucket", "place"], "left").withColumn("words", F.coalesce("words", F.lit(0).cast("long")))
    return out.withColumnRenamed("id", id_col).select(id_col, "source", "bucket", "place", "size", "source_size", "target", "epoch", "first", "words", "shard", "slot")


def _slots(spark, plan: Plan, shard_slots: int, seed: int) -> DataFrame:
    """``(k, epoch, block, shard, slot, upto)`` for every output slot; ``upto`` is 0 but for a slot that is cut."""
    shards = -(-plan.total // shard_slots)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(0).to_numpy()  # a range
            step = max(1, SLOTS_AT_ONCE // shard_slots)
            for at in range(0, len(numbers), step):
                some = numbers[at : at + step]
                first, upto = int(some[0]) * shard_slots, min((int(some[-1]) + 1) * shard_slots, plan.total)
                k, epoch, block, cut = plan.deal(first, upto, seed)
                slot = np.arange(first, upto)
                yield pa.RecordBatch.from_pydict({"k": k.astype(np.int32), "epoch": epoch.astype(np.int32), "block": block, "shard": slot // shard_slots, "slot": slot, "upto": cut})

    tasks = max(1, min(shards, max(spark.sparkContext.defaultParallelism, -(-plan.total // (1 << 22)))))
    return spark.range(0, shards, 1, tasks).mapInArrow(fill, "k int, epoch int, block long, shard long, slot long, upto long")


def op10_mix(spark, sf_dir: str) -> DataFrame:
    """The contract's digest: words taken of every document."""
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = mixed.groupBy("doc_id", "source", "bucket", "place").agg(
        F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("words").alias("taken")
    )
    return rows.select("doc_id", "size", "source_size", "target", "taken")
