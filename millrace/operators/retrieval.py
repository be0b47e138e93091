"""Retrieval over stored vectors and resolution of citations against what was retrieved."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import citations, norm_doc, norm_section
from millrace.session import bounded_batches, materialize

POOL, TOP, TOLERANCE = 24, 6, 1


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


#: Rows of a block of vectors, and bytes of queries that are sent to every executor at most.
BLOCK_ROWS, SENT_BYTES = 4096, 64 << 20
#: Queries that are multiplied with a block at once, and rows of nearest vectors that a task holds and sends at once.
QUERY_ROWS, HELD_ROWS, SENT_ROWS = 256, 1 << 20, 1 << 16
BLOCK = "ids binary, size int, units binary, n int"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ids and vectors as blocks of unit vectors of one length; vectors without a direction are left out."""
    for batch in batches:
        ids, lists = batch.column(0), batch.column(1)
        begin = lists.offsets.to_numpy()
        size = np.where(lists.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False), np.diff(begin), 0)
        flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
        names = ids.fill_null(0).to_numpy().astype(np.int64)
        for n in np.unique(size[size > 0]):
            rows = np.flatnonzero(size == n)
            for at in range(0, len(rows), BLOCK_ROWS):
                some = rows[at : at + BLOCK_ROWS]
                x = flat[begin[some][:, None] + np.arange(n)]
                length = np.sqrt((x * x).sum(axis=1))
                ok = np.isfinite(length) & (length > 0)
                yield pa.RecordBatch.from_pydict(
                    {"ids": pa.array([names[some][ok].tobytes()], pa.binary()), "size": pa.array([n], pa.int32()), "units": pa.array([(x[ok] / length[ok][:, None]).tobytes()], pa.binary()), "n": pa.array([int(ok.sum())], pa.int32())}
                )


def best_of(qi: np.ndarray, q: np.ndarray, vi: np.ndarray, v: np.ndarray, k: int, margin: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of some queries at a time their ``k`` nearest among ``v``, and those that rounding may put among them: indices of queries and vectors, scores."""
    for at in range(0, len(qi), QUERY_ROWS):
        near = q[at : at + QUERY_ROWS] @ v.T
        near[qi[at : at + QUERY_ROWS, None] == vi] = -np.inf
        least = np.partition(near, -k, axis=1)[:, -k] - margin if len(vi) > k else np.full(len(near), -2.0)
        a, b = np.nonzero((near >= least[:, None]) & np.isfinite(near))
        yield a + at, b, near[a, b]


class Best:
    """The nearest vectors of queries among all that a task has met: ``k`` of each and what rounding may put among them.

    Rows are held up to :data:`HELD_ROWS` and then cut to those; what is still more than half of that is sent on.
    """

    def __init__(self, k: int, margin: float):
        self.k, self.margin, self.parts, self.held = k, margin, [], 0

    def add(self, query_id: np.ndarray, vec_id: np.ndarray, raw: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((query_id, vec_id, raw))
        self.held += len(raw)
        if self.held > HELD_ROWS:
            self._cut()
            if self.held > HELD_ROWS // 2:
                yield from self.rest()

    def _cut(self) -> None:
        query_id, vec_id, raw = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.lexsort((-raw, query_id))
        query_id, vec_id, raw = query_id[order], vec_id[order], raw[order]
        start = np.flatnonzero(np.append(True, query_id[1:] != query_id[:-1]))
        size = np.diff(np.append(start, len(raw)))
        least = np.where(size >= self.k, raw[np.minimum(start + self.k, start + size) - 1], -np.inf) - self.margin
        keep = raw >= np.repeat(least, size)
        self.parts, self.held = [(query_id[keep], vec_id[keep], raw[keep])], int(keep.sum())

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self._cut()
            query_id, vec_id, raw = self.parts[0]
            for at in range(0, len(raw), SENT_ROWS):
                yield pa.RecordBatch.from_pydict({"query_id": query_id[at : at + SENT_ROWS], "vec_id": vec_id[at : at + SENT_ROWS], "raw": raw[at : at + SENT_ROWS]})
        self.parts, self.held = [], 0


def _nearest(k: int, digits: int):
    margin = 2 * 10.0**-digits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every query's ``k`` nearest of a task's pairs of blocks, and those that rounding may put among them."""
        best = Best(k, margin)
        for batch in batches:
            for row in range(batch.num_rows):
                qi, q, vi, v, size = (batch.column(c)[row].as_py() for c in ("qids", "qunits", "ids", "units", "size"))
                qi, vi = np.frombuffer(qi, np.int64), np.frombuffer(vi, np.int64)
                if not len(qi) or not len(vi):
                    continue
                for a, b, raw in best_of(qi, np.frombuffer(q).reshape(-1, size), vi, np.frombuffer(v).reshape(-1, size), k, margin):
                    yield from best.add(qi[a], vi[b], raw)
        yield from best.rest()

    return run


def top_k(queries: DataFrame, vectors: DataFrame, k: int = POOL, digits: int = 6) -> DataFrame:
    """The ``k`` nearest vectors of every query by cosine, ties by id.

    ``queries(query_id, q)`` is a stated set compared with all of ``vectors(vec_id, v)``, block with block as a product
    of matrices: a task sends on about ``k`` rows a query, as long as it holds those of all queries. Blocks of queries are sent to the vectors while
    they have :data:`SENT_BYTES` at most, and both sides are dealt by block beyond. Vectors that are null or have no
    direction are near nothing.
    """
    bounded_batches(queries.sparkSession)
    q = materialize(queries.select("query_id", "q").mapInArrow(_blocks, BLOCK), "queries").select(F.col("ids").alias("qids"), "size", F.col("units").alias("qunits"))
    v = vectors.select("vec_id", "v").mapInArrow(_blocks, BLOCK)
    sent = (q.agg(F.sum(F.octet_length("qunits"))).first()[0] or 0) <= SENT_BYTES
    pairs = v.join(F.broadcast(q), "size") if sent else v.withColumn("part", F.monotonically_increasing_id() % 64).join(q.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(63)))), ["size", "part"])
    scored = pairs.mapInArrow(_nearest(k, digits), "query_id long, vec_id long, raw double").select("query_id", "vec_id", F.round("raw", digits).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def rerank(pool: DataFrame, scorer=None, top: int = TOP) -> DataFrame:
    """The first ``top`` of a pool by ``scorer(pool) -> column``; by their first order without one."""
    score = F.col("score") if scorer is None else scorer
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "rank"))
    return pool.withColumn("final_rank", rank).where(F.col("final_rank") <= top)


def rerank_with(pool: DataFrame, model: Callable[[], Callable[[list[dict]], list[float]]], top: int = TOP) -> DataFrame:
    """The first ``top`` of a pool by a model that is made once a task and scores its rows a batch at a time.

    Where the model cannot be made (its library or file is missing), the pool keeps its first order and says so in
    ``reranked``; a model that fails on rows fails the job.
    """
    schema = T.StructType([*pool.schema.fields, T.StructField("model_score", T.DoubleType()), T.StructField("reranked", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            scorer = model()
        except (ImportError, OSError):
            scorer = None
        for batch in batches:
            scores = [float(x) for x in scorer(batch.to_pylist())] if scorer else [None] * batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array([scorer is not None] * batch.num_rows)], names=[*batch.schema.names, "model_score", "reranked"])

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("model_score"), "rank"))
    return pool.mapInArrow(run, schema).withColumn("final_rank", rank).where(F.col("final_rank") <= top)


def resolve_citations(answers: DataFrame, contexts: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """Support of every citation occurrence of ``answers(answer_id, text)``.

    ``contexts(answer_id, insurer, doc_short, filename, section_id, page)``. A citation is supported if insurer,
    document (by either name) and section are those of a retrieved chunk and the page is within ``tolerance``. An empty
    document token is never supported. Repeated citations count each time.
    """
    cited = answers.select("answer_id", F.posexplode(citations(F.col("text"))).alias("occurrence", "c"))
    cited = cited.select(
        "answer_id", "occurrence", F.col("c.citation").alias("citation"), F.lower("c.insurer").alias("who"), norm_doc(F.col("c.doc")).alias("doc"),
        norm_section(F.col("c.section")).alias("section"), F.col("c.page").alias("page"),
    )
    alias = F.explode(F.array("doc_short", "filename")).alias("name")
    known = contexts.select("answer_id", F.lower("insurer").alias("who"), alias, norm_section(F.col("section_id").cast("string")).alias("section"), F.col("page").alias("known_page"))
    known = known.withColumn("doc", norm_doc(F.col("name"))).where("doc <> ''").drop("name").distinct()
    near = cited.join(known, ["answer_id", "who", "doc", "section"], "left")
    ok = F.coalesce(F.max(F.abs(F.col("page") - F.col("known_page")) <= tolerance), F.lit(False))
    return near.groupBy("answer_id", "occurrence", "citation").agg(ok.alias("supported"))


def knn_vote(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """Most common label among neighbours, the smallest at ties, with its share; neighbours without a label abstain."""
    v = neighbours.join(labels.select(F.col("vec_id"), F.col("label")), "vec_id").where("label is not null").groupBy("query_id", "label").agg(F.count("*").alias("n"))
    best = F.max(F.struct(F.col("n"), (-F.col("label")).alias("neg"))).alias("b")
    return v.groupBy("query_id").agg(best, F.sum("n").alias("total")).select("query_id", (-F.col("b.neg")).alias("label"), (F.col("b.n") / F.col("total")).alias("share"))
