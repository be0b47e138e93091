"""The training-data pipeline: five stages over ``documents``, each written as Parquet and read again.

Defined cases, of every stage: a null text is a document without words and stays null where texts are not changed; an
empty text stays; texts are read whole, however long; rows without an id and repeated rows are documents of their own
(of equal texts the near-copy stage keeps one, an id before none); a null source is a source, a null language stays;
columns besides those of ``documents`` are dropped, so clashing names do not matter; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.mixing import mix
from millrace.llm.ngram_join import jaccard_classes
from millrace.llm.pii import find_pii
from millrace.llm.sentencepiece import default_model, encode_texts
from millrace.llm.toxicity import THRESHOLD, score, train
from millrace.session import materialize, scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``, whatever else the input has."""
    return docs.select(*COLUMNS)


def _rows(docs: DataFrame) -> DataFrame:
    """The documents with a ``row`` of their own, whatever their ids: written once, so that every reader sees the same."""
    return materialize(_documents(docs).withColumn("row", F.monotonically_increasing_id()), "rows")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network scores at least 0.7 go; labels teach it as in the operator."""
    docs = _documents(docs)
    net = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return score(docs, net).where(F.col("toxicity_score") < THRESHOLD).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar texts stays, that with the smallest id, ids that are null last.

    Rows are compared, not ids: rows without an id and rows that share one are documents like any other.
    """
    rows = _rows(docs)
    classes = jaccard_classes(rows, id_col="row").select("row", "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    first = classes.join(rows.select("row", "doc_id"), "row").groupBy("component_id").agg(F.min(order).alias("first")).select("first.row")
    return rows.join(first, "row", "left_semi").select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; no document goes."""
    docs = _documents(docs)
    # rows are paired with their texts by the text itself: redaction depends on nothing else
    keyed = docs.withColumn("row", F.struct("doc_id", "lang", "source", "text"))
    safe = find_pii(keyed.select("row", F.col("text").alias("body")), id_col="row", text_col="body")
    text = F.when(F.col("row.text").isNotNull(), F.col("redacted"))
    return safe.select(
        "row.doc_id", text.alias("text"), "row.lang", "row.source", F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars")
    )


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a row for each document and epoch, holding the stretches taken in that epoch.

    A document taken whole keeps its text as it is; else its stretches are cut at word starts and joined by line feeds.
    Rows are mixed, not ids: every row has its own stretches, whether its id is null or not its own.
    """
    docs = _rows(docs)
    taken = mix(docs, id_col="row", order=("doc_id", "text")).where("words > 0")
    spans = taken.groupBy("row", "size", "epoch").agg(F.sort_array(F.collect_list(F.struct("first", "words"))).alias("spans"))
    rows = docs.join(spans, "row").select("doc_id", "text", "lang", "source", "size", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from millrace.llm.words import chunks, split_words

        for batch in chunks(batches, 1):
            words = split_words(batch.column(1))
            texts = []
            for i, (text, size, spans) in enumerate(zip(batch.column(1).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                runs: list[list[int]] = []
                for s in spans:
                    if runs and runs[-1][1] == s["first"]:
                        runs[-1][1] += s["words"]
                    else:
                        runs.append([s["first"], s["first"] + s["words"]])
                if runs == [[0, size]]:
                    texts.append(text)
                    continue
                lo, origin = int(words.first[i]), int(words.offsets[i])
                raw = text.encode()
                count = int(words.first[i + 1]) - lo
                pieces = [raw[int(words.start[lo + a]) - origin : int(words.end[lo + min(b, count) - 1]) - origin].decode() for a, b in runs if a < count]
                texts.append("\n".join(pieces))
            n = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), batch.column(2), batch.column(3), n], names=list(COLUMNS))

    return rows.mapInArrow(cut, "doc_id long, text string, lang string, source string, n_chars long")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row."""
    return encode_texts(_documents(docs), default_model()).select("doc_id", "n_tokens", "token_ids", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: A network, similarity classes, a random field, permutations and byte pairs are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
