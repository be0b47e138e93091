"""Scans with declared schemas. No scan infers a schema, and every one says what it does with bad lines."""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import materialize
from millrace.sources.journal_lines import register


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, missing_ok: bool = False) -> DataFrame:
    """JSON lines, failing at a bad line; a missing path is an empty table if ``missing_ok``, else an error."""
    if missing_ok and not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_skipping(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines without those that do not parse."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def journal_lines(spark: SparkSession, path: str, split_bytes: int = 32 << 20, complete: bool = False) -> DataFrame:
    """``(file, offset, line)`` of journals, by ranges of ``split_bytes``; see :mod:`millrace.sources.journal_lines`."""
    register(spark)
    lines = spark.read.format("journal_lines").option("splitBytes", split_bytes).option("complete", str(complete).lower()).load(path)
    return lines.withColumn("line", F.col("line").cast("string"))


@F.pandas_udf(T.BooleanType())
def _no_json(lines: pd.Series) -> pd.Series:
    def fails(line: str) -> bool:
        try:
            json.loads(line)
        except ValueError:
            return True
        return False

    return lines.map(fails)


def first_tears(lines: DataFrame) -> DataFrame:
    """``(file, tear)``: where each torn file's first line stands that is not one JSON value.

    Spark's parser takes what follows a value for nothing and repeated keys for an error, so a line has to parse within
    brackets and as a member, and the few that do not are asked again.
    """
    alone = [F.try_parse_json(F.concat(F.lit(before), "line", F.lit(after))).isNull() for before, after in (("[", "]"), ('{"v":', "}"))]
    return lines.where(alone[0] | alone[1]).where(_no_json("line")).groupBy("file").agg(F.min("offset").alias("tear"))


def before_tears(lines: DataFrame, tears: DataFrame) -> DataFrame:
    return lines.join(tears, "file", "left").where("tear IS NULL OR offset < tear").drop("tear")


def read_torn(spark: SparkSession, path: str, schema: T.StructType | str, split_bytes: int = 32 << 20, complete: bool = False) -> DataFrame:
    """Per file, the JSON lines before its first bad one: a torn append loses its tail and nothing else.

    Columns: those of ``schema``, ``file`` and ``offset``. Ranges of one file are many tasks: a first pass finds the
    first bad line of every range, a file is cut at the least of them, and the second pass joins lines to the cuts, a
    row a torn file. ``complete`` leaves out a last line without a line feed even where it is JSON.
    """
    lines = journal_lines(spark, path, split_bytes, complete)
    tears = materialize(first_tears(lines), "tears")  # its size is known, so Spark decides how to join it
    return before_tears(lines, tears).select(F.from_json("line", schema).alias("r"), "file", "offset").select("r.*", "file", "offset")


def complete_lines(text: Column) -> Column:
    """A journal up to its last line feed."""
    return F.when(F.contains(text, F.lit("\n")), F.regexp_replace(text, "[^\n]*\\z", "")).otherwise(F.lit(""))


def read_named(spark: SparkSession, folder: str, pattern: str, names: list[str], schema: T.StructType | str) -> DataFrame:
    """JSON lines of files whose names match ``pattern``, its groups as integer columns; other files are not read."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(folder)
    rows = rows.withColumn("_name", F.col("_metadata.file_name")).where(F.rlike("_name", F.lit(f"^{pattern}$")))
    for i, name in enumerate(names, 1):
        rows = rows.withColumn(name, F.regexp_extract("_name", pattern, i).cast("int"))
    return rows.drop("_name")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, json_columns: dict[str, str] | None = None) -> DataFrame:
    """CSV with a header, quoted line feeds and doubled quotes; cells of ``json_columns`` are parsed by their types."""
    rows = spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"', mode="FAILFAST")
    for name, kind in (json_columns or {}).items():
        rows = rows.withColumn(name, F.from_json(name, kind))
    return rows


def read_config(spark: SparkSession, path: str) -> dict:
    """A JSON object from any store that Spark reads; repeated keys are an error."""

    def unique(pairs: list[tuple[str, object]]) -> dict:
        if len({k for k, _ in pairs}) != len(pairs):
            raise ValueError(f"{path}: repeated keys")
        return dict(pairs)

    return json.loads(spark.read.text(path, wholetext=True).first().value, object_pairs_hook=unique)


def read_tar_members(spark: SparkSession, path: str, wanted: str, expected: DataFrame | None = None) -> DataFrame:
    """``(archive, member, content, sha256)`` of members of tar archives whose names match ``wanted``.

    Archives are read whole, one a task, by Spark, which reads any store; a member's hash is compared with
    ``expected(member, sha256)``, if given, and a member that differs or is not listed there fails the read.
    """
    import re

    pattern = re.compile(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as tar:
                    for member in tar:
                        if member.isfile() and pattern.fullmatch(member.name):
                            yield pa.RecordBatch.from_pydict({"archive": [path], "member": [member.name], "content": [tar.extractfile(member).read()]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    members = files.mapInArrow(run, "archive string, member string, content binary").withColumn("sha256", F.sha2("content", 256))
    if expected is None:
        return members
    listed = members.join(expected.select("member", F.lower("sha256").alias("_wanted")), "member", "left")
    checked = F.when(F.col("sha256").eqNullSafe(F.col("_wanted")), F.col("sha256")).otherwise(F.raise_error(F.concat(F.lit("not the listed content: "), "member")))
    return listed.select("archive", "member", "content", checked.alias("sha256"))


def read_documents(spark: SparkSession, path: str, parse: Callable[[bytes], list[tuple[str, str]]], kept: float = 0.65, least_raw: int = 200) -> DataFrame:
    """Pages of binary documents: ``parse`` gives a page's markdown and raw text.

    The raw text is taken where markdown kept less than ``kept`` of more than ``least_raw`` raw characters.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pages = parse(content)
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": [path] * len(pages), "page": pa.array(range(1, len(pages) + 1), pa.int32()), "markdown": [m for m, _ in pages], "raw": [r for _, r in pages]}
                )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    pages = files.mapInArrow(run, "doc_id string, page int, markdown string, raw string")
    lost = (F.length("markdown") < kept * F.length("raw")) & (F.length("raw") > least_raw)
    return pages.select("doc_id", "page", F.when(lost, F.col("raw")).otherwise(F.col("markdown")).alias("text"))


def layout_order(blocks: DataFrame) -> DataFrame:
    """Lines of two-column pages in reading order, large text as headings.

    ``blocks``: doc_id, page, x0, x1, y0, width (of the page), size (of the font), text. Blocks that cross the middle
    belong to neither column and come in their place from the top.
    """
    middle = F.col("width") / 2
    column = F.when(F.col("x0") >= middle, 2).when(F.col("x1") <= middle, 1).otherwise(0)
    level = F.when(F.col("size") >= 16, F.lit("## ")).when(F.col("size") >= 9.5, F.lit("### ")).otherwise(F.lit(""))
    # a block across the middle opens a band: what stands above it is read before it, column by column
    down = Window.partitionBy("doc_id", "page").orderBy("y0", "column", "x0")
    placed = blocks.withColumn("column", column).withColumn("band", F.sum(F.when(F.col("column") == 0, 1).otherwise(0)).over(down))
    line = F.struct("band", "column", F.col("y0").alias("y"), F.col("x0").alias("x"), F.concat(level, F.col("text")).alias("line"))
    pages = placed.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    return pages.select("doc_id", "page", F.array_join(F.col("lines.line"), "\n").alias("text"))


def read_vectors(spark: SparkSession, path: str, metadata: dict[str, list] | None = None) -> DataFrame:
    """A vector table, filtered on metadata columns before anything else, so filters reach the scan."""
    rows = spark.read.parquet(path)
    for name, allowed in (metadata or {}).items():
        rows = rows.where(F.col(name).isin(*allowed))
    return rows


def embed(texts: DataFrame, text: str, client: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 32, prefix: str = "search_document: ") -> DataFrame:
    """Embeddings from a client made once a task and called with ``batch`` texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = client()
        for b in batches:
            values = [prefix + (t or "") for t in b.column(text).to_pylist()]
            vectors = [v for i in range(0, len(values), batch) for v in call(values[i : i + batch])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*b.schema.names, "embedding"])

    return texts.mapInArrow(run, T.StructType([*texts.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]))


