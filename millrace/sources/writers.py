"""Sinks. Nothing is overwritten: a path that exists is an error, and versioned snapshots are read back and compared."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import formula_safe
from millrace.operators.gates import GateError
from millrace.sources.readers import read_config


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with null fields kept and characters as they are."""
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def sorted_json(column: str, kind: T.DataType) -> Column:
    """A column as JSON with keys in alphabetical order at every level."""

    def arrange(c: Column, t: T.DataType) -> Column:
        if isinstance(t, T.StructType):
            return F.struct(*(arrange(c[f.name], f.dataType).alias(f.name) for f in sorted(t.fields, key=lambda f: f.name)))
        if isinstance(t, T.ArrayType):
            return F.transform(c, lambda x: arrange(x, t.elementType))
        if isinstance(t, T.MapType):
            return F.map_from_entries(F.array_sort(F.map_entries(c)))
        return c

    return F.to_json(F.when(F.col(column).isNotNull(), arrange(F.col(column), kind)), {"ignoreNullFields": "false"})


def _nested(t: T.DataType) -> bool:
    return isinstance(t, (T.StructType, T.ArrayType, T.MapType))


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON with sorted keys, others as they are."""
    return df.select(*(sorted_json(f.name, f.dataType).alias(f.name) if _nested(f.dataType) else F.col(f.name) for f in df.schema.fields))


def write_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    """CSV with a header; nested cells are JSON, nulls are empty."""
    writer = flat(df).write.mode("errorifexists").option("header", True).option("nullValue", "").option("emptyValue", '""' if not quote_all else "").option("escape", '"')
    writer.option("quoteAll", quote_all).csv(path)


def write_sorted_csv(df: DataFrame, path: str, key: str) -> int:
    """CSV with every cell quoted, nested cells as sorted JSON, in the order of ``key``; rows are counted again from the files."""
    write_csv(df.orderBy(key), path, quote_all=True)
    names = T.StructType([T.StructField(f.name, T.StringType()) for f in df.schema.fields])
    again = df.sparkSession.read.schema(names).csv(path, header=True, quote='"', escape='"', multiLine=True)
    wanted, got = df.count(), again.where(F.col(key).isNotNull()).count()
    if wanted != got:
        raise GateError(f"{path}: {got} rows with {key}, {wanted} expected")
    return got


def write_json(spark: SparkSession, value: object, path: str) -> None:
    """One JSON value as a file that readers see whole or not at all: written beside its place, then moved there."""
    import json

    hadoop = spark._jvm.org.apache.hadoop.fs
    place, beside = hadoop.Path(path), hadoop.Path(f"{path}.writing")
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(beside, True)
    out.write(bytearray(json.dumps(value, ensure_ascii=False, sort_keys=True, indent=1).encode()))
    out.close()
    if files.exists(place):
        files.delete(place, False)
    if not files.rename(beside, place):
        raise GateError(f"{path}: not written")


def union_columns(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows; columns in the order in which they first appear."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def lossless(df: DataFrame) -> DataFrame:
    """Every cell as JSON text, so that a CSV gives the types back; null is the JSON ``null``."""
    return df.select(*(F.coalesce(F.to_json(F.struct(F.col(f.name).alias("v")), {"ignoreNullFields": "false"})).alias(f.name) for f in df.schema.fields))


def from_lossless(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(*(F.from_json(f.name, T.StructType([T.StructField("v", f.dataType)]))["v"].alias(f.name) for f in schema.fields))


def write_lossless_csv(df: DataFrame, path: str) -> DataFrame:
    """Write, read again and compare both ways; returns what was read."""
    lossless(df).write.mode("errorifexists").csv(path, header=True, quote='"', escape='"', quoteAll=True)
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in df.schema.fields])
    again = from_lossless(df.sparkSession.read.schema(text).csv(path, header=True, quote='"', escape='"', multiLine=True), df.schema)
    if not (df.exceptAll(again).isEmpty() and again.exceptAll(df).isEmpty()):
        raise GateError(f"{path}: what was read differs from what was written")
    return again


def for_display(df: DataFrame, rule: str = "first") -> DataFrame:
    """Text cells that no spreadsheet takes for formulas."""
    return df.select(*(formula_safe(F.col(f.name), rule).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema.fields))


def fingerprint(df: DataFrame) -> tuple[int, int, int]:
    """Row count and two sums of row hashes: equal for equal multisets of rows, in any order.

    Sums keep how often a row occurs, which an exclusive or forgets. Both are modulo 2**64, of a hash and of its
    hash under another seed, so they can be added up over parts.
    """
    columns = ", ".join(f"`{f.name}`" if not isinstance(f.dataType, T.MapType) else f"array_sort(map_entries(`{f.name}`))" for f in df.schema.fields)
    h = F.expr(f"xxhash64({columns})") if df.columns else F.lit(0)
    # halves are added apart: a sum of 64-bit integers would overflow
    half = lambda x: [F.coalesce(F.sum(F.expr(e)), F.lit(0)) for e in (f"{x} & 4294967295", f"shiftrightunsigned({x}, 32)")]
    row = df.select(h.alias("h")).select("h", F.xxhash64("h", F.lit(1)).alias("g")).agg(F.count("*"), *half("h"), *half("g")).first()
    return row[0], row[1] + (row[2] << 32) & 2**64 - 1, row[3] + (row[4] << 32) & 2**64 - 1


def write_snapshot(df: DataFrame, root: str, version: str) -> DataFrame:
    """Parquet under ``root/version``, verified by reading it back.

    The manifest beside it holds the schema and the :func:`fingerprint`; :func:`read_snapshot` holds later reads
    against it. A version without a manifest was not finished, or differs from its source.
    """
    path = f"{root}/{version}"
    df.write.mode("errorifexists").parquet(path)
    spark = df.sparkSession
    again = spark.read.schema(df.schema).parquet(path)
    wanted, got = fingerprint(df), fingerprint(again)
    if got != wanted:
        raise GateError(f"{path}: the snapshot differs from its source")
    write_json(spark, {"schema": df.schema.jsonValue(), "rows": got[0], "hashes": [str(h) for h in got[1:]]}, f"{path}.manifest.json")
    return again


def read_snapshot(spark: SparkSession, root: str, version: str) -> DataFrame:
    """A snapshot whose rows still are those of its manifest."""
    path = f"{root}/{version}"
    manifest = read_config(spark, f"{path}.manifest.json")
    rows = spark.read.schema(T.StructType.fromJson(manifest["schema"])).parquet(path)
    if fingerprint(rows) != (manifest["rows"], *map(int, manifest["hashes"])):
        raise GateError(f"{path}: the snapshot differs from its manifest")
    return rows


def write_vectors(df: DataFrame, path: str, expected: int) -> DataFrame:
    """A vector table; a count other than ``expected`` is an error."""
    df.write.mode("errorifexists").parquet(path)
    again = df.sparkSession.read.parquet(path)
    if (n := again.count()) != expected:
        raise GateError(f"{path}: {n} vectors, {expected} expected")
    return again


def markdown_table(df: DataFrame, limit: int = 1000) -> str:
    """A report table; reports are small, and a larger frame is an error."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise GateError(f"a table of more than {limit} rows")
    cell = lambda x: "N/A" if x is None else f"{x:.3f}" if isinstance(x, float) else str(x).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows])
