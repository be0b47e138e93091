"""Pages to chunks: repeated lines, sections, chunks, ids."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import collapse_blank_lines, heading
from millrace.operators.numbering import number_rows

# Fixed values of chunking.
TARGET, OVERLAP, LEAST = 1700, 220, 350
LEAST_SECTION = 40
#: What separates paragraphs.
GAP = "\n\n"


def line_key(line: Column) -> Column:
    """A line without case, outer spaces and digits."""
    return F.regexp_replace(F.lower(F.trim(line)), "[0-9]+", "#")


def lines_of(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    return pages.select(F.col(doc).alias("doc"), F.col(page).alias("page"), F.posexplode(F.split(text, "\r?\n")).alias("line_no", "line")).withColumn("key", line_key(F.col("line")))


def repeated_line_counts(lines: DataFrame) -> DataFrame:
    """Pages of a document on which each short line occurs; a line counts once a page."""
    short = lines.where(F.length("key").between(3, 80)).select("doc", "page", "key").distinct()
    return short.groupBy("doc", "key").agg(F.count("*").alias("n_pages"))


def strip_repeated_lines(lines: DataFrame, share: float = 0.5, least_pages: int = 6, page_counts: DataFrame | None = None) -> DataFrame:
    """Lines but for those on more than ``share`` of a document's pages, if it has at least ``least_pages``.

    ``page_counts(doc, pages)`` spares counting pages over their lines, where a table of pages is at hand.
    """
    pages = lines.groupBy("doc").agg(F.countDistinct("page").alias("pages")) if page_counts is None else page_counts
    counts = repeated_line_counts(lines).join(pages, "doc")
    gone = counts.where((F.col("pages") >= least_pages) & (F.col("n_pages") > share * F.col("pages"))).select("doc", "key")
    return lines.join(gone, ["doc", "key"], "left_anti")


def sections(lines: DataFrame) -> DataFrame:
    """Gaps and islands: a heading opens a section, what comes before one is the preamble; short sections are dropped.

    Heading lines are not part of the text.
    """
    order = Window.partitionBy("doc").orderBy("page", "line_no")
    marked = lines.withColumn("h", heading(F.col("line")))
    marked = marked.withColumn("island", F.sum(F.when(F.col("h").isNotNull(), 1).otherwise(0)).over(order))
    body = F.sort_array(F.collect_list(F.when(F.col("h").isNull(), F.struct("page", "line_no", "line"))))
    s = marked.groupBy("doc", "island").agg(F.first("h", ignorenulls=True).alias("h"), F.min(F.struct("page", "line_no"))["page"].alias("page"), body.alias("body"))
    text = F.trim(F.regexp_replace(collapse_blank_lines(F.array_join(F.col("body.line"), "\n")), r"\A[ \t\r\n]+|[ \t\r\n]+\z", ""))
    s = s.withColumn("text", text).where(F.length("text") >= LEAST_SECTION)
    name = lambda f: F.coalesce(F.col(f"h.{f}"), F.lit("Preamble"))
    return s.select("doc", "island", name("section_id").alias("section_id"), name("section_title").alias("section_title"), "page", "text")


def chunk_cuts(sizes: Sequence[int], target: int, overlap: int) -> list[tuple[int, int, bool]]:
    """Runs of paragraphs, as ``(first, end, led by an overlap)``; ``sizes`` count each paragraph with its separator.

    A run ends before the paragraph that would pass the target, but holds one at least; it hands on an overlap if it is
    longer than that itself.
    """
    ends = list(accumulate(sizes, initial=0))
    cuts: list[tuple[int, int, bool]] = []
    first, carried = 0, False
    while first < len(sizes):
        lead = overlap + len(GAP) if carried else 0
        end = max(first + 1, bisect_right(ends, target - lead + ends[first]) - 1)
        cuts.append((first, end, carried))
        carried = lead + ends[end] - ends[first] > overlap
        first = end
    return cuts


def pack(text: str, target: int = TARGET, overlap: int = OVERLAP, least: int = LEAST) -> list[str]:
    """Paragraphs packed up to ``target`` characters; a chunk starts with the end of the one before.

    Paragraphs and tables are never split, so a chunk can be longer; a short tail joins the chunk before it. Where the
    runs of paragraphs end follows from their lengths alone; the chunks are slices of the text between those places.
    """
    if len(text) <= target:
        return [text]
    paragraphs = [p for p in text.split(GAP) if p and not p.isspace()]
    body = "".join(p + GAP for p in paragraphs)
    at = list(accumulate((len(p) + len(GAP) for p in paragraphs), initial=0))
    runs: list[str] = []
    for first, end, carried in chunk_cuts([b - a for a, b in pairwise(at)], target, overlap):
        lead = runs[-1][-overlap:] + GAP if carried else ""
        runs.append(lead + body[at[first] : at[end]])
    chunks = [r.strip() for r in runs]
    if len(chunks) > 1 and len(chunks[-1]) < least:
        chunks[-2:] = [GAP.join(chunks[-2:])]
    return chunks


def chunk(sectioned: DataFrame) -> DataFrame:
    """Rows of ``sections`` as chunks with their part; the only step that carries state from word to word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [pack(t or "") for t in batch.column(batch.num_columns - 1).to_pylist()]
            rows = pa.array([i for i, parts in enumerate(lists) for _ in parts], pa.int32())
            cols = [c.take(rows) for c in batch.columns[:-1]]
            part = pa.array([k for parts in lists for k in range(1, len(parts) + 1)], pa.int32())
            text = pa.array([p for parts in lists for p in parts], pa.string())
            yield pa.RecordBatch.from_arrays([*cols, part, text], names=[*batch.schema.names[:-1], "part", "text"])

    names = [c for c in sectioned.columns if c != "text"]
    ddl = ", ".join(f"{c} {sectioned.schema[c].dataType.simpleString()}" for c in names)
    return sectioned.select(*names, "text").mapInArrow(run, f"{ddl}, part int, text string")


class PackChunks:
    """A table function: rows ``(doc, island, at, paragraph)`` of a section, in order, become its chunks.

    Its argument is a table partitioned by document and section and ordered by ``at``, so it never sees two sections at
    once; what it holds is one section.
    """

    COLUMNS = "doc long, island long, part int, text string"

    def __init__(self):
        self.key, self.paragraphs = None, []

    def eval(self, row):
        self.key = row["doc"], row["island"]
        self.paragraphs.append(row["paragraph"])

    def terminate(self):
        if self.key is not None:
            for part, text in enumerate(pack(GAP.join(self.paragraphs)), 1):
                yield *self.key, part, text


def chunk_by_function(sectioned: DataFrame) -> DataFrame:
    """As :func:`chunk`, ``(doc, island, part, text)``, by the table function over exploded paragraphs."""
    rows = sectioned.select("doc", "island", F.posexplode(F.split(F.coalesce("text", F.lit("")), GAP)).alias("at", "paragraph"))
    return F.udtf(PackChunks, returnType=PackChunks.COLUMNS)(rows.asTable().partitionBy("doc", "island").orderBy("at"))


def suffix_duplicates(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Ids made unique in order of arrival: the second is ``id~2``.

    Rows are numbered in one order of ids and arrival, by ranges, so an id with a third of all rows is no single task;
    a row's place among its id's is its number less that of the id's first row.
    """
    numbered = number_rows(rows, [key, order], "_n")
    first = numbered.groupBy(F.col(key).alias("_key")).agg(F.min("_n").alias("_first"))
    placed = numbered.join(first, F.col(key).eqNullSafe(F.col("_key"))).withColumn("_n", F.col("_n") - F.col("_first") + 1)
    name = F.when(F.col("_n") == 1, F.col(key)).otherwise(F.concat(F.col(key), F.lit("~"), F.col("_n").cast("string")))
    return placed.withColumn(key, name).drop("_n", "_key", "_first")


def thin_documents(pages: DataFrame, doc: str, text: str, least: int = 100) -> DataFrame:
    """Documents with fewer than ``least`` characters a page."""
    return pages.groupBy(doc).agg(F.sum(F.length(text)).alias("chars"), F.count("*").alias("pages")).where(F.col("chars") < least * F.col("pages"))


def lookup_first_match(rows: DataFrame, name: str, patterns: list[tuple[str, str]], default: Column) -> DataFrame:
    """The value of the first pattern (case ignored) that a name matches, else the default: one chained expression."""
    found = F
    for pattern, value in patterns:
        found = found.when(F.rlike(F.col(name), F.lit(f"(?i){pattern}")), F.lit(value))
    return rows.withColumn("matched", found.otherwise(default))
