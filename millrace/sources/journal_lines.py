"""Journals as a data source: lines with their byte offsets, by ranges of files, in batch and as a stream.

``spark.read.format("journal_lines").option("path", folder)`` gives ``(file, offset, line)``. A file is cut in ranges of
``splitBytes`` (longer ones where a read had more than :data:`MOST_RANGES`, or a batch of a stream more than :data:`FEW_RANGES` of less than :data:`BUFFER`); a task owns the lines that start in its range and reads on to end the last one, so one large journal is
many tasks' work and a line of any length is read once. Lines of white space alone are no rows. Names that begin with
``_`` or ``.`` are no journals.

``complete=true`` leaves out a last line without a line feed, which its writer may not have ended; a stream always
does. A stream's offset is the bytes taken of every file; ``maxBytes`` bounds what one batch takes, over all files, and
a restart goes on at the bytes of its checkpoint. Files may grow and new ones may come; nothing is held in memory but
one line and a buffer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "journal_lines"
LINES = "file string, offset long, line binary"
_LINES = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("line", pa.binary())])
SPLIT = 32 << 20
BUFFER, TAIL = 1 << 20, 1 << 16
#: Ranges of one read at most: beyond, each is longer than ``splitBytes`` asks for, as a task costs more than its bytes.
MOST_RANGES = 256
#: Ranges of a stream's batch that may be shorter than a buffer: beyond, they grow up to one, as a batch waits for all.
FEW_RANGES = 4


@dataclass
class _Range(InputPartition):
    path: str
    lo: int
    hi: int
    size: int


def _files(path: str) -> dict[str, int]:
    """Journals of a folder, or one journal, and their sizes."""
    fs, root = pafs.FileSystem.from_uri(path)
    prefix = path[: -len(root.rstrip("/"))] if path.endswith(root) and "://" in path else path[: path.find("://") + 3] if "://" in path else ""
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(root, recursive=True))
    below = lambda f: f.path[len(root) :] if f.path != root else f.base_name
    return {prefix + f.path: f.size for f in found if f.is_file and not any(p.startswith(("_", ".")) for p in below(f).strip("/").split("/"))}


def _complete(path: str, size: int, floor: int = 0) -> int:
    """The bytes of a journal up to its last line feed, looked for backwards down to ``floor``."""
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(name) as file:
        end = size
        while end > floor:
            begin = max(floor, end - BUFFER)
            file.seek(begin)
            at = file.read(end - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return floor


def lines_of(path: str, lo: int, hi: int, size: int) -> Iterator[tuple[int, bytes]]:
    """Lines that start in ``[lo, hi)`` of a file of ``size`` bytes, and their offsets."""
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(name) as file:
        # the byte before the range tells whether a line starts with it
        at = start = max(lo - 1, 0)
        file.seek(at)
        parts, skip = [], lo > 0
        while start < hi or skip:
            # up to the range's end, and then what its last line needs
            more = file.read(min(BUFFER, max(hi - at, TAIL), size - at)) if at < size else b""
            at += len(more)
            parts.append(more)
            if more and b"\n" not in more:
                continue
            text, _, rest = b"".join(parts).rpartition(b"\n") if more else (b"".join(parts), b"", b"")
            for line in text.split(b"\n"):
                if skip:
                    skip = False
                elif start >= hi:
                    return
                elif line.strip():
                    yield start, line
                start += len(line) + 1
            if not more:
                return
            parts = [rest]


def _batches(p: _Range) -> Iterator[pa.RecordBatch]:
    offsets, lines, held = [], [], 0
    for offset, line in lines_of(p.path, p.lo, p.hi, p.size):
        offsets.append(offset)
        lines.append(line)
        held += len(line) + 64
        if held > BUFFER:
            yield pa.RecordBatch.from_arrays([pa.array([p.path] * len(lines)), pa.array(offsets), pa.array(lines, pa.binary())], schema=_LINES)
            offsets, lines, held = [], [], 0
    if lines:
        yield pa.RecordBatch.from_arrays([pa.array([p.path] * len(lines)), pa.array(offsets), pa.array(lines, pa.binary())], schema=_LINES)


def _ranges(path: str, lo: int, hi: int, size: int, split: int) -> list[_Range]:
    return [_Range(path, at, min(at + split, hi), size) for at in range(lo, hi, split)]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitBytes", SPLIT))
        self.complete = str(options.get("complete", "false")).lower() == "true"

    def partitions(self) -> list[_Range]:
        files = {path: _complete(path, size) if self.complete else size for path, size in sorted(_files(self.path).items())}
        split = max(self.split, -(-sum(files.values()) // MOST_RANGES))
        out = [r for path, size in files.items() for r in _ranges(path, 0, size, size, split)]
        return out or [_Range("", 0, 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        return _batches(partition) if partition.path else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitBytes", SPLIT))
        self.most = int(options.get("maxBytes", 1 << 60))
        self.taken: dict[str, int] = {}
        self.ends: dict[str, tuple[int, int]] = {}  # size seen and complete bytes then

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        left = self.most
        for path, size in sorted(_files(self.path).items()):
            done = self.taken.get(path, 0)
            if self.ends.get(path, (-1, 0))[0] != size:
                self.ends[path] = size, _complete(path, size, done)
            take = min(self.ends[path][1] - done, left)
            if take > 0:
                self.taken[path] = done + take
                left -= take
        return dict(self.taken)

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        for path, at in end.items():  # after a restart the checkpoint says what was taken
            self.taken[path] = max(self.taken.get(path, 0), at)
        out, total = [], sum(max(hi - start.get(path, 0), 0) for path, hi in end.items())
        split = max(self.split, min(BUFFER, -(-total // FEW_RANGES)), -(-total // MOST_RANGES))
        for path, hi in sorted(end.items()):
            lo = start.get(path, 0)
            if hi > lo:
                # the bytes up to hi hold no torn line, but hi may stand within one: its line goes on behind it
                size = _files(path)[path] if path not in self.ends else self.ends[path][0]
                out += _ranges(path, lo, hi, size, split)
        return out or [_Range("", 0, 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        return _batches(partition) if partition.path else iter(())

    def commit(self, end: dict) -> None:
        pass


class JournalLines(DataSource):
    """See the module's documentation."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def streamReader(self, schema) -> _Stream:
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    """Make the source known to a session."""
    spark.dataSource.register(JournalLines)
