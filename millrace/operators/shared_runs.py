"""Pairs of texts that may be alike, found by runs of characters that they have to share.

From 200 characters on, every block that SequenceMatcher matches, but for one that may begin both texts, holds one of the
second text's rare characters. Where those stand bounds how much of the text blocks shorter than a window can cover, so
like texts share windows, and how many is known from the second text alone. A window is found by the rarest of its
runs of :data:`RUN` characters, which both texts choose alike, so texts meet at those hashes and are never all compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.numbering import number_rows
from millrace.session import discard, materialize

#: Characters of a hashed run, and lengths of windows: the second text takes one of these, the first one has to serve all.
RUN, WINDOWS = 12, (16, 24, 32, 48, 64)
#: A run that more texts hold makes no pairs; what it may stand for is taken from the windows that a pair has to share.
COMMON = 1000
#: Characters of texts, about, that runs are counted in, so that windows take rare ones, and bits of a run's place there.
COUNTED_CHARS, PLACES = 20_000_000, 24
#: A second text takes the longest window of which common runs may stand for this share, or that with the largest share.
SPARE = 0.08
#: Characters of texts a part of the runs, and pairs that a task holds at once.
PART_CHARS, HELD = 5_000_000, 1 << 22
#: The layout of a run: 25 bits of its hash, 31 of the text's number, 7 of its length's logarithm, 1 for a second text's.
STEP, LENGTHS = 1.1, 127


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _run_hashes(codes: np.ndarray) -> np.ndarray:
    """Hashes of all runs of 12 characters, by joining those of 1, 2, 4 and 8."""
    if len(codes) < RUN:
        return np.zeros(0, np.uint64)
    odd = np.uint64(0xD6E8FEB86659FD93)
    one = codes.astype(np.uint64) + np.uint64(1)
    two = one[:-1] * odd + one[1:]
    four = _mixed(two[:-2] * odd + two[2:])
    eight = four[:-4] * odd + four[4:]
    return _mixed(eight[:-4] * odd + four[8:])


def _sliding(x: np.ndarray, size: int, of: np.ufunc) -> np.ndarray:
    held = 1
    while held < size:
        step = min(held, size - held)
        x = of(x[:-step], x[step:])
        held += step
    return x


def _chosen(ranks: np.ndarray, window: int) -> np.ndarray:
    """Whether a run has the least rank of any window that it is in."""
    size = window - RUN + 1
    if len(ranks) < size:
        return np.zeros(len(ranks), bool)
    least = _sliding(ranks, size, np.minimum)
    return ranks == _sliding(np.pad(least, size - 1), size, np.maximum)


def covered(gaps: list[int], most: int) -> int:
    """Characters that blocks of at most ``most`` cover if each but one holds a rare character.

    ``gaps`` are the lengths between rare characters, with both ends. A block reaches back as far as nothing is covered
    yet, and forward with what it has left, which no other division of it betters.
    """
    total, spare, reach = most, 0, most - 1
    for gap in gaps[:-1]:
        ahead = gap if gap < spare else spare
        back = gap - ahead
        if back > reach:
            back = reach
        total += ahead + back + 1
        spare = reach - back
    return total + min(gaps[-1], spare)


def _ranks(hashes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Ranks of runs, rare ones first."""
    return levels[hashes >> np.uint64(64 - PLACES)].astype(np.uint64) << np.uint64(61) | hashes >> np.uint64(3)


def windows_shared(text: str, ranks: np.ndarray, left_out: int, least: float) -> tuple[int, int]:
    """The window that a second text takes, and how many of those it shares at least with a first one of that ratio.

    Windows whose run is of level ``left_out`` or above do not count: what they cover may be matched as well. The number
    is 0 where no window is sure to be shared: in short texts and where rare characters or common runs are dense.
    """
    n = len(text)
    if n < 200:
        return 0, 0
    codes = _codes(text)
    at = np.flatnonzero(np.bincount(codes)[codes] <= n // 100 + 1)
    gaps = (np.diff(at, prepend=-1, append=n) - 1).tolist()
    need = math.floor(n * least / (2 - least)) - 1  # matched with the shortest first text
    best, most = (0, 0), -1.0
    for window in WINDOWS:
        often = np.flatnonzero(_sliding(ranks, window - RUN + 1, np.minimum) >> np.uint64(61) >= left_out)
        free = window + int(np.minimum(np.diff(often), window).sum()) if len(often) else 0
        sure = -(-(need - free - covered(gaps, window - 1)) // window)
        if sure < 1:
            break
        # what common runs may stand for, as a share of the text's runs
        spare = (sure - 1) * (window - RUN + 2) / (2 * n)
        if spare >= min(most, SPARE):
            best, most = (window, sure), spare
    return best


def _measured(least: float, levels, left_out: int):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            found = [windows_shared(t, _ranks(_run_hashes(_codes(t)), levels.value), left_out, least) for t in batch["text"].to_pylist()]
            columns = [pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "window", "sure"])

    return measure


def _planes(x: bytes) -> bytes:
    """Numbers byte by byte, so that high bytes, which repeat, are compressed."""
    return np.frombuffer(x, np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(x: bytes, kind: type = np.uint64) -> np.ndarray:
    """The numbers of :func:`_planes`."""
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view(kind).ravel()


def _blobs(parts: np.ndarray, *columns: np.ndarray) -> Iterable[tuple[int, list[bytes]]]:
    """Each part's values as bytes."""
    order = np.argsort(parts, kind="stable")
    held, starts = np.unique(parts[order], return_index=True)
    columns = [c[order] for c in columns]
    for part, lo, hi in zip(held.tolist(), starts, [*starts[1:], len(order)], strict=True):
        yield part, [c[lo:hi].tobytes() for c in columns]


def _counted(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 1024) for b in batches for k in range(0, b.num_rows, 1024)):
            hashes = np.concatenate([np.unique(_run_hashes(_codes(t))) for t in batch["text"].to_pylist()])
            made = list(_blobs(hashes % np.uint64(parts), hashes))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in made], pa.int32()), pa.array([b for _, (b,) in made], pa.binary())], names=["part", "runs"])

    return run


def _often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (blobs,) in _by_part(batches, "runs"):
        held, counts = np.unique(np.frombuffer(b"".join(blobs), np.uint64), return_counts=True)
        held, counts = held[counts > 1], counts[counts > 1]
        levels = np.minimum(np.log2(counts), 7).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([(held >> np.uint64(64 - PLACES)).astype(np.uint32).tobytes()]), pa.array([levels.tobytes()])], names=["places", "levels"])


def _levels(texts: DataFrame, share: int) -> np.ndarray:
    """How often runs occur as a power of two, by the first bits of their hashes, in one text of ``share``.

    It decides which runs stand for windows and which are left out as common; texts are measured by the same choice, so
    no pair depends on the sample.
    """
    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).select("text")
    made = some.mapInArrow(_counted(16), "part int, runs binary").repartition(16, "part").mapInArrow(_often, "places binary, levels binary")
    table = np.zeros(1 << PLACES, np.uint8)
    for row in made.toLocalIterator():
        np.maximum.at(table, np.frombuffer(row.places, np.uint32), np.frombuffer(row.levels, np.uint8))
    return table


def _runs(parts: int, levels, left_out: int):
    def rows(held: list[np.ndarray], to: list[np.ndarray]) -> pa.RecordBatch:
        made = [(p, [_planes(b)]) for p, (b,) in _blobs(np.concatenate(to), np.concatenate(held))]
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in made], pa.int32()), pa.array([b for _, (b,) in made], pa.binary())], names=["part", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, to, size = [], [], 0
        for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            for number, text, window in zip(*(batch[c].to_pylist() for c in ("number", "text", "window")), strict=True):
                hashes = _run_hashes(_codes(text))
                ranks = _ranks(hashes, levels.value)
                at = np.flatnonzero(_chosen(ranks, WINDOWS[0]))
                if not len(at):
                    continue
                second = (_chosen(ranks, window) & (ranks >> np.uint64(61) < left_out))[at] if window else np.zeros(len(at), bool)
                kind = number << 8 | min(int(math.log(len(text), STEP)), LENGTHS) << 1
                hashes = hashes[at]
                held.append(hashes >> np.uint64(39) << np.uint64(39) | np.uint64(kind) | second.astype(np.uint64))
                to.append((hashes % np.uint64(parts)).astype(np.uint32 if parts > 1 << 16 else np.uint16))
                size += len(at)
                if size > HELD // 2:
                    yield rows(held, to)
                    held, to, size = [], [], 0
        if held:
            yield rows(held, to)

    return run


def _by_part(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[list[list[bytes]]]:
    """The blobs of each part of a task."""
    parts: dict[int, list[list[bytes]]] = {}
    for batch in batches:
        for part, *blobs in zip(*(batch[c].to_pylist() for c in ("part", *columns)), strict=True):
            for held, blob in zip(parts.setdefault(part, [[] for _ in columns]), blobs, strict=True):
                held.append(blob)
    for part in sorted(parts):
        yield parts.pop(part)


PAIR_ROWS = "part int, kind int, codes binary, hits binary"
PAIRS, COMMONS, SURE = 0, 1, 2


def _pair_rows(kind: int, seconds: np.ndarray, parts: int, codes: np.ndarray, hits: np.ndarray) -> pa.RecordBatch:
    made = list(_blobs((seconds % np.uint64(parts)).astype(np.uint32), codes, hits.astype(np.int64)))
    arrays = [pa.array([p for p, _ in made], pa.int32()), pa.array([kind] * len(made), pa.int32()), *(pa.array([_planes(b[k]) for _, b in made], pa.binary()) for k in (0, 1))]
    return pa.RecordBatch.from_arrays(arrays, names=["part", "kind", "codes", "hits"])


def _summed(codes: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, hits = codes[order], hits[order]
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[starts], np.add.reduceat(hits, starts) if len(codes) else hits


def _meetings(least: float, parts: int):
    """For every run: pairs of texts of like length, the lower number first, with how often the second one holds it."""
    apart = np.int64(math.floor(math.log((2 - least) / least, STEP) + 1e-9) + 1)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (blobs,) in _by_part(batches, "runs"):
            runs = np.sort(np.concatenate([_numbers(b) for b in blobs]))
            del blobs
            # a row a run and text
            starts = np.flatnonzero(np.concatenate([[True], runs[1:] >> np.uint64(8) != runs[:-1] >> np.uint64(8)]))
            hits = np.add.reduceat((runs & np.uint64(1)).astype(np.int64), starts)
            runs = runs[starts]
            number, size = runs >> np.uint64(8) & np.uint64((1 << 31) - 1), (runs >> np.uint64(1) & np.uint64(LENGTHS)).astype(np.int64)
            run = runs >> np.uint64(39)
            first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
            texts = np.diff(first, append=len(run))
            end = np.repeat(first + texts, texts)
            common = np.repeat(texts > COMMON, texts)
            at = np.flatnonzero(common & (hits > 0))
            if len(at):
                yield _pair_rows(COMMONS, *(lambda c, h: (c, parts, c, h))(*_summed(number[at], hits[at])))
            left, held, count, step = np.flatnonzero(~common), [], 0, 1
            while True:
                left = left[left + step < end[left]]
                if len(left):
                    a = left[(hits[left + step] > 0) & (np.abs(size[left] - size[left + step]) <= apart)]
                    held.append((number[a + step] << np.uint64(31) | number[a], hits[a + step]))
                    count += len(a)
                if held and (not len(left) or count > HELD):
                    codes, sums = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    yield _pair_rows(PAIRS, codes >> np.uint64(31), parts, codes, sums)
                    held, count = [], 0
                if not len(left):
                    break
                step += 1

    return meet


def _sure_rows(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                number = batch["number"].to_numpy(zero_copy_only=False).astype(np.uint64)
                yield _pair_rows(SURE, number, parts, number, batch["sure"].to_numpy(zero_copy_only=False))

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that share enough windows, and second texts whose common runs leave none that is sure, with a null first text."""
    for kinds, codes, hits in _by_part(batches, "kind", "codes", "hits"):
        table = {}
        for kind in (PAIRS, COMMONS, SURE):
            of = [k for k, x in enumerate(kinds) if x == kind]
            none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            table[kind] = _summed(np.concatenate([none[0], *(_numbers(codes[k]) for k in of)]), np.concatenate([none[1], *(_numbers(hits[k], np.int64) for k in of)]))
        (pairs, shared), (those, common), (number, sure) = table[PAIRS], table[COMMONS], table[SURE]
        left = sure.copy()
        left[np.searchsorted(number, those)] -= common
        second = pairs >> np.uint64(31)
        need = left[np.searchsorted(number, second)]
        at = np.flatnonzero((need > 0) & (shared >= need))
        alone = number[left < 1].astype(np.int64)
        a = pa.concat_arrays([pa.array((pairs[at] & np.uint64((1 << 31) - 1)).astype(np.int64)), pa.nulls(len(alone), pa.int64())])
        yield pa.RecordBatch.from_arrays([a, pa.array(np.concatenate([second[at].astype(np.int64), alone]))], names=["a", "b"])


def candidates(rows: DataFrame, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts ``(number, id, text)`` of ``rows`` (id, text, row; deleted if they are scratch) by id, pairs ``(a, b)`` of numbers, ``a < b``, and numbers ``b`` that are left.

    Every pair whose ratio is at least ``least``, the text of the lower number first, is among the pairs, or its second
    text is among those left, which have to be compared with all texts before them.
    """
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    share, parts = -(-chars // COUNTED_CHARS) or 1, -(-chars // PART_CHARS) or 1
    left_out = min(max(int(math.log2(max(COMMON / 2 / share, 1))), 1), 7)
    levels = rows.sparkSession.sparkContext.broadcast(_levels(rows, share))
    kind = rows.schema["id"].dataType.simpleString()
    # numbered without their texts, which are written once
    texts = rows.join(number_rows(rows.select("id", "row"), ["id", "row"], "number").select("row", "number"), "row").select("number", "id", "text")
    texts = materialize(texts.mapInArrow(_measured(least, levels, left_out), f"number long, id {kind}, text string, window long, sure long"), "measured-texts")
    discard(rows)
    runs = texts.select("number", "text", "window").mapInArrow(_runs(parts, levels, left_out), "part int, runs binary")
    met = runs.repartition(parts, "part").mapInArrow(_meetings(least, 2 * parts), PAIR_ROWS)
    met = met.unionByName(texts.select("number", "sure").mapInArrow(_sure_rows(2 * parts), PAIR_ROWS))
    kept = materialize(met.repartition(2 * parts, "part").mapInArrow(_kept, "a long, b long"), "like-texts")
    return texts.drop("window", "sure"), kept.where("a IS NOT NULL"), kept.where("a IS NULL").select("b")
