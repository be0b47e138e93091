"""Words of Arrow text batches as numpy arrays: boundaries and 64-bit hashes, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: White space of the contract: \\x20 and \\x09-\\x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M2
        x = (x ^ (x >> np.uint64(27))) * _M3
        return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of some texts laid end to end: the bytes (padded by 8), each word's start and end, each text's words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # words of text i are first[i]:first[i + 1]
    offsets: np.ndarray  # bytes of text i are offsets[i]:offsets[i + 1]

    def __len__(self) -> int:
        return len(self.first) - 1

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of every word, eight bytes a step."""
        size = self.end - self.start
        lanes = np.ndarray((len(self.data) - 7,), dtype="<u8", buffer=self.data, strides=(1,))
        with np.errstate(over="ignore"):
            h = size.astype(np.uint64) * _M1 + np.uint64(seed)
            live, at, left = None, self.start, size
            while True:
                lane = lanes[at] & _MASKS[np.minimum(left, 8)]
                if live is None:
                    h = mix64(h ^ lane)
                else:
                    h[live] = mix64((h[live] ^ lane) * _M1)
                more = np.flatnonzero(left > 8)
                if not len(more):
                    return h
                live = more if live is None else live[more]
                at, left = at[more] + 8, left[more] - 8


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of ``texts`` end to end, padded by 8 zeros, and n + 1 offsets; nulls count as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    if data is None or not len(texts):
        return np.zeros(8, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.zeros(int(at[-1] - at[0]) + 8, dtype=np.uint8)
    raw[:-8] = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]]
    return raw, at - at[0]


def split_words(texts: pa.Array, lower: bool = False, inside: np.ndarray = ~SPACE) -> Words:
    """Runs of bytes that ``inside`` marks, by default words ``[^\\x20\\x09-\\x0D]+``; ``lower`` lower-cases A-Z first."""
    data, offsets = text_bytes(texts)
    n = len(data) - 8
    if lower:
        data = LOWER[data]
    full = inside[data[:n]]
    fresh = np.ones(n + 1, dtype=bool)  # a word may start here: a text or space before it
    np.logical_not(full[:-1], out=fresh[1:n])
    fresh[offsets] = True
    start = np.flatnonzero(full & fresh[:n])
    end = np.flatnonzero(full & (fresh[1:] | ~np.append(full[1:], False))) + 1
    return Words(data, start, end, np.searchsorted(start, offsets), offsets)


def chunks(batches: Iterator[pa.RecordBatch], text: int, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut by rows so that texts (column ``text``) of a piece hold about ``max_bytes``; no text is cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes_offsets(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + max_bytes, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def text_bytes_offsets(texts: pa.Array) -> tuple[None, np.ndarray]:
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    buffer = texts.buffers()[1]
    if buffer is None:
        return None, np.zeros(len(texts) + 1, dtype=np.int64)
    at = np.frombuffer(buffer, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return None, at.astype(np.int64)


def shingles(words: Words, size: int = 5, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of ``size``-word shingles of every text, end to end, and n + 1 offsets.

    A text of fewer words has one shingle, its whole sequence; a text without words has none.
    """
    h = words.hashes(seed)
    n, first = len(h), words.first
    count = np.diff(first)
    with np.errstate(over="ignore"):
        run = mix64(h + _M1) if n else h
        for k in range(1, size):
            run[: max(n - k, 0)] = mix64(run[: max(n - k, 0)] * _M1 + h[k:])
    out = np.empty(n, dtype=np.uint64)
    held = np.zeros(len(words) + 1, dtype=np.int64)
    at = 0
    for i in range(len(words)):
        lo, hi = int(first[i]), int(first[i + 1])
        m = hi - lo
        if m >= size:
            part = np.sort(run[lo : hi - size + 1])
            keep = np.empty(len(part), dtype=bool)
            keep[0] = True
            np.not_equal(part[1:], part[:-1], out=keep[1:])
            part = part[keep]
            out[at : at + len(part)] = part
            at += len(part)
        elif m:
            with np.errstate(over="ignore"):
                x = mix64(h[lo : lo + 1] + np.uint64(m) * _M2)
                for k in range(1, m):
                    x = mix64(x * _M1 + h[lo + k])
            out[at] = x[0]
            at += 1
        held[i + 1] = at
    assert len(count) == len(words)
    return out[:at], held
