"""SentencePiece encoding and decoding: batched Viterbi over words in numpy.

Words of equal length advance together, one end position a step. Hashes of all substrings probe the sorted keys of the
pieces; at each position the vectorised maximum over piece lengths gives the best last piece, kept as a backpointer.

* Unigram models: the maximum is the sum of scores, the longest piece at ties.
* BPE models: a piece may follow the best last piece of the rest only if merging would leave both apart (undoing both
  pieces' merges, last one first, never meets a pair that merges earlier). Exactly one candidate passes, so the same
  dynamic program gives what merging by rank gives.

A word is a run of spaces with the characters up to the next space; no piece spans two words (checked when a model is
loaded), so words are independent and each distinct one is encoded once, with a bounded cache between batches.

Unbroken words of more than :data:`UNBROKEN` characters have nothing to advance with. They take the same steps one
character at a time over the pieces that end there, block by block: a state and a backpointer of a few bytes a
character are all that grows with the word, and which pieces stay apart is remembered by pair.

Defined cases: null and empty texts have no ids; unknown characters become byte pieces, or one unknown id a run where
a model has none; texts are encoded whole; repeated rows give repeated results; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import math
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.words import Words, chunks, mix64, text_bytes
from millrace.session import bounded_batches

SPACE = 0x2581
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Score of an unknown character below the smallest score of a unigram model.
UNKNOWN_PENALTY = 10.0
#: Largest model file that is sent to executors.
MAX_MODEL_BYTES = 32 << 20
#: Words longer than this are cut where no piece spans, and decoded one by one if still longer.
LONG_WORD = 64
#: Words longer than this are decoded alone, in blocks of as many characters.
UNBROKEN = 1 << 14
CACHE_WORDS = 1 << 20
_M = np.uint64(0x9E3779B97F4A7C15)


def _wire(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol buffer message: number and raw value."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, data[at : at + n]
            at += n


class Sorted:
    """Sorted 64-bit keys with values; where keys with the same leading bits begin is kept in a table."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        bits = max(1, int(4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        # a last key that no probe passes
        self.keys, self.values = np.append(keys[order], np.uint64(2**64 - 1)), np.append(values[order], -1)
        self.begin = np.searchsorted(self.keys[:-1] >> self.shift, np.arange((1 << bits), dtype=np.uint64))

    def probe(self, h: np.ndarray) -> np.ndarray:
        """Values of keys, -1 for others."""
        at = self.begin[h >> self.shift]
        key = self.keys[at]
        while len(late := np.flatnonzero(key < h)):
            at[late] += 1
            key[late] = self.keys[at[late]]
            if not (key[late] < h[late]).any():
                break
        return np.where(key == h, self.values[at], -1)


@dataclass
class Model:
    """A piece table with what encoding needs, as plain arrays."""

    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    model_type: int
    dummy_prefix: bool = True
    remove_extra: bool = False
    left: np.ndarray = field(default=None)
    right: np.ndarray = field(default=None)
    rank: np.ndarray = field(default=None)
    pair_keys: np.ndarray = field(default=None)
    pair_rank: np.ndarray = field(default=None)

    @classmethod
    def load(cls, data: bytes) -> Model:
        if len(data) > MAX_MODEL_BYTES:
            raise ValueError(f"a model of {len(data)} bytes; {MAX_MODEL_BYTES} are sent to executors at most")
        pieces, scores, kinds = [], [], []
        kind_of_model, prefix, extra, charsmap = UNIGRAM, True, True, b""
        for number, value in _wire(data):
            if number == 1:
                one = dict(_wire(value))
                pieces.append(one[1].decode())
                scores.append(struct.unpack("<f", one.get(2, b"\0\0\0\0"))[0])
                kinds.append(one.get(3, NORMAL))
            elif number == 2:
                kind_of_model = dict(_wire(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(_wire(value))
                prefix, extra, charsmap = bool(spec.get(3, 1)), bool(spec.get(4, 1)), spec.get(2, b"")
        if charsmap:
            raise ValueError("models with a normalisation table are not supported; normalise the text first")
        return cls(pieces, np.array(scores), np.array(kinds), kind_of_model, prefix, extra).prepare()

    def prepare(self) -> Model:
        if self.model_type not in (UNIGRAM, BPE):
            raise ValueError(f"model type {self.model_type} is not supported")
        usable = [i for i in range(len(self.pieces)) if self.kinds[i] in (NORMAL, USER_DEFINED) and self.pieces[i]]
        mark = chr(SPACE)
        for i in usable:
            if mark in self.pieces[i].lstrip(mark):
                raise ValueError(f"piece {self.pieces[i]!r} spans words")
        self.usable = np.array(usable)
        if self.model_type == BPE:
            self._merges({self.pieces[i]: i for i in usable})
        return self

    def _merges(self, index: dict[str, int]) -> None:
        """Ranks of pieces, the last merge of each and all pairs that merge, in ranks: single characters first."""
        order = sorted(index.values(), key=lambda i: (len(self.pieces[i]) > 1, -self.scores[i], i))
        self.rank = np.full(len(self.pieces), -1)
        self.rank[order] = np.arange(len(order))
        rank = {self.pieces[i]: r for r, i in enumerate(order)}
        self.left, self.right = np.arange(len(order) + 1), np.arange(len(order) + 1)
        pairs: dict[int, int] = {}
        reach = np.ones(len(order) + 1, dtype=bool)
        for r, i in enumerate(order):
            piece = self.pieces[i]
            for cut in range(1, len(piece)):
                a, b = rank.get(piece[:cut]), rank.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = r
            if len(piece) > 1:
                parts = [rank.get(c, -1) for c in piece]
                while len(parts) > 2:
                    best = min(((pairs.get(a << 32 | b, 1 << 60) if a >= 0 <= b else 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                    if best[0] >= 1 << 60:
                        break
                    parts[best[1] : best[1] + 2] = [best[0]]
                reach[r] = len(parts) == 2 and pairs.get(parts[0] << 32 | parts[1]) == r if min(parts) >= 0 else False
                if reach[r]:
                    self.left[r], self.right[r] = parts
        self.reach = reach
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_rank = np.array([pairs[k] for k in self.pair_keys.tolist()], dtype=np.int64)
        self.of_rank = np.array([*order, -1])

    @cached_property
    def keys(self) -> tuple[Sorted, int]:
        """Keys of all beginnings of usable pieces and the longest piece's length.

        Values are ranks for BPE, else ids; a beginning that is no piece has -2, so that probes can stop.
        """
        value = {self.pieces[i]: int(self.rank[i]) if self.model_type == BPE else i for i in self.usable.tolist()}
        starts = {p[:n] for p in value for n in range(1, len(p) + 1)}
        hashes = np.array([self._hash(p) for p in starts], dtype=np.uint64)
        return Sorted(hashes, np.array([value.get(p, -2) for p in starts])), max(map(len, value))

    @cached_property
    def pairs(self) -> Sorted:
        """Keys of pairs that merge, with the rank of what they make."""
        return Sorted(mix64(self.pair_keys.astype(np.uint64)), self.pair_rank)

    @cached_property
    def alone(self) -> np.ndarray:
        """Characters below 65,536 that no piece of several characters holds: words are cut around them."""
        out = np.ones(1 << 16, dtype=bool)
        for i in self.usable.tolist():
            if len(self.pieces[i]) > 1:
                out[[ord(c) for c in self.pieces[i] if ord(c) < 1 << 16]] = False
        out[SPACE] = False
        return out

    @staticmethod
    def _hash(piece: str) -> int:
        h, full = 0, 2**64 - 1
        for c in piece:  # as extend() does
            h = ((h + 1) * int(_M) & full) ^ ord(c)
            h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & full
            h = (h ^ h >> 27) * 0x94D049BB133111EB & full
            h ^= h >> 31
        return h

    @cached_property
    def bytes_of(self) -> list[bytes]:
        """What each id decodes to."""
        out = []
        for piece, kind in zip(self.pieces, self.kinds, strict=True):
            if kind == BYTE:
                out.append(bytes([int(piece[1:-1], 16)]))
            elif kind == CONTROL:
                out.append(b"")
            else:
                out.append((" ⁇ " if kind == UNKNOWN else piece.replace(chr(SPACE), " ")).encode())
        return out

    @cached_property
    def byte_ids(self) -> np.ndarray | None:
        found = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        return np.array([found[b] for b in range(256)]) if len(found) == 256 else None

    @cached_property
    def unknown(self) -> int:
        return int(np.flatnonzero(self.kinds == UNKNOWN)[0])

    @cached_property
    def joined(self) -> np.ndarray:
        """Sorted pairs of characters that follow each other inside some piece."""
        pairs = {ord(a) << 32 | ord(b) for i in self.usable for a, b in zip(self.pieces[i], self.pieces[i][1:], strict=False)}
        return np.array(sorted(pairs), dtype=np.int64)


def extend(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Hashes of strings from those of the strings without their last character."""
    with np.errstate(over="ignore"):
        return mix64((h + np.uint64(1)) * _M ^ c.astype(np.uint64))


def stays_apart(model: Model, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether BPE leaves pieces ``a`` and ``b`` (ranks) apart where they meet."""
    a, b = a.copy(), b.copy()
    apart = model.reach[b].copy()
    limit = np.full(len(a), np.iinfo(np.int64).max)
    live = np.flatnonzero(apart)
    while len(live):
        x, y = a[live], b[live]
        merged = model.pairs.probe(mix64((x << 32 | y).astype(np.uint64)))
        clash = (merged >= 0) & (merged < limit[live])
        apart[live[clash]] = False
        live = live[~clash]
        x, y = a[live], b[live]
        open_a, open_b = model.right[x] != x, model.left[y] != y
        # undo the later merge; of two that can be undone, the one with the higher rank
        undo_a = open_a & ((x > y) | ~open_b)
        undo_b = open_b & ~undo_a
        limit[live] = np.where(undo_a, x, np.where(undo_b, y + 1, 0))
        a[live] = np.where(undo_a, model.right[x], x)
        b[live] = np.where(undo_b, model.left[y], y)
        live = live[undo_a | undo_b]
    return apart


def _best(model: Model, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length and value of the last piece at every end position (columns 1..L) of equal-length words (rows)."""
    keys, longest = model.keys
    count, size = chars.shape
    longest = min(longest, size)
    found = np.full((longest + 1, count * size), -1, dtype=np.int64)  # by length and start
    live, h = np.arange(count * size), np.zeros(count * size, dtype=np.uint64)
    flat, room = chars.ravel(), size - np.arange(count * size) % size
    for n in range(1, longest + 1):
        if n > 1:
            more = (found[n - 1][live] != -1) & (room[live] >= n)  # beginnings of longer pieces only
            live, h = live[more], h[more]
        if not len(live):
            break
        h = extend(h, flat[live + n - 1])
        found[n][live] = keys.probe(h)
    found = found.reshape(longest + 1, count, size)
    back = np.ones((count, size + 1), dtype=np.int16)
    piece_at = np.full((count, size + 1), -1, dtype=np.int64)
    every = np.arange(count)
    if model.model_type == UNIGRAM:
        score = np.full((count, size + 1), -np.inf)
        score[:, 0] = 0
        penalty = float(model.scores[model.kinds == NORMAL].min(initial=0)) - UNKNOWN_PENALTY
        for end in range(1, size + 1):
            lengths = range(min(end, longest), 0, -1)  # the longest first: it wins ties
            options = []
            for n in lengths:
                piece = found[n, :, end - n]
                gain = np.where(piece >= 0, model.scores[piece], penalty if n == 1 else -np.inf)
                options.append(score[:, end - n] + gain)
            options = np.array(options)
            pick = options.argmax(axis=0)
            score[:, end] = options[pick, every]
            back[:, end] = min(end, longest) - pick
            piece_at[:, end] = np.maximum(found[back[:, end], every, end - back[:, end]], -1)
        return back, piece_at
    none = len(model.left) - 1  # an unknown character merges with nothing
    last = np.full((count, size + 1), none, dtype=np.int64)
    for end in range(1, size + 1):
        todo = np.ones(count, dtype=bool)
        for n in range(min(end, longest), 0, -1):
            piece = found[n, :, end - n]
            rows = np.flatnonzero(todo & (piece >= 0))
            if not len(rows):
                continue
            ok = stays_apart(model, last[rows, end - n], piece[rows])
            rows = rows[ok]
            last[rows, end], back[rows, end] = piece[rows], n
            todo[rows] = False
    return back, model.of_rank[last]


def _utf8(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of characters end to end, and how many each has."""
    n = 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)
    c, width = np.repeat(c.astype(np.int64), n), np.repeat(n, n)
    place = np.arange(len(c)) - np.repeat(np.cumsum(n) - n, n)
    low = (c >> (6 * (width - 1 - place))) & 0x3F | 0x80
    head = np.select([width == 1, width == 2, width == 3], [c, c >> 6 | 0xC0, c >> 12 | 0xE0], c >> 18 | 0xF0)
    return np.where(place == 0, head, low), n


def _ids(model: Model, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of equal-length words end to end, and how many each has."""
    back, piece = _best(model, chars)
    count, size = chars.shape
    ends = np.zeros((count, size + 1), dtype=bool)
    rows, at = np.arange(count), np.full(count, size)
    while len(rows):
        ends[rows, at] = True
        at = at - back[rows, at]
        rows, at = rows[at > 0], at[at > 0]
    row, end = np.nonzero(ends)
    return _known(model, piece[row, end], row, chars[row, end - 1], count)


def _known(model: Model, value: np.ndarray, row: np.ndarray, char: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids with unknown characters (-1) as bytes or as one unknown id a run, and how many each of ``count`` rows has."""
    if (value < 0).any():
        unknown = value < 0
        if model.byte_ids is None:
            value = np.where(unknown, model.unknown, value)
            again = np.append(False, unknown[1:] & unknown[:-1] & (row[1:] == row[:-1]))
            row, value = row[~again], value[~again]
        else:
            raw, n = _utf8(char[unknown])
            width = np.ones(len(value), dtype=np.int64)
            width[unknown] = n
            row, spread = np.repeat(row, width), np.repeat(unknown, width)
            value = np.repeat(value, width)
            value[spread] = model.byte_ids[raw]
    return value.astype(np.int32), np.bincount(row, minlength=count)


def decode_alone(model: Model, chars: np.ndarray, block: int = UNBROKEN) -> np.ndarray:
    """Ids of one long word: the steps of :func:`_best` for a single row, without a row of lengths for each character."""
    keys, longest = model.keys
    n, bpe = len(chars), model.model_type == BPE
    none = len(model.left) - 1 if bpe else -1
    last, back = array("i", [none]) * (n + 1), bytearray(b"\1") * (n + 1)
    score = array("d", [] if bpe else [-math.inf]) * (n + 1)
    if not bpe:
        score[0] = 0.0
    penalty = float(model.scores[model.kinds == NORMAL].min(initial=0)) - UNKNOWN_PENALTY
    scores = model.scores.tolist()
    apart: dict[int, bool] = {}
    for lo in range(0, n, block):  # pieces that end in lo + 1 .. lo + block
        hi, begin = min(lo + block, n), max(lo - longest + 1, 0)
        part = chars[begin:hi]
        live, h = np.arange(len(part)), np.zeros(len(part), dtype=np.uint64)
        ends, sizes, values = [], [], []
        for size in range(1, longest + 1):
            live, h = live[live + size <= len(part)], h[live + size <= len(part)]
            h = extend(h, part[live + size - 1])
            found = keys.probe(h)
            at = np.flatnonzero(((found >= 0) | (size == 1)) & (begin + live + size > lo))  # every character, if unknown
            ends.append(begin + live[at] + size)
            sizes.append(np.full(len(at), size))
            values.append(np.maximum(found[at], -1))
            live, h = live[found != -1], h[found != -1]  # beginnings of longer pieces only
        end, size, value = (np.concatenate(x) for x in (ends, sizes, values))
        order = np.lexsort((-size, end))
        if bpe:
            done = -1
            for e, k, v in zip(end[order].tolist(), size[order].tolist(), value[order].tolist(), strict=True):
                if e == done or v < 0:
                    continue
                pair = last[e - k] << 32 | v
                ok = apart.get(pair)
                if ok is None:
                    if len(apart) > CACHE_WORDS:
                        apart.clear()
                    ok = apart[pair] = bool(stays_apart(model, np.array([pair >> 32]), np.array([v]))[0])
                if ok:
                    last[e], back[e], done = v, k, e
            continue
        for e, k, v in zip(end[order].tolist(), size[order].tolist(), value[order].tolist(), strict=True):
            gain = score[e - k] + (scores[v] if v >= 0 else penalty)
            if gain > score[e]:
                score[e], last[e], back[e] = gain, v, k
    cuts = []
    at = n
    while at:
        cuts.append(at)
        at -= back[at]
    at = np.array(cuts[::-1])
    value = np.frombuffer(last, dtype=np.int32)[at]
    return _known(model, model.of_rank[value] if bpe else value, np.zeros(len(at), np.int64), chars[at - 1], 1)[0]


class Encoder:
    """Encodes batches of texts; keeps ids of distinct words up to :data:`CACHE_WORDS`."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.known, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _normal(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Code points of all texts with spaces escaped, and offsets."""
        data, offsets = text_bytes(texts)
        raw = data[:-8]
        points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
        at = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets]
        points = np.where(points == 32, SPACE, points).astype(np.uint32)
        if self.model.remove_extra:
            space = points == SPACE
            again = np.append(False, space[:-1])
            again[at[:-1][at[:-1] < len(points)]] = True  # a leading space goes too
            keep = ~(space & again)
            # a single trailing space goes as well
            last = at[1:][at[1:] > at[:-1]] - 1
            kept_at = np.concatenate([[0], np.cumsum(keep)])
            points, at = points[keep], kept_at[at]
            last = at[1:][at[1:] > at[:-1]] - 1
            keep = np.ones(len(points), dtype=bool)
            keep[last[points[last] == SPACE]] = False
            kept_at = np.concatenate([[0], np.cumsum(keep)])
            points, at = points[keep], kept_at[at]
        if self.model.dummy_prefix:
            full = at[1:] > at[:-1]
            points = np.insert(points, at[:-1][full], SPACE)
            at = at + np.concatenate([[0], np.cumsum(full)])
        return points, at

    def _words(self, points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        space = points == SPACE
        begin = space & ~np.append(False, space[:-1])
        begin[at[:-1][at[:-1] < len(points)]] = True
        alone = self.model.alone[np.minimum(points, 0xFFFF)]
        begin |= alone
        begin[1:] |= alone[:-1]
        start = np.flatnonzero(begin)
        long = np.flatnonzero(np.diff(np.append(start, len(points))) > LONG_WORD)
        if len(long):
            pairs, joined = points[:-1].astype(np.int64) << 32 | points[1:], self.model.joined
            ends = np.append(start, len(points))
            for i in long:
                inside = pairs[ends[i] : ends[i + 1] - 1]
                spot = np.minimum(np.searchsorted(joined, inside), len(joined) - 1)
                begin[ends[i] + 1 + np.flatnonzero(joined[spot] != inside)] = True
            start = np.flatnonzero(begin)
        return start, np.append(start[1:], len(points))

    def _learn(self, points: np.ndarray, start: np.ndarray, end: np.ndarray, keys: np.ndarray) -> None:
        if len(self.known) + len(keys) > CACHE_WORDS:
            self._forget()
        size = end - start
        ids, held, order = [], [], []
        for n in np.unique(size):
            rows = np.flatnonzero(size == n)
            step = max(1, (1 << 18) // int(n))
            for k in range(0, len(rows), step):
                some = rows[k : k + step]
                value, count = _ids(self.model, points[start[some][:, None] + np.arange(n)])
                ids.append(value)
                held.append(count)
                order.append(some)
        count, order = np.concatenate(held), np.concatenate(order)
        at = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, *ids])
        known = np.concatenate([self.known, keys[order]])
        sort = np.argsort(known)
        self.known = known[sort]
        self.at, self.size = np.concatenate([self.at, at])[sort], np.concatenate([self.size, count])[sort]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and n + 1 offsets."""
        points, at = self._normal(texts)
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        start, end = self._words(points, at)
        unbroken = end - start > UNBROKEN
        alone = np.flatnonzero(unbroken)
        long_ids = [decode_alone(self.model, points[start[i] : end[i]]) for i in alone]
        usual = np.flatnonzero(~unbroken)
        word_start, word_end = start[usual], end[usual]
        padded = np.append(points, np.zeros(2, np.uint32))
        h = Words(padded.view(np.uint8), word_start * 4, word_end * 4, np.array([0, len(usual)]), np.array([0, len(points) * 4])).hashes()
        keys, first, back = np.unique(h, return_index=True, return_inverse=True)
        new = np.flatnonzero(~np.isin(keys, self.known)) if len(self.known) else np.arange(len(keys))
        if len(self.known) + len(new) > CACHE_WORDS:
            self._forget()
            new = np.arange(len(keys))
        if len(new):
            self._learn(points, word_start[first[new]], word_end[first[new]], keys[new])
        spot = np.searchsorted(self.known, keys)
        size, begin = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        size[usual], begin[usual] = self.size[spot][back], self.at[spot][back]
        known = self.ids
        if len(alone):
            size[alone] = [len(x) for x in long_ids]
            begin[alone] = len(known) + np.concatenate([[0], np.cumsum(size[alone])[:-1]])
            known = np.concatenate([known, *long_ids])
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = known[np.repeat(begin - upto[:-1], size) + np.arange(upto[-1])]
        # an unknown run may cross a cut only where a model has no byte pieces
        if self.model.byte_ids is None:
            owner = np.repeat(np.searchsorted(at, start, side="right"), size)
            again = np.append(False, (ids[1:] == self.model.unknown) & (ids[:-1] == self.model.unknown) & (owner[1:] == owner[:-1]))
            upto = np.concatenate([[0], np.cumsum(~again)])[upto]
            ids = ids[~again]
        return ids, upto[np.searchsorted(start, at)]


def decode(model: Model, ids: np.ndarray) -> str:
    """The text of ``ids``; bytes that are no UTF-8 become replacement characters."""
    table = model.bytes_of
    text = b"".join([table[i] for i in ids.tolist()]).decode(errors="replace")
    return text[1:] if model.dummy_prefix and text.startswith(" ") else text


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, token_ids, n_byte_tokens, round_trip)`` for every row of ``docs``.

    ``round_trip`` says that decoding gives the text again, which holds for every text under byte fallback and identity
    normalisation, but for U+2581, which stands for a space.
    """
    bounded_batches(docs.sparkSession)
    with open(model_path, "rb") as file:
        model = Model.load(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        is_byte = model.kinds == BYTE
        for batch in chunks(batches, 1, 2 << 20):
            ids, at = encoder.encode(batch.column(1))
            texts = batch.column(1).fill_null("").to_pylist()
            same = [decode(model, ids[at[i] : at[i + 1]]) == t.replace(chr(SPACE), " ") for i, t in enumerate(texts)]
            fallback = np.concatenate([[0], np.cumsum(is_byte[ids])])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(at)),
                    pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)),
                    pa.array(fallback[at[1:]] - fallback[at[:-1]]),
                    pa.array(same),
                ],
                names=["id", "n_tokens", "token_ids", "n_byte_tokens", "round_trip"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n_tokens long, token_ids array<int>, n_byte_tokens long, round_trip boolean")
    return out.withColumnRenamed("id", id_col)


def default_model() -> str:
    """The 32,000-piece model of the installed public tokenizers."""
    return "/opt/tokenizers/piece_bpe_32k.model"


def op8_sentencepiece(spark, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """Ids of all ``documents`` and whether they decode to the text."""
    return encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_path or default_model())
