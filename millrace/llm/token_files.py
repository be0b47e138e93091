"""Token ids as compressed binary files: static range asymmetric numeral system over one shared frequency table.

Documents are encoded with a public tokenizer, an end id follows each, and the ids of all documents in order of their
id make one stream, cut in files by ranges of the document id. The counts of all ids of the corpus, scaled to a power
of two, are the table that every block uses; it is one small file beside the others.

A block holds :data:`BLOCK` ids over :data:`LANES` interleaved states (64 bits, 32-bit words) and depends on no other
block. Every :data:`CHECKPOINT` ids it keeps the states, the place in its words and the CRC-32 of the ids up to the
next one, so decoding may start at any checkpoint. numpy advances all lanes of all blocks of a segment together when
encoding, and all checkpoints of it when decoding. A segment is what one reading task owns: it lists the documents that
start in it, and its task reads on into the next segments, by checkpoints, to end its last document.

File, little endian: ``MRTOKENS``, head, segments, then each segment's place and size, and a tail. Whatever is read
back is held against its checksum, and each checkpoint's last states against the next one's.

Defined cases: a null text is empty and has the end id alone; a null id comes first; rows with equal ids follow each
other, ordered by a hash of their token ids (equal rows are interchangeable); a document may be longer than a segment;
an empty table writes the table only and reads no rows; other columns are not read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.words import LOWER, SPACE, Words, chunks, text_bytes
from millrace.session import bounded_batches, discard, materialize, qualified, scratch_path

LANES, CHECKPOINT, BLOCK, SEGMENT = 16, 1 << 12, 1 << 14, 1 << 21
#: Ids a file; more ids make more files.
FILE_IDS = 1 << 24
LOW = 1 << 31
MAGIC, TABLE_MAGIC, VERSION = b"MRTOKENS", b"MRTABLE1", 1
HEAD = struct.Struct("<8sIBxxxIIII")  # magic, version, scale bits, lanes, checkpoint, block, checksum of the table
SEGMENT_HEAD = struct.Struct("<QQIIII")  # ids before it in the file, start of its first document, ids, documents, blocks, checksum of these and the documents
BLOCK_HEAD = struct.Struct("<III")  # ids, words, checksum of these and the checkpoints
TAIL = struct.Struct("<QIIQ8s")  # place of the list, segments, checksum of the list, ids, magic
#: Pieces whose ids a worker keeps, and the slots of their table.
MOST_PIECES, TABLE_BITS = 600_000, 21
#: Bytes from which a text is encoded in parts.
LONG_TEXT = 4 << 20
#: Classes of bytes. Marks are what no tokenizer word and no special token begins with or joins to letters.
SPACES, LETTERS, MARKS, OTHER = range(4)
KIND = np.full(256, OTHER, dtype=np.uint8)
KIND[0x80:0xC0] = KIND[0xC3:0xCA] = LETTERS
KIND[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = LETTERS
KIND[list(b".,;:!?()[]{}\"#$%&*+-/=>@\\^_`|~")] = MARKS
KIND[SPACE] = SPACES
#: Multiplication and division signs, and the one Latin letter that lower-cases to two characters.
NOT_LETTERS = np.array([0xC397, 0xC3B7, 0xC4B0])
READ = "doc_id long, start long, n_tokens long, ids binary"


# --- tokenizing ---


class WordEncoder:
    """Ids of texts by a tokenizer that drops white space: pieces of words are encoded once and kept.

    Such a tokenizer never joins, composes or lower-cases across white space, and it parts letters from punctuation. So
    a word of Latin letters and ASCII punctuation is cut in its runs of either (letters of A-Z lower-cased, as the
    tokenizer does), any other word is one piece, and the ids of a text are those of its pieces. Pieces are met by a
    64-bit hash in an open table and held against their size and first eight bytes; a text whose pieces clash is
    encoded whole. ``apart=False`` encodes all texts whole, for tokenizers whose pieces hold spaces.
    """

    def __init__(self, path: str, end_id: int, apart: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id, self.apart = Tokenizer.from_file(path), end_id, apart
        added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        if apart and not all((KIND[list(t)] == OTHER).any() for t in added):
            raise ValueError("a special token of this tokenizer looks like a word: encode whole texts")
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids that end a run of letters
        if suffix:
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.keys, self.entry = np.zeros(1 << TABLE_BITS, np.uint64), np.zeros(1 << TABLE_BITS, np.int32)
        self.ids = np.array([self.end_id], dtype=np.uint32)
        self.at, self.size, self.sign = np.zeros(1, np.int64), np.ones(1, np.int64), np.zeros(1, np.uint64)  # entry 0 is the end

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, or -1."""
        out, live, slot = np.full(len(h), -1, np.int64), np.arange(len(h)), (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        while len(live):
            key = self.keys[slot]
            hit = key == h[live]
            out[live[hit]] = self.entry[slot[hit]]
            on = ~hit & (key != 0)
            live, slot = live[on], slot[on] + 1 & (1 << TABLE_BITS) - 1
        return out

    def _put(self, h: np.ndarray, first: int) -> None:
        live, slot = np.arange(len(h)), (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        while len(live):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[live[free]]
            mine = self.keys[slot] == h[live]  # of some that want one slot, one has it
            self.entry[slot[mine]] = first + live[mine]
            live, slot = live[~mine], slot[~mine] + 1 & (1 << TABLE_BITS) - 1

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self._library(texts)
        at = np.concatenate([[0], np.cumsum([len(f) + 1 for f in found], dtype=np.int64)])
        return np.fromiter(chain.from_iterable((*f, self.end_id) for f in found), np.uint32, int(at[-1])), at

    def _learn(self, pieces: list[bytes], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of pieces, of which ``letters`` are runs of letters: those go to the library many a text."""
        size, found = np.zeros(len(pieces), np.int64), [np.zeros(0, np.uint32)] * len(pieces)
        runs, rest = np.flatnonzero(letters & self.ends.any()).tolist(), np.flatnonzero(~(letters & self.ends.any())).tolist()
        joined = self._library([b" ".join([pieces[i] for i in runs[k : k + 256]]).decode() for k in range(0, len(runs), 256)])
        ids = np.fromiter(chain.from_iterable(joined), np.uint32)
        last = np.flatnonzero(self.ends[ids])
        if len(last) == len(runs):
            for i, lo, hi in zip(runs, [0, *(last[:-1] + 1).tolist()], (last + 1).tolist(), strict=False):
                found[i] = ids[lo:hi]
        else:
            rest = list(range(len(pieces)))
        for i, x in zip(rest, self._library([pieces[i].decode() for i in rest]), strict=True):
            found[i] = np.array(x, np.uint32)
        size[:] = [len(f) for f in found]
        return np.concatenate([np.zeros(0, np.uint32), *found]), size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each followed by the end id, and n + 1 offsets."""
        data, offsets = text_bytes(texts)
        if not self.apart:
            return self._whole(texts.fill_null("").to_pylist())
        if len(texts) == 1 and offsets[1] > LONG_TEXT:
            return self._long(data[: offsets[1]].tobytes())
        if len(self.at) > MOST_PIECES or len(self.ids) > 8 * MOST_PIECES:
            self.forget()
        start, end, plain = _pieces(data, offsets)
        low = LOWER[data]
        h, sign = _marks(low, start, end)
        odd = np.flatnonzero(~plain)
        h[odd], sign[odd] = _marks(data, start[odd], end[odd])
        entry = self._find(h)
        new = np.flatnonzero(entry < 0)
        if len(new):
            keys, first, back = np.unique(h[new], return_index=True, return_inverse=True)
            at = new[first]
            raw, lowered = data.tobytes(), low.tobytes()
            pieces = [(lowered if p else raw)[s:e] for s, e, p in zip(start[at].tolist(), end[at].tolist(), plain[at].tolist(), strict=True)]
            ids, size = self._learn(pieces, plain[at] & (KIND[data[start[at]]] == LETTERS))
            entry[new] = len(self.at) + back
            self._put(keys, len(self.at))
            self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(size) - size])
            self.size, self.sign = np.concatenate([self.size, size]), np.concatenate([self.sign, sign[at]])
            self.ids = np.concatenate([self.ids, ids])
        if (self.sign[entry] != sign).any():
            return self._whole(texts.fill_null("").to_pylist())
        first = np.searchsorted(start, offsets)
        entry = np.insert(entry, first[1:], 0)  # the end follows the pieces of each text
        size = self.size[entry]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.at[entry] - upto[:-1], size) + np.arange(upto[-1])]
        return ids, upto[first + np.arange(len(first))]

    def _long(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """A long text in parts that end before white space."""
        parts, lo = [], 0
        while lo < len(text):
            hi = len(text)
            if hi - lo > LONG_TEXT:
                space = re.compile(rb"[\x20\x09-\x0d]").search(text, lo + LONG_TEXT // 2)
                hi = space.start() if space else hi
            part = pa.array([text[lo:hi]], pa.binary()).view(pa.string())
            parts.append((self._whole([text[lo:hi].decode()]) if hi - lo > LONG_TEXT else self.encode(part))[0][:-1])
            lo = hi
        ids = np.concatenate([*parts, np.array([self.end_id], np.uint32)])
        return ids, np.array([0, len(ids)])


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each piece in padded bytes, and whether it is a run of a plain word."""
    n = int(offsets[-1])
    kind = KIND[data[:n]]
    lead = np.flatnonzero((data[:n] >= 0xC3) & (data[:n] <= 0xC9))
    pair = data[lead].astype(np.int32) << 8 | data[lead + 1]
    kind[lead[np.isin(pair, NOT_LETTERS) | (pair >= 0xC990)]] = OTHER
    inner = offsets[(offsets > 0) & (offsets < n)]
    before, after = np.full(n, SPACES, np.uint8), np.full(n, SPACES, np.uint8)
    before[1:], after[: max(n - 1, 0)] = kind[:-1], kind[1:]
    before[inner], after[inner - 1] = SPACES, SPACES
    full = kind != SPACES
    start = np.flatnonzero(full & (kind != before))
    opens = before[start] == SPACES
    word = np.cumsum(opens) - 1
    plain = np.ones(int(opens.sum()), bool)
    plain[word[np.searchsorted(start, np.flatnonzero(kind == OTHER), side="right") - 1]] = False
    keep = opens | plain[word]
    start, opens, word = start[keep], opens[keep], word[keep]
    end = np.flatnonzero(full & (after == SPACES))[word] + 1
    same = np.flatnonzero(~opens)  # a piece in a word ends the one before
    end[same - 1] = start[same]
    return start, end, plain[word]


def _marks(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of pieces, never 0, and a sign of their size and first eight bytes."""
    h = Words(data, start, end, np.array([0, len(start)]), np.array([0, len(data) - 8])).hashes()
    lanes = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    size = np.minimum(end - start, 8)
    first = lanes[start] << ((8 - size) * 8).astype(np.uint64)
    return np.maximum(h, np.uint64(1)), first ^ (end - start).astype(np.uint64)


@lru_cache(maxsize=1)
def encoder_of(path: str, end_id: int, apart: bool) -> WordEncoder:
    """One encoder a worker: the words that a task met are known to the next."""
    return WordEncoder(path, end_id, apart)


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    width = data.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def id_bytes(vocabulary: int) -> int:
    return 2 if vocabulary <= 1 << 16 else 4


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int, vocabulary: int, apart: bool = True) -> DataFrame:
    """``(doc_id, ids, counts)``: each document's ids and the end id as ``width``-byte little-endian integers.

    A task's last row has no ids and counts what it met: pairs of 64-bit integers, an id and its count.
    """
    bounded_batches(docs.sparkSession)
    width = id_bytes(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path, end_id, apart)
        met = np.zeros(vocabulary, np.int64)
        for batch in chunks(batches, 1):
            ids, at = encoder.encode(batch.column(1))
            met += np.bincount(ids, minlength=len(met))
            yield pa.RecordBatch.from_arrays([batch.column(0), _binary(ids.astype(f"<u{width}"), at), pa.nulls(batch.num_rows, pa.binary())], names=names)
        some = np.flatnonzero(met)
        if len(some):
            counts = np.stack([some, met[some]], axis=1).astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([counts], pa.binary())], names=names)

    names = ["doc_id", "ids", "counts"]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids binary, counts binary")


def _values(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Integers of a binary column end to end, and n + 1 offsets."""
    wide = pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat.view(f"<u{width}") if flat.ctypes.data % width == 0 else flat.copy().view(f"<u{width}"), (at - at[0]) // width


def count_ids(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs in all documents, by the counts of :func:`encode_documents`; the driver gets one row an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                found = np.frombuffer(raw, "<i8").reshape(-1, 2)
                counts[found[:, 0]] += found[:, 1]
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(counts[met])], names=["id", "n"])

    out = np.zeros(vocabulary, np.int64)
    for r in tokens.where("counts IS NOT NULL").select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r.id] = r.n
    return out


# --- the coder ---


@dataclass
class Table:
    """Frequencies of ids that add up to ``2 ** scale``, and what is derived from them."""

    scale: int
    freq: np.ndarray

    def __post_init__(self) -> None:
        if int(self.freq.sum(dtype=np.int64)) != 1 << self.scale:
            raise ValueError("frequencies do not add up")
        start = (np.cumsum(self.freq, dtype=np.int64) - self.freq).astype(np.uint64)
        self.both = self.freq.astype(np.uint64) << np.uint64(32) | start  # one look-up for frequency and start
        self.common = int(np.argmax(self.freq))  # fills up a step

    @classmethod
    def of(cls, counts: np.ndarray, scale: int | None = None) -> Table:
        """Every id that occurs gets at least one slot."""
        scale = scale or max(16, len(counts).bit_length() + 2)
        if scale > 30:
            raise ValueError(f"{len(counts)} ids are too many")
        slots = 1 << scale
        freq = np.where(counts > 0, np.maximum(1, np.floor(counts / max(1, counts.sum()) * slots)), 0).astype(np.int64)
        if not freq.any():
            freq[0] = slots
        order = np.argsort(-freq, kind="stable")
        spare = slots - int(freq.sum())
        if spare >= 0:
            freq[order[0]] += spare
        else:  # the many ones are taken from the largest, in proportion
            room = freq - (freq > 0)
            take = np.floor(room * (-spare / room.sum())).astype(np.int64)
            rest = -spare - int(take.sum())
            more = order[(room - take)[order] > 0][:rest]
            take[more] += 1
            freq -= take
        return cls(scale, freq.astype(np.uint32))

    @property
    def slots(self) -> np.ndarray:
        """The id of each slot."""
        return np.repeat(np.arange(len(self.freq), dtype=f"u{id_bytes(len(self.freq))}"), self.freq)

    def dump(self) -> bytes:
        body = TABLE_MAGIC + struct.pack("<II", self.scale, len(self.freq)) + zlib.compress(self.freq.astype("<u4").tobytes())
        return body + struct.pack("<I", zlib.crc32(body))

    @classmethod
    def load(cls, raw: bytes) -> Table:
        if raw[:8] != TABLE_MAGIC or struct.unpack("<I", raw[-4:])[0] != zlib.crc32(raw[:-4]):
            raise ValueError("the frequency table is damaged")
        scale, n = struct.unpack("<II", raw[8:16])
        return cls(scale, np.frombuffer(zlib.decompress(raw[16:-4]), "<u4", n))

    @property
    def crc(self) -> int:
        return zlib.crc32(self.freq.astype("<u4").tobytes())


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))


def _encode_blocks(table: Table, ids: np.ndarray, n: int) -> list[bytes]:
    """Blocks of equal step counts: ``ids`` (blocks, steps * LANES), of which the last block has ``n`` real ids."""
    blocks, steps = len(ids), ids.shape[1] // LANES
    symbols = ids.reshape(blocks, steps, LANES)
    every, scale, up = CHECKPOINT // LANES, np.uint64(table.scale), np.uint64(63 - table.scale)
    state = np.full((blocks, LANES), LOW, dtype=np.uint64)
    words, sent = np.zeros((steps, blocks, LANES), np.uint32), np.zeros((steps, blocks, LANES), bool)
    states = np.zeros((-(-steps // every), blocks, LANES), np.uint64)
    half, low = np.uint64(32), np.uint64(0xFFFFFFFF)
    for t in range(steps - 1, -1, -1):
        both = table.both[symbols[:, t]]
        freq = both >> half
        full = state >= freq << up
        words[t], sent[t] = state.astype(np.uint32), full
        state = np.where(full, state >> half, state)
        q, r = np.divmod(state, freq)
        state = (q << scale) + r + (both & low)
        if t % every == 0:
            states[t // every] = state
    held = np.concatenate([np.zeros((1, blocks), np.int64), np.cumsum(sent.sum(axis=2), axis=0)])
    words, sent = words.transpose(1, 0, 2), sent.transpose(1, 0, 2)
    out = []
    for b in range(blocks):
        real = n if b == blocks - 1 else ids.shape[1]
        points = b"".join(
            struct.pack("<II", held[k * every, b], _crc(ids[b, k * CHECKPOINT : min((k + 1) * CHECKPOINT, real)])) + states[k, b].astype("<u8").tobytes() for k in range(len(states))
        )
        sizes = struct.pack("<II", real, held[-1, b])
        out.append(sizes + struct.pack("<I", zlib.crc32(points, zlib.crc32(sizes))) + points + words[b][sent[b]].astype("<u4").tobytes())
    return out


def encode_ids(table: Table, ids: np.ndarray) -> list[bytes]:
    """The blocks of some ids: full ones together, then the rest filled up to whole steps with the most common id."""
    whole = len(ids) // BLOCK
    out = _encode_blocks(table, ids[: whole * BLOCK].reshape(whole, BLOCK), BLOCK) if whole else []
    rest = ids[whole * BLOCK :]
    if len(rest):
        padded = np.full(-(-len(rest) // LANES) * LANES, table.common, dtype=ids.dtype)
        padded[: len(rest)] = rest
        out += _encode_blocks(table, padded[None, :], len(rest))
    return out


POINT = 8 + 8 * LANES


@dataclass
class _Block:
    n: int
    words: np.ndarray
    offset: np.ndarray  # of each checkpoint in the words
    crc: np.ndarray
    states: np.ndarray


def _block(raw: memoryview, at: int) -> tuple[_Block, int]:
    begin = at + BLOCK_HEAD.size
    if begin > len(raw):
        raise ValueError("a block is cut off")
    n, n_words, crc = BLOCK_HEAD.unpack_from(raw, at)
    count = -(-n // CHECKPOINT)
    points, end = raw[begin : begin + count * POINT], begin + count * POINT + 4 * n_words
    if zlib.crc32(points, zlib.crc32(raw[at : at + 8])) != crc or end > len(raw):
        raise ValueError("a block's checkpoints are damaged")
    table = np.frombuffer(points, np.uint8).reshape(count, POINT)
    head = np.ascontiguousarray(table[:, :8]).view("<u4")
    block = _Block(n, np.frombuffer(raw, "<u4", n_words, begin + count * POINT), head[:, 0].astype(np.int64), head[:, 1], np.ascontiguousarray(table[:, 8:]).view("<u8"))
    return block, end


def decode_blocks(table: Table, blocks: list[_Block], first: int, last: int, slots: np.ndarray) -> np.ndarray:
    """Ids ``[first, last)`` of blocks laid end to end, decoding only the checkpoints that hold them."""
    picked, begin, at = [], None, 0
    for b in blocks:
        for k in range(len(b.offset)):
            size = min(CHECKPOINT, b.n - k * CHECKPOINT)
            if at < last and at + size > first:
                begin = at if begin is None else begin
                picked.append((b, k, size))
            at += size
    if not picked:
        return np.zeros(0, np.uint32)
    # all words end to end; a checkpoint reads on from its own place
    base, pool, upto = {}, [], 0
    for b, _, _ in picked:
        if id(b) not in base:
            base[id(b)] = upto
            pool.append(b.words)
            upto += len(b.words)
    pool = np.append(np.concatenate(pool), np.uint32(0)) if upto else np.zeros(1, np.uint32)
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(picked)
    steps_of = np.array([-(-size // LANES) for _, _, size in picked])
    mask, scale, half, low = np.uint64((1 << table.scale) - 1), np.uint64(table.scale), np.uint64(32), np.uint64(LOW)
    right = np.uint64(0xFFFFFFFF)
    for steps in np.unique(steps_of):
        some = np.flatnonzero(steps_of == steps)
        state = np.stack([picked[i][0].states[picked[i][1]] for i in some]).astype(np.uint64)
        place = np.array([base[id(picked[i][0])] + picked[i][0].offset[picked[i][1]] for i in some])
        got = np.empty((len(some), steps, LANES), np.uint32)
        for t in range(steps):
            slot = state & mask
            s = slots[slot]
            got[:, t] = s
            both = table.both[s]
            state = (both >> half) * (state >> scale) + slot - (both & right)
            short = state < low
            order = np.cumsum(short, axis=1)
            word = pool[np.minimum(place[:, None] + order - 1, len(pool) - 1)]
            state = np.where(short, state << half | word, state)
            place += order[:, -1]
        for row, i in enumerate(some):
            block, k, size = picked[i]
            after = block.states[k + 1] if k + 1 < len(block.states) else np.full(LANES, LOW, np.uint64)
            ids = got[row].reshape(-1)[:size]
            if _crc(ids) != block.crc[k] or not (after == state[row]).all():
                raise ValueError("ids do not fit their checksum")
            out[i] = ids
    return np.concatenate(out)[first - begin : last - begin]


# --- files ---


class _SegmentWriter:
    """Collects documents and writes a segment whenever it has its ids."""

    def __init__(self, out, table: Table):
        self.out, self.table = out, table
        self.size = out.write(HEAD.pack(MAGIC, VERSION, table.scale, LANES, CHECKPOINT, BLOCK, table.crc)) or HEAD.size
        self.ids: list[np.ndarray] = []
        self.held, self.done, self.docs, self.n_docs = 0, 0, [], 0
        self.listed: list[tuple[int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids), self.done + self.held))
        self.n_docs += 1
        while len(ids):
            part = ids[: SEGMENT - self.held]
            self.ids.append(part)
            self.held += len(part)
            ids = ids[len(part) :]
            if self.held == SEGMENT:
                self.flush()

    def flush(self) -> None:
        if not self.held and not self.docs:
            return
        ids = np.concatenate(self.ids)
        names = np.array([0 if d[0] is None else d[0] for d in self.docs], "<i8").tobytes()
        docs = names + np.array([d[1] for d in self.docs], "<i8").tobytes() + np.array([d[0] is None for d in self.docs], np.uint8).tobytes()
        blocks = encode_ids(self.table, ids)
        head = SEGMENT_HEAD.pack(self.done, self.docs[0][2] if self.docs else 0, len(ids), len(self.docs), len(blocks), 0)[:-4]
        raw = b"".join([head, struct.pack("<I", zlib.crc32(docs, zlib.crc32(head))), docs, *blocks])
        self.listed.append((self.size, len(raw)))
        self.out.write(raw)
        self.size += len(raw)
        self.done += len(ids)
        self.ids, self.held, self.docs = [], 0, []

    def close(self) -> None:
        self.flush()
        body = np.array(self.listed, "<u8").tobytes()
        tail = TAIL.pack(self.size, len(self.listed), zlib.crc32(body), self.done, MAGIC)
        self.out.write(body + tail)
        self.size += len(body) + len(tail)
        self.out.close()


def _put(fs: pafs.FileSystem, temporary: str, final: str) -> None:
    # a repeated attempt has the same ids; some stores do not move onto a file
    if fs.get_file_info(final).type != pafs.FileType.NotFound:
        fs.delete_file(final)
    fs.move(temporary, final)


def _writer(folder: str, width: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        segments = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if segments is None:
                fs, root = pafs.FileSystem.from_uri(folder)
                with fs.open_input_file(f"{root}/table") as file:
                    table = Table.load(file.read())
                temporary, final = f"{root}/.part-{part:06d}-{attempt}", f"{root}/part-{part:06d}.tokens"
                segments = _SegmentWriter(fs.open_output_stream(temporary, compression=None), table)
            ids, at = _values(batch.column(1), width)
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                segments.add(doc_id, ids[at[i] : at[i + 1]].copy())
        if segments is not None:
            segments.close()
            _put(fs, temporary, final)
            row = {"part": [part], "path": [f"{folder}/part-{part:06d}.tokens"], "bytes": [segments.size], "n_ids": [segments.done], "n_docs": [segments.n_docs]}
            yield pa.RecordBatch.from_pydict(row)

    return write


@dataclass
class TokenFile:
    path: str
    bytes: int
    n_ids: int
    n_docs: int


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1, apart: bool = True, file_ids: int = FILE_IDS) -> list[TokenFile]:
    """Write ``docs(doc_id, text)`` to ``folder`` and return its files in order, one for about ``file_ids`` ids.

    Texts are encoded once and kept as scratch ids until the files stand. A range of the document id, then of a hash
    of the ids and of the row, is a file: rows that share one id are spread too. The driver gets a row an id of the
    vocabulary and a row a file.
    """
    spark = docs.sparkSession
    from tokenizers import Tokenizer

    vocabulary = max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1)
    folder = qualified(spark, folder)
    tokens = materialize(encode_documents(docs, tokenizer_path, end_id, vocabulary, apart), "ids")
    counts = count_ids(tokens, vocabulary)
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/table", compression=None) as file:
        file.write(Table.of(counts).dump())
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("ids"), F.col("row")]
    count = max(spark.sparkContext.defaultParallelism, -(-int(counts.sum()) // file_ids))
    rows = tokens.where("counts IS NULL").select("doc_id", "ids").withColumn("row", F.monotonically_increasing_id()).repartitionByRange(count, *keys).sortWithinPartitions(*keys)
    written = rows.select("doc_id", "ids").mapInArrow(_writer(folder, id_bytes(vocabulary)), "part long, path string, bytes long, n_ids long, n_docs long").collect()  # a row a file
    discard(tokens)
    return [TokenFile(r.path, r.bytes, r.n_ids, r.n_docs) for r in sorted(written, key=lambda r: r.part)]


def _listed(file, size: int) -> tuple[list[tuple[int, int]], int]:
    """Place and size of each segment, and the ids of the file."""
    file.seek(size - TAIL.size)
    place, count, crc, n_ids, magic = TAIL.unpack(file.read(TAIL.size))
    file.seek(place)
    body = file.read(16 * count)
    if magic != MAGIC or zlib.crc32(body) != crc:
        raise ValueError("the list of segments is damaged")
    return [(int(a), int(b)) for a, b in np.frombuffer(body, "<u8").reshape(count, 2)], n_ids


class _Segment:
    def __init__(self, file, place: int, size: int):
        file.seek(place)
        raw = memoryview(file.read(size))
        self.before, self.first_start, self.n, n_docs, n_blocks, crc = SEGMENT_HEAD.unpack_from(raw)
        at, end = SEGMENT_HEAD.size, SEGMENT_HEAD.size + 17 * n_docs
        if zlib.crc32(raw[at:end], zlib.crc32(raw[: at - 4])) != crc:
            raise ValueError("a segment's documents are damaged")
        self.doc_id = np.frombuffer(raw, "<i8", n_docs, at)
        self.length = np.frombuffer(raw, "<i8", n_docs, at + 8 * n_docs)
        self.null = np.frombuffer(raw, np.uint8, n_docs, at + 16 * n_docs).astype(bool)
        self.blocks = []
        for _ in range(n_blocks):
            block, end = _block(raw, end)
            self.blocks.append(block)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that start in the given segments."""
    for batch in batches:
        for r in batch.to_pylist():
            fs, path = pafs.FileSystem.from_uri(r["path"])
            with fs.open_input_file(path.rpartition("/")[0] + "/table") as file:
                table = Table.load(file.read())
            with fs.open_input_file(path) as file:
                magic, version, scale, lanes, every, block, crc = HEAD.unpack(file.read(HEAD.size))
                if (magic, version, scale, lanes, every, block, crc) != (MAGIC, VERSION, table.scale, LANES, CHECKPOINT, BLOCK, table.crc):
                    raise ValueError(f"{r['path']} does not fit its table")
                listed, _ = _listed(file, r["size"])
                segment, slots = _Segment(file, *listed[r["segment"]]), table.slots
                if not len(segment.length):
                    continue
                end = segment.first_start + np.cumsum(segment.length)
                start = end - segment.length
                first, last = int(start[0]) - segment.before, int(end[-1]) - segment.before
                parts = [decode_blocks(table, segment.blocks, first, min(last, segment.n), slots)]
                left, k = last - segment.n, r["segment"] + 1
                while left > 0:  # the last document goes on
                    more = _Segment(file, *listed[k])
                    parts.append(decode_blocks(table, more.blocks, 0, min(left, more.n), slots))
                    left, k = left - more.n, k + 1
                ids = np.concatenate(parts).astype("<u4", copy=False)
                at = np.append(start, end[-1]) - start[0]
                for lo in range(0, len(start), 4096):
                    hi = min(lo + 4096, len(start))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(segment.doc_id[lo:hi], mask=segment.null[lo:hi]),
                            pa.array(r["base"] + start[lo:hi]),
                            pa.array(segment.length[lo:hi]),
                            _binary(ids[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )


def read_tokens(spark: SparkSession, files: list[TokenFile]) -> DataFrame:
    """The documents of files in order: id, ids of all before it, own ids (end included) as little-endian 32-bit integers."""
    bounded_batches(spark)
    rows, base = [], 0
    for f in files:
        rows.append((qualified(spark, f.path), f.bytes, base))
        base += f.n_ids

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                fs, path = pafs.FileSystem.from_uri(r["path"])
                with fs.open_input_file(path) as file:
                    count = len(_listed(file, r["size"])[0])
                yield pa.RecordBatch.from_pydict({"path": [r["path"]] * count, "size": [r["size"]] * count, "base": [r["base"]] * count, "segment": list(range(count))})

    schema = "path string, size long, base long"
    listed = spark.createDataFrame(rows, schema).mapInArrow(segments, f"{schema}, segment long")
    count = max(1, min(100_000, sum(-(-f.n_ids // SEGMENT) for f in files)))
    return listed.repartition(count, F.xxhash64("path", "segment")).mapInArrow(_reader, READ)


def default_tokenizer() -> str:
    """The word BPE of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op12_token_files(spark, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """The contract's digest of all ``documents``, written as files and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    files = write_tokens(docs, scratch_path(spark, "tokens"), tokenizer_path or default_tokenizer())
    return read_tokens(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
