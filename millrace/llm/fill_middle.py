"""Fill-in-middle: texts cut in three at unit boundaries and laid out anew between sentinels.

A unit is a run of ASCII letters or one other code point. A byte automaton (:data:`NEXT`, :data:`EMIT`) reads a text
once: it steps over UTF-8 continuation bytes, opens a unit, and recognises a sentinel at its last byte; what a
transition emits is counted. The second pass looks the drawn cuts up in those counts. The automaton's state depends on
the last two bytes only (checked when its table is built), so the states of all bytes of a batch are two table look-ups
and no loop over bytes; counts are kept a block of 4,096 bytes, so a long text costs two bytes a byte.

Sentinels begin with ``<`` and hold no other, so text and sentinels laid end to end never form a further one, and
splitting an output at its sentinels gives the three parts back.

Defined cases: a null text is empty; an empty text, and a text that holds a sentinel, is plain; a null id is drawn as
the empty string would be; equal ids draw the same numbers (cuts differ with the number of units); repeated rows stay;
texts of any length are read whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.words import chunks, text_bytes
from millrace.session import bounded_batches

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"

#: Classes of bytes. BEFORE stands for what precedes a text.
LETTER, NAME, OPEN, CLOSE, POINT, CONTINUATION, BEFORE = range(7)
#: States: outside letters, within letters, after ``<``, after ``<`` and a sentinel's letter.
OUTSIDE, WORD, OPENED, NAMED = range(4)
#: What transitions emit, as bits.
UNIT, CODE_POINT, SENTINEL = 1, 2, 4

CLASS = np.full(256, POINT, dtype=np.uint8)
CLASS[0x80:0xC0] = CONTINUATION
CLASS[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = LETTER
CLASS[[ord("P"), ord("S"), ord("M")]] = NAME
CLASS[ord("<")], CLASS[ord(">")] = OPEN, CLOSE


def _table() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emission by state and class."""
    step, emit = np.zeros((4, 7), dtype=np.uint8), np.zeros((4, 7), dtype=np.uint8)
    for state in range(4):
        letters = state in (WORD, NAMED)
        step[state] = [WORD, NAMED if state == OPENED else WORD, OPENED, OUTSIDE, OUTSIDE, OUTSIDE, OUTSIDE]
        emit[state] = UNIT | CODE_POINT
        emit[state, [LETTER, NAME]] = CODE_POINT if letters else UNIT | CODE_POINT
        emit[state, [CONTINUATION, BEFORE]] = 0
        if state == NAMED:
            emit[state, CLOSE] |= SENTINEL
    return step, emit


NEXT, EMIT = _table()
#: The state after any two classes, whatever was before them.
AFTER = NEXT[NEXT[OUTSIDE]]
if not (NEXT[NEXT] == AFTER).all():
    raise AssertionError("the automaton remembers more than two bytes")
#: The emission of a byte by the classes of the two before it and its own.
EMITS = EMIT[AFTER].reshape(-1)

BLOCK_BITS = 12
_STEP = 1 << 20


def scan(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """What the automaton emits at every byte of the texts laid end to end in ``data[: offsets[-1]]``."""
    n = int(offsets[-1])
    out = np.empty(n, dtype=np.uint8)
    starts = offsets[:-1][np.diff(offsets) > 0]
    for lo in range(0, n, _STEP):
        hi = min(lo + _STEP, n)
        # classes from two bytes before the step on
        kind = np.full(hi - lo + 2, BEFORE, dtype=np.uint8)
        back = min(2, lo)
        kind[2 - back :] = CLASS[data[lo - back : hi]]
        first, second = kind[:-2].copy(), kind[1:-1].copy()
        here = starts[(starts >= lo - 1) & (starts < hi)] - lo
        second[here[here >= 0]] = BEFORE
        first[here[here >= 0]] = BEFORE
        after = here + 1
        first[after[after < hi - lo]] = BEFORE
        at = (first.astype(np.uint16) * 7 + second) * 7 + kind[2:]
        out[lo:hi] = EMITS[at]
    return out


class Counts:
    """Ranks and places of one emitted bit, by sums of blocks."""

    def __init__(self, emitted: np.ndarray, bit: int):
        self.flags = np.append((emitted & bit) != 0, False)
        blocks = np.add.reduceat(self.flags, np.arange(0, len(self.flags), 1 << BLOCK_BITS), dtype=np.int64)
        self.upto = np.concatenate([[0], np.cumsum(blocks)])

    def before(self, at: np.ndarray) -> np.ndarray:
        """Emissions before each place."""
        block = at >> BLOCK_BITS
        begin = block << BLOCK_BITS
        pairs = np.stack([begin, at], axis=1).reshape(-1)
        inside = np.add.reduceat(self.flags, pairs, dtype=np.int64)[::2] if len(pairs) else np.zeros(0, np.int64)
        return self.upto[block] + np.where(begin < at, inside, 0)

    def place(self, rank: int) -> int:
        """The place of the emission with ``rank`` others before it."""
        block = int(np.searchsorted(self.upto, rank, side="right")) - 1
        begin = block << BLOCK_BITS
        return begin + int(np.flatnonzero(self.flags[begin : begin + (1 << BLOCK_BITS)])[rank - self.upto[block]])


def _strings(parts: list[bytes]) -> pa.Array:
    sizes = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=sizes[1:])
    return pa.Array.from_buffers(pa.string(), len(parts), [None, pa.py_buffer(sizes), pa.py_buffer(b"".join(parts))])


def _transform(plain_percent: int, spm_percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 5):
            data, offsets = text_bytes(batch.column(5))
            emitted = scan(data, offsets)
            units, points, marks = (Counts(emitted, bit) for bit in (UNIT, CODE_POINT, SENTINEL))
            first_unit, held = units.before(offsets), np.diff(marks.before(offsets))
            n = np.diff(first_unit)
            h1, h2, h3, h4 = (batch.column(i).to_numpy() for i in range(1, 5))
            low, high = np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))
            plain = (n == 0) | (held > 0) | (h3 % 100 >= 100 - plain_percent)
            spm = h4 % 100 < spm_percent
            one, two = offsets[:-1].copy(), offsets[1:].copy()
            out = []
            for i in range(batch.num_rows):
                begin, end = int(offsets[i]), int(offsets[i + 1])
                if plain[i]:
                    out.append(data[begin:end].tobytes())
                    continue
                # the unit that a cut stands before; after the last one a cut is the text's end
                a = units.place(int(first_unit[i] + low[i])) if low[i] < n[i] else end
                b = units.place(int(first_unit[i] + high[i])) if high[i] < n[i] else end
                one[i], two[i] = a, b
                prefix, middle, suffix = data[begin:a].tobytes(), data[a:b].tobytes(), data[b:end].tobytes()
                head = (SUFFIX, suffix, PREFIX, prefix) if spm[i] else (PREFIX, prefix, SUFFIX, suffix)
                out.append(b"".join((*head, MIDDLE, middle)))
            starts, cut, end = points.before(offsets[:-1]), points.before(one), points.before(two)
            form = np.where(plain, PLAIN, np.where(spm, SPM, PSM)).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(form, pa.string()), pa.array(cut - starts, mask=plain), pa.array(end - cut, mask=plain), _strings(out)],
                names=["id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return run


def draws(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers: the first 8-digit groups of the SHA-256 of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """``(id, n, form, prefix_chars, middle_chars, output)`` for every row: units, layout, lengths in code points, new text.

    ``plain_percent`` of texts stay as they are, ``spm_percent`` of the others put the suffix first. One map step: no
    shuffle, and a lost executor repeats its own tasks only.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), *draws(F.col(id_col), seed), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_transform(plain_percent, spm_percent), f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("id", id_col)


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    part = F.split(output, "<[PSM]>")
    prefix, suffix = F.when(form == SPM, part[2]).otherwise(part[1]), F.when(form == SPM, part[1]).otherwise(part[2])
    return F.when(form == PLAIN, output).otherwise(F.concat(prefix, part[3], suffix))


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of all ``documents``."""
    out = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output"), 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
