"""Toxicity: a convolutional text classifier trained and applied in numpy.

Words (runs of letters and digits, lower-cased) are hashed to embeddings, the sum of one of the word and one of its
first bytes; filters of widths 1 to 3 slide over them, each is max-pooled over the whole text, and a logistic layer
reads the pools. Pooling makes training sparse: only the words under each filter's maximum get a gradient. Embeddings
start from log odds in the training rows; hashes whose log odds are not significant share the unknown embedding, and a
run of more unknown words than a filter is wide is cut to that width while training, which changes no maximum.

The threshold is calibrated for each language on rows held out of the fit, shrunk towards that of all rows where a
language has few, so that 0.7 is the calibrated threshold everywhere. The language is guessed from function words of the text; the columns of the table are never read.

Defined cases: null, empty and blank texts are scored as a text without words; a label null or missing teaches
nothing; several labels of an id count as their maximum; with fewer than :data:`LEAST_CLASS` training rows of either
class every score is 0; texts are scored whole; repeated rows give repeated results; an empty table an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.words import Words, chunks, split_words
from millrace.session import bounded_batches

#: Bound of the labelled rows that the classifier is fitted on, taken in hash order.
TRAIN_ROWS = 12_000
#: Bound of the words that a text gives to the fit (texts are scored whole), and the runs that a longer one gives them in.
FIT_WORDS, FIT_RUNS = 8192, 32
#: Of those, one in so many calibrates and stops the fit.
HOLD_OUT = 5
LEAST_CLASS = 10
THRESHOLD = 0.7
BUCKETS = 1 << 16
DIM, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
PAD = max(WIDTHS)
#: Buckets in fewer training rows, or with log odds of fewer standard errors, share the embedding of unknown words.
LEAST_ROWS = 6
LEAST_ODDS = 1.5
#: Toxic rows of a language at which its threshold is half its own and half that of all rows.
SHRINK = 10
#: Bytes of a word that its second embedding is for; shorter words have the first alone.
PREFIX = 6
EPOCHS, BATCH = 10, 128

_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Function words by which a language is guessed.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was with as be by on are this at from or an have not which",
    "de": "der die und das den von zu mit ist im für auf nicht ein eine dem des sich auch es als an er so",
    "fr": "le la les de des et un une du que qui dans en pour pas sur au avec est ce il par plus ne",
    "es": "el la los las de que y en un una por con para del se no es al lo como más su sus pero",
}
LANGUAGES = ("", *FUNCTION_WORDS)


def _hash_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words = split_words(texts, lower=True, inside=_LETTERS)
    return words.hashes(), words.first


def _hash_both(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, of their first bytes (0 for short words), and each text's words."""
    words = split_words(texts, lower=True, inside=_LETTERS)
    short = Words(words.data, words.start, np.minimum(words.end, words.start + PREFIX), words.first, words.offsets)
    return words.hashes(), np.where(words.end - words.start > PREFIX, short.hashes(1), np.uint64(0)), words.first


def _stop_table() -> tuple[np.ndarray, np.ndarray]:
    hashes, langs = [], []
    for i, lang in enumerate(FUNCTION_WORDS):
        for w in FUNCTION_WORDS[lang].split():
            hashes.append(int(_hash_words(pa.array([w]))[0][0]))
            langs.append(i)
    order = np.argsort(np.array(hashes, dtype=np.uint64))
    return np.array(hashes, dtype=np.uint64)[order], np.array(langs)[order]


def guess_language(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Index in :data:`LANGUAGES` of each text's language; 0 where no function word occurs."""
    table, langs = _stop_table()
    lo, hi = np.searchsorted(table, h, side="left"), np.searchsorted(table, h, side="right")
    counts = np.zeros((len(first), len(FUNCTION_WORDS)), dtype=np.int64)
    hit = np.flatnonzero(hi > lo)
    text = np.searchsorted(first, hit, side="right") - 1
    for step in range(int((hi - lo).max(initial=0))):  # a word may belong to several languages
        more = lo[hit] + step < hi[hit]
        np.add.at(counts, (text[more], langs[lo[hit][more] + step]), 1)
    counts = counts[:-1]
    return np.where(counts.sum(axis=1) > 0, counts.argmax(axis=1) + 1, 0)


@dataclass
class Network:
    """The classifier: rows of embeddings for known buckets (row 0: padding and unknown words), filters and output."""

    row_of: np.ndarray
    embed: np.ndarray
    filters: list[np.ndarray]  # width x DIM x FILTERS
    biases: list[np.ndarray]
    out: np.ndarray
    bias: float
    shift: np.ndarray  # by language: the calibrated threshold's logit

    def rows(self, h: np.ndarray, p: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two rows of every word of every text, padded, and offsets."""
        n = np.diff(first)
        at = np.concatenate([[0], np.cumsum(n + PAD)])
        out = np.zeros((at[-1], 2), dtype=np.int32)
        spot = np.repeat(at[:-1] - first[:-1], n) + np.arange(len(h))
        out[spot, 0], out[spot, 1] = self.row_of[_bucket(h)], self.row_of[_bucket(p) + BUCKETS]
        return out, at

    def logits(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        pools = []
        a, b = np.ascontiguousarray(rows[:, 0]), np.ascontiguousarray(rows[:, 1])
        edge = (at[1:, None] - np.arange(1, PAD)).ravel()
        for w, bias in zip(self.filters, self.biases, strict=True):
            tables = np.einsum("rd,kdf->krf", self.embed, w).astype(np.float32)
            total = tables[0][a] + tables[0][b]
            for k in range(1, len(w)):
                total[: len(a) - k] += tables[k][a[k:]] + tables[k][b[k:]]
            # windows that begin in a text's last padding would reach into the next text; they hold no words
            total[edge] = -np.inf
            pools.append(np.maximum(np.maximum.reduceat(total, at[:-1], axis=0) + bias, 0))
        return np.concatenate(pools, axis=1) @ self.out + self.bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        h, p, first = _hash_both(texts)
        z = self.logits(*self.rows(h, p, first)).astype(np.float64) - self.shift[guess_language(h, first)]
        return 1 / (1 + np.exp(-np.clip(z + np.log(THRESHOLD / (1 - THRESHOLD)), -50, 50)))


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(48)).astype(np.int64)


def _squeeze(rows: np.ndarray) -> np.ndarray:
    """Rows of a text with runs of unknown words cut to the widest filter, and padded."""
    known = rows.any(axis=1)
    upto = np.concatenate([[0], np.cumsum(known)])
    n = len(rows)
    lo = np.maximum(np.arange(n) - PAD, 0)
    keep = known | (upto[np.arange(n)] - upto[lo] > 0) | (np.arange(n) < PAD)
    # unknown words just before a known one count too
    hi = np.minimum(np.arange(n) + PAD, n)
    keep |= upto[hi] - upto[np.arange(n)] > 0
    return np.concatenate([rows[keep], np.zeros((PAD, 2), rows.dtype)])


def pack(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Both buckets of every word in 32 bits: all that training needs of a word."""
    return ((h >> np.uint64(48)) << np.uint64(16) | p >> np.uint64(48)).astype(np.uint32)


def _unpack(words: np.ndarray) -> np.ndarray:
    """Buckets of words and of first bytes, the latter from :data:`BUCKETS` on, as two columns."""
    return np.stack([words >> np.uint32(16), (words & np.uint32(0xFFFF)) + np.uint32(BUCKETS)], axis=1)


def _log_odds(texts: list[np.ndarray], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By bucket: texts that hold it, and its smoothed log odds over their standard error."""
    n, pos = np.zeros(2 * BUCKETS), np.zeros(2 * BUCKETS)
    for words, y in zip(texts, toxic, strict=True):
        held = np.unique(_unpack(np.unique(words)))
        n[held] += 1
        pos[held] += y
    share = toxic.mean()
    a, b = pos + 10 * share, n - pos + 10 * (1 - share)
    return n, (np.log(a / b) - np.log(share / (1 - share))) / np.sqrt(1 / a + 1 / b)


def fit(texts: list[np.ndarray], toxic: np.ndarray, langs: np.ndarray, hold: np.ndarray, seed: int = 11) -> Network | None:
    """Train on texts as packed words; rows that ``hold`` marks only calibrate and stop the fit."""
    train = np.flatnonzero(~hold)
    if min(toxic[train].sum(), (1 - toxic[train]).sum()) < LEAST_CLASS:
        return None
    rng = np.random.default_rng(seed)
    n, odds = _log_odds([texts[i] for i in train], toxic[train])
    known = np.flatnonzero((n >= LEAST_ROWS) & (np.abs(odds) >= LEAST_ODDS))
    known = known[known != BUCKETS]  # short words
    row_of = np.zeros(2 * BUCKETS, dtype=np.int32)
    row_of[known] = np.arange(1, len(known) + 1)
    embed = rng.normal(0, 0.05, (len(known) + 1, DIM)).astype(np.float32)
    embed[np.arange(1, len(known) + 1), (known >= BUCKETS).astype(int)] = np.clip(odds[known], -4, 8) / 4
    embed[0] = 0
    filters = [rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for w in filters:
        w[:, 0, 0] += 1.0 / len(w)  # three filters of each width start on the log odds
        w[:, 1, 1] += 1.0 / len(w)
        w[:, :2, 2] += 0.7 / len(w)
    biases = [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS]
    out = rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32)
    for k in range(3):
        out[k::FILTERS] += 0.3
    net = Network(row_of, embed, filters, biases, out, -2.0, np.zeros(len(LANGUAGES)))
    rows = [_squeeze(row_of[_unpack(words)]) for words in texts]
    slow = [np.zeros_like(x) for x in (embed, *filters, *biases, out)]
    slow_bias, best, kept, hold_at = 0.0, np.inf, None, np.flatnonzero(hold)

    def held_logits() -> np.ndarray:
        at = np.concatenate([[0], np.cumsum([len(rows[i]) for i in hold_at])])
        parts = []
        for lo in range(0, len(hold_at), 256):
            some = hold_at[lo : lo + 256]
            parts.append(net.logits(np.concatenate([rows[i] for i in some]), at[lo : lo + len(some) + 1] - at[lo]))
        return np.concatenate(parts)

    for _ in range(EPOCHS):
        order = rng.permutation(train)
        for lo in range(0, len(order), BATCH):
            some = order[lo : lo + BATCH]
            grad = [np.zeros_like(x) for x in (*filters, *biases)]
            spots, places, values = [], [], []
            for k, w in enumerate(filters):
                pos = np.empty((len(some), FILTERS), dtype=np.int64)
                val = np.empty((len(some), FILTERS))
                flat = np.concatenate([rows[i] for i in some])
                x = embed[flat[:, 0]] + embed[flat[:, 1]]
                total = x @ w[0]
                for j in range(1, len(w)):
                    total[: len(flat) - j] += x[j:] @ w[j]
                at = 0
                for i, doc in enumerate(some):
                    n_words = len(rows[doc]) - PAD + 1
                    part = total[at : at + n_words]
                    p = part.argmax(axis=0)
                    pos[i], val[i] = at + p, part[p, np.arange(FILTERS)]
                    at += len(rows[doc])
                spots.append(pos)
                places.append(flat)
                values.append(val + biases[k])
            pool = np.maximum(np.concatenate(values, axis=1), 0)
            drop = rng.random(pool.shape) > 0.2
            pool = pool * drop / 0.8
            p = 1 / (1 + np.exp(-np.clip(pool @ net.out + net.bias, -30, 30)))
            delta = (p - toxic[some]) / len(some)
            g_out, g_bias = pool.T @ delta + 1e-4 * net.out, delta.sum()
            g_pool = delta[:, None] * net.out[None, :] * drop / 0.8
            touched, steps = [], []
            for k, w in enumerate(filters):
                g = g_pool[:, k * FILTERS : (k + 1) * FILTERS] * (values[k] > 0)
                grad[len(filters) + k] += g.sum(axis=0)
                for j in range(len(w)):
                    word = places[k][np.minimum(spots[k] + j, len(places[k]) - 1)]
                    x = embed[word].sum(axis=2)  # texts x FILTERS x DIM
                    grad[k][j] += np.einsum("bf,bfd->df", g, x)
                    touched.append(word.reshape(-1, 2).T.ravel())
                    steps += [(g[:, :, None] * w[j].T[None]).reshape(-1, DIM)] * 2
            word, back = np.unique(np.concatenate(touched), return_inverse=True)
            g_embed = np.zeros((len(word), DIM))
            np.add.at(g_embed, back, np.concatenate(steps))
            g_embed[word == 0] = 0
            slow[0][word] += g_embed**2
            embed[word] -= 0.05 * g_embed / (np.sqrt(slow[0][word]) + 1e-6)
            for x, g, s in zip((*filters, *biases, net.out), (*grad, g_out), slow[1:], strict=True):
                s += g**2
                x -= 0.05 * g / (np.sqrt(s) + 1e-6)
            slow_bias += g_bias**2
            net.bias -= 0.05 * g_bias / (np.sqrt(slow_bias) + 1e-6)
        z = held_logits()
        loss = np.logaddexp(0, -z * (2 * toxic[hold_at] - 1)).mean() if len(hold_at) else 0.0
        if loss < best:
            best = loss
            kept = (embed.copy(), [w.copy() for w in filters], [b.copy() for b in biases], net.out.copy(), net.bias)
    net.embed, net.filters, net.biases, net.out, net.bias = kept
    embed = net.embed
    z = held_logits()
    net.shift = calibrate(z, toxic[hold_at], langs[hold_at])
    return net


def _threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The logit between two rows at which F1 is largest; the middle of the widest such gap."""
    order = np.argsort(-z)
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + max(y.sum(), 1))
    i = int(f1.argmax())
    below = z[order[i + 1]] if i + 1 < len(z) else z[order[i]] - 2
    return float((z[order[i]] + below) / 2)


def calibrate(z: np.ndarray, y: np.ndarray, langs: np.ndarray) -> np.ndarray:
    """Thresholds by language: each one's own, drawn towards that of all rows as if by :data:`SHRINK` toxic rows more.

    A language without toxic rows has that of all rows.
    """
    if not y.sum():
        return np.zeros(len(LANGUAGES))
    pooled = _threshold(z, y)
    out = np.full(len(LANGUAGES), pooled)
    for k in range(len(LANGUAGES)):
        own = langs == k
        if toxic := y[own].sum():
            out[k] = (toxic * _threshold(z[own], y[own]) + SHRINK * pooled) / (toxic + SHRINK)
    return out


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learnt: crc32 of the id as text, modulo 3, is 1. A row without an id has no label."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def spread(words: np.ndarray, first: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` words of each text (:data:`FIT_WORDS`), in :data:`FIT_RUNS` runs from all over it, and offsets."""
    most = most or FIT_WORDS
    size = np.diff(first)
    if (size <= most).all():
        return words, first
    parts, run = [], max(1, most // FIT_RUNS)
    for lo, n in zip(first[:-1].tolist(), size.tolist(), strict=True):
        if n <= most:
            parts.append(words[lo : lo + n])
        else:
            begins = lo + np.linspace(0, n - run, most // run).astype(np.int64)
            parts.append(words[(begins[:, None] + np.arange(run)).reshape(-1)])
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, seed: int = 11) -> Network | None:
    """Fit on at most ``rows`` labelled rows of ``docs``, none of them held out; None if a class is too small."""
    bounded_batches(docs.sparkSession)
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("order", F.xxhash64(F.lit(seed), F.col("doc_id")))
    marks = marks.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy("order", "doc_id").limit(rows)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1):
            h, p, first = _hash_both(batch.column(1))
            packed, at = spread(pack(h, p).view(np.int32), first)
            words = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(packed))
            lang = pa.array(guess_language(h, first).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), words, lang, batch.column(2), batch.column(3)], names=["doc_id", "words", "lang", "toxic", "order"])

    marks = F.broadcast(marks)  # at most `rows` rows
    sample = docs.select("doc_id", "text").join(marks, "doc_id").mapInArrow(hashed, "doc_id long, words array<int>, lang int, toxic int, order long")
    # an id may have many documents, so rows are cut again where the driver takes them
    table = sample.orderBy("order", "doc_id", F.xxhash64("words"), "words").limit(rows).toArrow()
    order = np.lexsort((table.column("doc_id").to_numpy(), table.column("order").to_numpy()))
    lists = table.column("words").combine_chunks()
    words, at = lists.values.to_numpy().view(np.uint32), lists.offsets.to_numpy()
    texts = [words[at[i] : at[i + 1]] for i in order]
    langs = table.column("lang").to_numpy()[order]
    toxic = table.column("toxic").to_numpy()[order].astype(np.float64)
    if not len(toxic):
        return None
    return fit(texts, toxic, langs, np.arange(len(toxic)) % HOLD_OUT == 0, seed)


def score(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a ``toxicity_score`` of every row in place of any such column; the text alone is read."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop("toxicity_score")
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, at):
            s = net.scores(batch.column(at)) if net else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], names=[*names, "toxicity_score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("toxicity_score", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """The contract's digest: scores of all ``documents`` by a network fitted on ``labels``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    net = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1):
            s = net.scores(batch.column(1)) if net else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], names=["doc_id", "score"])

    rows = docs.mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
