"""Exact and fuzzy overlap with protected texts, and reasons why a record may not be used."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.sequence import Text, ratio_from
from millrace.functions.text import norm_key
from millrace.operators.shared_runs import candidates
from millrace.session import discard, materialize, qualified, scratch_path

#: Up to so many characters of protected texts are sent to every executor; more are joined by shuffle.
SENT_CHARS = 32 << 20
RUN = 5


def with_runs(rows: DataFrame, words: str, out: str, shorter: bool = False) -> DataFrame:
    """``rows`` with hashes of all runs of :data:`RUN` words, made by joining runs of 1, 2 and 4 words.

    With ``shorter``, runs of 1, 2 and 4 words come before them, and none are null.
    """
    n = F.size(words)
    later = lambda c, k: F.slice(c, F.lit(k + 1), F.greatest(n, F.lit(1)))
    pair = lambda x, y: F.when(y.isNotNull(), F.xxhash64(x, y))
    rows = rows.withColumn("_1", F.transform(words, lambda w: F.xxhash64(w)))
    # a projection a step, so that no array is made twice; runs past the end are null
    rows = rows.withColumn("_2", F.zip_with("_1", later("_1", 1), pair))
    rows = rows.withColumn("_4", F.zip_with("_2", later("_2", 2), pair))
    rows = rows.withColumn(out, F.zip_with("_4", later("_1", RUN - 1), pair))
    if shorter:
        rows = rows.withColumn(out, F.array_compact(F.concat("_1", "_2", "_4", out)))
    return rows.drop("_1", "_2", "_4")


def containment(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """Pairs of a record and a protected text that it contains, both normalised.

    Items of more than :data:`RUN` + 1 words are blocked on one of their word runs, which every containing record has
    to hold; shorter ones, few by nature, are compared with every record. Up to :data:`SENT_CHARS` characters of items
    are sent to the records, whose runs are then probed where they are made: nothing but pairs is shuffled. Beyond, runs
    are shuffled to the items and records joined again for the pairs.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), norm_key(F.col(text)).alias("text"))
    i = items.select(F.col(item_id).alias("item_id"), norm_key(F.col(item_text)).alias("item")).where("item <> ''").withColumn("words", F.split("item", " "))
    # a record may begin or end inside a word of the item, so the key leaves the item's outer words out
    long, short = i.where(F.size("words") >= RUN + 2), i.where(F.size("words") < RUN + 2)
    keyed = with_runs(long.withColumn("words", F.slice("words", 2, RUN)), "words", "runs").select("item_id", "item", F.col("runs")[0].alias("key"))
    few = (i.agg(F.sum(F.length("item"))).first()[0] or 0) <= SENT_CHARS
    whole = with_runs(d.withColumn("words", F.split("text", " ")), "words", "runs").drop("words")
    if few:
        found = whole.select("doc_id", "text", F.explode(F.array_distinct("runs")).alias("key")).join(F.broadcast(keyed), "key")
        found = found.where(F.contains("text", F.col("item"))).select("doc_id", "item_id")
    else:
        runs = whole.select("doc_id", F.explode(F.array_distinct("runs")).alias("key")).where("key is not null")
        found = runs.join(keyed, "key").select("doc_id", "item_id", "item").distinct().join(d, "doc_id").where(F.contains("text", F.col("item"))).select("doc_id", "item_id")
    rest = d.join(F.broadcast(short) if few else short, F.contains(d.text, short.item))
    return found.union(rest.select("doc_id", "item_id")).distinct()


def equal_texts(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """Pairs equal after normalisation: a plain equi join."""
    d = docs.select(F.col(doc_id).alias("doc_id"), norm_key(F.col(text)).alias("k"))
    i = items.select(F.col(item_id).alias("item_id"), norm_key(F.col(item_text)).alias("k"))
    return d.join(i, "k").select("doc_id", "item_id")


#: Counters of a text, by hash: of its characters and of its runs of :data:`GRAM` characters.
CHARS, GRAMS, GRAM = 64, 1024, 4
#: Lengths of longer runs and their counters: what few counters leave, as unlike runs share them, is asked of more.
LONG_GRAMS = ((8, 4096), (8, 16384))
#: Characters of texts whose rare characters a task keeps listed.
PLACED_CHARS = 1 << 21
#: Tasks at most; more tiles than that share tasks.
MOST_TASKS = 100_000
#: Rows and characters of a block of texts; a task holds two.
BLOCK_ROWS, BLOCK_CHARS = 2048, 1 << 22


def _gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    n = max(len(codes) - q + 1, 0)
    h = np.zeros(n, np.uint64)
    for k in range(q):
        h = (h + codes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _counters(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, int]:
    """Counts by bucket, up to 255, and what lies above."""
    full = np.bincount((hashes % np.uint64(buckets)).astype(np.int64), minlength=buckets)
    held = np.minimum(full, 255)
    return held.astype(np.uint8), int((full - held).sum())


def _profile(text: str) -> tuple[int, str, bytes, int, bytes, int, bytes]:
    """Length, characters and counters of what SequenceMatcher indexes of this text as the second one, and counters with their excess.

    From 200 characters on it seeds matches only at characters that make up at most a hundredth of the second text, so
    each block holds one of those, but for one that may begin both texts.
    """
    codes = _codes(text)
    n = len(codes)
    kinds, counts = np.unique(codes, return_counts=True)
    seeds = (kinds, counts) if n < 200 else (kinds[counts <= n // 100 + 1], counts[counts <= n // 100 + 1])
    rare = np.bincount((_gram_hashes(seeds[0], 1) % np.uint64(CHARS)).astype(np.int64), weights=seeds[1], minlength=CHARS).astype(np.int32)
    chars, more_chars = _counters(_gram_hashes(codes, 1), CHARS)
    grams, more_grams = _counters(_gram_hashes(codes, GRAM), GRAMS)
    return n, "".join(map(chr, seeds[0].tolist())), rare.tobytes(), more_chars, chars.tobytes(), more_grams, grams.tobytes()


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(k, 512) for b in batches for k in range(0, b.num_rows, 512)):
        columns = zip(*map(_profile, batch.column(1).to_pylist()), strict=True)
        kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.binary())
        arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=["id", "text", "band", "part", "n", "indexed", "rare", "more_chars", "chars", "more_grams", "grams"])


def _banded(rows: DataFrame, ratio: float) -> tuple[DataFrame, dict[int, int]]:
    """Texts with their length band, and the number of blocks of each band."""
    # bands of a fixed ratio, a little wider for rounding: texts that may match lie in the same or in neighbouring bands
    band = F.floor(F.log(F.length("text").cast("double")) / F.lit(-math.log(ratio) * 1.0001)).cast("int")
    rows = rows.where("text <> ''").withColumn("band", band)
    sizes = rows.groupBy("band").agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars")).collect()
    return rows, {r.band: max(-(-r.rows // BLOCK_ROWS), -(-r.chars // BLOCK_CHARS)) for r in sizes}


def _write_blocks(rows: DataFrame, parts: dict[int, int], name: str) -> str:
    """Writes the texts of the bands in ``parts`` with their counters, block by block, and returns the folder."""
    folder = qualified(rows.sparkSession, scratch_path(rows.sparkSession, name))
    if parts:
        of = F.create_map(*(F.lit(x) for item in parts.items() for x in item))
        placed = rows.where(F.col("band").isin(*parts)).withColumn("part", F.pmod(F.xxhash64("id", "text"), of[F.col("band")]).cast("int"))
        kind = rows.schema["id"].dataType.simpleString()
        made = placed.repartition(sum(parts.values()), "band", "part").mapInArrow(_profiles, f"id {kind}, text string, band int, part int, n long, indexed string, rare binary, more_chars long, chars binary, more_grams long, grams binary")
        made.write.partitionBy("band", "part").parquet(folder)
    return folder


def _shared(x: np.ndarray, y: np.ndarray, m: int) -> np.ndarray:
    """Sums of the smaller counters, a row each; a text of ``m`` characters counts no more than those."""
    return np.minimum(x, y).sum(axis=1, dtype=np.uint16 if m < 1 << 16 else np.int64).astype(np.int64)


def _matches(a: pa.Table, b: pa.Table, least: float, below: bool) -> tuple[list[int], list[int], list[float]]:
    """Rows of both blocks whose ratio is at least ``least``; only what the bounds leave is compared."""
    column = lambda t, c: t[c].to_numpy()
    counters = lambda t, c, k: np.frombuffer(b"".join(t[c].to_pylist()), np.uint8).reshape(-1, k)
    n, more_chars, chars, more_grams, grams = column(a, "n"), column(a, "more_chars"), counters(a, "chars", CHARS), column(a, "more_grams"), counters(a, "grams", GRAMS)
    order = np.argsort(n, kind="stable")
    n, more_chars, chars, more_grams, grams = n[order], more_chars[order], chars[order], more_grams[order], grams[order]
    b_chars, b_grams = counters(b, "chars", CHARS), counters(b, "grams", GRAMS)
    rare = np.frombuffer(b"".join(b["rare"].to_pylist()), np.int32).reshape(-1, CHARS)
    chars = np.ascontiguousarray(chars.T)  # a row a counter, as neighbouring texts are summed at once
    open_chars = chars.astype(np.int32)
    open_chars[chars == 255] = np.iinfo(np.int32).max  # a full counter bounds nothing
    a_ids, b_ids = a["id"].combine_chunks(), b["id"].combine_chunks()
    tables = a, b
    texts: dict[tuple[int, int], Text] = {}
    placed = 0
    long = {(side, *k): (np.zeros((t.num_rows, k[1]), np.uint8), np.full(t.num_rows, -1, np.int64)) for side, t in enumerate(tables) for k in LONG_GRAMS}

    def text_of(side: int, i: int) -> Text:
        nonlocal placed
        if (side, i) not in texts:
            if placed > PLACED_CHARS:
                texts.clear()
                placed = 0
            texts[side, i] = Text(tables[side]["text"][i].as_py(), tables[side]["indexed"][i].as_py())
            placed += len(texts[side, i].text)
        return texts[side, i]

    def long_counters(side: int, q: int, size: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        held, more = long[side, q, size]
        for i in at[more[at] < 0].tolist():
            held[i], more[i] = _counters(_gram_hashes(_codes(tables[side]["text"][i].as_py()), q), size)
        return held[at], more[at]

    found: tuple[list[int], list[int], list[float]] = ([], [], [])
    for j, (m, c, g) in enumerate(zip(*(column(b, x) for x in ("n", "more_chars", "more_grams")), strict=True)):
        # 2 * min / (n + m) bounds the ratio; ends with a margin for rounding
        lo, hi = np.searchsorted(n, [math.floor(m * least / (2 - least)) - 1, math.ceil(m * (2 - least) / least) + 2])
        need = np.ceil(least * (n[lo:hi] + m) / 2 - 1e-6).astype(np.int64)
        shared = np.minimum(chars[:, lo:hi], b_chars[j][:, None]).sum(axis=0, dtype=np.uint16)
        keep = shared + np.minimum(more_chars[lo:hi], c) >= need
        # each block but one holds an indexed character that both texts have, and blocks are apart, so their number is
        # bounded by what is not matched too; each may cut GRAM - 1 runs
        met = rare[j].nonzero()[0]
        most = np.minimum(np.minimum(open_chars[met, lo:hi], rare[j][met][:, None]).sum(axis=0) + 1, n[lo:hi] + m - 2 * need + 1)
        at = lo + np.flatnonzero(keep)
        need, most = need[keep], most[keep]
        if below and len(at):
            keep = np.asarray(pc.fill_null(pc.less(a_ids.take(pa.array(order[at])), b_ids[j]), False))
            at, need, most = at[keep], need[keep], most[keep]
        for lo in range(0, len(at), 1024):
            near, floor, cuts = at[lo : lo + 1024], need[lo : lo + 1024], most[lo : lo + 1024]
            shared = _shared(grams[near], b_grams[j], m) + np.minimum(more_grams[near], g)
            keep = shared >= floor - (GRAM - 1) * cuts
            near, floor, cuts = order[near[keep]], floor[keep], cuts[keep]
            for q, size in LONG_GRAMS:
                least_shared = floor - (q - 1) * cuts
                ask = np.flatnonzero(least_shared > 0)
                if len(ask):
                    (x, more_x), (y, more_y) = long_counters(0, q, size, near[ask]), long_counters(1, q, size, np.array([j]))
                    keep = np.ones(len(near), bool)
                    keep[ask] = _shared(x, y, m) + np.minimum(more_x, more_y) >= least_shared[ask]
                    near, floor, cuts = near[keep], floor[keep], cuts[keep]
            for i in near.tolist():
                ratio = ratio_from(text_of(0, i), text_of(1, j), least)
                if ratio is not None:
                    for held, x in zip(found, (i, j, ratio), strict=True):
                        held.append(x)
    return found


def fuzzy_pairs(left: DataFrame, left_id: str, left_text: str, right: DataFrame, right_id: str, right_text: str, least: float = 0.85, below: bool = False) -> DataFrame:
    """Pairs whose SequenceMatcher ratio, left text first, is at least ``least``; with ``below``, those with ``a < b``.

    Whole texts are compared, block with block of neighbouring length bands, read from a shared table, so that no pair
    is shuffled. Lossless bounds come first: lengths, characters, and runs of characters, of which a pair shares what
    matches less what the ends of matching blocks may cut.
    """
    ratio = least / (2 - least)
    spark = left.sparkSession
    a_rows = left.select(F.col(left_id).alias("id"), F.col(left_text).alias("text"))
    same = left is right and (left_id, left_text) == (right_id, right_text)
    a_rows, a_parts = _banded(a_rows, ratio)
    b_rows, b_parts = (a_rows, a_parts) if same else _banded(right.select(F.col(right_id).alias("id"), F.col(right_text).alias("text")), ratio)
    # bands without a neighbour on the other side have no pair
    near = lambda parts, others: {k: n for k, n in parts.items() if {k - 1, k, k + 1} & set(others)}
    a_parts, b_parts = near(a_parts, b_parts), near(b_parts, a_parts)
    a_folder = _write_blocks(a_rows, a_parts, "fuzzy-left")
    b_folder = a_folder if same else _write_blocks(b_rows, b_parts, "fuzzy-right")
    # every block with those of its own and the neighbouring bands
    def blocks(parts: dict[int, int], side: str) -> DataFrame:
        rows = spark.createDataFrame(list(parts.items()), "band int, parts int")  # a row a band
        return rows.select(F.col("band").alias(f"{side}_band"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias(f"{side}_part"))

    tiles = blocks(a_parts, "a").withColumn("near", F.explode(F.array(*(F.col("a_band") + k for k in (-1, 0, 1)))))
    tiles = tiles.join(blocks(b_parts, "b"), F.col("near") == F.col("b_band")).select("a_band", "a_part", "b_band", "b_part")
    count = sum(n * b_parts.get(band + k, 0) for band, n in a_parts.items() for k in (-1, 0, 1))
    kinds = left.schema[left_id].dataType, right.schema[right_id].dataType

    def read(folder: str, band: int, part: int) -> pa.Table:
        import pyarrow.dataset as ds
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(f"{folder}/band={band}/part={part}")
        return ds.dataset(path, filesystem=store, format="parquet").to_table() if store.get_file_info(path).type == fs.FileType.Directory else pa.table({})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a_band, a_part, b_band, b_part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = read(a_folder, a_band, a_part), read(b_folder, b_band, b_part)
                if not a.num_rows or not b.num_rows:
                    continue
                i, j, ratios = _matches(a, b, least, below)
                pa.default_memory_pool().release_unused()
                if i:
                    ids = a["id"].combine_chunks().take(pa.array(i)), b["id"].combine_chunks().take(pa.array(j))
                    yield pa.RecordBatch.from_arrays([*ids, pa.array(ratios, pa.float64())], names=["a", "b", "ratio"])

    return tiles.repartition(max(1, min(count, MOST_TASKS))).mapInArrow(run, f"a {kinds[0].simpleString()}, b {kinds[1].simpleString()}, ratio double")


def _ratios(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        second = Text("")
        for batch in (b.slice(k, 64) for b in batches for k in range(0, b.num_rows, 64)):
            ratios = []
            for x, y in zip(batch["a_text"].to_pylist(), batch["b_text"].to_pylist(), strict=True):
                second = second if second.text == y else Text(y)  # pairs come by their second text, which is indexed once
                ratios.append(ratio_from(Text(x), second, least))
            found = pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(ratios, pa.float64())], names=["a", "b", "ratio"])
            yield found.filter(pc.is_valid(found["ratio"]))

    return run


def like_texts(rows: DataFrame, least: float) -> DataFrame:
    """``(a, b, ratio)`` with ``a < b`` of different texts ``(id, text, row)``, their ratio at least ``least``.

    Pairs are those that share as many windows as they have to. Texts in which no window is sure, which are short, have
    dense rare characters or consist of common runs, are compared with all texts of like length.
    """
    texts, pairs, rest = candidates(rows, least)
    side = lambda x: texts.select(F.col("number").alias(x), F.col("id").alias(f"{x}_id"), F.col("text").alias(f"{x}_text"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").where("a_id < b_id").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "a_text", "b_text")
    kind = rows.schema["id"].dataType.simpleString()
    found = met.mapInArrow(_ratios(least), f"a {kind}, b {kind}, ratio double")
    left = materialize(texts.join(rest, F.col("number") == F.col("b"), "left_semi").select("id", "text"), "rest-texts")
    return found.unionByName(fuzzy_pairs(texts, "id", "text", left, "id", "text", least, below=True))


def near_copies(docs: DataFrame, doc_id: str, text: str, least: float) -> DataFrame:
    """``(a, b, ratio)``: pairs of like texts among the first document of each text, and each first document with its copies.

    Equal texts are one when texts are compared, so a group of copies costs a row a copy and not one a pair.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("id IS NOT NULL AND text <> ''")
    # a text may be a costly expression, and rows of one id are told apart by a row of their own
    rows = materialize(rows.select("*", F.sha2("text", 256).alias("digest"), F.monotonically_increasing_id().alias("row")), "texts")
    first = rows.select("id", "digest", "row").groupBy("digest").agg(F.min(F.struct("id", "row")).alias("first"))
    first = materialize(first.select("digest", F.col("first.id").alias("first"), F.col("first.row").alias("row")), "first-copies")
    copies = rows.select("id", "digest").join(first.drop("row"), "digest").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("ratio"))
    copies = materialize(copies.distinct(), "copies")
    alone = materialize(rows.join(first.select("row"), "row", "left_semi").select("id", "text", "row"), "distinct-texts")
    discard(rows, first)
    return like_texts(alone, least).unionByName(copies)


def reasons(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """All reasons that hold for a row, sorted; an empty array means that it may be used."""
    found = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in rules.items())), lambda x: x.isNotNull())
    return df.withColumn("reasons", F.array_sort(F.array_distinct(found)))


def block_pages(rows: DataFrame, doc: str, pages: str, protected: DataFrame) -> DataFrame:
    """Rows with no page among ``protected(doc, page)``; ``pages`` is an array."""
    hit = rows.select(F.monotonically_increasing_id().alias("_row"), "*")
    bad = hit.select("_row", F.col(doc).alias("doc"), F.explode(pages).alias("page")).join(protected, ["doc", "page"], "left_semi").select("_row").distinct()
    return hit.join(bad, "_row", "left_anti").drop("_row")


def token_budget(rows: DataFrame, n_tokens: str, budget: int = 2048) -> DataFrame:
    """Whole rows within the budget are kept, others are marked; nothing is cut."""
    return rows.withColumn("kept", F.coalesce(F.col(n_tokens) <= budget, F.lit(False))).withColumn("reason", F.when(~F.col("kept"), "over_budget"))


def _quotes(citations: DataFrame, band: int | None) -> tuple[DataFrame, list[str]]:
    """Normalised quotes on each page that they may be on, and the columns that a quote and its chunk share."""
    c = citations.select("cite_id", "filename", F.lower("insurer").alias("who"), F.col("page").try_cast("int").alias("p"), norm_key(F.col("quote")).alias("q")).where("q <> ''")
    if band is None:
        return c.drop("p"), ["filename", "who"]
    # the band becomes an equi join: a citation looks on each page that it may be on
    return c.withColumn("p", F.explode(F.sequence(F.col("p") - band, F.col("p") + band))), ["filename", "who", "p"]


def _quote_matches(c: DataFrame, chunks: DataFrame, on: list[str]) -> DataFrame:
    """``(*on, q, chunk_id, size)``: chunks that hold a quote, a row for each different quote and not for each citation.

    A quote's inner words are whole words of a chunk that holds it, so a quote of three words or more meets only chunks
    with a run of its inner words: the first five, or four, two or one of a shorter quote. Keys of all quotes are
    sent to the chunks while they have :data:`SENT_CHARS` bytes at most, and only runs that are keys leave their task,
    without their text: each text is shuffled once, to the quotes that it may hold. Quotes of one or two words, few by
    nature, meet the chunks of their file and pages, and are sent to them up to :data:`SENT_CHARS` characters.
    """
    k = chunks.select("chunk_id", "filename", F.lower("insurer").alias("who"), F.col("page").cast("int").alias("p"), norm_key(F.col("text")).alias("t"), F.length("text").alias("size"))
    k = k.select(*on, "chunk_id", "t", "size")
    different = c.select(*on, "q").distinct().withColumn("words", F.split("q", " "))
    inner = F.greatest(F.size("words") - 2, F.lit(0))
    quotes = with_runs(different.withColumn("words", F.slice("words", F.lit(2), F.least(inner, F.lit(RUN)))), "words", "runs", shorter=True)
    quotes = materialize(quotes.select(*on, "q", F.try_element_at("runs", F.lit(-1)).alias("key")), "quotes")
    keyed, short = quotes.where("key IS NOT NULL"), quotes.where("key IS NULL").drop("key")
    keys = keyed.select("key").distinct()
    few = (short.agg(F.sum(F.length("q"))).first()[0] or 0) <= SENT_CHARS
    whole = with_runs(k.withColumn("words", F.split("t", " ")), "words", "runs", shorter=True)
    run = F.explode(F.array_distinct("runs")).alias("key")
    held = whole.select(*on, "chunk_id", run).join(F.broadcast(keys) if 8 * keys.count() <= SENT_CHARS else keys, "key", "left_semi")
    pairs = held.join(keyed, [*on, "key"]).select(*on, "chunk_id", "q").alias("pair")
    same = [F.col(f"pair.{x}").eqNullSafe(F.col(f"chunk.{x}")) for x in (*on, "chunk_id")]
    met = pairs.join(k.alias("chunk"), same).where(F.contains("t", F.col("q")))
    met = met.select(*(f"pair.{x}" for x in on), "q", "chunk.chunk_id", "size")
    return met.union(k.join(F.broadcast(short) if few else short, on).where(F.contains("t", F.col("q"))).select(*on, "q", "chunk_id", "size"))


def cited_chunks(citations: DataFrame, chunks: DataFrame, band: int | None = 1) -> DataFrame:
    """Chunks that hold a cited quote: same file and insurer, page within ``band`` (any page if None), quote contained.

    ``citations``: cite_id, filename, insurer, page (text), quote. ``chunks``: chunk_id, filename, insurer, page, text.
    Citations with one quote are matched once; the result has a row for each of them.
    """
    c, on = _quotes(citations, band)
    return c.join(_quote_matches(c, chunks, on), [*on, "q"]).select("cite_id", "chunk_id", "size").distinct()


def shortest_cited_chunks(citations: DataFrame, chunks: DataFrame, band: int | None = 1) -> DataFrame:
    """``(cite_id, chunk_id)``: of :func:`cited_chunks` each citation's shortest, then the smallest id.

    It is found for each different quote, so many citations of one quote that many chunks hold make no row a pair.
    """
    c, on = _quotes(citations, band)
    best = _quote_matches(c, chunks, on).groupBy(*on, "q").agg(F.min(F.struct("size", "chunk_id")).alias("best"))
    return c.join(best, [*on, "q"]).groupBy("cite_id").agg(F.min("best").alias("best")).select("cite_id", F.col("best.chunk_id").alias("chunk_id"))


def shortest(rows: DataFrame, by: Sequence[str], size: str, key: str) -> DataFrame:
    """The shortest match of each group, then the smallest key."""
    return rows.groupBy(*by).agg(F.min_by(key, F.struct(size, key)).alias(key))
