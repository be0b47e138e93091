"""Queries over texts: cleaning, sections, duplicates, overlap with protected texts, retrieval, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.graph import connected_components
from millrace.operators import corpus as C
from millrace.operators import decontam as D
from millrace.operators import retrieval as R
from millrace.operators import vector_cells as VC
from millrace.operators import splits as S
from millrace.plans.registry import query
from millrace.session import table
from millrace.sources.writers import for_display

KEY_SQL = "trim(regexp_replace(lower(text), '[ \\t\\r\\n]+', ' ', 'g'))"


@query(f"""
    SELECT sha256({KEY_SQL}) AS key_hash, count(*) AS n_docs, min(doc_id) AS first_doc
    FROM documents GROUP BY 1 HAVING count(*) > 1""")
def exact_dup_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of documents whose normalised texts are equal."""
    docs = table(spark, sf_dir, "documents")
    keyed = docs.select("doc_id", F.sha2(X.norm_key(F.col("text")), 256).alias("key_hash"))
    out = keyed.groupBy("key_hash").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))
    return out.where("n_docs > 1")


@query(f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha256({KEY_SQL})")
def canonical_docs(spark, sf_dir):
    """The first document of every class of equal normalised texts."""
    return table(spark, sf_dir, "documents").groupBy(F.sha2(X.norm_key(F.col("text")), 256).alias("k")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


LINES_SQL = """
    lines AS (SELECT source AS doc, doc_id AS page, line, regexp_replace(lower(trim(line)), '[0-9]+', '#', 'g') AS key
              FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents))"""


def _lines(spark, sf_dir):
    return C.lines_of(table(spark, sf_dir, "documents"), "source", "doc_id", "text")


@query(f"""
    WITH {LINES_SQL}
    SELECT doc, key, count(DISTINCT page) AS n_pages FROM lines WHERE length(key) BETWEEN 3 AND 80
    GROUP BY doc, key HAVING count(DISTINCT page) >= 3""")
def repeated_lines(spark, sf_dir):
    """Short lines on three or more pages (documents) of a source."""
    return C.repeated_line_counts(_lines(spark, sf_dir)).where("n_pages >= 3")


@query(f"""
    WITH {LINES_SQL},
    counts AS (SELECT doc, key, count(DISTINCT page) AS n FROM lines WHERE length(key) BETWEEN 3 AND 80 GROUP BY doc, key),
    pages AS (SELECT doc, count(DISTINCT page) AS p FROM lines GROUP BY doc),
    gone AS (SELECT doc, key FROM counts JOIN pages USING (doc) WHERE p >= 6 AND n > 0.05 * p)
    SELECT page AS doc_id, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars
    FROM lines l WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc = l.doc AND g.key = l.key) GROUP BY page""")
def strip_repeated_lines_docs(spark, sf_dir):
    """Lines left of every document without those on over 5 percent of its source's pages."""
    pages = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("doc")).agg(F.countDistinct("doc_id").alias("pages"))
    kept = C.strip_repeated_lines(_lines(spark, sf_dir), share=0.05, page_counts=pages)
    return kept.groupBy(F.col("page").alias("doc_id")).agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).cast("long").alias("n_chars"))


def _marked(spark, sf_dir):
    """Documents with every fifth line as a markdown heading, so that sections exist."""
    lines = _lines(spark, sf_dir)
    return lines.withColumn("line", F.when(F.col("line_no") % 5 == 0, F.concat(F.lit("## "), F.col("line"))).otherwise(F.col("line"))).withColumn("doc", F.col("page"))


SECTIONS_SQL = """
    l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n, unnest(string_split(text, chr(10))) AS line FROM documents),
    h AS (SELECT *, n % 5 = 0 AND length(trim('## ' || line)) <= 120 AND regexp_matches(trim('## ' || line), '^#{1,4}[ \\t]+(.+)$')
                    AND trim(line, ' *:-–—·•|.') <> '' AS heading FROM l),
    i AS (SELECT *, sum(CASE WHEN heading THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS island FROM h),
    s AS (SELECT doc_id, island, string_agg(CASE WHEN n % 5 = 0 THEN '## ' || line ELSE line END, chr(10) ORDER BY n) FILTER (WHERE NOT heading) AS body FROM i GROUP BY ALL),
    t AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(body, ''), '\\n{3,}', chr(10) || chr(10), 'g'), '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g') AS text FROM s)"""


@query(f"""
    WITH {SECTIONS_SQL}
    SELECT doc_id, count(*) AS n_sections, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM t WHERE length(text) >= 40 GROUP BY doc_id""")
def sections_by_heading(spark, sf_dir):
    """Sections of documents in which every fifth line is a heading."""
    s = C.sections(_marked(spark, sf_dir))
    return s.groupBy(F.col("doc").alias("doc_id")).agg(F.count("*").alias("n_sections"), F.sum(F.length("text")).cast("long").alias("n_chars"))


#: What Python's ``strip`` takes off.
SPACES = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


_CHUNKS_SQL = rf"""
    WITH RECURSIVE {SECTIONS_SQL.replace("SELECT doc_id, regexp_replace(regexp_replace(coalesce", "SELECT doc_id, island, regexp_replace(regexp_replace(coalesce")},
    p AS (SELECT doc_id, island, text, list_filter(string_split(text, chr(10) || chr(10)), lambda x: regexp_replace(x, '{SPACES}+', '', 'g') <> '') AS blocks FROM t WHERE length(text) >= 40),
    r AS (SELECT doc_id, island, blocks, 0 AS k, '' AS buf, CAST(NULL AS INTEGER) AS n FROM p WHERE length(text) > 1700
          UNION ALL SELECT doc_id, island, blocks, k + 1, CASE WHEN full_ THEN CASE WHEN length(buf) > 220 THEN right(buf, 220) || chr(10) || chr(10) ELSE '' END ELSE buf END || blocks[k + 1] || chr(10) || chr(10),
                           CASE WHEN full_ THEN length(regexp_replace(buf, '^{SPACES}+|{SPACES}+$', '', 'g')) END
          FROM (SELECT *, buf <> '' AND length(buf) + length(blocks[k + 1]) + 2 > 1700 AS full_ FROM r WHERE k < len(blocks))),
    done AS (SELECT doc_id, island, k, n FROM r WHERE n IS NOT NULL),
    tail AS (SELECT doc_id, island, k + 1 AS k, length(regexp_replace(buf, '^{SPACES}+|{SPACES}+$', '', 'g')) AS n FROM r WHERE k = len(blocks) AND k > 0),
    last AS (SELECT doc_id, island, max(k) AS k FROM done GROUP BY ALL),
    joined AS (SELECT d.doc_id, d.island, d.k, d.n + CASE WHEN l.k = d.k AND t.n < 350 THEN t.n + 2 ELSE 0 END AS n FROM done d JOIN last l ON l.doc_id = d.doc_id AND l.island = d.island JOIN tail t ON t.doc_id = d.doc_id AND t.island = d.island
               UNION ALL SELECT t.doc_id, t.island, t.k, t.n FROM tail t LEFT JOIN last l ON l.doc_id = t.doc_id AND l.island = t.island WHERE l.k IS NULL OR t.n >= 350
               UNION ALL SELECT doc_id, island, 1, length(text) FROM p WHERE length(text) <= 1700)
    SELECT doc_id, CAST(island AS BIGINT) AS island, CAST(row_number() OVER (PARTITION BY doc_id, island ORDER BY k) AS INTEGER) AS part, CAST(n AS INTEGER) AS n_chars FROM joined"""


@query(_CHUNKS_SQL)
def chunk_pack(spark, sf_dir):
    """Chunks of all sections, by the lengths of their paragraphs."""
    chunks = C.chunk(C.sections(_marked(spark, sf_dir)))
    return chunks.select(F.col("doc").alias("doc_id"), "island", "part", F.length("text").alias("n_chars"))


@query(_CHUNKS_SQL)
def chunk_pack_by_function(spark, sf_dir):
    """The same by a table function over a partitioned, ordered table of paragraphs."""
    chunks = C.chunk_by_function(C.sections(_marked(spark, sf_dir)).withColumn("island", F.col("island").cast("long")))
    return chunks.select(F.col("doc").alias("doc_id"), "island", "part", F.length("text").alias("n_chars"))


@query("""
    SELECT source || CASE WHEN n = 1 THEN '' ELSE '~' || n END AS id, doc_id
    FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)""")
def suffix_ids(spark, sf_dir):
    """Repeated ids made unique in order of arrival."""
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("id"), "doc_id")
    return C.suffix_duplicates(rows, "id", "doc_id")


@query("""
    SELECT source, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) AS pages FROM documents GROUP BY source
    HAVING sum(length(text)) < 2300 * count(*)""")
def thin_sources(spark, sf_dir):
    """Sources with few characters a page."""
    return C.thin_documents(table(spark, sf_dir, "documents"), "source", "text", 2300)


FIRST_MATCH = [("^src1", "one"), ("src[0-4]$", "low"), ("SRC", "any")]


@query("""
    SELECT doc_id, CASE WHEN regexp_matches(source, '(?i)^src1') THEN 'one' WHEN regexp_matches(source, '(?i)src[0-4]$') THEN 'low'
                        WHEN regexp_matches(source, '(?i)SRC') THEN 'any' ELSE source END AS matched FROM documents""")
def regex_lookup_first_match(spark, sf_dir):
    """The first of several patterns that a name matches, with a default."""
    return C.lookup_first_match(table(spark, sf_dir, "documents"), "source", FIRST_MATCH, F.col("source")).select("doc_id", "matched")


@query("""
    WITH d AS (SELECT doc_id, trim(regexp_replace(lower(text), '[ \\t\\r\\n]+', ' ', 'g')) AS t FROM documents),
         i AS (SELECT item_id, trim(regexp_replace(lower(text), '[ \\t\\r\\n]+', ' ', 'g')) AS t FROM benchmark)
    SELECT doc_id, item_id FROM d, i WHERE i.t <> '' AND contains(d.t, i.t)""")
def benchmark_containment(spark, sf_dir):
    """Documents that hold a whole protected text."""
    return D.containment(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


@query("""
    WITH i AS (SELECT item_id, text FROM benchmark UNION ALL SELECT 1000000 + doc_id, '  ' || text FROM documents WHERE doc_id % 50 = 0)
    SELECT d.doc_id, i.item_id FROM documents d JOIN i
    ON trim(regexp_replace(lower(d.text), '[ \\t\\r\\n]+', ' ', 'g')) = trim(regexp_replace(lower(i.text), '[ \\t\\r\\n]+', ' ', 'g'))""")
def benchmark_exact(spark, sf_dir):
    """Documents equal to a protected text: those of the benchmark, and every fiftieth document with other spaces."""
    docs = table(spark, sf_dir, "documents")
    held = docs.where("doc_id % 50 = 0").select((F.col("doc_id") + 1_000_000).alias("item_id"), F.concat(F.lit("  "), "text").alias("text"))
    items = table(spark, sf_dir, "benchmark").select("item_id", "text").union(held)
    return D.equal_texts(docs, "doc_id", "text", items, "item_id", "text")


@query()
def fuzzy_overlap(spark, sf_dir):
    """Whole texts of documents against protected texts by SequenceMatcher ratio."""
    docs = table(spark, sf_dir, "documents").select("doc_id", X.norm_key(F.col("text")).alias("t"))
    items = table(spark, sf_dir, "benchmark").select("item_id", X.norm_key(F.col("text")).alias("t"))
    return D.fuzzy_pairs(docs, "doc_id", "t", items, "item_id", "t", 0.85)


@query()
def near_duplicate_pairs(spark, sf_dir):
    """Documents whose whole texts nearly repeat each other, of equal texts the first one; and that one with its copies."""
    docs = table(spark, sf_dir, "documents").select("doc_id", X.norm_words(F.col("text")).alias("t"))
    return D.near_copies(docs, "doc_id", "t", 0.9)


@query("""
    WITH k AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[0-9]+(?:[.,][0-9]+)*', '<number>', 'g'), '[^\\p{L}\\p{N}<>]+', ' ', 'g')) AS key FROM documents)
    SELECT sha256(key) AS key_hash, count(*) AS n_docs, min(doc_id) AS first_doc FROM k GROUP BY 1 HAVING count(*) > 1""")
def template_groups(spark, sf_dir):
    """Documents that differ in numbers and punctuation alone."""
    keyed = table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.template_key(F.col("text")), 256).alias("key_hash"))
    return keyed.groupBy("key_hash").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc")).where("n_docs > 1")


@query("""
    WITH d AS (SELECT doc_id, lang, source, trim(regexp_replace(lower(text), '[ \\t\\r\\n]+', ' ', 'g')) AS t FROM documents),
         i AS (SELECT item_id, trim(regexp_replace(lower(text), '[ \\t\\r\\n]+', ' ', 'g')) AS t FROM benchmark),
         hit AS (SELECT DISTINCT doc_id FROM d, i WHERE i.t <> '' AND contains(d.t, i.t)),
         f AS (SELECT d.doc_id, [CASE WHEN l.doc_id IS NULL THEN 'unverified' END, CASE WHEN d.source = 'src3' THEN 'forbidden_source' END,
                                 CASE WHEN h.doc_id IS NOT NULL THEN 'text_overlap' END, CASE WHEN l.quality = 0 THEN 'low_quality' END] AS r
               FROM d LEFT JOIN labels l USING (doc_id) LEFT JOIN hit h USING (doc_id))
    SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(r, lambda x: x IS NOT NULL))), ',') AS reasons FROM f""")
def leakage_reasons(spark, sf_dir):
    """All reasons why a document may not be trained on."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    hit = D.containment(docs, "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text").select("doc_id").distinct().withColumn("hit", F.lit(True))
    rows = docs.select("doc_id", "source").join(labels.withColumn("labelled", F.lit(True)), "doc_id", "left").join(hit, "doc_id", "left")
    rules = {
        "unverified": F.col("labelled").isNull(),
        "forbidden_source": F.col("source") == "src3",
        "text_overlap": F.col("hit").isNotNull(),
        "low_quality": F.col("quality") == 0,
    }
    return D.reasons(rows, rules).select("doc_id", F.array_join("reasons", ",").alias("reasons"))


@query("""
    WITH p AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '([0-9]+)', 1), lambda x: TRY_CAST(x AS INTEGER))) AS page FROM documents),
    bad AS (SELECT DISTINCT doc_id FROM p WHERE page IN (SELECT CAST(item_id AS INTEGER) FROM benchmark))
    SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM bad)""")
def protected_page_block(spark, sf_dir):
    """Documents that name no protected number."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.regexp_extract_all("text", F.lit("([0-9]+)"), F.lit(1)), lambda x: x.try_cast("int")).alias("pages"), F.lit("all").alias("book"))
    protected = table(spark, sf_dir, "benchmark").select(F.lit("all").alias("doc"), F.col("item_id").cast("int").alias("page"))
    return D.block_pages(docs, "book", "pages", protected).select("doc_id")


@query("""
    WITH n AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda x: x <> '')) AS n_tokens FROM documents)
    SELECT doc_id, n_tokens, n_tokens <= 512 AS kept, CASE WHEN n_tokens > 512 THEN 'over_budget' END AS reason FROM n""")
def token_budget(spark, sf_dir):
    """Whole documents within a budget of words; the others keep a reason."""
    n = F.size(F.filter(F.split("text", "[ \\t\\r\\n]+"), lambda x: x != "")).cast("long")
    return D.token_budget(table(spark, sf_dir, "documents").select("doc_id", n.alias("n_tokens")), "n_tokens", 512)


@query("""
    WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?][ \\t\\r\\n]+|\\n+)', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS p FROM documents)
    SELECT doc_id, CAST(len(p) AS BIGINT) AS n_segments, CAST(coalesce(list_max(list_transform(p, lambda x: length(x))), 0) AS BIGINT) AS longest,
           array_to_string(p, '') = (SELECT text FROM documents d WHERE d.doc_id = s.doc_id) AS lossless FROM s""")
def sentence_segments(spark, sf_dir):
    """Segments of every document; joined they are the text."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", X.segments(F.col("text")).alias("p"))
    longest = F.coalesce(F.array_max(F.transform("p", lambda x: F.length(x))), F.lit(0))
    return rows.select("doc_id", F.size("p").cast("long").alias("n_segments"), longest.cast("long").alias("longest"), (F.array_join("p", "") == F.col("text")).alias("lossless"))


@query("""
    WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?][ \\t\\r\\n]+|\\n+)', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS p FROM documents)
    SELECT doc_id, CASE WHEN len(p) > 2 THEN sha256(p[2] || p[3]) END AS span_hash, CAST(NULL AS VARCHAR) AS other FROM s""")
def span_lookup(spark, sf_dir):
    """A range of segments by id; a range across sources resolves to nothing."""
    rows = table(spark, sf_dir, "documents").select("doc_id", X.segments(F.col("text")).alias("p"))
    return rows.select("doc_id", F.sha2(X.resolve_span(F.lit("A1-A2"), F.col("p")), 256).alias("span_hash"), X.resolve_span(F.lit("A1-B2"), F.col("p")).alias("other"))


NORMS_SQL = """regexp_replace(regexp_replace(translate(regexp_replace(lower(text), '<br[ \\t\\r\\n]*/?>|&lt;br[ \\t\\r\\n]*/?&gt;', ' ', 'g'),
    '’‘“”–—', '''''""--'), '[ \\t\\r\\n*_#|•·]+', ' ', 'g'), '-{2,}', '-', 'g')"""


@query(f"""
    SELECT doc_id, sha256(trim({NORMS_SQL})) AS folded, sha256(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))) AS words FROM documents""")
def normalisers(spark, sf_dir):
    """Folded and words-only forms of texts."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.fold(t), 256).alias("folded"), F.sha2(X.norm_words(t), 256).alias("words"))


_TOPK_SQL = """
    WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0),
    s AS (SELECT query_id, vec_id, round(list_cosine_similarity(CAST(q AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS score FROM q, embeddings WHERE query_id <> vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 6"""


@query(_TOPK_SQL)
def vector_topk(spark, sf_dir):
    """Six nearest vectors of every query; queries are the ids divisible by 100."""
    return R.rerank(R.top_k(*_vectors(spark, sf_dir))).select("query_id", "vec_id", "score", "rank")


@query(_TOPK_SQL)
def vector_topk_in_cells(spark, sf_dir):
    """The same by cells of the vectors, leaving out those that cannot hold a near one."""
    return R.rerank(VC.top_k_in_cells(*_vectors(spark, sf_dir))).select("query_id", "vec_id", "score", "rank")


def _vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    queries = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return queries, v.select("vec_id", F.col("embedding").alias("v"))


@query("""
    WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0),
    s AS (SELECT query_id, e.vec_id, label, round(list_cosine_similarity(CAST(q AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS score FROM q, embeddings e WHERE query_id <> e.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s),
    v AS (SELECT query_id, label, count(*) AS n FROM r WHERE rank <= 24 AND label IS NOT NULL GROUP BY ALL),
    b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, label) AS k, sum(n) OVER (PARTITION BY query_id) AS total FROM v)
    SELECT query_id, label, round(n / total, 6) AS share FROM b WHERE k = 1""")
def knn_label_vote(spark, sf_dir):
    """The label that most of a query's 24 nearest vectors have."""
    voted = R.knn_vote(R.top_k(*_vectors(spark, sf_dir)), table(spark, sf_dir, "embeddings"))
    return voted.select("query_id", F.col("label").cast("int").alias("label"), F.round("share", 6).alias("share"))


@query("""
    WITH g AS (SELECT source AS grp, count(*) AS size, sha256('7:' || source) AS o FROM documents GROUP BY source),
    c AS (SELECT *, sum(size) OVER (ORDER BY o, grp) - size AS before, greatest(1, round(0.1 * sum(size) OVER ())) AS target FROM g)
    SELECT doc_id, CASE WHEN before < target THEN 'validation' ELSE 'train' END AS side FROM documents JOIN c ON source = grp""")
def grouped_split(spark, sf_dir):
    """A tenth for validation, by whole sources in hash order."""
    return S.grouped_split(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 7).select("doc_id", "side")


@query("""
    WITH o AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id END AS frozen FROM documents),
    p AS (SELECT doc_id, row_number() OVER (ORDER BY frozen IS NULL, frozen, doc_id) AS position FROM o)
    SELECT m AS milestone, doc_id, CAST(position AS INTEGER) AS position FROM p, (SELECT unnest([50, 75, 100, 200]) AS m) WHERE position <= m""")
def milestone_prefix(spark, sf_dir):
    """Nested prefixes: a frozen order first, then new ids."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")).alias("frozen"))
    return S.milestones(rows, "doc_id", "frozen", [50, 75, 100, 200]).select("milestone", "doc_id", "position")


@query("""
    WITH t AS (SELECT doc_id, source || '/' || lang AS stratum, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS turn FROM documents)
    SELECT doc_id, stratum FROM t ORDER BY turn, stratum, doc_id LIMIT 28""")
def stratified_round_robin(spark, sf_dir):
    """28 documents, one of each stratum in turn: a sampling operator."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang").alias("stratum"))
    return S.round_robin(rows, "stratum", "doc_id", 28).select("doc_id", "stratum")


@query("SELECT doc_id FROM documents ORDER BY sha256('0:' || doc_id), doc_id LIMIT 45")
def hash_sample(spark, sf_dir):
    """45 documents in hash order: a sampling operator."""
    return S.sample(table(spark, sf_dir, "documents"), "doc_id", 45, 0).select("doc_id")


@query("""
    WITH b AS (SELECT source, bool_or(lang IN ('de', 'fr')) AND bool_or(lang = 'es') AS ok FROM documents GROUP BY source),
    h AS (SELECT source FROM b WHERE ok ORDER BY sha256('5:' || source), source LIMIT 5)
    SELECT doc_id, source IN (SELECT source FROM h) AS held_out FROM documents""")
def disjoint_holdout(spark, sf_dir):
    """Five sources that have two kinds of documents are held out whole."""
    return S.disjoint_holdout(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "source", "lang", ["de", "fr"], "es", 5, 5).select("doc_id", "held_out")


@query("SELECT source, lang, min(doc_id) AS doc_id FROM documents GROUP BY source, lang")
def one_per_stratum(spark, sf_dir):
    """The first document of every stratum."""
    return S.one_per_stratum(table(spark, sf_dir, "documents"), ["source", "lang"], "doc_id")


@query("""
    WITH RECURSIVE e AS (SELECT DISTINCT user_id * 100 + day(ts) AS a, 10000000 + day(ts) * 100000 + CAST(floor(value) AS BIGINT) AS b FROM events WHERE event_type = 'purchase'),
    n AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r AS (SELECT a AS node, a AS seen FROM n UNION SELECT r.node, n.b FROM r JOIN n ON n.a = r.seen)
    SELECT node, min(seen) AS component FROM r GROUP BY node""")
def connected_components_query(spark, sf_dir):
    """Components of a day's users that share a rounded amount."""
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'").withColumn("day", F.dayofmonth("ts"))
    edges = e.select((F.col("user_id") * 100 + F.col("day")).alias("a"), (10_000_000 + F.col("day") * 100_000 + F.floor("value")).cast("long").alias("b")).distinct()
    return connected_components(edges)


@query("""
    WITH c AS (SELECT doc_id AS cite_id, source AS filename, CAST(doc_id % 10 + 1 AS VARCHAR) AS page, trim(regexp_replace(lower(string_split(text, chr(10))[1]), '[ \\t\\r\\n]+', ' ', 'g')) AS q FROM documents),
    k AS (SELECT doc_id AS chunk_id, source AS filename, doc_id % 10 AS page, trim(regexp_replace(lower(text), '[ \\t\\r\\n]+', ' ', 'g')) AS t, length(text) AS size FROM documents),
    m AS (SELECT cite_id, chunk_id, size FROM c JOIN k USING (filename) WHERE q <> '' AND contains(t, q) AND abs(CAST(c.page AS INTEGER) - k.page) <= 1)
    SELECT cite_id, arg_min(chunk_id, (size, chunk_id)) AS chunk_id FROM m GROUP BY cite_id""")
def page_band_join(spark, sf_dir):
    """For first lines as quotes, the shortest chunk of the same file within one page that holds them."""
    docs = table(spark, sf_dir, "documents")
    quotes = docs.select(F.col("doc_id").alias("cite_id"), F.col("source").alias("filename"), F.lit("X").alias("insurer"), (F.col("doc_id") % 10 + 1).cast("string").alias("page"), F.substring_index("text", "\n", 1).alias("quote"))
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("filename"), F.lit("x").alias("insurer"), (F.col("doc_id") % 10).cast("int").alias("page"), "text")
    return D.shortest_cited_chunks(quotes, chunks)


@query("""
    SELECT doc_id, CASE WHEN regexp_matches(cell, '^[=+\\-@\\t\\r]') THEN '''' || cell ELSE cell END AS cell FROM
    (SELECT doc_id, ['=', '+', '-', '@', ' =', 'x'][CAST(doc_id % 6 AS INTEGER) + 1] || text AS cell FROM documents)""")
def formula_escape(spark, sf_dir):
    """Cells that no spreadsheet takes for formulas."""
    marks = F.array(*(F.lit(m) for m in ("=", "+", "-", "@", " =", "x")))
    cells = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.get(marks, (F.col("doc_id") % 6).cast("int")), F.col("text")).alias("cell"))
    return for_display(cells)


@query("""SELECT item_id AS id, text FROM benchmark""")
def lossless_csv(spark, sf_dir):
    """Texts with quotes and line feeds through a CSV of JSON cells and back."""
    from millrace.session import scratch_path
    from millrace.sources.writers import write_lossless_csv

    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return write_lossless_csv(rows, scratch_path(spark, "csv"))


@query("""
    SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)) AS host, CAST(length(html) AS BIGINT) AS n_chars,
           CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS n_paragraphs FROM pages""")
def page_profile(spark, sf_dir):
    """Host, size and paragraphs of every page."""
    return table(spark, sf_dir, "pages").select(
        "page_id", F.lower(F.regexp_extract("url", "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1)).alias("host"), F.length("html").cast("long").alias("n_chars"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("n_paragraphs")
    )


@query("""
    SELECT 'kept' AS part, count(*) AS n FROM documents WHERE doc_id % 10 <> 0
    UNION ALL SELECT 'lost', count(*) FROM documents WHERE doc_id % 10 = 0""")
def preservation_audit(spark, sf_dir):
    """Rows of an older table that a newer one still has unchanged, and those it lacks."""
    from millrace.operators.gates import not_preserved

    old = table(spark, sf_dir, "documents")
    new = old.where("doc_id % 10 <> 0").withColumn("extra", F.lit(1))
    lost = not_preserved(old, new).agg(F.count("*").alias("n")).select(F.lit("lost").alias("part"), "n")
    kept = old.intersectAll(new.select(*old.columns)).agg(F.count("*").alias("n")).select(F.lit("kept").alias("part"), "n")
    return kept.union(lost)


