"""Queries that write given tables with a sink, read them back with a source, and gates and text rules over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import gates
from millrace.plans.registry import query
from millrace.session import scratch_path, table
from millrace.sources import readers as R
from millrace.sources import writers as W


@query("SELECT doc_id, lang, source, sha256(coalesce(text, '')) AS text_sha256, text IS NULL AS no_text FROM documents")
def jsonl_documents(spark, sf_dir):
    """Documents as JSON lines, written with null fields and read with a declared schema."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    path = scratch_path(spark, "jsonl")
    W.write_jsonl(docs, path)
    rows = R.read_jsonl(spark, path, docs.schema)
    return rows.select("doc_id", "lang", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), F.col("text").isNull().alias("no_text"))


@query("SELECT event_id, user_id, event_type FROM events WHERE NOT (event_type = 'signup' AND value > 50)")
def jsonl_skipping_bad_lines(spark, sf_dir):
    """Events as JSON lines of which some were cut: those are skipped, what follows them is read."""
    path = scratch_path(spark, "skipping")
    line = F.to_json(F.struct("event_id", "user_id", "event_type", "props"))
    cut = F.when(F.expr("event_type = 'signup' AND value > 50"), F.substring(line, F.lit(1), F.length(line) - 5)).otherwise(line)
    table(spark, sf_dir, "events").select(cut.alias("value")).write.text(path)
    return R.read_jsonl_skipping(spark, path, "event_id long, user_id long, event_type string, props string").select("event_id", "user_id", "event_type")


@query("SELECT 0 AS missing, count(*) AS found FROM region")
def maybe_missing_table(spark, sf_dir):
    """A missing table that may be missing has no rows; one that is there is read."""
    path = scratch_path(spark, "optional")
    region = table(spark, sf_dir, "region")
    missing = R.read_jsonl(spark, path, region.schema, missing_ok=True).agg(F.count("*").cast("int").alias("missing"))
    W.write_jsonl(region, path)
    found = R.read_jsonl(spark, path, region.schema, missing_ok=True).agg(F.count("*").alias("found"))
    return missing.join(found, F.lit(True))  # one row by one row


@query("SELECT n_nationkey, n_name, n_regionkey AS shard, n_regionkey % 2 + 1 AS vote FROM nation")
def rows_of_named_files(spark, sf_dir):
    """Files whose names say what they hold; a file of another name beside them is not read."""
    nations, folder = table(spark, sf_dir, "nation"), scratch_path(spark, "named")
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    name = F.format_string("shard_%d_v%d.jsonl", F.col("n_regionkey"), F.col("n_regionkey") % 2 + 1)
    nations.withColumn("name", name).repartition("name").write.partitionBy("name").json(f"{folder}-parts")
    for part in files.listStatus(hadoop.Path(f"{folder}-parts")):  # a file a region
        place = part.getPath()
        if "=" in place.getName():
            files.mkdirs(hadoop.Path(folder))
            (made,) = [f.getPath() for f in files.listStatus(place) if f.getPath().getName().startswith("part-")]
            files.rename(made, hadoop.Path(f"{folder}/{place.getName().partition('=')[2]}"))
    W.write_json(spark, {"n_nationkey": -1}, f"{folder}/notes.json")
    rows = R.read_named(spark, folder, r"shard_(\d+)_v(\d+)\.jsonl", ["shard", "vote"], "n_nationkey int, n_name string")
    return rows.select("n_nationkey", "n_name", "shard", "vote")


@query("""
    SELECT conv_id, turn, role, sha256(coalesce(text, '')) AS text_sha256, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\r\\n]+'), lambda x: x <> '')[1:3] AS head FROM conversations""")
def csv_conversations(spark, sf_dir):
    """Turns as quoted CSV with line feeds, quotes and a nested column, read with a declared schema."""
    words = F.slice(F.filter(F.split(F.coalesce("text", F.lit("")), X.BLANKS), lambda x: x != ""), 1, 3)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), words.alias("head"))
    path = scratch_path(spark, "csv")
    W.write_csv(rows, path, quote_all=True)
    again = R.read_csv(spark, path, "conv_id long, turn long, role string, text string, head string", {"head": "array<string>"})
    return again.select("conv_id", "turn", "role", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "head")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def sorted_csv_customers(spark, sf_dir):
    """Customers as CSV in order of their key, counted again from the files."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    path = scratch_path(spark, "sorted")
    W.write_sorted_csv(rows, path, "c_custkey")
    return R.read_csv(spark, path, "c_custkey long, c_name string, c_mktsegment string")


@query("""
    SELECT 'c' || c_custkey AS key, c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT 's' || s_suppkey, s_name, NULL, s_acctbal FROM supplier""")
def union_of_columns(spark, sf_dir):
    """Customers and suppliers as one table with the columns of both."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return W.union_columns([c, s])


@query("""
    SELECT item_id, 1 AS page, CASE WHEN length(t) > 200 AND length(t) // 2 < 0.65 * length(t) THEN t ELSE left(t, length(t) // 2) END AS text FROM (SELECT item_id, trim(text, E' \\n\\r\\t') AS t FROM benchmark)
    UNION ALL SELECT item_id, 2, trim(text, E' \\n\\r\\t') FROM benchmark""")
def parsed_documents(spark, sf_dir):
    """Protected texts as binary documents of two pages, where a parser keeps half of the first one: long pages fall back to raw text."""
    folder = scratch_path(spark, "binary")
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("value"))
    items.repartition("item_id").write.partitionBy("item_id").option("lineSep", "\u0000").text(folder)

    def parse(content: bytes) -> list[tuple[str, str]]:
        t = content.decode().rstrip("\0").strip(" \n\r\t")
        return [(t[: len(t) // 2], t), (t, t)]

    pages = R.read_documents(spark, f"{folder}/item_id=*/part-*", parse)
    return pages.select(F.regexp_extract("doc_id", "item_id=([0-9]+)", 1).cast("long").alias("item_id"), "page", "text")


@query("""
    WITH l AS (SELECT doc_id, generate_subscripts(s, 1) - 1 AS i, unnest(s) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
    b AS (SELECT doc_id, i, line, i // 2 AS y, CASE WHEN i % 7 = 6 THEN 0 WHEN i % 2 = 0 THEN 1 ELSE 2 END AS col FROM l),
    o AS (SELECT *, sum(CASE WHEN col = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY y, col, i ROWS UNBOUNDED PRECEDING) AS band FROM b)
    SELECT doc_id, sha256(string_agg((CASE WHEN i % 5 = 0 THEN '## ' ELSE '' END) || line, chr(10) ORDER BY band, col, y, i)) AS page_sha256 FROM o GROUP BY doc_id""")
def two_column_layout(spark, sf_dir):
    """Lines of documents as blocks of two columns, every seventh across both, in reading order."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "text"))
    across, right = F.col("i") % 7 == 6, F.col("i") % 2 == 1
    x0 = F.when(across, F.col("i") / 1e9).when(right, F.lit(300.0) + F.col("i") / 1e9).otherwise(F.col("i") / 1e9)
    blocks = lines.select(
        "doc_id", F.lit(1).alias("page"), x0.alias("x0"), F.when(across | right, F.lit(590.0)).otherwise(F.lit(290.0)).alias("x1"), F.floor(F.col("i") / 2).cast("double").alias("y0"),
        F.lit(600.0).alias("width"), F.when(F.col("i") % 5 == 0, F.lit(16.0)).otherwise(F.lit(8.0)).alias("size"), "text")
    return R.layout_order(blocks).select("doc_id", F.sha2("text", 256).alias("page_sha256"))


@query("SELECT r_name, count(n_nationkey) AS nations FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def stored_config(spark, sf_dir):
    """Counts of a small table written as one JSON value, seen whole or not at all, and read as a configuration."""
    counted = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("n_regionkey") == F.col("r_regionkey"), "left").groupBy("r_name").agg(F.count("n_nationkey").alias("nations"))
    path = f"{scratch_path(spark, 'config')}/settings.json"
    W.write_json(spark, {"nations": {r.r_name: r.nations for r in counted.collect()}}, path)  # a row a region
    return spark.createDataFrame(list(R.read_config(spark, path)["nations"].items()), "r_name string, nations long")


@query("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def verified_snapshot(spark, sf_dir):
    """Orders as a version that is read back against its manifest, then totals of what was read."""
    root = scratch_path(spark, "versions")
    W.write_snapshot(table(spark, sf_dir, "orders"), root, "v1")
    return W.read_snapshot(spark, root, "v1").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT vec_id, label, len(embedding) AS size FROM embeddings WHERE label IN (1, 3, 5)")
def stored_vectors(spark, sf_dir):
    """A vector table written with its count checked and read by metadata."""
    rows = table(spark, sf_dir, "embeddings")
    path = scratch_path(spark, "vectors")
    W.write_vectors(rows, path, rows.count())
    return R.read_vectors(spark, path, {"label": [1, 3, 5]}).select("vec_id", "label", F.size("embedding").alias("size"))


@query("SELECT item_id, CAST(length('search_document: ' || text) AS DOUBLE) AS chars, CAST(length(text) - length(replace(text, ' ', '')) + 1 AS DOUBLE) AS blanks FROM benchmark")
def embedded_texts(spark, sf_dir):
    """Vectors of a client that is made once a task and called with batches of prefixed texts."""

    def client():
        return lambda texts: [[float(len(t)), float(t.count(" "))] for t in texts]

    rows = R.embed(table(spark, sf_dir, "benchmark").select("item_id", "text"), "text", client)
    return rows.select("item_id", F.col("embedding")[0].cast("double").alias("chars"), F.col("embedding")[1].cast("double").alias("blanks"))


@query("""
    SELECT '| ' || r_name || ' | ' || count(n_nationkey) || ' | ' || printf('%.3f', avg(n_nationkey)) || ' |' AS line FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name
    UNION ALL SELECT '| r_name | n | mean |' UNION ALL SELECT '|---|---|---|'""")
def markdown_report(spark, sf_dir):
    """A report table in markdown, a row a line."""
    rows = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    report = rows.groupBy("r_name").agg(F.count("n_nationkey").alias("n"), F.avg("n_nationkey").alias("mean"))
    return spark.createDataFrame([(line,) for line in W.markdown_table(report).split("\n")], "line string")


_PRICES = "SELECT p_brand, avg(p_retailprice) AS v FROM part GROUP BY p_brand"


@query(f"""
    WITH live AS ({_PRICES}), old AS (SELECT p_brand, CASE WHEN p_brand LIKE '%1' THEN round(v, 0) ELSE v END AS v FROM live WHERE p_brand NOT LIKE '%3' UNION ALL SELECT 'Brand#gone', 1.0)
    SELECT coalesce(old.p_brand, live.p_brand) AS p_brand, round(old.v, 6) AS committed, round(live.v, 6) AS live FROM old FULL JOIN live ON old.p_brand = live.p_brand
    WHERE old.p_brand IS NULL OR live.p_brand IS NULL OR abs(old.v - live.v) > 1e-6""")
def report_drift(spark, sf_dir):
    """Brands whose mean price moved from a committed report, appeared or went."""
    live = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("v"))
    old = live.where("p_brand NOT LIKE '%3'").select("p_brand", F.when(F.col("p_brand").like("%1"), F.round("v", 0)).otherwise(F.col("v")).alias("v"))
    old = old.union(spark.createDataFrame([("Brand#gone", 1.0)], "p_brand string, v double"))
    return gates.drifted(old, live, ["p_brand"], "v").select("p_brand", F.round("committed", 6).alias("committed"), F.round("live", 6).alias("live"))


_METRICS = """
    SELECT l_shipdate::DATE AS day, l_returnflag AS flag, count(*) FILTER (l_discount > 0.05)::DOUBLE AS numerator, count(*) AS denominator,
        CASE l_returnflag WHEN 'R' THEN round(count(*) FILTER (l_discount > 0.05) / count(*), 2) WHEN 'N' THEN 2.0 * count(*) FILTER (l_discount > 0.05) / count(*) ELSE count(*) FILTER (l_discount > 0.05) / count(*) END AS value FROM lineitem GROUP BY 1, 2"""


@query(f"SELECT day, flag, denominator FROM ({_METRICS}) WHERE abs(value - numerator / denominator) > 1e-12 OR value < 0 OR value > 1")
def metric_gate(spark, sf_dir):
    """Daily metrics that differ from their numerator over denominator: of rounded, doubled and right values."""
    hit = F.count_if(F.col("l_discount") > 0.05).cast("double")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day"), F.col("l_returnflag").alias("flag")).agg(hit.alias("numerator"), F.count("*").alias("denominator"))
    share = F.col("numerator") / F.col("denominator")
    value = F.when(F.col("flag") == "R", F.round(share, 2)).when(F.col("flag") == "N", share * 2).otherwise(share)
    return gates.metric_breaches(rows.withColumn("value", value)).select("day", "flag", "denominator")


@query("""
    WITH b AS (SELECT user_id, event_type, count(*) FILTER (value > 150) AS unjudged, avg(value) AS m FROM events GROUP BY ALL)
    SELECT user_id || '/' || event_type AS path, ['rate'] AS points FROM b WHERE unjudged > 0 AND event_type <> 'view'""")
def leaked_points(spark, sf_dir):
    """Report blocks that carry a point estimate beside a bound though something is unjudged."""
    b = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count_if(F.col("value") > 150).alias("unjudged"), F.avg("value").alias("m"))
    path = F.concat(F.col("user_id").cast("string"), F.lit("/"), "event_type")
    leaf = lambda key, value, kind: F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"), F.lit(kind).alias("type"))
    bound = F.when(F.col("event_type") != "view", leaf("rate_lower", F.col("m"), "double"))
    leaves = F.filter(F.array(leaf("rate", F.col("m"), "double"), bound, leaf("n_recovered_unjudged", F.col("unjudged"), "int")), lambda x: x.isNotNull())
    return gates.leaked_points(b.select(path.alias("path"), F.explode(leaves).alias("l")).select("path", "l.*"), ["rate"])


@query("SELECT event_id, event_type NOT IN ('purchase', 'error', 'signup') AS strict FROM events")
def strict_json_gate(spark, sf_dir):
    """Properties that are one JSON value without repeated keys: some got a repeated key, another value or a number that is none."""
    p, kind = F.col("props"), F.col("event_type")
    changed = F.when(kind == "purchase", F.concat(F.lit('{"k": 0, '), F.substring(p, F.lit(2), F.length(p)))).when(kind == "error", F.concat(p, p)).when(kind == "signup", F.lit('{"k": NaN}')).otherwise(p)
    return table(spark, sf_dir, "events").select("event_id", X.strict_json(changed).alias("strict"))


@query("""
    WITH a AS (SELECT doc_id, lang, CASE WHEN source LIKE '%1' THEN '<think>' || left(text, 50) || '</think> ' || substr(text, 51) WHEN source LIKE '%2' THEN left(text, 80) || '<think>' || substr(text, 81) ELSE text END AS raw FROM (SELECT *, coalesce(text, '') AS t FROM documents) d),
    s AS (SELECT *, strpos(raw, '</think>') > 0 AS closed, lang = 'en' AND strpos(raw, '</think>') = 0 AS truncated FROM a)
    SELECT doc_id, sha256(trim(string_split(regexp_replace(raw, '<think>.*?</think>[ \\t\\r\\n]*', '', 'gs'), '<think>')[1], ' ')) AS stripped_sha256, truncated,
        sha256(CASE WHEN truncated THEN '' WHEN closed THEN trim(list_extract(string_split(raw, '</think>'), -1), ' ') ELSE trim(raw, ' ') END) AS answer_sha256,
        regexp_matches(regexp_replace(raw, '[^\\x00-\\x7F]', 'x', 'g'), '(?i)\\b(?:the|que|und)[0-9.-]*\\b') AS named FROM s WHERE raw IS NOT NULL""")
def answer_rules(spark, sf_dir):
    """Reasoning stripped, final answers where reasoning is expected, and texts that name one of some words."""
    t, source = F.col("text"), F.col("source")
    raw = F.when(source.like("%1"), F.concat(F.lit("<think>"), F.substring(t, 1, 50), F.lit("</think> "), F.substring(t, F.lit(51), F.length(t))))
    raw = raw.when(source.like("%2"), F.concat(F.substring(t, 1, 80), F.lit("<think>"), F.substring(t, F.lit(81), F.length(t)))).otherwise(t)
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", raw.alias("raw")).where("raw IS NOT NULL")
    final = X.final_answer(F.col("raw"), F.col("lang") == "en")
    return rows.select(
        "doc_id", F.sha2(X.strip_reasoning(F.col("raw")), 256).alias("stripped_sha256"), final["truncated"].alias("truncated"), F.sha2(final["answer"], 256).alias("answer_sha256"),
        X.names_a_model(F.regexp_replace("raw", r"[^\x00-\x7F]", "x"), ["the", "que", "und"]).alias("named"))


@query("""
    SELECT page_id, replace(regexp_replace(lower(trim(regexp_replace(u, '^["'']+|["'']+$', '', 'g'))), '[ \\t\\r\\n]+', ' ', 'g'), '', '') AS doc,
        list_transform(regexp_extract_all(url, '([0-9]+)', 1), lambda x: TRY_CAST(x AS INTEGER)) AS numbers FROM (SELECT page_id, url, regexp_replace(regexp_replace(url, '^.*[/\\\\]', ''), '(?i)\\.pdf$', '') AS u FROM pages WHERE url IS NOT NULL)""")
def document_names(spark, sf_dir):
    """Names and numbers in the addresses of pages."""
    rows = table(spark, sf_dir, "pages").where("url IS NOT NULL")
    return rows.select("page_id", X.norm_doc(F.col("url")).alias("doc"), X.page_numbers(F.col("url")).alias("numbers"))


@query("SELECT event_type, list_sort(list(value))[CAST(ceil(count(*) / 2.0) AS INTEGER)] AS median_low, round(coalesce(sum(value) FILTER (user_id % 2 = 0) / nullif(sum(value) FILTER (value > 400), 0), -1), 6) AS ratio FROM events GROUP BY event_type")
def lower_medians(spark, sf_dir):
    """Lower medians, which are always one of the values, and a ratio with a stated value where nothing is counted."""
    e = table(spark, sf_dir, "events").groupBy("event_type")
    ratio = X.safe_ratio(F.sum(F.when(F.col("user_id") % 2 == 0, F.col("value"))), F.sum(F.when(F.col("value") > 400, F.col("value"))), -1.0)
    return e.agg(X.median_low(F.col("value")).alias("median_low"), F.round(ratio, 6).alias("ratio"))

