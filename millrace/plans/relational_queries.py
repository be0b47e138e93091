"""Standard relational queries: joins, set operations, cubes, windows, as-of. Extensions beside the corpus operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.plans.registry import query
from millrace.session import table


@query("""
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, sf_dir):
    """Totals by flag and status: one map-side aggregate over a pruned scan."""
    li = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.count("*").alias("n"),
    )


@query("""
    SELECT n_name, r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY ALL""")
def nation_revenue(spark, sf_dir):
    """Revenue by nation: facts are joined by key, dimensions as Spark finds them small."""
    t = lambda n: table(spark, sf_dir, n)
    o = t("orders").where("o_orderdate < timestamp_ntz '1996-01-01'").select("o_orderkey", "o_custkey")
    li = t("lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    c = t("customer").select("c_custkey", "c_nationkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    by = j.groupBy("c_nationkey").agg(F.sum("v").alias("v"))  # dimensions join what is left
    out = by.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return out.select("n_name", "r_name", F.round("v", 2).alias("revenue"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_sales(spark, sf_dir):
    """All combinations of two dimensions."""
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""
    SELECT r_name, n_name, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def rollup_revenue(spark, sf_dir):
    """Balances by region and nation with subtotals."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.rollup("r_name", "n_name").agg(F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def grouping_sets_returns(spark, sf_dir):
    """Chosen groupings in one pass."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupingSets([["l_returnflag"], ["l_linestatus"], []], "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("""
    SELECT o_orderkey, CAST(rank() OVER w AS INTEGER) AS rnk, CAST(dense_rank() OVER w AS INTEGER) AS dense, CAST(ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS tile
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC)""")
def rank_dense_ntile(spark, sf_dir):
    """Ranks of a customer's orders."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"))
    t = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.rank().over(w).alias("rnk"), F.dense_rank().over(w).alias("dense"), F.ntile(4).over(t).alias("tile"))


@query("""
    SELECT event_id, lag(event_type) OVER w AS before, lead(event_type) OVER w AS after, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def lag_lead_events(spark, sf_dir):
    """Neighbours and a moving mean of a user's events."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    m = F.avg("value").over(w.rowsBetween(-2, 0))
    return table(spark, sf_dir, "events").select("event_id", F.lag("event_type").over(w).alias("before"), F.lead("event_type").over(w).alias("after"), F.round(m, 4).alias("moving"))


@query("""
    WITH p AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase'), c AS (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY ALL)
    SELECT p.event_id, c.event_id AS click_id FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts >= c.ts""")
def asof_prev_event(spark, sf_dir):
    """The last click before each purchase: both sides are merged by time and the last seen is carried on."""
    e = table(spark, sf_dir, "events").where("event_type in ('purchase', 'click')").select("user_id", "ts", "event_id", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "click", 0).otherwise(1), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    click = F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(w)
    return e.withColumn("click_id", click).where("event_type = 'purchase'").select("event_id", "click_id")


@query("""
    WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part)
    SELECT p_brand, p_partkey, CAST(n AS INTEGER) AS n FROM r WHERE n <= 3""")
def top_k_per_group(spark, sf_dir):
    """Three dearest parts of a brand: the limit is pushed below the shuffle."""
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, sf_dir, "part").withColumn("n", F.row_number().over(w)).where("n <= 3").select("p_brand", "p_partkey", "n")


@query("""
    SELECT 'intersect' AS op, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)
    UNION ALL SELECT 'except', count(*) FROM (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier)
    UNION ALL SELECT 'union', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)
    UNION ALL SELECT 'union_all', count(*) FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier)""")
def set_ops(spark, sf_dir):
    """Sizes of set operations on nations."""
    c, s, n = table(spark, sf_dir, "customer").select("c_nationkey"), table(spark, sf_dir, "supplier").select("s_nationkey"), table(spark, sf_dir, "nation").select("n_nationkey")
    size = lambda df, op: df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
    return size(c.intersect(s), "intersect").union(size(n.subtract(s), "except")).union(size(c.union(s).distinct(), "union")).union(size(c.union(s), "union_all"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def customers_without_orders(spark, sf_dir):
    """An anti join."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


@query("SELECT event_id, json_extract_string(props, '$.' || k) AS v FROM events, (SELECT unnest(json_keys((SELECT props FROM events WHERE props IS NOT NULL ORDER BY event_id LIMIT 1))) AS k ORDER BY k LIMIT 1)")
def json_props(spark, sf_dir):
    """A property of every event, by the first key in order of the first event."""
    e = table(spark, sf_dir, "events")
    key = e.where("props is not null").orderBy("event_id").limit(1).select(F.array_min(F.json_object_keys("props")).alias("k")).first()
    return e.select("event_id", F.get_json_object("props", f"$.{key.k if key else 'x'}").alias("v"))


@query("SELECT user_id, string_agg(event_type || ':' || n, ',' ORDER BY event_type) AS counts FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def map_ops(spark, sf_dir):
    """Counts of a user's events as a map, rendered in key order."""
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    m = e.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return m.select("user_id", F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda x: F.concat_ws(":", x["key"], x["value"].cast("string"))), ",").alias("counts"))


@query("""
    SELECT s_suppkey, count(*) AS n_below FROM supplier JOIN part ON p_retailprice BETWEEN s_acctbal - 10 AND s_acctbal + 10 GROUP BY s_suppkey""")
def price_band_join(spark, sf_dir):
    """A range join by buckets of the range's width."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal").withColumn("b", F.explode(F.sequence(F.floor((F.col("s_acctbal") - 10) / 20), F.floor((F.col("s_acctbal") + 10) / 20))))
    p = table(spark, sf_dir, "part").select("p_retailprice", F.floor(F.col("p_retailprice") / 20).alias("b"))
    return s.join(p, "b").where("p_retailprice between s_acctbal - 10 and s_acctbal + 10").groupBy("s_suppkey").agg(F.count("*").alias("n_below"))


@query("SELECT o_orderstatus, round(coalesce(sum(o_totalprice) FILTER (o_orderpriority LIKE '1%'), 0), 2) AS urgent, round(coalesce(sum(o_totalprice) FILTER (o_orderpriority NOT LIKE '1%'), 0), 2) AS other FROM orders GROUP BY 1")
def pivot_priority(spark, sf_dir):
    """A pivot over a fixed list of values."""
    o = table(spark, sf_dir, "orders").withColumn("k", F.when(F.startswith("o_orderpriority", F.lit("1")), "urgent").otherwise("other"))
    p = o.groupBy("o_orderstatus").pivot("k", ["urgent", "other"]).agg(F.sum("o_totalprice"))
    return p.select("o_orderstatus", *(F.round(F.coalesce(c, F.lit(0.0)), 2).alias(c) for c in ("urgent", "other")))


@query()
def approx_distinct_users(spark, sf_dir):
    """Distinct users by event type, estimated."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("n_users"))
