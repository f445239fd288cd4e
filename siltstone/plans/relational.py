"""Relational queries: filters, joins, aggregates, windows, set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import graph as G
from siltstone.operators import relational as R
from siltstone.streaming import streams as ST

from .catalog import query, table


@query("SELECT d.doc_id, d.n_chars FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id WHERE length(d.text) >= 200 AND length(d.text) < 65535 AND len(e.embedding) > 0")
def p01_ingest_filter(spark, d):
    docs = table(spark, d, "documents").filter(F.length("text").between(200, 65534)).select("doc_id", "n_chars")
    e = table(spark, d, "embeddings").filter(F.size("embedding") > 0).select(F.col("vec_id").alias("doc_id"))
    return docs.join(e, "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE length(text) < 65535 AND text <> ''")
def p02_corpus_filter(spark, d):
    return table(spark, d, "documents").filter((F.length("text") < 65535) & (F.col("text") != "")).select("doc_id", "lang")


@query("SELECT vec_id, label FROM embeddings WHERE label = 3")
def p03_scope_filter(spark, d):
    return table(spark, d, "embeddings").filter("label = 3").select("vec_id", "label")


@query("SELECT doc_id, source FROM documents WHERE source = 'src7'")
def p04_path_filter(spark, d):
    return table(spark, d, "documents").filter("source = 'src7'").select("doc_id", "source")


@query("SELECT event_id, value FROM events WHERE value > 50")
def p05_score_threshold(spark, d):
    return table(spark, d, "events").filter("value > 50").select("event_id", "value")


@query("SELECT vec_id, label, CASE WHEN label = 0 THEN 0 ELSE 1 END AS mode FROM embeddings")
def p06_level_modes(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    return e.filter("label = 0").withColumn("mode", F.lit(0)).unionByName(e.filter("label > 0").withColumn("mode", F.lit(1)))


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3 ORDER BY c_custkey LIMIT 10")
def p07_conditions(spark, d):
    return R.select_where(table(spark, d, "customer"), {"c_mktsegment": "BUILDING", "c_nationkey": 3}, 10, "c_custkey").select("c_custkey", "c_name")


@query("SELECT * FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 25")
def p08_all_ordered(spark, d):
    return table(spark, d, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(25)


@query("SELECT event_id, event_type FROM events WHERE event_type NOT IN ('view', 'error')")
def p09_ignored_types(spark, d):
    return table(spark, d, "events").filter(~F.col("event_type").isin("view", "error")).select("event_id", "event_type")


@query("SELECT conv_id, turn, trim(text) AS text FROM conversations WHERE role = 'user' AND trim(text) <> ''")
def p10_text_items(spark, d):
    c = table(spark, d, "conversations").filter("role = 'user'").withColumn("text", F.trim("text"))
    return c.filter("text <> ''").select("conv_id", "turn", "text")


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def p11_with_summaries(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").filter("quality IS NOT NULL").select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def p13_unstored_keys(spark, d):
    return R.missing_keys(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name <> ' ' AND s_acctbal >= 0")
def p14_valid_edges(spark, d):
    return R.join_where(table(spark, d, "supplier"), table(spark, d, "nation"), "a.s_nationkey = b.n_nationkey", ["s_suppkey", "n_name"], "n_name <> ' ' AND s_acctbal >= 0")


@query("WITH t AS (SELECT item_id, unnest(string_split(lower(text), ' ')) AS token FROM benchmark), v AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS token FROM documents) SELECT item_id, token, count(*) AS n FROM t WHERE token IN (SELECT token FROM v) GROUP BY ALL")
def p15_vocabulary_filter(spark, d):
    t = table(spark, d, "benchmark").select("item_id", F.explode(F.split(F.lower("text"), " ")).alias("token"))
    v = table(spark, d, "documents").select(F.explode(F.split(F.lower("text"), " ")).alias("token")).distinct()
    return t.join(v, "token", "left_semi").groupBy("item_id", "token").agg(F.count("*").alias("n"))


@query("SELECT i.id AS doc_id, d.lang, d.n_chars FROM (SELECT unnest([5, 2, 999999, 17]) AS id) i LEFT JOIN documents d ON d.doc_id = i.id")
def p16_by_ids(spark, d):
    ids = spark.range(1).select(F.explode(F.array(*[F.lit(x).cast("long") for x in (5, 2, 999999, 17)])).alias("doc_id"))
    return ids.join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id", "left")


@query("SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN [] ELSE list_transform(list_filter(list(turn ORDER BY turn), lambda x: x > 0), lambda x: x - 1) END AS pages FROM conversations GROUP BY conv_id")
def p17_reference_pages(spark, d):
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("t"))
    return g.select("conv_id", F.when(F.col("conv_id") % 3 == 0, F.array().cast("array<long>")).otherwise(F.transform(F.filter("t", lambda x: x > 0), lambda x: x - 1)).alias("pages"))


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000 ORDER BY c_custkey LIMIT 50")
def j01_join_where(spark, d):
    return R.join_where(table(spark, d, "customer"), table(spark, d, "nation"), "a.c_nationkey = b.n_nationkey", ["c_custkey", "n_name"], "c_acctbal > 5000", 50, ["c_custkey"])


@query("WITH h AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS rank FROM conversations) SELECT h.conv_id, min(h.rank) AS rank, p.page_id, length(p.html) AS n FROM h JOIN pages p ON p.page_id = h.conv_id % 50 GROUP BY h.conv_id, p.page_id, p.html")
def j02_parent_page(spark, d):
    w = Window.partitionBy("conv_id").orderBy(F.desc(F.length("text")), "turn")
    h = table(spark, d, "conversations").select("conv_id", (F.col("conv_id") % 50).alias("page_id"), F.row_number().over(w).alias("rank"))
    best = h.groupBy("conv_id", "page_id").agg(F.min("rank").alias("rank"))
    return best.join(table(spark, d, "pages").select("page_id", F.length("html").alias("n")), "page_id").select("conv_id", "rank", "page_id", "n")


@query("SELECT e.vec_id, coalesce(d.lang, '') AS lang FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id * 3")
def j03_hit_text(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") * 3).alias("doc_id"))
    return e.join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", "left").select("vec_id", R.coalesced(F.col("lang")).alias("lang"))


@query("WITH q AS (SELECT n_name, unnest([1, 2, 3]) AS page FROM nation), s AS (SELECT s_nationkey, min(s_suppkey) AS k FROM supplier GROUP BY 1) SELECT q.n_name, q.page, coalesce(CAST(s.k AS VARCHAR), '') AS sha1 FROM q JOIN nation n USING (n_name) LEFT JOIN s ON s.s_nationkey = n.n_nationkey")
def j04_company_references(spark, d):
    first = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("k"))
    n = table(spark, d, "nation").join(first, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return n.select("n_name", F.explode(F.array(*[F.lit(x) for x in (1, 2, 3)])).alias("page"), R.coalesced(F.col("k").cast("string")).alias("sha1"))


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def j05_metadata_join(spark, d):
    c = table(spark, d, "customer").filter("c_acctbal > 0").select("c_custkey", "c_name")
    return table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name")


@query("SELECT l_orderkey, l_linenumber, coalesce(p_name, '') AS p_name FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 25) ON l_partkey = p_partkey")
def j06_source_join(spark, d):
    p = table(spark, d, "part").filter("p_size > 25").select("p_partkey", "p_name")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(p, F.col("l_partkey") == F.col("p_partkey"), "left").select("l_orderkey", "l_linenumber", R.coalesced(F.col("p_name")).alias("p_name"))


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def j16_entity_pairs(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    return R.join_where(n, n, "a.n_nationkey < b.n_nationkey", ["a.n_name AS a", "b.n_name AS b"])


@query("SELECT source, string_agg(md5(text), chr(10) || chr(10) ORDER BY doc_id) AS joined FROM documents GROUP BY source")
def j18_blocks_by_title(spark, d):
    g = table(spark, d, "documents").groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", F.md5("text").alias("t")))).alias("b"))
    return g.select("source", F.array_join(F.transform("b", lambda x: x["t"]), "\n\n").alias("joined"))


_EV = "SELECT event_id, user_id, ts, event_type, value FROM events"


@query("""WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts, value FROM events WHERE event_type = 'click')
    SELECT l.event_id, l.user_id, (SELECT arg_max(value, (ts, value)) FROM r WHERE r.user_id = l.user_id AND r.ts <= l.ts) AS right_value FROM l""")
def j21_asof(spark, d):
    e = table(spark, d, "events")
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.filter("event_type = 'click'").select("user_id", "ts", "value")
    return R.asof_join(left, right, "user_id", "ts", ["value"]).select("event_id", "user_id", "right_value")


@query("SELECT o_orderkey, p_partkey FROM orders JOIN part ON o_totalprice >= p_retailprice AND o_totalprice < p_retailprice + p_size")
def j21_range(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    p = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("lo"), (F.col("p_retailprice") + F.col("p_size")).alias("hi"))
    return R.range_join(o, p, "o_totalprice", "lo", "hi", 50.0).select("o_orderkey", "p_partkey")


@query("SELECT c_custkey, o.n AS n_orders, c_nationkey FROM customer FULL OUTER JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) o ON c_custkey = o_custkey")
def j21_full_outer(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("n_orders"))
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "full").select("c_custkey", "n_orders", "c_nationkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j21_anti(spark, d):
    """Customers without an order."""
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT l_returnflag, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1")
def a01_group_aggregate(spark, d):
    return R.aggregate_by(table(spark, d, "lineitem"), "l_returnflag", "round(sum(l_extendedprice), 2)", "total")


@query("SELECT count(*) AS total, CAST(ceil(count(*) / 30.0) AS BIGINT) AS pages FROM orders WHERE o_orderpriority = '1-URGENT'")
def a02_page_totals(spark, d):
    return R.page_totals(table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'"), 30)


@query("SELECT max(label) AS top FROM embeddings")
def a03_scalar_max(spark, d):
    return table(spark, d, "embeddings").agg(F.max("label").alias("top"))


@query("SELECT DISTINCT c_mktsegment FROM customer")
def a21_distinct_names(spark, d):
    return table(spark, d, "customer").select("c_mktsegment").distinct()


@query("SELECT DISTINCT md5(text) AS line FROM documents")
def a22_dedupe_lines(spark, d):
    return table(spark, d, "documents").select(F.md5("text").alias("line")).distinct()


@query("SELECT md5(text) AS h, min(doc_id) AS first FROM documents GROUP BY 1")
def a23_keep_first(spark, d):
    w = Window.partitionBy("h").orderBy("first")
    return table(spark, d, "documents").select(F.md5("text").alias("h"), F.col("doc_id").alias("first")).withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


@query("SELECT source, lang, max(doc_id) AS last FROM documents GROUP BY ALL")
def a25_last_wins(spark, d):
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.max("doc_id").alias("last"))


@query("SELECT role, sum(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))) AS tokens, count(*) AS requests FROM conversations GROUP BY role")
def a26_token_accounting(spark, d):
    return table(spark, d, "conversations").groupBy("role").agg(F.sum(T.token_count(F.col("text"))).alias("tokens"), F.count("*").alias("requests"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag) AS g1, grouping(l_linestatus) AS g2 FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def a27_cube(spark, d):
    g = table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus")
    return g.agg(F.count("*").alias("n"), F.grouping("l_returnflag").cast("int").alias("g1"), F.grouping("l_linestatus").cast("int").alias("g2"))


@query("SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def a27_rollup(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def a27_percentiles(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("median"), F.round(F.percentile("value", 0.95), 6).alias("p95"))


@query("SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1")
def a27_salted_count(spark, d):
    return R.salted_count(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k")), "k")


@query("SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_name) AS rank FROM customer")
def w07_ranking(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_name")).alias("rank"))


@query("SELECT l_orderkey, l_linenumber, rank() OVER w AS r, dense_rank() OVER w AS dr, lag(l_quantity) OVER w AS prev, lead(l_quantity) OVER w AS nxt, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)")
def w08_analytic(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("dr"), F.lag("l_quantity").over(w).alias("prev"), F.lead("l_quantity").over(w).alias("nxt"),
        F.round(F.sum("l_quantity").over(w.rowsBetween(-2, 0)), 4).alias("moving"),
    )


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY date_diff('day', TIMESTAMP '1970-01-01', o_orderdate) RANGE BETWEEN 90 PRECEDING AND CURRENT ROW) AS recent FROM orders")
def w08_range_frame(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.unix_date(F.to_date("o_orderdate"))).rangeBetween(-90, 0)
    return table(spark, d, "orders").select("o_orderkey", F.count("*").over(w).alias("recent"))


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate, o_orderkey OFFSET 40 LIMIT 20")
def k14_page(spark, d):
    return R.page(table(spark, d, "orders"), 3, 20, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_custkey")


@query("SELECT p_name, p_partkey FROM part ORDER BY p_name, p_partkey")
def k15_external_sort(spark, d):
    return table(spark, d, "part").select("p_name", "p_partkey").orderBy("p_name", "p_partkey")


@query("SELECT DISTINCT source, lang FROM documents ORDER BY ALL")
def k16_sort_dedupe(spark, d):
    return table(spark, d, "documents").select("source", "lang").distinct().orderBy("source", "lang")


@query("SELECT 'c' AS kind, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 's', s_suppkey, s_name FROM supplier")
def u02_concatenate(spark, d):
    c = table(spark, d, "customer").select(F.lit("c").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return c.unionByName(table(spark, d, "supplier").select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))


@query("SELECT doc_id, NULL AS page_id FROM documents UNION ALL SELECT NULL, page_id FROM pages")
def u06_concat_frames(spark, d):
    return table(spark, d, "documents").select("doc_id").unionByName(table(spark, d, "pages").select("page_id"), allowMissingColumns=True)


@query("(SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)")
def u07_intersect(spark, d):
    return table(spark, d, "customer").select("c_nationkey").intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("SELECT l_suppkey, l_linenumber FROM lineitem EXCEPT ALL SELECT l_suppkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'")
def u07_except_all(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_suppkey", "l_linenumber").exceptAll(li.filter("l_returnflag = 'R'").select("l_suppkey", "l_linenumber"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def t03_tumbling(spark, d):
    g = table(spark, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")


@query("WITH s AS (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS start FROM events) SELECT start, count(*) AS n FROM s GROUP BY 1")
def t03_sliding(spark, d):
    g = table(spark, d, "events").groupBy(F.window("ts", "12 hours", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def t03_session(spark, d):
    g = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("""WITH e AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e),
    r AS (SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n, round(sum(value), 4) AS total, first(event_type ORDER BY ts, event_type) AS first_type, last(event_type ORDER BY ts, event_type) AS last_type FROM s GROUP BY user_id, k)
    SELECT user_id, first, last, n, total, first_type, last_type FROM r WHERE epoch_ms(last) + 7200001 <= (SELECT epoch_ms(max(ts)) FROM events) - 600000""")
def t03_stateful_runs(spark, d):
    """Runs of each user's events by a stateful stream; those that the watermark hasn't closed yet aren't given."""
    events = ST.read_stream(spark, f"{d}/events*.parquet", table(spark, d, "events").schema)
    path = G.shared_path(spark, "runs")
    found = ST.run_to_files(ST.user_runs(events, 7200, "10 minutes"), f"{path}/out", f"{path}/state")
    return found.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("first", "last")], "n", F.round("total", 4).alias("total"), "first_type", "last_type")


@query("SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) AS days, last_day(o_orderdate) AS month_end FROM orders")
def f34_dates(spark, d):
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.year(day).alias("y"), F.quarter(day).alias("q"), F.datediff(day, F.lit("1992-01-01")).alias("days"), F.last_day(day).alias("month_end"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def f34_json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
