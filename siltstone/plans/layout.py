"""Sources, sinks and document-layout queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import chunks as C

from .catalog import query, table


@query("SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS term FROM documents) WHERE term <> '' GROUP BY ALL")
def s25_postings(spark, d):
    from siltstone.operators.search import postings

    return postings(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "term", "tf")


@query("SELECT doc_id, pos + 1 AS id, md5(p) AS body, source || '.pdf' AS path FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents) WHERE trim(p) <> ''")
def s27_chunk_blocks(spark, d):
    p = C.by_paragraph(table(spark, d, "documents").withColumn("path", F.concat("source", F.lit(".pdf"))), "text", ["doc_id", "path"], "\n")
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw"), F.concat("source", F.lit(".pdf")).alias("path"))
    return p.select("doc_id", "path", "pos").join(docs, ["doc_id", "path", "pos"]).select("doc_id", (F.col("pos") + 1).alias("id"), F.md5("raw").alias("body"), "path")


@query("SELECT r_regionkey AS level, unnest(list(n_name ORDER BY n_name)) AS entity FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def s28_layers(spark, d):
    layers = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("layer"))
    return layers.select(F.col("n_regionkey").alias("level"), F.explode("layer").alias("entity"))


@query("SELECT c_nationkey, (list(CAST(c_custkey AS VARCHAR) ORDER BY c_custkey))[1:5] AS first_ids FROM customer GROUP BY 1")
def s29_first_sources(spark, d):
    g = table(spark, d, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list("c_custkey")).alias("l"))
    joined = g.select("c_nationkey", F.array_join(F.transform("l", lambda x: x.cast("string")), "|").alias("s"))
    return joined.select("c_nationkey", F.slice(F.split("s", r"\|"), 1, 5).alias("first_ids"))


@query("SELECT p_partkey, 0 AS level FROM part WHERE length(p_name) <= 190 AND length(p_type) <= 190")
def s30_origin_relations(spark, d):
    return table(spark, d, "part").filter((F.length("p_name") <= 190) & (F.length("p_type") <= 190)).select("p_partkey", F.lit(0).alias("level"))


@query("SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def s38_metadata_lookup(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name")  # 25 rows
    return table(spark, d, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "n_name")


@query("SELECT source, list(doc_id ORDER BY doc_id) AS ids, count(*) AS n FROM documents GROUP BY 1")
def e06_flat_blocks(spark, d):
    nested = table(spark, d, "documents").groupBy("source").agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    flat = nested.select("source", F.posexplode("ids").alias("pos", "id"))
    return flat.groupBy("source").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.count("*").alias("n"))


@query("SELECT conv_id, max(CASE WHEN role = 'user' THEN md5(text) END) AS caption, max(CASE WHEN role = 'assistant' THEN md5(text) END) AS footnote FROM conversations GROUP BY 1")
def e11_captions(spark, d):
    of = lambda r: F.max(F.when(F.col("role") == r, F.md5("text")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(of("user").alias("caption"), of("assistant").alias("footnote"))


@query("SELECT page_id, len(string_split(html, '<p>')) - 1 AS n_paragraphs, length(html) AS n_chars FROM pages")
def e12_page_counts(spark, d):
    return table(spark, d, "pages").select("page_id", (F.size(F.split("html", "<p>")) - 1).alias("n_paragraphs"), F.length("html").alias("n_chars"))


@query("SELECT source, CAST(doc_id // 20 + 1 AS BIGINT) AS page, string_agg(md5(text), chr(10) ORDER BY doc_id) AS text FROM documents GROUP BY ALL")
def e04_page_text(spark, d):
    g = table(spark, d, "documents").groupBy("source", (F.floor(F.col("doc_id") / 20) + 1).alias("page")).agg(F.array_sort(F.collect_list(F.struct("doc_id", F.md5("text").alias("t")))).alias("l"))
    return g.select("source", "page", F.array_join(F.transform("l", lambda x: x["t"]), "\n").alias("text"))


@query("WITH b AS (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role) AS nxt FROM conversations) SELECT conv_id, turn, role, role = 'user' AND nxt = 'assistant' AS joined FROM b")
def w06_adjacent_rules(spark, d):
    from pyspark.sql import Window

    nxt = F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn", "role"))
    return table(spark, d, "conversations").withColumn("nxt", nxt).select("conv_id", "turn", "role", ((F.col("role") == "user") & (F.col("nxt") == "assistant")).alias("joined"))


@query("SELECT source, '| id | lang |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || doc_id || ' | ' || lang || ' |', chr(10) ORDER BY doc_id) AS md FROM documents GROUP BY 1")
def f21_markdown_table(spark, d):
    rows = table(spark, d, "documents").groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", "lang"))).alias("l"))
    line = F.transform("l", lambda x: F.concat(F.lit("| "), x["doc_id"].cast("string"), F.lit(" | "), x["lang"], F.lit(" |")))
    return rows.select("source", F.concat(F.lit("| id | lang |\n| --- | --- |\n"), F.array_join(line, "\n")).alias("md"))


@query("SELECT source, round(quantile_cont(n_chars, 0.9), 4) AS p90, min(n_chars) AS lo, max(n_chars) AS hi FROM documents GROUP BY 1")
def m11_percentiles(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.round(F.percentile("n_chars", 0.9), 4).alias("p90"), F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"))
