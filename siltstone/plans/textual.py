"""Text functions and chunkers as queries."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import chunks as C

from .catalog import query, table

_TOK = "CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN [] ELSE string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') END"


def _docs(spark, d):
    return table(spark, d, "documents")


@query("SELECT doc_id, CASE WHEN len(regexp_extract_all(t, '[\\x{4e00}-\\x{9fff}]')) >= len(list_filter(string_split_regex(t, '[^\\p{L}\\p{N}_]+'), lambda x: regexp_full_match(x, '[a-zA-Z]+'))) THEN 'zh' ELSE 'en' END AS lang FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '文字中文 ab' ELSE text END AS t FROM documents)")
def f01_language_by_words(spark, d):
    t = F.when(F.col("doc_id") % 2 == 0, "文字中文 ab").otherwise(F.col("text"))
    return _docs(spark, d).select("doc_id", T.language_by_words(t).alias("lang"))


@query("SELECT doc_id, CASE WHEN length(t) = 0 THEN NULL WHEN length(regexp_replace(t, '[^\\x{4e00}-\\x{9fff}]', '', 'g')) > length(regexp_replace(t, '[^A-Za-z]', '', 'g')) THEN 'zh' ELSE 'en' END AS lang FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '中文字符 a' ELSE text END AS t FROM documents)")
def f02_language_by_chars(spark, d):
    t = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, "中文字符 a").otherwise(F.col("text"))
    return _docs(spark, d).select("doc_id", T.language_by_chars(t).alias("lang"))


@query("SELECT page_id, md5(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '^\\s+|\\s+$', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&#x27;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[\\x00-\\x1f\\x{7f}-\\x{9f}]', '', 'g')) AS cleaned FROM pages")
def f04_clean_string(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(T.clean_string(F.col("html"))).alias("cleaned"))


@query("SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\||###'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM documents")
def f05_split_markers(spark, d):
    return _docs(spark, d).select("doc_id", T.split_by_markers(F.col("text"), ["|", "###"]).alias("parts"))


@query("SELECT p_partkey, regexp_full_match(x, '[-+]?[0-9]*\\.?[0-9]+') AS ok FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '-1.5' WHEN 1 THEN '.5' WHEN 2 THEN '1e5' ELSE p_name END AS x FROM part)")
def f06_number_test(spark, d):
    k = F.col("p_partkey") % 4
    return table(spark, d, "part").select("p_partkey", T.is_number(F.when(k == 0, "-1.5").when(k == 1, ".5").when(k == 2, "1e5").otherwise(F.col("p_name"))).alias("ok"))


@query("SELECT n_nationkey, '\"' || n_name || '\",' || chr(9) || '\"' || n_regionkey || '\"' AS line FROM nation")
def f07_csv_rows(spark, d):
    return table(spark, d, "nation").select("n_nationkey", T.to_csv_row(F.array("n_name", F.col("n_regionkey").cast("string"))).alias("line"))


@query("SELECT doc_id, 'doc-' || md5(text) AS id FROM documents")
def f08_hash_id(spark, d):
    return _docs(spark, d).select("doc_id", T.hash_id(F.col("text"), "doc-").alias("id"))


@query("SELECT c_custkey, md5('{\"a\":' || c_custkey || ',\"b\":\"' || c_mktsegment || '\"}') AS key FROM customer")
def f09_args_key(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.md5(F.to_json(F.struct(F.col("c_custkey").alias("a"), F.col("c_mktsegment").alias("b")))).alias("key"))


@query(f"SELECT doc_id, len({_TOK}) AS n, array_to_string(({_TOK})[1:20], ' ') AS head FROM documents")
def f14_tokens(spark, d):
    return _docs(spark, d).select("doc_id", T.token_count(F.col("text")).alias("n"), T.truncate_tokens(F.col("text"), 20).alias("head"))


@query("SELECT doc_id, md5(CASE WHEN regexp_full_match(text, '[\\x00-\\x7F]*', 's') THEN lower(text) ELSE text END) AS t FROM documents")
def f15_ascii_lower(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.ascii_lower(F.col("text"))).alias("t"))


_GLYPHS = "'/seven.tnum/period.tnum/zero.pl.tnum glyph<c=3> /A.cap ' || n_name"


@query(f"SELECT n_nationkey, '7.0  A ' || n_name AS cleaned, 5 AS n FROM nation")
def f17_glyphs(spark, d):
    t = F.concat(F.lit("/seven.tnum/period.tnum/zero.pl.tnum glyph<c=3> /A.cap "), "n_name")
    return table(spark, d, "nation").select("n_nationkey", T.clean_glyphs(t).alias("cleaned"), T.glyph_count(t).alias("n"))


@query("SELECT page_id, 'see  and ' || regexp_extract(url, '#.*$') || chr(10) || 'end' AS cleaned FROM pages")
def f18_markdown(spark, d):
    t = F.concat(F.lit("see [x]("), "url", F.lit(") and "), "url", F.lit("* \n\n\n\nend"))
    return table(spark, d, "pages").select("page_id", T.clean_markdown(F.regexp_replace(t, r"\* \n", "\n")).alias("cleaned"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'no answer' END AS answer FROM customer")
def f19_extract_answer(spark, d):
    t = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('So. The answer to the question is "'), "c_name", F.lit('".'))).otherwise("no answer")
    return table(spark, d, "customer").select("c_custkey", T.extract_answer(t).alias("answer"))


@query("SELECT n_nationkey, n_name AS node1, 'r' || n_regionkey AS node2 FROM nation")
def f20_graph_result(spark, d):
    t = F.concat(F.lit("node1:"), "n_name", F.lit(" node2:r"), "n_regionkey", F.lit(" relation:in"))
    return table(spark, d, "nation").select("n_nationkey", F.regexp_extract(t, "node1:(.*?) node2:", 1).alias("node1"), F.regexp_extract(t, "node2:(.*?) relation:", 1).alias("node2"))


@query("SELECT vec_id, list_transform(embedding[1:4], lambda x: x::FLOAT) AS bbox FROM embeddings")
def f22_bbox(spark, d):
    return table(spark, d, "embeddings").select("vec_id", T.parse_bbox(F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("string"))).alias("bbox"))


@query("SELECT conv_id, string_agg(role || ': ' || md5(text), chr(10) ORDER BY turn, role, md5(text)) AS content FROM conversations GROUP BY conv_id")
def f23_block_text(spark, d):
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.md5("text").alias("t")))).alias("l"))
    return g.select("conv_id", F.array_join(F.transform("l", lambda x: F.concat(x["role"], F.lit(": "), x["t"])), "\n").alias("content"))


@query("SELECT p_partkey, CAST(round_even(p_size / 28.0, 0) * 28 AS BIGINT) AS r, CAST(ceil(p_size / 28.0) * 28 AS BIGINT) AS c, CAST(floor(p_size / 28.0) * 28 AS BIGINT) AS f FROM part")
def f24_factors(spark, d):
    n = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", T.round_by(n, 28).alias("r"), T.ceil_by(n, 28).alias("c"), T.floor_by(n, 28).alias("f"))


@query("SELECT o_orderkey, round(date_diff('second', TIMESTAMP '1992-01-01 00:00:00', o_orderdate) / 3600.0, 4) AS hours FROM orders")
def f25_elapsed(spark, d):
    start = F.to_timestamp(F.lit("1992-01-01, 00:00:00"), "yyyy-MM-dd, HH:mm:ss")
    return table(spark, d, "orders").select("o_orderkey", F.round((F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) - F.unix_timestamp(start)) / 3600.0, 4).alias("hours"))


@query("SELECT doc_id, md5(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) AS t FROM documents")
def f26_ascii_only(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.ascii_only(F.col("text"))).alias("t"))


@query("SELECT n_nationkey, n_name AS head, 'in' AS relation, 'R' || n_regionkey AS tail FROM nation")
def f27_triples(spark, d):
    t = F.concat(F.lit("1. "), "n_name", F.lit(" | in | R"), "n_regionkey", F.lit("\n2. bad | line\n3. x | is | x"))
    return table(spark, d, "nation").select("n_nationkey", F.explode(T.triples(t)).alias("t")).select("n_nationkey", "t.*")


@query("SELECT n_nationkey, n_name || chr(9) || 'in' || chr(9) || n_regionkey || chr(9) || 'd' || n_nationkey AS t FROM nation")
def f29_six_tuple(spark, d):
    j = F.to_json(F.struct(F.col("n_name").alias("head"), F.lit("in").alias("rel"), F.col("n_regionkey").alias("tail"), F.concat(F.lit("d"), "n_nationkey").alias("desc")))
    return table(spark, d, "nation").select("n_nationkey", F.concat_ws("\t", *[F.get_json_object(j, f"$.{k}") for k in ("head", "rel", "tail", "desc")]).alias("t"))


@query("SELECT s_suppkey, upper(s_name) AS entity_name, 'SUPPLIER' AS entity_type, 'from ' || s_nationkey AS description, 'chunk-1' AS source_id FROM supplier WHERE s_suppkey % 3 <> 0")
def f30_entity_records(spark, d):
    kind = F.when(F.col("s_suppkey") % 3 == 0, F.lit('"other"')).otherwise(F.lit('"entity"'))
    r = F.concat_ws("<|>", kind, "s_name", F.lit("supplier"), F.concat(F.lit(" from "), "s_nationkey", F.lit("\x07 ")))
    return table(spark, d, "supplier").select("s_suppkey", T.entity_record(r, F.lit("chunk-1")).alias("e")).filter("e IS NOT NULL").select("s_suppkey", "e.*")


@query("SELECT s_suppkey, upper(s_name) AS src_id, 'N' || s_nationkey AS tgt_id, CASE WHEN s_suppkey % 2 = 0 THEN 2.5 ELSE 1.0 END AS weight FROM supplier")
def f30_relation_records(spark, d):
    w = F.when(F.col("s_suppkey") % 2 == 0, "2.5").otherwise("heavy")
    r = F.concat_ws("<|>", F.lit('"relationship"'), "s_name", F.concat(F.lit("n"), "s_nationkey"), F.lit("ships"), w)
    return table(spark, d, "supplier").select("s_suppkey", T.relation_record(r, F.lit("c")).alias("e")).select("s_suppkey", "e.src_id", "e.tgt_id", "e.weight")


@query("SELECT r_regionkey, '# ' || r_name || chr(10) || chr(10) || 'sum' || chr(10) || chr(10) || '## a' || chr(10) || chr(10) || r_name AS report FROM region")
def f31_report(spark, d):
    found = F.array(F.struct(F.lit("a").alias("summary"), F.col("r_name").alias("explanation")))
    return table(spark, d, "region").select("r_regionkey", T.report_markdown(F.col("r_name"), F.lit("sum"), found).alias("report"))


@query(f"SELECT doc_id, len({_TOK}) < 300 AS short, CASE WHEN len({_TOK}) < 300 THEN md5(text) ELSE md5(array_to_string(({_TOK})[1:300], ' ')) END AS kept FROM documents")
def f35_description_branch(spark, d):
    t, n = F.col("text"), T.token_count(F.col("text"))
    return _docs(spark, d).select("doc_id", (n < 300).alias("short"), F.when(n < 300, F.md5(t)).otherwise(F.md5(T.truncate_tokens(t, 300))).alias("kept"))


@query("SELECT n_nationkey, 'search' AS name, n_name AS args FROM nation")
def f37_tool_call(spark, d):
    t = F.concat(F.lit("Thought\nAction: old\nAction Input: x\nObservation: y\nAction: search\nAction Input: "), "n_name", F.lit("\nObservation:"))
    return table(spark, d, "nation").select("n_nationkey", T.tool_call(t).alias("c")).select("n_nationkey", "c.*")


@query("SELECT n_nationkey, 'chat/completions/' || n_nationkey AS endpoint FROM nation")
def f38_endpoint(spark, d):
    return table(spark, d, "nation").select("n_nationkey", T.api_endpoint(F.concat(F.lit("https://api.example.com/v1/chat/completions/"), "n_nationkey")).alias("endpoint"))


@query("SELECT n_nationkey, unnest(['user', 'assistant', 'user']) AS role, unnest([n_name, 'a', 'b']) AS content FROM nation")
def f39_message_pairs(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.explode(T.message_pairs(F.array("n_name", F.lit("a"), F.lit("b")))).alias("m")).select("n_nationkey", "m.*")


@query("SELECT conv_id, turn, role, role = 'user' AND rtrim(text) LIKE '%.' AS ends FROM conversations")
def f40_ends_with(spark, d):
    kind = F.when(F.col("role") == "user", "text").otherwise("table")
    return table(spark, d, "conversations").select("conv_id", "turn", "role", T.ends_with_colon(kind, F.regexp_replace("text", r"\.$", ":")).alias("ends"))


@query("SELECT item_id, unnest(['first part', 'second']) AS q FROM benchmark")
def r11_decompose(spark, d):
    t = F.lit("Here:\n1. first part\n2) second\nend")
    return table(spark, d, "benchmark").select("item_id", F.explode(T.number_list(t)).alias("q"))


@query("SELECT item_id, unnest(['a' || item_id, 'b', 'c']) AS q FROM benchmark")
def r10_rewrites(spark, d):
    j = F.concat(F.lit('{"queries": ["a'), "item_id", F.lit('", "b", "c", "d"]}'))
    q = F.coalesce(F.from_json(j, "queries array<string>")["queries"], F.filter(F.split(j, "\n"), lambda x: F.trim(x) != ""))
    return table(spark, d, "benchmark").select("item_id", F.explode(F.slice(q, 1, 3)).alias("q"))


@query("SELECT doc_id, 'Text retrieved from page 1: ' || chr(10) || '\"\"\"' || chr(10) || lang || chr(10) || '\"\"\"' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'Text retrieved from page 2: ' || chr(10) || '\"\"\"' || chr(10) || source || chr(10) || '\"\"\"' AS context FROM documents")
def r14_context(spark, d):
    pages = F.array(F.struct(F.lit(1).alias("page"), F.col("lang").alias("text")), F.struct(F.lit(2).alias("page"), F.col("source").alias("text")))
    return _docs(spark, d).select("doc_id", T.numbers_context(pages).alias("context"))


_STEPS = "SELECT doc_id, t, unnest(range(0, len(t), {step})) AS pos FROM (SELECT doc_id, %s AS t FROM documents) WHERE len(t) > 0" % _TOK


@query(f"SELECT doc_id, pos // 100 AS chunk_no, len(t[pos + 1:pos + 128]) AS n_tokens, md5(array_to_string(t[pos + 1:pos + 128], ' ')) AS chunk FROM ({_STEPS.format(step=100)})")
def c04_token_windows(spark, d):
    return C.by_tokens(_docs(spark, d), "text", 128, 28, ["doc_id"]).withColumn("chunk", F.md5("chunk"))


@query(f"""SELECT doc_id, n AS chunk_no, len(t[n * 250 + 1:n * 250 + 300]) AS n_tokens, md5(array_to_string(t[n * 250 + 1:n * 250 + 300], ' ')) AS chunk FROM
    (SELECT doc_id, t, unnest(range(0, greatest(1, CAST(ceil((len(t) - 50) / 250.0) AS BIGINT)))) AS n FROM (SELECT doc_id, {_TOK} AS t FROM documents) WHERE len(t) > 0)""")
def c06_fixed_tokens(spark, d):
    return C.by_fixed_tokens(_docs(spark, d), "text", 300, 50, ["doc_id"]).withColumn("chunk", F.md5("chunk"))


@query("SELECT doc_id, pos // 900 + 1 AS chunk_id, md5(substr(x, pos + 1, 1000)) AS chunk FROM (SELECT doc_id, x, unnest(range(0, length(x), 900)) AS pos FROM (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') AS x FROM documents) WHERE length(x) > 0)")
def c11_char_windows(spark, d):
    docs = _docs(spark, d).select("doc_id", T.ascii_only(F.col("text")).alias("x"))
    return C.by_chars(docs, "x", 1000, 100, ["doc_id"]).withColumn("chunk", F.md5("chunk"))


@query("SELECT doc_id, md5(trim(p)) AS paragraph FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM documents) WHERE trim(p) <> ''")
def c13_paragraphs(spark, d):
    return C.by_paragraph(_docs(spark, d), "text", ["doc_id"], "\n").select("doc_id", F.md5("paragraph").alias("paragraph"))


@query(f"SELECT doc_id, pos // 256 AS chunk_no, len(t[pos + 1:pos + 256]) AS n_tokens, md5(array_to_string(t[pos + 1:pos + 256], ' ')) AS chunk FROM ({_STEPS.format(step=256)})")
def c14_disjoint_windows(spark, d):
    return C.by_tokens(_docs(spark, d), "text", 256, 0, ["doc_id"]).withColumn("chunk", F.md5("chunk"))


@query(f"SELECT doc_id, pos // 896 AS chunk_no, md5(array_to_string(t[pos + 1:pos + 1024], ' ')) AS hash_code FROM ({_STEPS.format(step=896)})")
def c15_report_chunks(spark, d):
    return C.by_tokens(_docs(spark, d), "text", 1024, 128, ["doc_id"]).select("doc_id", "chunk_no", T.hash_id(F.col("chunk")).alias("hash_code"))


@query("""WITH m AS (SELECT doc_id, 'intro' || chr(10) || '# A' || doc_id || chr(10) || 'body' || chr(10) || '####### x' || chr(10) || '  ## B ' || chr(10) || lang AS t FROM documents)
    SELECT doc_id, unnest([0, 1, 2]) AS section, unnest([0, 1, 2]) AS level, unnest(['', 'A' || doc_id, 'B']) AS header, unnest(['intro', 'body' || chr(10) || '####### x', split_part(t, chr(10), 6)]) AS content FROM m""")
def c01_markdown_headers(spark, d):
    t = F.concat(F.lit("intro\n# A"), "doc_id", F.lit("\nbody\n####### x\n  ## B \n"), "lang")
    return C.by_headers(_docs(spark, d).select("doc_id", t.alias("t")), "t", "doc_id")


@query("""WITH p AS (SELECT o_custkey AS doc, CAST(o_orderkey % 7 + 1 AS INT) AS page, min(o_orderkey) AS k FROM orders GROUP BY ALL), l AS (SELECT doc, unnest(range(1, max(page) + 1)) AS page FROM p GROUP BY doc)
    SELECT l.doc, CAST(l.page AS INT) AS page, coalesce(CAST(k AS VARCHAR), '') AS text FROM l LEFT JOIN p ON p.doc = l.doc AND p.page = l.page""")
def w05_fill_pages(spark, d):
    p = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("doc"), (F.col("o_orderkey") % 7 + 1).cast("int").alias("page")).agg(F.min("o_orderkey").cast("string").alias("text"))
    return C.fill_pages(p, "doc", "page", "text")


@query()
def c03_size_splits(spark, d):
    return C.by_function(_docs(spark, d), "text", ["doc_id"], partial(C.split_by_size, size=400, overlap=40, stops=C.STOPS["en"]))


@query()
def c08_recursive_splits(spark, d):
    return C.by_function(_docs(spark, d), "text", ["doc_id"], partial(C.recursive_split, size=500))


@query("""WITH e AS (SELECT vec_id, vec_id % 20 AS doc, embedding::DOUBLE[] AS v FROM embeddings), f AS (SELECT doc, vec_id, 1 - list_cosine_similarity(v, lag(v) OVER (PARTITION BY doc ORDER BY vec_id)) AS far FROM e),
    c AS (SELECT doc, quantile_cont(far, 0.95) AS cut FROM f GROUP BY 1) SELECT doc, vec_id, CAST(sum(CASE WHEN far > cut THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY vec_id) AS BIGINT) AS "group" FROM f JOIN c USING (doc)""")
def c09_semantic_groups(spark, d):
    e = table(spark, d, "embeddings").withColumn("doc", F.col("vec_id") % 20)
    return C.semantic_breaks(e, "doc", "vec_id", "embedding")


_FAR = "WITH e AS (SELECT vec_id, vec_id % 20 AS doc, embedding::DOUBLE[] AS v FROM embeddings), f AS (SELECT doc, vec_id, 1 - list_cosine_similarity(v, lag(v) OVER (PARTITION BY doc ORDER BY vec_id)) AS far FROM e)"
_GROUPS = 'SELECT doc, vec_id, CAST(sum(CASE WHEN {} > cut THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY vec_id) AS BIGINT) AS "group" FROM {} JOIN c USING (doc)'


def _grouped(spark, d, **how):
    return C.semantic_breaks(table(spark, d, "embeddings").withColumn("doc", F.col("vec_id") % 20), "doc", "vec_id", "embedding", **how)


@query(f"{_FAR}, c AS (SELECT doc, avg(far) + 1.2 * stddev_pop(far) AS cut FROM f GROUP BY 1) {_GROUPS.format('far', 'f')}")
def c09_semantic_deviation(spark, d):
    return _grouped(spark, d, kind="deviation", amount=1.2)


@query(f"{_FAR}, c AS (SELECT doc, avg(far) + 0.6 * (quantile_cont(far, 0.75) - quantile_cont(far, 0.25)) AS cut FROM f GROUP BY 1) {_GROUPS.format('far', 'f')}")
def c09_semantic_quartiles(spark, d):
    return _grouped(spark, d, kind="quartiles", amount=0.6)


@query(
    f"""{_FAR}, g AS (SELECT doc, vec_id, CASE WHEN far IS NULL THEN NULL WHEN lag(far) OVER w IS NULL THEN lead(far) OVER w - far WHEN lead(far) OVER w IS NULL THEN far - lag(far) OVER w ELSE (lead(far) OVER w - lag(far) OVER w) / 2 END AS slope
    FROM f WINDOW w AS (PARTITION BY doc ORDER BY vec_id)), c AS (SELECT doc, quantile_cont(slope, 0.9) AS cut FROM g GROUP BY 1) {_GROUPS.format('slope', 'g')}"""
)
def c09_semantic_gradient(spark, d):
    return _grouped(spark, d, kind="gradient", percent=0.9)


@query(
    """WITH w AS (SELECT doc_id // 100 AS part, doc_id FROM documents WHERE len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) > 60)
    SELECT part, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM w GROUP BY 1"""
)
def x09_packed_chunks(spark, d):
    """A table function in SQL: texts packed to chunks of 61 words in runs of 100 ids; the texts that are chunks of their own for their length."""
    C.register(spark)
    table(spark, d, "documents").select(F.expr("doc_id div 100").alias("part"), "doc_id", F.concat_ws(" ", "doc_id", "text").alias("text")).createOrReplaceTempView("_x09_documents")
    found = spark.sql("SELECT * FROM packed_chunks(TABLE(_x09_documents) PARTITION BY part ORDER BY (doc_id), 'text', 61)")
    alone = found.filter((F.col("n_rows") == 1) & (F.size(T.tokens(F.col("chunk"))) > 61))
    return alone.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.substring_index("chunk", " ", 1).cast("long")).alias("ids"))
