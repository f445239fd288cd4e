"""Retrieval queries: vector search, lexical search, fusion, budgets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions import vectors as V
from siltstone.operators import relational as R
from siltstone.operators import search as S

from .catalog import query, table

_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_DOT = "list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def _vector(spark, d, vec_id):
    """The query vector: one row, bounded by its dimension."""
    return table(spark, d, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()[0]


def _hits(spark, d, vec_id, k, **how):
    return S.search(table(spark, d, "embeddings"), _vector(spark, d, vec_id), k, **how).select("vec_id", "label", F.round("score", 4).alias("score"))


@query(f"SELECT e.vec_id, e.label, round({_COS}, 4) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label < 5 AND {_COS} > 0.0 ORDER BY {_COS} DESC, e.vec_id LIMIT 10")
def k01_cosine_topk(spark, d):
    return _hits(spark, d, 0, 10, where=F.col("label") < 5, threshold=0.0)


@query(f"SELECT e.vec_id, e.label, round({_COS}, 4) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q WHERE {_COS} > 0.1 ORDER BY {_COS} DESC, e.vec_id LIMIT 20")
def k02_threshold_records(spark, d):
    return _hits(spark, d, 3, 20, threshold=0.1)


@query(f"SELECT e.vec_id, e.label, round({_DOT}, 4) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q WHERE e.label = 2 ORDER BY {_DOT} DESC, e.vec_id LIMIT 6")
def k03_inner_product_per_document(spark, d):
    return _hits(spark, d, 7, 6, metric="ip", where=F.col("label") == 2)


@query("SELECT page_id, url, 0.5 AS distance FROM pages ORDER BY page_id")
def k05_all_pages(spark, d):
    return table(spark, d, "pages").select("page_id", "url", F.lit(0.5).alias("distance")).orderBy("page_id")


@query(f"SELECT e.vec_id, e.label, round({_COS}, 4) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 11) q WHERE {_COS} > 0.2 ORDER BY {_COS} DESC, e.vec_id LIMIT 15")
def k08_nano_threshold(spark, d):
    return _hits(spark, d, 11, 15, threshold=0.2)


@query(f"SELECT e.vec_id, e.label, round({_DOT}, 4) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 5) q WHERE e.label > 0 ORDER BY {_DOT} DESC, e.vec_id LIMIT 10")
def k09_level_search(spark, d):
    return _hits(spark, d, 5, 10, metric="ip", where=F.col("label") > 0)


@query(f"SELECT e.vec_id, e.label, round({_COS}, 4) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 9) q WHERE round({_COS}, 6) < 1.0 ORDER BY {_COS} DESC, e.vec_id LIMIT 10")
def k10_similar_without_exact(spark, d):
    near = S.search(table(spark, d, "embeddings"), _vector(spark, d, 9), 10, where=F.round(V.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in _vector(spark, d, 9)])), 6) < 1.0)
    return near.select("vec_id", "label", F.round("score", 4).alias("score"))


@query(f"WITH c AS (SELECT vec_id, embedding FROM embeddings WHERE label = 3) SELECT e.vec_id, round({_COS}, 4) AS score FROM c e, (SELECT embedding FROM embeddings WHERE vec_id = 2) q ORDER BY {_COS} DESC, e.vec_id LIMIT 5")
def k12_cosine_rerank(spark, d):
    some = table(spark, d, "embeddings").filter("label = 3")
    return S.search(some, _vector(spark, d, 2), 5).select("vec_id", F.round("score", 4).alias("score"))


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 6) AS similarity FROM embeddings")
def k13_similarity_kernels(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(V.norm(e), 6).alias("norm"), F.round(V.cosine(e, F.reverse(e)), 6).alias("similarity"))


@query(
    f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round({_COS}, 10) AS sc FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, round(sc, 4) AS score, rank FROM r WHERE rank <= 5"""
)
def k18_batched_topk(spark, d):
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return S.batched_search(q, e, 5).select("query_id", "vec_id", F.round("score", 4).alias("score"), "rank")


@query("SELECT doc_id, n_chars, running FROM (SELECT doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS running FROM documents) WHERE running <= 40000")
def w01_token_budget(spark, d):
    return S.within_budget(table(spark, d, "documents"), "n_chars", ["doc_id"], 40000, ["source"]).select("doc_id", "n_chars", F.col("running").cast("decimal(38,0)").cast("long").alias("running"))


@query(
    """WITH b AS (SELECT min(CASE WHEN c_acctbal > 0 THEN c_acctbal END) lo, max(CASE WHEN c_acctbal > 0 THEN c_acctbal END) hi FROM customer)
    SELECT c_custkey, round(CASE WHEN c_acctbal > 0 THEN CASE WHEN hi > lo THEN (c_acctbal - lo) / (hi - lo) ELSE 1.0 END ELSE 0.0 END, 8) AS scaled FROM customer, b"""
)
def w02_min_max(spark, d):
    return S.min_max(table(spark, d, "customer"), "c_acctbal", "x").select("c_custkey", F.round("x", 8).alias("scaled"))


_BM25 = """WITH t AS (SELECT doc_id, unnest(string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS term FROM documents), l AS (SELECT doc_id, count(*) AS length FROM t WHERE term <> '' GROUP BY 1),
    s AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(length) FROM l) / (SELECT count(*) FROM documents) AS mean_length), f AS (SELECT term, count(DISTINCT doc_id) AS df FROM t WHERE term <> '' GROUP BY 1),
    i AS (SELECT term, n, mean_length, ln((n - df + 0.5) / (df + 0.5)) AS raw FROM f, s), m AS (SELECT sum(raw) / count(*) AS mean_idf FROM i),
    w AS (SELECT term, n, mean_length, CASE WHEN raw < 0 THEN 0.25 * mean_idf ELSE raw END AS idf FROM i, m WHERE term IN ('of', 'and', 'haing')),
    h AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN ('of', 'and', 'haing') GROUP BY 1, 2),
    r AS (SELECT h.doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean_length))), 4) AS score FROM h JOIN w USING (term) JOIN l USING (doc_id) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20)"""


@query(_BM25 + " SELECT * FROM r")
def r01_bm25(spark, d):
    return S.bm25(S.index_of(table(spark, d, "documents")), ["of", "and", "haing"], 20)


@query(
    _BM25
    + f""", v AS (SELECT e.vec_id AS doc_id, {_COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY 2 DESC, 1 LIMIT 20),
    u AS (SELECT doc_id, score AS vs, 0.0 AS ts FROM v UNION ALL SELECT doc_id, 0.0, score FROM r),
    b AS (SELECT min(CASE WHEN vs > 0 THEN vs END) vl, max(CASE WHEN vs > 0 THEN vs END) vh, min(CASE WHEN ts > 0 THEN ts END) tl, max(CASE WHEN ts > 0 THEN ts END) th FROM u),
    x AS (SELECT doc_id, 0.6 * CASE WHEN vs > 0 THEN CASE WHEN vh > vl THEN (vs - vl) / (vh - vl) ELSE 1.0 END ELSE 0.0 END + 0.4 * CASE WHEN ts > 0 THEN CASE WHEN th > tl THEN (ts - tl) / (th - tl) ELSE 1.0 END ELSE 0.0 END AS score FROM u, b)
    SELECT doc_id, round(score, 4) AS score FROM x ORDER BY x.score DESC, doc_id LIMIT 15"""
)
def r04_hybrid_fusion(spark, d):
    v = S.search(table(spark, d, "embeddings"), _vector(spark, d, 0), 20).select(F.col("vec_id").alias("doc_id"), "score")
    t = S.bm25(S.index_of(table(spark, d, "documents")), ["of", "and", "haing"], 20)
    return S.fuse(v, t, 0.6, 15, "doc_id").select("doc_id", F.round("score", 4).alias("score"))


@query("SELECT doc_id, 1 AS store FROM documents WHERE lang = 'fr' UNION ALL SELECT doc_id, 2 FROM documents WHERE source = 'src0'")
def u01_union_hits(spark, d):
    docs = table(spark, d, "documents")
    return docs.filter("lang = 'fr'").select("doc_id", F.lit(1).alias("store")).unionByName(docs.filter("source = 'src0'").select("doc_id", F.lit(2).alias("store")))


@query("SELECT * FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY role, turn ORDER BY conv_id) AS rank FROM conversations) WHERE rank = 1")
def a24_merge_first_wins(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return S.first_by_key(c, ["role", "turn"], ["conv_id"]).withColumn("rank", F.lit(1))


@query("SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) - 1 AS seq FROM documents")
def w04_sequential_ids(spark, d):
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return table(spark, d, "documents").select("doc_id", "source", (F.row_number().over(w) - 1).alias("seq"))


@query(
    f"""WITH h AS (SELECT e.vec_id, {_COS} AS sc FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 6) q ORDER BY 2 DESC, 1 LIMIT 36),
    s AS (SELECT vec_id, round(sc, 10) AS dist, CASE WHEN vec_id % 7 = 0 THEN 0.0 ELSE (vec_id * 37 % 100) / 100.0 END AS llm, (row_number() OVER (ORDER BY sc DESC, vec_id) - 1) // 4 AS batch FROM h)
    SELECT vec_id, batch, round(0.7 * llm + 0.3 * dist, 4) AS combined FROM s"""
)
def r07_weighted_rerank(spark, d):
    """36 hits of a search, scored by a model in batches of four (0 where it gave nothing), in the order of the weighted score."""
    hits = S.search(table(spark, d, "embeddings"), _vector(spark, d, 6), 36).select("vec_id", F.round("score", 10).alias("score"))
    model = hits.filter("vec_id % 7 <> 0").select("vec_id", ((F.col("vec_id") * 37 % 100) / 100.0).alias("relevance"))
    return S.weighted_rerank(hits, model, "vec_id", 0.7, 4).select("vec_id", F.col("batch").cast("long").alias("batch"), "combined")


@query(
    f"""WITH o AS (SELECT ordinality - 1 AS pos, CAST(x AS BIGINT) AS idx FROM (SELECT unnest(['3','1','2','9']) AS x, generate_subscripts(['3','1','2','9'], 1) AS ordinality)),
    h AS (SELECT e.vec_id, {_COS} AS sc FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 6) q ORDER BY 2 DESC, 1 LIMIT 36),
    c AS (SELECT vec_id, row_number() OVER (ORDER BY sc DESC, vec_id) AS idx FROM h) SELECT c.vec_id, o.pos, 4 - o.pos AS score FROM o JOIN c USING (idx)"""
)
def r06_index_list_rerank(spark, d):
    """Hits of a search in the order of the list that a model gave."""
    hits = S.search(table(spark, d, "embeddings"), _vector(spark, d, 6), 36).select("vec_id", "score")
    c = hits.select("vec_id", F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")).cast("long").alias("idx"))  # 36 rows
    order = spark.range(1).select(F.posexplode(F.split(F.lit("3,1,2,9"), ",")).alias("pos", "x")).select(F.col("pos").cast("long").alias("pos"), F.col("x").cast("long").alias("idx"))
    return c.join(F.broadcast(order), "idx").select("vec_id", "pos", (4 - F.col("pos")).alias("score"))


@query(
    f"""WITH h AS (SELECT e.vec_id, {_COS} AS sc FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q ORDER BY 2 DESC, 1 LIMIT 36),
    j AS (SELECT h.vec_id, sc, text, length(text) % 97 / 97.0 AS m FROM h LEFT JOIN documents ON doc_id = h.vec_id)
    SELECT vec_id, row_number() OVER (ORDER BY coalesce(m, -1e9) DESC, vec_id) AS rank FROM j ORDER BY coalesce(m, -1e9) DESC, vec_id LIMIT 8"""
)
def r12_retrieve_and_rerank(spark, d):
    """Many hits are retrieved, a model orders them, the best stay."""
    hits = S.search(table(spark, d, "embeddings"), _vector(spark, d, 3), 36).select("vec_id", "score")
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return S.rerank(hits, texts, "vec_id", lambda t: F.length(t) % 97 / 97.0, 8).select("vec_id", "rank")


@query("SELECT source, count(*) AS n, min(doc_id) AS first FROM documents WHERE source IN ('src1', 'src2') GROUP BY 1")
def r12_full_context(spark, d):
    """Instead of a search, all pages of the documents asked for."""
    docs = S.full_context(table(spark, d, "documents"), "source", ["src1", "src2"], ["doc_id"])
    return docs.groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


_RANKED = "SELECT vec_id, label, rank FROM (SELECT e.vec_id, e.label, row_number() OVER (PARTITION BY e.label ORDER BY {0} DESC, e.vec_id) AS rank FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 12) q WHERE e.label IN (1, 4) AND round({0}, 6) < 1.0) WHERE rank <= 4"


@query(_RANKED.format(_COS))
def r16_passages_by_type(spark, d):
    """The nearest passages of each type wanted, without the query itself."""
    found = S.passages(table(spark, d, "embeddings"), _vector(spark, d, 12), "label", [1, 4], 4)
    return found.select("vec_id", "label", "rank")


@query("WITH h AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) SELECT doc_id, pos // 4 AS batch, CASE WHEN pos % 4 = 3 THEN 0.0 WHEN (doc_id % 13) / 10.0 > 1 THEN 1.0 ELSE (doc_id % 13) / 10.0 END AS relevance FROM h")
def r15_block_relevance(spark, d):
    """A model ranks blocks four at a time in JSON: scores in the order of the blocks, brought to 0..1; blocks that it left out get 0."""
    blocks = R.running(table(spark, d, "documents").select("doc_id"), [], ["doc_id"], F.lit(1), "pos")
    asked = blocks.groupBy(F.expr("pos div 4").alias("batch")).agg(F.array_sort(F.collect_list(F.struct("pos", "doc_id"))).alias("blocks"))
    score = F.transform(F.slice("blocks", 1, 3), lambda b: F.struct((b["doc_id"] % 13 / 10.0).alias("relevance_score")))
    answered = asked.withColumn("answer", F.to_json(F.struct(score.alias("block_rankings"))))
    return S.block_relevance(answered, "blocks", "answer").select(F.col("block.doc_id").alias("doc_id"), "batch", "relevance")


@query(f"SELECT e.vec_id FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 9) q WHERE round({_COS}, 6) < 1.0 AND e.label = (SELECT label FROM embeddings WHERE vec_id = 9)")
def p12_without_exact(spark, d):
    e = table(spark, d, "embeddings")
    label = e.filter("vec_id = 9").select("label").first()[0]
    return S.without_exact(e.filter(F.col("label") == label), _vector(spark, d, 9)).select("vec_id")


@query("SELECT doc_id, min(pos) AS pos FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id, lang) AS pos FROM (SELECT doc_id % 50 AS doc_id, n_chars, lang FROM documents)) GROUP BY 1")
def w03_first_seen(spark, d):
    """Each key where it is first seen, with its rank among all."""
    hits = table(spark, d, "documents").select((F.col("doc_id") % 50).alias("doc_id"), "n_chars", "lang")
    ranked = hits.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id", "lang")))
    return S.first_by_key(ranked, ["doc_id"], ["pos"]).select("doc_id", "pos")


@query(
    f"""WITH h AS (SELECT e.vec_id, {_COS} AS sc FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 4) q WHERE {_COS} > 0.05 ORDER BY 2 DESC, 1 LIMIT 20),
    j AS (SELECT h.vec_id, h.sc, d.text, len(string_split(trim(regexp_replace(d.text, '\\s+', ' ', 'g')), ' ')) AS n FROM h JOIN documents d ON d.doc_id = h.vec_id),
    r AS (SELECT *, sum(n) OVER (ORDER BY sc DESC, vec_id ROWS UNBOUNDED PRECEDING) AS running FROM j) SELECT string_agg(md5(text), chr(10) ORDER BY sc DESC, vec_id) AS context, count(*) AS n FROM r WHERE running <= 10000"""
)
def q01_naive_context(spark, d):
    from siltstone.functions import text as T

    hits = S.search(table(spark, d, "embeddings"), _vector(spark, d, 4), 20, threshold=0.05).select("vec_id", "score")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text", T.token_count(F.col("text")).alias("n"))
    kept = S.within_budget(docs.join(F.broadcast(hits), "vec_id"), "n", [F.desc("score"), "vec_id"], 10000)
    one = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", F.md5("text").alias("t"))))
    return kept.agg(F.array_join(F.transform(one, lambda x: x["t"]), "\n").alias("context"), F.count("*").alias("n"))
