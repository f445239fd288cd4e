"""Composite retrieval pipelines over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import providers as P
from siltstone.functions import text as T
from siltstone.operators import graph as G
from siltstone.operators import search as S

from .catalog import query, table
from .clusters import EMBED


def answer_contexts(questions: DataFrame, chunks: DataFrame, k: int, budget: int) -> DataFrame:
    """question_id, context, n of the k best chunks (chunk_id, text, embedding) of each question (question_id, embedding) within a token budget."""
    hits = S.batched_search(questions, chunks.select("chunk_id", "embedding"), k, "question_id", "chunk_id")
    texts = hits.join(chunks.select("chunk_id", "text", T.token_count(F.col("text")).alias("tokens")), "chunk_id")
    kept = S.within_budget(texts, "tokens", ["rank"], budget, ["question_id"])
    g = kept.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("chunk_id").alias("page"), "text"))).alias("l"))
    return g.select("question_id", T.numbers_context(F.col("l")).alias("context"), F.size("l").alias("n"))


@query()
def q15_question_contexts(spark, d):
    docs = table(spark, d, "documents")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), "text", P.embed(F.col("text")).alias("embedding"))
    questions = table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), P.embed(F.col("text")).alias("embedding"))
    return answer_contexts(questions, G.settled(chunks, "chunks"), 5, 4000)


@query("""WITH h AS (SELECT e.vec_id FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) q WHERE list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) > 0.05 ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, 1 LIMIT 20),
    g AS (SELECT l_suppkey AS src, l_partkey % 200 + 1000 AS tgt, count(*) AS weight FROM lineitem GROUP BY ALL), b AS (SELECT src, tgt, weight FROM g UNION ALL SELECT tgt, src, weight FROM g), c AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM g UNION ALL SELECT tgt FROM g) GROUP BY 1)
    SELECT src, tgt, weight, degree FROM b JOIN c ON c.node = b.tgt WHERE src IN (SELECT vec_id FROM h) ORDER BY degree DESC, weight DESC, src, tgt LIMIT 50""")
def q02_local_context(spark, d):
    """Entities nearest to a question with their neighbours: vector hits, then one hop, ranked by degree and weight."""
    e = table(spark, d, "embeddings")
    vector = e.filter("vec_id = 1").select("embedding").first()[0]
    hits = S.search(e, vector, 20, threshold=0.05).select(F.col("vec_id").alias("node"), "score")
    edges = G.settled(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 200 + 1000).alias("tgt")).groupBy("src", "tgt").agg(F.count("*").alias("weight")), "edges")
    near = G.both_ways(edges).join(F.broadcast(hits), F.col("src") == F.col("node"), "left_semi")
    ranked = near.join(G.degrees(edges).withColumnRenamed("node", "tgt"), "tgt")
    return ranked.select("src", "tgt", "weight", "degree").orderBy(F.desc("degree"), F.desc("weight"), "src", "tgt").limit(50)


@query(EMBED.format(key="item_id", text="text", table="benchmark") + ", n AS (SELECT k, sqrt(sum(x * x)) AS n FROM e GROUP BY 1) SELECT k AS item_id, i AS dim, round(x / n, 4) AS value FROM e JOIN n USING (k) WHERE x <> 0")
def x01_hash_embeddings(spark, d):
    e = table(spark, d, "benchmark").select("item_id", P.embed(F.col("text")).alias("embedding"))
    return e.select("item_id", F.posexplode("embedding").alias("dim", "value")).filter("value <> 0").select("item_id", F.col("dim").cast("long").alias("dim"), F.round(F.col("value").cast("double"), 4).alias("value"))


@query(r"SELECT item_id, string_split(string_split(trim(text, ' ' || chr(9) || chr(10) || chr(13)), chr(10))[-1], '. ')[1] AS answer FROM benchmark")
def x03_extractive_answers(spark, d):
    return table(spark, d, "benchmark").select("item_id", P.answer(F.col("text")).alias("answer"))
