"""Multi-hop answering of a table of questions: each round is one pass over all that are still open.

The state is a table: what a question has gathered, what it asks next, and its answer. A round searches for all open queries
at once, keeps what the extraction takes from the hits, and lets the critic answer or name the next query. Extraction and
critic are expressions over columns, so a model is called in batches in the tasks; nothing comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import postings
from .ann import VectorIndex
from .graph import settled

#: Takes (_q, query) and gives (_q, rank, text): the texts found for each query.
Retriever = Callable[[DataFrame], DataFrame]


def vector_retriever(index: VectorIndex, text: str, embed: Callable[[Column], Column], k: int = 14, nprobe: int | None = None, refine: int | None = -1) -> Retriever:
    """The k nearest stored rows of each query's vector."""
    p = index.params

    def run(queries: DataFrame) -> DataFrame:
        hits = index.search_many(queries.select("_q", embed(F.col("query")).alias(p.vector)), k, "_q", nprobe, refine)
        return hits.join(index.rows().select(p.key, F.col(text).alias("text")), p.key).select("_q", "rank", "text")

    return run


def text_retriever(index: postings.PositionalIndex, field: str, texts: DataFrame, text: str, k: int = 14) -> Retriever:
    """The k best texts (index.key, text) of each query by BM25."""

    def run(queries: DataFrame) -> DataFrame:
        hits = postings.ranked_many(index, field, queries, "_q", "query", k)
        return hits.join(texts.select(index.key, F.col(text).alias("text")), index.key).select("_q", "rank", "text")

    return run


def answer_questions(
    questions: DataFrame, retrieve: Retriever, extract: Callable[[Column, Column, Column], Column], critic: Callable[[Column, Column], Column], rounds: int = 5, nothing: str = "Insufficient information."
) -> DataFrame:
    """questions (any columns, question) with answer, hops (rounds that it took) and memory (what was gathered, in order).

    extract(question, query, texts) gives what to keep of the texts found, null or '' for nothing; what is in memory already
    isn't kept twice. critic(question, memory) gives a struct of answer (null: not yet) and query (null: ask the same again). A
    question without an answer after all rounds gets nothing. A null question is asked nothing and gets nothing too. Rows of
    equal questions each get their answer.
    """
    names = questions.columns
    state = questions.withColumns({"_q": F.monotonically_increasing_id(), "_query": F.col("question"), "memory": F.array().cast("array<string>"), "answer": F.lit(None).cast("string"), "hops": F.lit(0)})
    live, out = settled(state, "questions"), None
    for hop in range(1, rounds + 1):
        # Questions that ask the same are searched for once: many meet at a few queries after a hop.
        asked = settled(live.filter("_query IS NOT NULL").groupBy("_query").agg(F.min("_q").alias("_q")), "asked")
        found = retrieve(asked.select("_q", F.col("_query").alias("query")))
        texts = found.groupBy("_q").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("_texts"))  # as many as the retriever gives
        step = live.join(asked.join(texts, "_q").drop("_q"), "_query", "left").withColumn("_texts", F.coalesce("_texts", F.array().cast("array<string>")))
        step = step.withColumn("_note", extract(F.col("question"), F.col("_query"), F.col("_texts")))
        fresh = (F.col("_note") != "") & ~F.array_contains("memory", F.col("_note"))
        step = step.withColumn("memory", F.when(fresh, F.concat("memory", F.array("_note"))).otherwise(F.col("memory")))
        step = step.withColumn("_said", critic(F.col("question"), F.col("memory")))
        step = step.withColumns({"answer": F.col("_said.answer"), "_query": F.coalesce("_said.query", "_query"), "hops": F.lit(hop)})
        now = settled(step.select(*names, "_q", "_query", "memory", "answer", "hops"), "hop")
        done = now.filter("answer IS NOT NULL")
        out = done if out is None else out.unionByName(done)
        live = now.filter("answer IS NULL")
        if live.isEmpty():
            break
    out = live if out is None else out.unionByName(live)
    return out.select(*names, F.coalesce("answer", F.lit(nothing)).alias("answer"), "hops", "memory")
