"""Exact vector search, ranking cut-offs, score fusion and lexical scoring."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.functions import vectors as V

from .graph import shared_path, shared_root

#: Queries that are broadcast to all tasks at once; more are taken in further passes.
QUERY_BLOCK = 4096
#: Vectors whose scores against a block of queries are held at once.
ROW_BLOCK = 1024


def top_k(df: DataFrame, score: Column, key: str, k: int, name: str = "score") -> DataFrame:
    """The k rows with the largest score, ties by key: one TakeOrderedAndProject, no full sort."""
    return df.withColumn(name, score).orderBy(F.desc(name), key).limit(k)


def search(df: DataFrame, query: list[float], k: int, vector: str = "embedding", key: str = "vec_id", metric: str = "cosine", where: Column | None = None, threshold: float | None = None) -> DataFrame:
    """Exact k nearest rows to one vector. where is applied before scoring; threshold is strict."""
    size = math.sqrt(sum(float(x) ** 2 for x in query)) if metric == "cosine" else 1.0
    q = F.array(*[F.lit(float(x) / size if size else 0.0) for x in query])  # a cosine's query is normalised here, once
    if where is not None:
        df = df.filter(where)
    score = V.dot(F.col(vector), q)
    if metric == "cosine":
        score = F.when(V.norm(F.col(vector)) == 0, 0.0).otherwise(score / V.norm(F.col(vector)))
    scored = df.withColumn("score", score)
    if threshold is not None:
        scored = scored.filter(F.col("score") > threshold)
    return scored.orderBy(F.desc("score"), key).limit(k)


def _best(score: np.ndarray, ids: np.ndarray, held: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, score, id) of the k best of each line of score together with those held; ties by id."""
    line, best, names = held
    least = np.full(len(score), -np.inf)
    if score.shape[1] >= k:
        least = -np.partition(-score, k - 1, axis=1)[:, k - 1]
    n = np.bincount(line, minlength=len(score))
    full = np.flatnonzero(n == k)
    if len(full):  # the last of a full line is its least
        least[full] = np.maximum(least[full], best[np.cumsum(n)[full] - 1])
    row, col = np.nonzero(score >= least[:, None])
    line, best, names = np.concatenate([line, row]), np.concatenate([best, score[row, col]]), np.concatenate([names, ids[col]])
    order = np.lexsort((names, -best, line))
    line = line[order]
    first = np.searchsorted(line, np.arange(len(score)))
    kept = order[np.arange(len(line)) - first[line] < k]
    return line[np.arange(len(line)) - first[line] < k], best[kept], names[kept]


def batched_search(queries: DataFrame, vectors: DataFrame, k: int, query_key: str = "query_id", key: str = "vec_id", vector: str = "embedding", decimals: int = 10) -> DataFrame:
    """query_id, key, score, rank: the k nearest vectors by cosine of each row of queries (query_id, vector).

    Every row of queries with a vector is a query of its own, also if its query_id is null or that of another row. Queries come
    to the driver and go to the tasks in blocks of QUERY_BLOCK. Each task scores its vectors against a block by matrix products
    over ROW_BLOCK vectors and gives out its own k best of each query, so that k rows a query and task are shuffled, not all
    pairs.
    """
    spark, found = vectors.sparkSession, None
    kind = queries.schema[query_key].dataType.simpleString()
    rows = queries.select(query_key, vector).filter(F.col(vector).isNotNull()).orderBy(query_key, F.hash(vector)).toLocalIterator(prefetchPartitions=True)
    numbers, named = 0, None
    while block := list(islice(rows, QUERY_BLOCK)):
        matrix = np.array([r[1] for r in block], np.float64)
        size = np.linalg.norm(matrix, axis=1, keepdims=True)
        shared = spark.sparkContext.broadcast((numbers, np.divide(matrix, size, out=np.zeros_like(matrix), where=size > 0)))
        own = spark.createDataFrame([(numbers + i, r[0]) for i, r in enumerate(block)], f"_q long, {query_key} {kind}")
        named = own if named is None else named.unionByName(own)
        numbers += len(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            first, q = shared.value
            held = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
                size = np.linalg.norm(flat, axis=1, keepdims=True)
                flat = np.divide(flat, size, out=np.zeros_like(flat), where=size > 0)
                for i in range(0, len(ids), ROW_BLOCK):
                    held = _best(np.round(q @ flat[i : i + ROW_BLOCK].T, decimals), ids[i : i + ROW_BLOCK], held, k)
            yield pa.RecordBatch.from_arrays([pa.array(held[0] + first), pa.array(held[2]), pa.array(held[1])], ["_q", key, "score"])

        part = vectors.select(F.col(key).cast("long"), vector).filter(F.col(vector).isNotNull()).mapInArrow(run, f"_q long, {key} long, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"{query_key} {kind}, {key} long, score double, rank int")
    rank = F.row_number().over(Window.partitionBy("_q").orderBy(F.desc("score"), key))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).join(named, "_q").select(query_key, key, "score", "rank")


def within_budget(df: DataFrame, size: str, order: list, budget: int, by: list[str] = ()) -> DataFrame:
    """The longest prefix, in order, whose sizes sum to at most budget."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("running", F.sum(size).over(w)).filter(F.col("running") <= budget)


def min_max(df: DataFrame, score: str, name: str) -> DataFrame:
    """Positive scores brought to 0..1 (1 if all are equal), others 0. The bounds are one aggregate row, joined by broadcast."""
    positive = F.when(F.col(score) > 0, F.col(score))
    bounds = df.agg(F.min(positive).alias("_lo"), F.max(positive).alias("_hi"))
    ranged = F.when(F.col("_hi") > F.col("_lo"), (F.col(score) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(1.0)
    return df.join(F.broadcast(bounds)).withColumn(name, F.when(F.col(score) > 0, ranged).otherwise(0.0)).drop("_lo", "_hi")


def fuse(vector_hits: DataFrame, text_hits: DataFrame, alpha: float, n: int, key: str) -> DataFrame:
    """Hits (key, score) of two stores: alpha * vector + (1 - alpha) * text of min-max scores, n best."""
    both = vector_hits.select(key, F.col("score").alias("vector_score"), F.lit(0.0).alias("text_score")).unionByName(text_hits.select(key, F.lit(0.0).alias("vector_score"), F.col("score").alias("text_score")))
    ranged = min_max(min_max(both, "vector_score", "v"), "text_score", "t")
    return top_k(ranged, alpha * F.col("v") + (1 - alpha) * F.col("t"), key, n)


def _counted(words: Column) -> Column:
    """array<struct(term, tf)> of an array of words, by runs in its order."""
    sort = F.sort_array(words)
    starts = lambda s: F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
    runs = lambda s, at: F.transform(at, lambda x, i: F.struct(F.get(s, x).alias("term"), (F.coalesce(F.get(at, i + 1), F.size(s)) - x).cast("long").alias("tf")))
    both = F.transform(F.array(F.struct(sort.alias("s"))), lambda r: F.struct(r["s"].alias("s"), starts(r["s"]).alias("at")))
    return F.element_at(F.transform(both, lambda r: runs(r["s"], r["at"])), 1)


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf, length: the inverted index with each document's length in tokens.

    A row's words are counted where it is read. Only rows whose key others have too are put together by a shuffle.
    """

    def counted(rows: DataFrame) -> DataFrame:
        own = rows.select(key, T.tokens(F.col(text)).alias("_t"))
        return own.select(key, F.size("_t").alias("length"), F.explode(_counted(F.col("_t"))).alias("_c")).select(key, "length", "_c.term", "_c.tf")

    again = docs.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).filter("_n > 1").select("_key")
    if again.isEmpty():
        return counted(docs)
    own = F.col(key).eqNullSafe(F.col("_key"))
    merged = counted(docs.join(again, own, "left_semi")).groupBy(key, "length", "term").agg(F.sum("tf").alias("tf"))
    return counted(docs.join(again, own, "left_anti")).unionByName(merged)


@dataclass(frozen=True)
class TextIndex:
    """postings (key, length, term, tf), terms (term, df) and one row of statistics (n, mean_length, mean_idf) of a table of texts."""

    key: str
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame


def _raw_idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5))


def build_index(docs: DataFrame, key: str, text: str, path: str) -> None:
    """Writes the index of docs to the folder path; the statistics come last, so that an index with them is whole.

    Postings are sorted by term in each file and have Bloom filters of their terms, so that a search reads few row groups. They
    aren't dealt by term: a term that most documents have would make one task of them.
    """
    postings(docs, key, text).sortWithinPartitions("term").write.option("parquet.bloom.filter.enabled#term", "true").parquet(f"{path}/postings")
    post = docs.sparkSession.read.parquet(f"{path}/postings")
    post.groupBy("term").agg(F.count("*").alias("df")).sortWithinPartitions("term").write.parquet(f"{path}/terms")
    sizes = docs.agg(F.count("*").alias("n"), F.avg(T.token_count(F.coalesce(F.col(text), F.lit("")))).alias("mean_length"))
    idf = docs.sparkSession.read.parquet(f"{path}/terms").join(F.broadcast(sizes.select("n"))).agg(F.avg(_raw_idf(F.col("n"), F.col("df"))).alias("mean_idf"))
    sizes.join(idf).write.parquet(f"{path}/stats")


def open_index(spark: SparkSession, key: str, path: str) -> TextIndex | None:
    """The index in the folder path, None without a whole one."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/stats/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        return None
    return TextIndex(key, *(spark.read.parquet(f"{path}/{x}") for x in ("postings", "terms", "stats")))


def delete_path(spark: SparkSession, path: str) -> bool:
    """Removes a file, folder or index; whether there was one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def index_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> TextIndex:
    """The index of a table of files, built once for each state of its files (path, size, time) and kept in the shared folder."""
    spark = docs.sparkSession
    files = docs.select(F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").alias("h")).distinct()
    state = files.agg(F.sum(F.col("h").cast("decimal(38,0)"))).first()[0]
    path = f"{shared_root(spark)}/index-{hashlib.md5(f'{state} {key} {text}'.encode()).hexdigest()}"
    found = open_index(spark, key, path)
    if found is None:
        fresh = shared_path(spark, "index")
        build_index(docs, key, text, fresh)
        move(spark, fresh, path)
        found = open_index(spark, key, path) or open_index(spark, key, fresh)
    return found


def move(spark: SparkSession, old: str, new: str) -> bool:
    """Renames a folder; False, and old stays, if new is there."""
    a, b = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (old, new))
    system = a.getFileSystem(spark._jsc.hadoopConfiguration())
    return not system.exists(b) and system.rename(a, b)


def bm25(index: TextIndex, terms: list[str], k: int, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """key, score of the k best documents by Okapi BM25.

    idf is ln((n - df + 0.5) / (df + 0.5)); negative ones become epsilon times the mean idf of all terms. Only postings of
    the query's terms are read; the statistics are over all documents.
    """
    key, stats = index.key, F.broadcast(index.stats)  # one row
    raw = _raw_idf(F.col("n"), F.col("df"))
    few = index.terms.filter(F.col("term").isin(terms)).join(stats).select("term", "mean_length", F.when(raw < 0, epsilon * F.col("mean_idf")).otherwise(raw).alias("idf"))
    wanted = F.array(*[F.lit(x) for x in terms])
    repeats = F.size(F.filter(wanted, lambda x: x == F.col("term")))  # a repeated query term counts as often
    part = repeats * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))
    hits = index.postings.filter(F.col("term").isin(terms))
    scored = hits.join(F.broadcast(few), "term").groupBy(key).agg(F.round(F.sum(part), 4).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(k)


def first_n(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def first_by_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return first_n(df, keys, order, 1)


def rerank(hits: DataFrame, texts: DataFrame, key: str, model: Callable[[Column], Column], n: int) -> DataFrame:
    """key, rank, model_score of the n hits (key, score) that the model scores best by their text; one without text counts as the worst."""
    scored = hits.join(texts, key, "left").select(key, F.coalesce(F.when(F.col("text").isNotNull(), model(F.col("text"))), F.lit(-1e9)).alias("model_score"))
    best = scored.orderBy(F.desc("model_score"), key).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("model_score"), key)))  # n rows


def weighted_rerank(hits: DataFrame, model: DataFrame, key: str, weight: float, batch: int) -> DataFrame:
    """key, batch, combined of hits (key, score): weight * relevance + (1 - weight) * score, relevance 0 where the model (key, relevance) gave none."""
    numbered = hits.withColumn("batch", F.floor((F.row_number().over(Window.orderBy(F.desc("score"), key)) - 1) / batch))  # top-k hits
    return numbered.join(model, key, "left").select(key, "batch", F.round(weight * F.coalesce("relevance", F.lit(0.0)) + (1 - weight) * F.col("score"), 4).alias("combined"))


def full_context(pages: DataFrame, document: str, wanted: list, order: list[str]) -> DataFrame:
    """All pages of the wanted documents in order, instead of a search in them."""
    return pages.filter(F.col(document).isin(wanted)).orderBy(document, *order)


def without_exact(df: DataFrame, vector: list[float], column: str = "embedding") -> DataFrame:
    """Rows whose cosine to vector, at six decimals, is below 1."""
    return df.filter(F.round(V.cosine(F.col(column), F.array(*[F.lit(float(x)) for x in vector])), 6) < 1.0)


def passages(df: DataFrame, vector: list[float], kind: str, wanted: list, n: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The n nearest rows of each wanted type with their rank in it, without exact matches."""
    found = None
    for x in wanted:
        near = search(without_exact(df.filter(F.col(kind) == x), vector, column), vector, n, column, key)
        found = near if found is None else found.unionByName(near)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(kind).orderBy(F.desc("score"), key)))


def block_relevance(asked: DataFrame, blocks: str, answer: str) -> DataFrame:
    """A row for each block of each batch with relevance 0..1 by the model's JSON answer, in the blocks' order; 0 where it has none."""
    told = F.from_json(F.col(answer), "block_rankings array<struct<relevance_score: double>>")["block_rankings"]
    rows = asked.withColumn("_told", told).select("*", F.posexplode(blocks).alias("_i", "block"))
    score = F.coalesce(F.get(F.col("_told"), F.col("_i"))["relevance_score"], F.lit(0.0))
    return rows.withColumn("relevance", F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))).drop("_told", "_i", blocks, answer)
