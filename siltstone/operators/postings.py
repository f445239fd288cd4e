"""A stored positional index of several text fields: phrases by positions, best documents by skipping blocks.

A row holds one term of one field in one block of at most BLOCK documents: their keys, lengths, frequencies and places, and the
largest frequency and smallest length among them, from which the best score in the block follows without its documents. Rows
are sorted by field, term and block in each file, so a search reads the row groups of its terms, and of these only blocks that
can still hold one of the k best.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.session import importable

from .graph import shared_path

BLOCK = 1024
#: Words with which a block ends before it has BLOCK documents; a task holds no more than these and one document's.
BLOCK_WORDS = 1 << 20
#: Blocks that are scored first, for the score that others must reach; and blocks up to which their numbers go into the filter.
SEEDS, LISTED = 4, 500


@dataclass(frozen=True)
class PositionalIndex:
    """postings, terms (field, term, df), fields (field, n, mean), docs (key).

    postings: field, term, block, n, tf_max, length_min, words, and for the term's n documents keys, lengths and tfs; places has
    all places of the term, the document's number in the block times 2^32 plus the position.
    """

    key: str
    lower: bool
    postings: DataFrame
    terms: DataFrame
    fields: DataFrame
    docs: DataFrame

    def words(self, query: str) -> list[str]:
        return (query.lower() if self.lower else query).split()


def _inverted(field: str, block: int, keys: pa.Array, lists: pa.Array) -> pa.RecordBatch | None:
    """One row for each term in the word lists of a block's documents."""
    length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    code = coded.indices.to_numpy()
    if not len(code):
        return None
    order = np.argsort(code, kind="stable")  # by term, and in it by document and position
    code, doc = code[order], np.repeat(np.arange(len(length), dtype=np.int32), length)[order]
    at = (doc.astype(np.int64) << 32) + (np.arange(len(code)) - np.repeat(np.cumsum(length) - length, length))[order]
    term = np.r_[True, code[1:] != code[:-1]]
    start = np.flatnonzero(term | np.r_[True, doc[1:] != doc[:-1]])  # where a document of a term starts
    first = np.flatnonzero(term[start])  # which of these are a term's first
    tf, own = np.diff(np.r_[start, len(code)]).astype(np.int32), length[doc[start]].astype(np.int32)
    n, terms = np.diff(np.r_[first, len(start)]), coded.dictionary.take(pa.array(code[start[first]]))
    lists_of = lambda values, starts: pa.ListArray.from_arrays(pa.array(np.r_[starts, len(values)].astype(np.int32)), values)
    columns = [pa.array([field]).take(pa.array(np.zeros(len(first), np.int32))), terms, pa.array(np.full(len(first), block, np.int64)), pa.array(n.astype(np.int64))]
    columns += [pa.array(np.maximum.reduceat(tf, first)), pa.array(np.minimum.reduceat(own, first)), pa.array(np.add.reduceat(tf, first, dtype=np.int64))]
    columns += [lists_of(keys.take(pa.array(doc[start])), first), lists_of(pa.array(own), first), lists_of(pa.array(tf), first), lists_of(pa.array(at), start[first])]
    return pa.RecordBatch.from_arrays(columns, ["field", "term", "block", "n", "tf_max", "length_min", "words", "keys", "lengths", "tfs", "places"])


def build(docs: DataFrame, key: str, fields: list[str], path: str, lower: bool = True) -> None:
    """Writes the index to the folder path. Tokens are words between white space; a null field has none.

    A block is of documents that lie side by side, so the task that reads them makes its rows; words don't go through a shuffle.
    """
    spark, kind, most, full = importable(docs.sparkSession), dict(docs.dtypes)[key], BLOCK, BLOCK_WORDS
    words = [T.tokens(F.lower(F.col(f)) if lower else F.col(f)).alias(f"t{i}") for i, f in enumerate(fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, m, block = [], 0, 0, TaskContext.get().partitionId() << 32

        def made() -> Iterator[pa.RecordBatch]:
            for i, f in enumerate(fields):
                row = _inverted(f, block, pa.concat_arrays([b.column(0) for b in held]), pa.concat_arrays([b.column(i + 1) for b in held]))
                if row is not None:
                    yield row

        for batch in batches:
            sizes = [pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[1:]]
            ends, i = np.r_[0, np.cumsum(sum(sizes))], 0
            while i < batch.num_rows:
                j = min(batch.num_rows, i + most - n, int(np.searchsorted(ends[1:], ends[i] + full - m)) + 1)
                held, n, m = [*held, batch.slice(i, j - i)], n + j - i, m + int(ends[j] - ends[i])
                if n >= most or m >= full:
                    yield from made()
                    held, n, m, block = [], 0, 0, block + 1
                i = j
        if held:
            yield from made()

    kinds = f"field string, term string, block long, n long, tf_max int, length_min int, words long, keys array<{kind}>, lengths array<int>, tfs array<int>, places array<long>"
    made = docs.select(F.col(key).alias("key"), *words).mapInArrow(run, kinds).sortWithinPartitions("field", "term", "block")
    made.write.option("parquet.block.size", 1 << 20).option("parquet.page.size", 1 << 16).parquet(f"{path}/postings")
    rows = spark.read.schema(made.schema).parquet(f"{path}/postings")
    rows.groupBy("field", "term").agg(F.sum("n").alias("df")).sortWithinPartitions("field", "term").write.parquet(f"{path}/terms")
    docs.select(F.col(key).alias("key")).write.parquet(f"{path}/docs")
    known = docs.agg(F.count("*").alias("n"), *[F.count(f).alias(f"k{i}") for i, f in enumerate(fields)]).filter("n > 0")
    known = known.select("n", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"k{i}").alias("known")) for i, f in enumerate(fields)])).alias("f")).select("n", "f.*")
    sizes = known.join(rows.groupBy("field").agg(F.sum("words").alias("words")), "field", "left")
    mean = F.when(F.col("known") > 0, F.coalesce("words", F.lit(0)) / F.col("known"))
    sizes.select("field", "n", mean.alias("mean")).coalesce(1).write.parquet(f"{path}/fields")


def open_index(spark: SparkSession, key: str, path: str, lower: bool = True) -> PositionalIndex:
    return PositionalIndex(key, lower, *(spark.read.parquet(f"{path}/{x}") for x in ("postings", "terms", "fields", "docs")))


_known: dict[str, str] = {}


def index_of(docs: DataFrame, key: str, fields: list[str], lower: bool = True) -> PositionalIndex:
    """The index of a table of files, built once for each state of its files in the life of the application."""
    files = docs.select(F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").alias("h")).distinct()
    state = files.agg(F.sum(F.col("h").cast("decimal(38,0)"))).first()[0]
    spark = docs.sparkSession
    name = hashlib.md5(f"{spark.sparkContext.applicationId} {state} {key} {fields} {lower} {docs.select(*fields).columns}".encode()).hexdigest()
    if name not in _known:
        path = shared_path(spark, "positions")
        build(docs, key, fields, path, lower)
        _known[name] = path
    return open_index(spark, key, _known[name], lower)


def _about(index: PositionalIndex, fields: list[str], terms: list[str]) -> DataFrame:
    """field, term, df, n, mean of the query's terms: a row for each field and term at most."""
    few = index.terms.filter(F.col("field").isin(fields) & F.col("term").isin(terms))
    return F.broadcast(few.join(F.broadcast(index.fields), "field"))


def _documents() -> Column:
    """keys, lengths and tfs of a row's documents, one struct each."""
    return F.arrays_zip("keys", "lengths", "tfs")


def _bm25(tf: Column, length: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    idf = F.log(1 + (F.col("df_n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.col("mean")))


def _natural(tf: Column, length: Column) -> Column:
    return tf * F.pow(F.log10(F.col("df_n") / F.col("df")), 2)


def ranked(index: PositionalIndex, fields: list[str], terms: list[str], k: int, weight=_bm25, every: bool = False, decimals: int = 4) -> DataFrame:
    """key, score of the k best documents: weights are summed over a field's terms, and the best field counts.

    every: only fields with all terms. Weights must grow with the frequency and not with the length, as block bounds rest on it.
    """
    terms = list(dict.fromkeys(terms))
    about = _about(index, fields, terms).withColumnRenamed("n", "df_n")
    few = index.postings.filter(F.col("field").isin(fields) & F.col("term").isin(terms))
    bound = few.select("field", "term", "block", "tf_max", "length_min").join(about, ["field", "term"])
    bound = bound.groupBy("field", "block").agg(F.sum(weight(F.col("tf_max"), F.col("length_min"))).alias("most"), F.count("*").alias("_m"))
    bound = bound.filter(F.col("_m") == len(terms)) if every else bound
    bound = bound.groupBy("block").agg(F.max("most").alias("most"))

    def scores(rows: DataFrame) -> DataFrame:
        each = rows.select("field", "term", F.explode(_documents()).alias("d")).join(about, ["field", "term"])
        own = each.groupBy("d.keys", "field").agg(F.sum(weight(F.col("d.tfs"), F.col("d.lengths"))).alias("s"), F.count("*").alias("_m"))
        own = own.filter(F.col("_m") == len(terms)) if every else own
        best = own.groupBy(F.col("keys").alias("key")).agg(F.round(F.max("s"), decimals).alias("score"))
        return best.orderBy(F.desc("score"), "key").limit(k).select(F.col("key").alias(index.key), "score")

    seeds = [r.block for r in bound.orderBy(F.desc("most"), "block").limit(SEEDS).collect()]
    first = [r.score for r in scores(few.filter(F.col("block").isin(seeds))).collect()] if seeds else []
    least = first[-1] - 2 * 10**-decimals if len(first) == k else 0.0
    wanted = bound.filter((F.col("most") >= least) | F.col("block").isin(seeds)).select("block")
    listed = [r.block for r in wanted.limit(LISTED + 1).collect()]
    return scores(few.filter(F.col("block").isin(listed)) if len(listed) <= LISTED else few.join(wanted, "block", "left_semi"))


def phrase(index: PositionalIndex, field: str, query: str) -> DataFrame:
    """key, n: how often the words of query stand in a row in field, for documents where they do."""
    words = index.words(query)
    if not words:
        return index.docs.select(F.col("key").alias(index.key), F.lit(0).alias("n")).filter("false")
    few = index.postings.filter((F.col("field") == field) & F.col("term").isin(words))
    row = F.struct("term", F.struct("keys", "places").alias("r"))
    at = few.groupBy("block").agg(F.map_from_entries(F.collect_list(row)).alias("at")).filter(F.size("at") == len(set(words)))  # blocks with all words
    starts = None
    for i, w in enumerate(words):
        here = F.transform(F.col("at")[w]["places"], lambda p: p - i)  # noqa: B023  called at once
        starts = here if starts is None else F.array_intersect(starts, here)
    # The first word's documents have their keys in the order of their places.
    first = F.col("at")[words[0]]
    owners = F.zip_with(F.array_distinct(F.transform(first["places"], lambda p: F.shiftright(p, 32))), first["keys"], lambda p, k: F.struct(p.alias("place"), k.alias("key"), F.lit(0).alias("n")))
    hits = F.transform("starts", lambda p: F.struct(F.shiftright(p, 32).alias("place"), F.lit(None).cast(index.docs.schema["key"].dataType).alias("key"), F.lit(1).alias("n")))
    own = at.withColumn("starts", starts).filter(F.size("starts") > 0).select("block", F.explode(F.concat(owners, hits)).alias("d"))
    counted = own.groupBy("block", "d.place").agg(F.first("d.key", ignorenulls=True).alias("key"), F.sum("d.n").cast("int").alias("n")).filter("n > 0")
    return counted.select(F.col("key").alias(index.key), "n")


def multi_match(index: PositionalIndex, fields: list[str], query: str, k: int) -> DataFrame:
    """key, score, stage of the k best: BM25 over several fields (the best counts), else all documents at 1.

    A phrase can't stand where none of its words does, so there is no stage for it in between; see ``match_phrase``. Nothing
    but the index is read.
    """
    terms = index.words(query)
    if terms:
        best = ranked(index, fields, terms, k)
        if not best.isEmpty():
            return best.withColumn("stage", F.lit("match"))
    return index.docs.select(F.col("key").alias(index.key), F.lit(1.0).alias("score"), F.lit("all").alias("stage")).orderBy(index.key).limit(k)


def match_phrase(index: PositionalIndex, field: str, query: str, k: int) -> DataFrame:
    """key, n of the k documents in which the phrase stands most often."""
    return phrase(index, field, query).orderBy(F.desc("n"), index.key).limit(k)


def fulltext(index: PositionalIndex, field: str, terms: list[str], k: int) -> DataFrame:
    """key, score of documents with all terms: the sum of tf * idf^2, idf = log10(n / df)."""
    return ranked(index, [field], terms, k, _natural, every=True, decimals=6)


def ranked_many(index: PositionalIndex, field: str, queries: DataFrame, query_key: str, query: str, k: int) -> DataFrame:
    """query_key, key, score, rank: the k best documents of each row of queries by BM25 over one field; a repeated word counts once."""
    asked = queries.select(query_key, F.explode(F.array_distinct(T.tokens(F.lower(F.col(query)) if index.lower else F.col(query)))).alias("term"))
    about = index.terms.filter(F.col("field") == field).join(F.broadcast(index.fields.withColumnRenamed("n", "df_n")), "field").select("term", "df", "df_n", "mean")
    hits = index.postings.filter(F.col("field") == field).select("term", "keys", "lengths", "tfs").join(asked.join(about, "term"), "term")
    each = hits.select(query_key, "df", "df_n", "mean", F.explode(_documents()).alias("d"))
    scored = each.groupBy(query_key, F.col("d.keys").alias(index.key)).agg(F.round(F.sum(_bm25(F.col("d.tfs"), F.col("d.lengths"))), 6).alias("score"))
    first = Window.partitionBy(query_key).orderBy(F.desc("score"), index.key)
    return scored.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
