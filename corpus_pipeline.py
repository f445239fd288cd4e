"""The corpus pipeline: quality rules, language ID, near-duplicate removal, substring removal, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import lang_id, near_dup, packing, quality, substring
from siltstone.llm.shared import prepare, written


def _columns(df: DataFrame) -> list:
    """df's columns, whatever their names hold."""
    return [F.col(f"`{c}`") for c in df.columns]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or whose log-likelihood ratio lies below the threshold.

    Null, empty and blank texts have no words and go. Repeated rows are judged alike. A null doc_id is judged as others, but is
    never trusted. An empty table stays empty; columns of any name come along.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.quality(docs, labels, row=True).filter("kept").select("_row.*")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language; lang becomes the predicted one.

    Null texts and texts without a letter go, and all do if no row has a lang to learn from. Rows with a null lang are
    predicted but not learned from. Repeated rows are judged alike; an empty table stays empty; columns of any name come along.
    """
    found = lang_id.predict(docs, lang_id.train(docs), row=True).filter("lang_pred <> 'und'")
    return found.select([F.col("lang_pred").alias(c) if c == "lang" else F.col("_row")[c].alias(c) for c in docs.columns])


#: Similarity of 0.80 or more. 64 bands of 8 miss a pair at 0.80 with probability 8e-6; of 512 bins, it has 70 percent equal by more than five standard errors.
NEAR_DUPLICATES = near_dup.NearDupParams(percent=80, bands=64, sketch_percent=70)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of texts alike by 0.80 or more.

    Of several rows with that doc_id the one whose text has the smallest hash is kept, of equal texts the row that comes first
    as JSON. Rows without doc_id, and null, empty and blank texts, are linked with nothing and stay. An empty table stays
    empty; columns of any name come along.
    """
    p = NEAR_DUPLICATES
    dropped = written(near_dup.near_duplicates(docs, p).filter("NOT kept").select("doc_id").distinct(), "dropped")
    few = dropped.count() <= p.broadcast_ids
    left = docs.join(F.broadcast(dropped) if few else dropped, "doc_id", "left_anti").select(_columns(docs))
    repeated = written(docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "repeated")
    n = repeated.count()
    if not n:
        return left
    mark = F.broadcast(repeated) if n <= p.broadcast_ids else repeated
    row = F.struct(_columns(left))
    several = left.join(mark, "doc_id", "left_semi").select("doc_id", row.alias("_row"), F.xxhash64("text").alias("_h"), F.to_json(row).alias("_j"))
    first = several.groupBy("doc_id").agg(F.min_by("_row", F.struct("_h", "_j")).alias("_row")).select("_row.*")
    return left.join(mark, "doc_id", "left_anti").select(_columns(docs)).unionByName(first)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Text becomes the words that no earlier document's window covers; n_chars follows.

    A null or empty text becomes an empty one; a document all of whose words go stays, with an empty text. A null doc_id comes
    after all others; rows of one doc_id don't take from each other. An empty table stays empty; columns of any name come along.
    """
    found = substring.dedup_substrings(docs, row=True)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return found.select([new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4,096 tokens.

    A null or empty text is its end id alone. Every row is packed, rows without doc_id first, repeated rows each; an empty
    table gives no pieces. Other columns are not looked at.
    """
    return packing.pack(docs, packing.PackingParams(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substrings", substring_stage),
    ("packing", packing_stage),
]

#: The stages can't be expressed in SQL; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
