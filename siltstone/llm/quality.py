"""Quality rules: rule counts of every text, and a hashed n-gram log-likelihood ratio between trusted and raw text.

Only DataFrame functions run here. Two multinomials over hashed word 1- and 2-grams are counted in one pass: one over all
documents (raw), one over the trusted ones (target). With r and t the counts of a bucket, R and T their totals, the
weight of a bucket is ln(t + k) - ln(r * T / R + k): both multinomials, brought to the target's size, with the same k
pseudo-counts. Rare buckets so weigh almost nothing, and buckets that are common in the raw text but missing from the
target weigh much. A document's score is the mean weight of its n-grams; below the threshold it is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_BREAK = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class QualityParams:
    buckets: int = 1 << 16
    #: Pseudo-counts that both multinomials get in each bucket.
    smoothing: float = 5.0
    #: Mean log-likelihood ratio below which a document is rejected.
    threshold: float = -0.18
    #: At most so many trusted documents (those with the smallest hash of doc_id) make up the target.
    trusted_docs: int = 20_000
    min_words: int = 50
    max_repeat_percent: int = 50


def _words(text: Column) -> Column:
    trimmed = F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_BREAK))


def rule_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with _words, n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words; a null text has no words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.withColumn("_words", _words(text)).withColumn("n_words", F.size("_words").cast("long"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = (
        df.withColumn("_lines", lines)
        .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .drop("_lines")
    )
    # The hash of each 3-word window; only texts in which one occurs twice are looked at closely.
    grams = F.expr("CASE WHEN n_words >= 3 THEN transform(slice(_words, 1, size(_words) - 2), (w, i) -> xxhash64(w, get(_words, i + 1), get(_words, i + 2))) ELSE array() END")
    df = df.withColumn("_grams", grams)
    ranked = F.expr("CASE WHEN size(array_distinct(_grams)) < size(_grams) THEN sort_array(transform(_grams, (g, i) -> struct(g AS g, i AS i))) ELSE array() END")
    df = df.withColumn("_ranked", ranked).drop("_grams")
    at = F.expr("sort_array(transform(filter(_ranked, (x, j) -> x.g <=> get(_ranked, j - 1).g OR x.g <=> get(_ranked, j + 1).g), x -> x.i))")
    df = df.withColumn("_at", at).drop("_ranked")
    covered = F.expr("aggregate(transform(_at, (p, k) -> least(3, coalesce(get(_at, k + 1) - p, 3))), 0L, (s, x) -> s + x)")
    return df.withColumn("n_repeat_words", covered).drop("_at")


def _buckets(n: int) -> Column:
    """Buckets of all 1-grams and 2-grams of _words."""
    return F.expr(
        f"concat(transform(_words, w -> cast(pmod(xxhash64(w), {n}) AS int)), "
        f"transform(slice(_words, 2, greatest(size(_words) - 1, 0)), (w, i) -> cast(pmod(xxhash64(get(_words, i), w), {n}) AS int)))"
    )


def trusted_ids(labels: DataFrame, limit: int) -> DataFrame:
    """doc_id of documents labelled as good and not toxic: at most limit, those with the smallest hash."""
    good = labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    return good.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def weights(docs: DataFrame, labels: DataFrame, p: QualityParams, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row with the array w of all bucket weights; zeros if there is no trusted or no raw text."""
    trusted = trusted_ids(labels, p.trusted_docs).select(F.col("doc_id").alias("_id"), F.lit(1).alias("_t"))
    own = docs.select(F.col(id_col).cast("long").alias("_id"), _words(F.coalesce(F.col(text_col), F.lit(""))).alias("_words"))
    flagged = own.join(F.broadcast(trusted), "_id", "left")  # at most trusted_docs rows
    counts = flagged.select("_t", F.explode(_buckets(p.buckets)).alias("b")).groupBy("b").agg(F.count("*").alias("r"), F.count("_t").alias("t"))
    dense = docs.sparkSession.range(p.buckets).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left")
    one = dense.agg(F.sort_array(F.collect_list(F.struct("b", "r", "t"))).alias("a"), F.sum("r").alias("big_r"), F.sum("t").alias("big_t"))
    k = F.lit(p.smoothing)
    w = lambda x: F.log(F.coalesce(x["t"], F.lit(0)) + k) - F.log(F.coalesce(x["r"], F.lit(0)) * F.col("big_t") / F.col("big_r") + k)
    return one.select(F.transform("a", lambda x: F.when(F.col("big_t") > 0, w(x)).otherwise(0.0)).alias("w"))


def quality(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams(), id_col: str = "doc_id", text_col: str = "text", row: bool = False) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept for every row.

    labels: doc_id, quality, toxic. base_failed: fewer than min_words words, or too large a share of words in repeated
    3-word windows. kept: not base_failed and score >= threshold. A null or empty text has no words, fails the base and
    scores 0. Repeated rows are judged alike. An empty table gives an empty result; without trusted documents all scores
    are 0, so that the base alone decides. With row, the input row comes along as the struct _row, so that columns of any
    name may be there.
    """
    cols = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")]
    own = docs.select(*cols, *([F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row")] if row else []))
    df = rule_counts(own).withColumn("_w", weights(docs, labels, p, text_col, id_col).scalar())
    mean = F.expr("CASE WHEN n_words = 0 THEN 0D ELSE aggregate(_b, 0D, (s, b) -> s + get(_w, b)) / size(_b) END")
    # True, but not deterministic to the optimizer: a filter on the result isn't pushed below, where it would be worked out
    # from the texts anew for each use of each column.
    stay = F.monotonically_increasing_id() >= 0
    failed = (F.col("n_words") < p.min_words) | (100 * F.col("n_repeat_words") > p.max_repeat_percent * F.col("n_words"))
    return (
        df.withColumn("_b", _buckets(p.buckets))
        .withColumn("score", mean)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= p.threshold) & stay)
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept", *(["_row"] if row else []))
    )
