"""Scoring of answers and references, statistics, and reference validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _lower(c: Column) -> Column:
    return F.lower(F.trim(c))


def answer_score(kind: Column, actual: Column, predicted: Column) -> Column:
    """1 or 0 for number (within 1 % of a positive value), boolean and name (case aside); Jaccard for names (comma lists).

    'N/A' on both sides is right, on one side wrong; a number that can't be read is wrong.
    """
    a, p = actual.try_cast("double"), predicted.try_cast("double")
    names = lambda c: F.array_distinct(F.transform(F.split(F.lower(F.trim(c)), ","), lambda x: F.trim(x)))
    jaccard = F.size(F.array_intersect(names(actual), names(predicted))) / F.size(F.array_union(names(actual), names(predicted)))
    flag = lambda c: F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)
    return (
        F.when((actual == "N/A") & (predicted == "N/A"), 1.0)
        .when((actual == "N/A") | (predicted == "N/A"), 0.0)
        .when(kind == "number", flag(F.abs(p - a) < 0.01 * a))
        .when(kind == "boolean", flag(F.lower(actual) == F.lower(predicted)))
        .when(kind == "name", flag(_lower(actual) == _lower(predicted)))
        .when(kind == "names", jaccard)
    )


def best_answer_score(kind: Column, answers: Column, predicted: Column) -> Column:
    """The highest score over several right answers."""
    return F.array_max(F.transform(answers, lambda a: answer_score(kind, a, predicted)))


def reference_score(refs: Column, pools: Column) -> Column:
    """1 less 0.1 for each reference in no pool and 0.25 for each pool without a reference, at least 0."""
    known = F.flatten(pools)
    extra = F.size(F.filter(refs, lambda r: ~F.array_contains(known, r)))
    unmet = F.size(F.filter(pools, lambda p: ~F.arrays_overlap(p, refs)))
    return F.greatest(F.lit(0.0), 1.0 - 0.1 * extra - 0.25 * unmet)


def submission_scores(scored: DataFrame) -> DataFrame:
    """submission, R, G, score, value_accuracy from rows (submission, value_score, ref_score)."""
    g = scored.groupBy("submission").agg(F.sum("ref_score").alias("R"), F.sum("value_score").alias("G"), F.count("*").alias("n"))
    return g.select("submission", "R", "G", (F.col("G") + F.col("R") / 2).alias("score"), (100 * F.col("G") / F.col("n")).alias("value_accuracy"))


def statistics(answers: DataFrame, value: str, error: str) -> DataFrame:
    """One row: total, error, na, success."""
    e, na = F.col(error).isNotNull(), F.col(value) == "N/A"
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    return answers.agg(F.count("*").alias("total"), count(e).alias("error"), count(~e & na).alias("na"), count(~e & ~na).alias("success"))


def overlap_metrics(results: DataFrame, kind: str, answer: str, gold: str) -> DataFrame:
    """kind (null: all), n, hits, accuracy: an answer hits if it shares a word with the gold answer."""
    words = lambda c: F.split(F.lower(F.trim(F.col(c))), r"\s+")
    hit = F.arrays_overlap(words(answer), words(gold)).cast("int")
    return results.rollup(kind).agg(F.count("*").alias("n"), F.sum(hit).alias("hits")).withColumn("accuracy", F.col("hits") / F.col("n"))


def valid_pages(claimed: Column, retrieved: Column, least: int = 2, most: int = 8) -> Column:
    """Claimed pages that were retrieved, in order; filled from the retrieved ones up to least, cut at most."""
    real = F.filter(claimed, lambda p: F.array_contains(retrieved, p))
    filled = F.when(F.size(real) >= least, real).otherwise(F.slice(F.concat(real, F.array_except(retrieved, real)), 1, least))
    return F.slice(filled, 1, most)


def positive_references(refs: Column, value: Column) -> Column:
    """References with a page, one less; none if the value is 'N/A'."""
    kept = F.transform(F.filter(refs, lambda r: r["page"].isNotNull()), lambda r: F.struct(r["sha1"].alias("sha1"), (r["page"] - 1).alias("page")))
    return F.when(value == "N/A", F.slice(kept, 1, 0)).otherwise(kept)
