"""Evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import evaluation as E

from .catalog import query, table

_JAC = "len(list_intersect({a}, {b})) * 1.0 / len(list_distinct(list_concat({a}, {b})))"
_PA = "CASE p_partkey % 5 WHEN 0 THEN 'N/A' WHEN 1 THEN CAST(p_retailprice AS VARCHAR) WHEN 2 THEN 'Yes' WHEN 3 THEN p_brand ELSE p_brand || ',' || p_type END"


def _answers(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey") % 5
    kind = F.when(k < 2, "number").when(k == 2, "boolean").when(k == 3, "name").otherwise("names")
    actual = F.when(k == 0, "N/A").when(k == 1, "1000").when(k == 2, "yes").when(k == 3, F.concat(F.lit(" "), F.lower("p_brand"))).otherwise(F.concat("p_brand", F.lit(",x")))
    predicted = F.when(k == 0, F.when(F.col("p_size") < 25, "N/A").otherwise("3")).when(k == 1, F.when(F.col("p_size") < 25, "1005").otherwise("1010")).when(k == 2, "YES").when(k == 3, F.col("p_brand")).otherwise(F.concat("p_brand", F.lit(", y")))
    return p.select("p_partkey", kind.alias("kind"), actual.alias("actual"), predicted.alias("predicted"))


_SCORES = "CASE p_partkey % 5 WHEN 0 THEN CASE WHEN p_size < 25 THEN 1.0 ELSE 0.0 END WHEN 1 THEN CASE WHEN p_size < 25 THEN 1.0 ELSE 0.0 END WHEN 2 THEN 1.0 WHEN 3 THEN 1.0 ELSE 1.0 / 3 END"


@query(f"SELECT p_partkey, round({_SCORES}, 6) AS score FROM part")
def a19_answer_scores(spark, d):
    a = _answers(spark, d)
    return a.select("p_partkey", F.round(E.answer_score(F.col("kind"), F.col("actual"), F.col("predicted")), 6).alias("score"))


@query("SELECT conv_id, round(greatest(0.0, 1.0 - 0.1 * len(list_filter(refs, lambda r: r % 3 <> 0)) - CASE WHEN len(list_filter(refs, lambda r: r = 0)) > 0 THEN 0 ELSE 0.25 END - CASE WHEN len(list_filter(refs, lambda r: r IN (3, 6))) > 0 THEN 0 ELSE 0.25 END - CASE WHEN len(list_filter(refs, lambda r: r % 3 = 0 AND r > 6)) > 0 THEN 0 ELSE 0.25 END), 4) AS score FROM (SELECT conv_id, list(DISTINCT turn) AS refs FROM conversations GROUP BY 1)")
def a20_reference_scores(spark, d):
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_set("turn").alias("refs"))
    pools = F.array(F.array(F.lit(0).cast("long")), F.array(*[F.lit(x).cast("long") for x in (3, 6)]), F.transform(F.sequence(F.lit(3), F.lit(400)), lambda x: x.cast("long") * 3))
    return g.select("conv_id", F.round(E.reference_score(F.col("refs"), pools), 4).alias("score"))


@query(f"WITH s AS (SELECT p_brand AS submission, {_SCORES} AS v, (p_size % 5) / 4.0 AS r FROM part) SELECT submission, round(sum(r), 6) AS \"R\", round(sum(v), 6) AS \"G\", round(sum(v) + sum(r) / 2, 6) AS score, round(100 * sum(v) / count(*), 6) AS value_accuracy FROM s GROUP BY 1")
def a18_submission_scores(spark, d):
    a = _answers(spark, d).join(table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("submission"), ((F.col("p_size") % 5) / 4.0).alias("ref_score")), "p_partkey")
    s = E.submission_scores(a.withColumn("value_score", E.answer_score(F.col("kind"), F.col("actual"), F.col("predicted"))))
    return s.select("submission", *[F.round(c, 6).alias(c) for c in ("R", "G", "score", "value_accuracy")])


@query("SELECT count(*) AS total, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS error, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS na, sum(CASE WHEN event_type NOT IN ('error', 'view') THEN 1 ELSE 0 END) AS success FROM events")
def a16_statistics(spark, d):
    e = table(spark, d, "events").select(F.when(F.col("event_type") == "view", "N/A").otherwise("1").alias("v"), F.when(F.col("event_type") == "error", "x").alias("e"))
    return E.statistics(e, "v", "e")


@query("SELECT o_orderstatus AS kind, count(*) AS n, sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS hits, round(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) / count(*), 6) AS accuracy FROM orders GROUP BY ROLLUP (o_orderstatus)")
def a17_metrics(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("answer"), F.lit("x 1-urgent 2-HIGH").alias("gold"))
    return E.overlap_metrics(o, "kind", "answer", "gold").withColumn("accuracy", F.round("accuracy", 6))


@query("SELECT b.item_id, q.item_id IS NULL AS missing FROM benchmark b LEFT JOIN (SELECT item_id FROM benchmark WHERE length(text) > 200) q USING (item_id)")
def j14_predictions(spark, d):
    b = table(spark, d, "benchmark").select("item_id")
    q = table(spark, d, "benchmark").filter(F.length("text") > 200).select("item_id", F.lit(1).alias("p"))
    return b.join(q, "item_id", "left").select("item_id", F.col("p").isNull().alias("missing"))


@query("SELECT source AS q, min(doc_id) AS gold FROM documents WHERE lang <> '' GROUP BY 1")
def j15_first_gold(spark, d):
    from siltstone.operators.search import first_by_key

    return first_by_key(table(spark, d, "documents").filter("lang <> ''").select(F.col("source").alias("q"), F.col("doc_id").alias("gold")), ["q"], ["gold"])


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(" + _JAC.format(a="list_distinct(string_split(lower(a.n_name), 'a'))", b="list_distinct(string_split(lower(b.n_name), 'a'))") + ", 6) AS jaccard FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1")
def u04_jaccard(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.array_distinct(F.split(F.lower("n_name"), "a")).alias("x"))
    m = n.select((F.col("n_nationkey") - 1).alias("n_nationkey"), F.col("n_nationkey").alias("b"), F.col("x").alias("y"))
    return n.join(m, "n_nationkey").select(F.col("n_nationkey").alias("a"), "b", F.round(F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y")), 6).alias("jaccard"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN [3, 5] ELSE [1, 3] END AS pages FROM nation")
def u05_valid_pages(spark, d):
    claimed = F.when(F.col("n_nationkey") % 2 == 0, F.array(*map(F.lit, (3, 99, 5)))).otherwise(F.array(*map(F.lit, (77, 1))))
    return table(spark, d, "nation").select("n_nationkey", E.valid_pages(claimed, F.array(*map(F.lit, (1, 3, 5, 9)))).alias("pages"))
