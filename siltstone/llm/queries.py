"""The queries of the llm operators over the tables in a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, fingerprint, lang_id, license_scan, lm_scoring, near_dup, negatives, packing, quality, sharding, substring, wavelet
from .shared import prepare


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.pseudo_likelihood(_table(spark, sf_dir, "documents"))


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    known = docs.filter(~lang_id.held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    found = lang_id.predict(docs, lang_id.train(known))
    return found.select("doc_id", lang_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_files(_table(spark, sf_dir, "documents"), wavelet.TokenFileParams(public_tokenizers.path("byte_bpe_50k.json")))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(_table(spark, sf_dir, "documents")).drop("kept_text")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = bpe.BpeParams(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.encode(_table(spark, sf_dir, "documents"), p, ids=False)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), packing.PackingParams(public_tokenizers.path("word_bpe_49k.json")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label_col=label)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(_table(spark, sf_dir, "embeddings"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), carry=[])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_lm_scoring, op2_near_dup, op3_lang_id, op4_quality, op5_fingerprints, op6_token_files, op7_substrings, op8_bpe, op9_licenses, op10_packing, op11_hard_negatives, op12_centroids, op13_sharding)
    return {f.__name__: f for f in found}


_WORDS = "list_filter(string_split_regex(coalesce({}, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUP_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS c FROM documents UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.node),
k AS (SELECT node, min(c) AS c FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, k.c AS component_id, d.doc_id = k.c AS kept FROM documents d JOIN k ON k.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

SUBSTRINGS_SQL = f"""
WITH w AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
m AS (SELECT g, min(doc_id) AS d FROM g GROUP BY 1),
f AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS pos FROM g JOIN m USING (g) WHERE d < doc_id),
x AS (SELECT doc_id, list(pos) AS gone, count(*) AS n FROM f GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(array_to_string(list_filter(w, lambda v, i: NOT list_contains(coalesce(gone, []), i)), ' ')) AS kept_sha256 FROM w LEFT JOIN x USING (doc_id)"""


NEGATIVES_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(CAST(a.e AS DOUBLE[]), CAST(b.e AS DOUBLE[])) AS BIGINT) AS score FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, p.id ORDER BY s.score DESC, s.id) AS INT) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
QUALIFY row_number() OVER (PARTITION BY anchor_id, p.id ORDER BY s.score DESC, s.id) <= 5"""

_NEAREST = """SELECT v.vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.vec_id, k.c, CAST(list_sum(list_transform(range(1, 65), lambda i: (v.e[i] - k.e[i]) * (v.e[i] - k.e[i]))) AS BIGINT) AS d FROM v, {} k) v GROUP BY 1"""
_MOVED = """SELECT k.c, coalesce(m.e, k.e) AS e FROM {0} k LEFT JOIN (SELECT c, list(x ORDER BY i) AS e FROM (SELECT c, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM (SELECT n.c, unnest(v.e) AS x, unnest(range(1, 65)) AS i FROM {1} n JOIN v USING (vec_id)) GROUP BY 1, 2) GROUP BY 1) m USING (c)"""
CENTROIDS_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
k0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS INT) AS c, e FROM v QUALIFY c < 16),
n0 AS ({_NEAREST.format('k0')}), k1 AS ({_MOVED.format('k0', 'n0')}), n1 AS ({_NEAREST.format('k1')}), k2 AS ({_MOVED.format('k1', 'n1')}), n2 AS ({_NEAREST.format('k2')}), k3 AS ({_MOVED.format('k2', 'n2')}), n3 AS ({_NEAREST.format('k3')})
SELECT n.vec_id, n.c AS cluster, n.d AS distance, CAST(sum(n.d) OVER (PARTITION BY n.c) AS BIGINT) AS cluster_inertia, CAST(sum(n.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k.e, ',')) AS centroid_sha256 FROM n3 n JOIN k3 k USING (c)"""


def oracle_sql() -> dict[str, str]:
    """The other operators' methods can't be expressed in SQL; their tests hold them against brute-force versions."""
    return {"op2_near_dup": NEAR_DUP_SQL, "op7_substrings": SUBSTRINGS_SQL, "op11_hard_negatives": NEGATIVES_SQL, "op12_centroids": CENTROIDS_SQL}
