"""Clustering, embedding and ingest queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import providers as P
from siltstone.functions import vectors as V
from siltstone.operators import ann as A
from siltstone.operators import cluster as M
from siltstone.operators import graph as G
from siltstone.operators import knowledge as K
from siltstone.operators import layout as L
from siltstone.operators import neighbours as N
from siltstone.operators import search as S

from .catalog import query, table


@query()
def m01_reduced(spark, d):
    from pyspark.ml.functions import vector_to_array

    return M.reduced(table(spark, d, "embeddings"), "embedding", 4).select("vec_id", vector_to_array("features").alias("features"))


@query()
def m01_neighbour_layout(spark, d):
    nodes = table(spark, d, "embeddings").select(F.col("vec_id").alias("node"), "embedding")
    return N.layout(nodes, "embedding", N.LayoutParams(epochs=15)).select(F.col("node").alias("vec_id"), "features")


@query()
def m05_hard_labels(spark, d):
    f = M.reduced(table(spark, d, "embeddings").select(F.col("vec_id").alias("node"), "embedding"), "embedding", 3)
    model = M.mixture(f, "features", 50, size=20)
    return M.hard_labels(model, f).select("node", "community")


@query()
def m04_soft_labels(spark, d):
    f = M.reduced(table(spark, d, "embeddings").select(F.col("vec_id").alias("node"), "embedding"), "embedding", 3)
    model = M.mixture(f, "features", 50, starts=2, size=100)
    return M.soft_labels(model, f, 0.1).select("node", "labels")


@query()
def m08_cluster_tree(spark, d):
    """node, parent, level: clusters of clusters up to one root."""
    nodes = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("node"), "embedding")
    return K.cluster_tree(nodes, layers=3)[0]


@query()
def m06_clusters(spark, d):
    """The global stage: reduction, the mixture of least BIC, labels above a threshold."""
    nodes = table(spark, d, "embeddings").select(F.col("vec_id").alias("node"), "embedding")
    return K.clustered(nodes, "embedding", 3, 50, 0.1)


_H = "('0x' || substr(md5(w), 1, 15))::BIGINT"
#: Hash embeddings of a table's texts, as non-zero dimensions (k, i, x).
EMBED = """WITH w AS (SELECT {key} AS k, unnest(list_filter(string_split_regex(lower({text}), '\\s+'), lambda v: v <> '')) AS w FROM {table}), e AS (SELECT k, """ + f"{_H} % 64 AS i, sum(CASE WHEN {_H} >= 576460752303423488 THEN 1 ELSE -1 END)::DOUBLE AS x FROM w GROUP BY ALL)"


@query(
    EMBED.format(key="item_id", text="text", table="benchmark")
    + """, n AS (SELECT k, sqrt(sum(x * x)) AS n FROM e GROUP BY 1), p AS (SELECT a.k, sum(a.x * b.x) AS s FROM e a JOIN e b ON b.k = a.k + 1 AND b.i = a.i GROUP BY 1)
    SELECT a.item_id, round(CASE WHEN x.n = 0 OR y.n = 0 THEN 0 ELSE coalesce(s, 0) / (x.n * y.n) END, 4) AS score FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1 LEFT JOIN p ON p.k = a.item_id LEFT JOIN n x ON x.k = a.item_id LEFT JOIN n y ON y.k = b.item_id"""
)
def k06_text_similarity(spark, d):
    """Cosine of the embeddings of each text and the next."""
    b = table(spark, d, "benchmark").select("item_id", P.embed(F.col("text")).alias("x"))
    after = b.select((F.col("item_id") - 1).alias("item_id"), F.col("x").alias("y"))
    return b.join(after, "item_id").select("item_id", F.round(V.cosine(F.col("x"), F.col("y")), 4).alias("score"))


@query("SELECT e.vec_id, round(1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 4) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 8) q ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id LIMIT 10")
def k07_nearest_by_distance(spark, d):
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id = 8").select("embedding").first()[0]
    return S.search(e, q, 10).select("vec_id", F.round(1 - F.col("score"), 4).alias("distance"))


_INDEXED = "SELECT e.vec_id, {} FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {}) q WHERE {} ORDER BY {} DESC, e.vec_id LIMIT {}"
_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_DOT = "list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def _index(spark, rows, **how):
    return A.VectorIndex.create(rows, G.shared_path(spark, "ann"), A.IndexParams(64, nprobe=4, **how))


def _vector(spark, d, vec_id):
    return table(spark, d, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()[0]


@query(_INDEXED.format(f"round(1 - {_COS}, 4) AS distance", 8, "true", _COS, 10))
def k07_index_nearest(spark, d):
    """All cells of a stored index, scored exactly: the answer of the full scan."""
    index = _index(spark, table(spark, d, "embeddings"))
    return index.search(_vector(spark, d, 8), 10, nprobe=len(index.model.cells), refine=None).select("vec_id", F.round(1 - F.col("score"), 4).alias("distance"))


@query(_INDEXED.format(f"round({_DOT}, 4) AS score", 5, "e.label > 0", _DOT, 10))
def k09_index_levels(spark, d):
    """Inner products in a stored index under a condition on the level."""
    index = _index(spark, table(spark, d, "embeddings"), metric="ip")
    return index.search(_vector(spark, d, 5), 10, "label > 0", nprobe=len(index.model.cells), refine=None).select("vec_id", F.round("score", 4).alias("score"))


@query(
    f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round({_COS}, 10) AS sc FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)
    SELECT query_id, vec_id, round(sc, 4) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, vec_id) AS INT) AS rank FROM s QUALIFY rank <= 5"""
)
def k18_index_batched(spark, d):
    """Many queries against all cells of a stored index."""
    e = table(spark, d, "embeddings")
    index = _index(spark, e)
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return index.search_many(q, 5, nprobe=len(index.model.cells), refine=None).select("query_id", "vec_id", F.round("score", 4).alias("score"), "rank")


@query(_INDEXED.format("e.label % 3 AS level", 2, "e.label % 3 > 0 AND e.label <> 4", _COS, 12))
def s28_entity_store(spark, d):
    """Entities of all levels in a fresh index, one kind deleted again, searched above level 0."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding", (F.col("label") % 3).alias("level"), "label")
    index = _index(spark, e)
    index.delete(e.filter("label = 4"))
    return index.search(_vector(spark, d, 2), 12, "level > 0", nprobe=len(index.model.cells), refine=None).select("vec_id", "level")


@query(_INDEXED.format("e.label", 5, "e.vec_id % 9 <> 0", _COS, 12))
def s34_index_reopened(spark, d):
    """An index filled in two writes, cleaned, compacted, and opened anew by its path."""
    e = table(spark, d, "embeddings")
    index = _index(spark, e.filter("vec_id % 2 = 0"))
    index.insert(e.filter("vec_id % 2 = 1"))
    index.delete(e.filter("vec_id % 9 = 0"))
    index.compact()
    again = A.VectorIndex(spark, index.path)
    return again.search(_vector(spark, d, 5), 12, nprobe=len(again.model.cells), refine=None).select("vec_id", "label")


@query("SELECT label, vec_id, rank FROM (SELECT e.label, e.vec_id, row_number() OVER (PARTITION BY e.label ORDER BY list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) AS rank FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) WHERE rank <= 3")
def k04_topk_per_document(spark, d):
    from pyspark.sql import Window

    e = table(spark, d, "embeddings")
    q = F.array(*[F.lit(float(x)) for x in e.filter("vec_id = 0").select("embedding").first()[0]])
    w = Window.partitionBy("label").orderBy(F.desc("score"), "vec_id")
    return e.withColumn("score", V.dot(F.col("embedding"), q)).withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("label", "vec_id", "rank")


@query("SELECT e.vec_id, e.label FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 2) q WHERE e.label IN (1, 4) ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id LIMIT 8")
def k11_blocks_by_type(spark, d):
    e = table(spark, d, "embeddings")
    return S.search(e, e.filter("vec_id = 2").select("embedding").first()[0], 8, where=F.col("label").isin(1, 4)).select("vec_id", "label")


@query("WITH b AS (SELECT l_orderkey AS doc, l_linenumber AS pos, CASE WHEN l_linenumber % 3 = 0 THEN 'groups' ELSE 'texts' END AS kind, l_orderkey % 5 AS idx FROM lineitem GROUP BY ALL) SELECT doc, pos, CASE WHEN kind = 'groups' THEN s ELSE 0 END AS sub, CASE WHEN kind = 'groups' THEN idx + s ELSE idx END AS idx FROM b, (SELECT unnest([0, 1]) AS s) WHERE kind = 'groups' OR s = 0")
def e01_resolved_references(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("pos")).distinct()
    body = li.select("doc", "pos", F.when(F.col("pos") % 3 == 0, "groups").otherwise("texts").alias("kind"), (F.col("doc") % 5).alias("idx"))
    docs = li.select("doc").distinct()
    items = docs.select("doc", F.lit("texts").alias("kind"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))).alias("idx"), F.lit("t").alias("text"))
    groups = docs.select("doc", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("group"), F.array(F.lit(0), F.lit(1)).alias("s")).select("doc", "group", F.explode("s").alias("sub")).select("doc", "group", "sub", F.lit("texts").alias("kind"), (F.col("group") + F.col("sub")).alias("idx"))
    return L.resolve_references(body, items, groups).select("doc", "pos", "sub", "idx")


@query("SELECT conv_id AS doc, CAST(turn // 2 + 1 AS BIGINT) AS page, count(*) AS n, string_agg(md5(text), chr(10) ORDER BY turn, role, md5(text)) AS text FROM conversations GROUP BY ALL")
def e02_assembled_pages(spark, d):
    b = table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), (F.floor(F.col("turn") / 2) + 1).alias("page"), "turn", "role", F.md5("text").alias("text"))
    return L.assemble_pages(b, ["turn", "role"])


@query("SELECT r_regionkey, '| id | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS md FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def e03_tables(spark, d):
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"]))
    g = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(rows.alias("rows"))
    return g.select("r_regionkey", L.markdown_table(F.concat(F.array(F.array(F.lit("id"), F.lit("name"))), F.col("rows"))).alias("md"))


@query("SELECT page_id AS doc, unnest(['text', 'table']) AS block_type, 1 AS page FROM pages")
def e05_page_blocks(spark, d):
    p = table(spark, d, "pages").select(F.col("page_id").alias("doc"), F.lit(0).alias("page_idx"), F.array("url", F.lit(" ")).alias("paras"), F.array(F.lit("|a|")).alias("tables"), F.array(F.lit(None).cast("string")).alias("images"))
    return L.page_blocks(p).select("doc", "block_type", "page")


_NO = "regexp_replace({0}, '{1}', '{2}', 'gis')"
_BODY = "html"
for _tag in ("script", "style", "nav", "head"):
    _BODY = _NO.format(_BODY, rf"<{_tag}\b.*?</{_tag}>", " ")
_BODY = _NO.format(_NO.format(_NO.format(_BODY, "<!--.*?-->", " "), r"<br\s*/?>|</p>|</h[1-6]>|</li>|</div>", "\n"), "<[^>]+>", " ")
for _mark, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
    _BODY = f"replace({_BODY}, '{_mark}', '{_char}')"


@query("SELECT page_id, trim(regexp_replace(regexp_replace(" + _BODY + r", '[ \t\r]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g')) AS text FROM pages")
def e08_page_texts(spark, d):
    return table(spark, d, "pages").select("page_id", L.strip_html(F.col("html")).alias("text"))


@query("WITH h AS (SELECT e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS sc FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) q ORDER BY 2 DESC, 1 LIMIT 36) SELECT h.vec_id, coalesce(length(text) % 97 / 97.0, -1e9) AS model_score FROM h LEFT JOIN documents ON doc_id = h.vec_id ORDER BY 2 DESC, 1 LIMIT 10")
def r05_rerank(spark, d):
    """A model's score orders the candidates; a missing one counts as the worst."""
    e = table(spark, d, "embeddings")
    near = S.search(e, e.filter("vec_id = 1").select("embedding").first()[0], 36).select("vec_id", "score")
    docs = near.join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text"), "vec_id", "left")
    model = F.when(F.col("text").isNotNull(), F.length("text") % 97 / 97.0)
    return S.top_k(docs, F.coalesce(model, F.lit(-1e9)), "vec_id", 10, "model_score").select("vec_id", "model_score")


@query("SELECT doc_id, source FROM documents")
def t01_incremental_ingest(spark, d):
    """Documents stored in two overlapping runs: each once."""
    from siltstone.sources.io import KeyedTable

    docs = table(spark, d, "documents").select("doc_id", "source")
    store = KeyedTable(spark, G.shared_path(spark, "ingest"), "doc_id")
    for part in (docs.filter("source <> 'src0'"), docs):
        store.upsert(store.missing(part))
    return store.load()
