"""Entity merges, cluster trees, reports, extraction and question batches as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import parsing
from siltstone.functions import text as T
from siltstone.operators import chunks as C
from siltstone.operators import evaluation as E
from siltstone.operators import graph as G
from siltstone.operators import knowledge as K
from siltstone.operators import search as S

from .catalog import query, table

_head = lambda t: T.truncate_tokens(t, 5)  # noqa: E731  a summary
_HEAD = "array_to_string((string_split(trim(regexp_replace({0}, '\\s+', ' ', 'g')), ' '))[1:5], ' ')"


def _supplier_graph(spark, d):
    """Suppliers of one line order of a customer, as edges between suppliers, with nations as communities."""
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_suppkey") + F.col("l_linenumber") * F.col("l_linenumber")).alias("tgt"))
    edges = li.join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("tgt")), "tgt").groupBy("src", "tgt").agg(F.count("*").alias("weight")).filter("src <> tgt")
    members = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("community"))
    return edges, members


_EDGES = "(SELECT l_suppkey AS src, l_suppkey + l_linenumber * l_linenumber AS tgt, count(*) AS weight FROM lineitem WHERE l_suppkey + l_linenumber * l_linenumber IN (SELECT s_suppkey FROM supplier) GROUP BY ALL HAVING l_suppkey <> l_suppkey + l_linenumber * l_linenumber)"
_MEMBERS = "(SELECT s_suppkey AS node, s_nationkey AS community FROM supplier)"


@query("""WITH e AS (SELECT p_brand AS entity, p_partkey AS line, p_type AS description, 'd' || p_size % 4 AS source_id FROM part), s AS (SELECT entity, source_id, min(line) AS line FROM e GROUP BY ALL)
    SELECT entity, (SELECT string_agg(description, ' | Here is another description : ' ORDER BY line, description) FROM e x WHERE x.entity = e.entity) AS description, (SELECT string_agg(source_id, '|' ORDER BY line, source_id) FROM s WHERE s.entity = e.entity) AS source_id FROM e GROUP BY entity""")
def a06_concat_merge(spark, d):
    e = table(spark, d, "part").select(F.col("p_brand").alias("entity"), F.col("p_partkey").alias("line"), F.col("p_type").alias("description"), F.concat(F.lit("d"), F.col("p_size") % 4).alias("source_id"))
    return K.concat_merge(e)


@query("SELECT l_suppkey AS src, l_partkey % 30 AS tgt, arg_max('o' || l_orderkey || '-' || l_linenumber, l_orderkey * 10 + l_linenumber) AS description FROM lineitem GROUP BY ALL")
def a06_last_relations(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 30).alias("tgt"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), F.concat(F.lit("o"), "l_orderkey", F.lit("-"), "l_linenumber").alias("description"))
    return K.last_relations(li)


@query("""SELECT '"' || upper(n_name) || '"' AS src, '"' || upper(r_name) || '"' AS tgt, true AS known FROM nation JOIN region ON n_regionkey = r_regionkey""")
def a07_adapted_names(spark, d):
    """Names written in different ways, brought to one form, so that all ends of relations are nodes."""
    both = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    entities = both.select(F.lower("n_name").alias("entity_name")).unionByName(both.select(F.concat(F.lit(' "'), "r_name", F.lit('"')).alias("entity_name")))
    relations = both.select(F.concat(F.lit('"'), "n_name", F.lit('"')).alias("src"), F.concat("r_name", F.lit(" ")).alias("tgt"))
    e, r = K.adapted(entities, relations)
    known = e.select("entity_name").distinct()
    ends = r.join(known.withColumnRenamed("entity_name", "src"), "src", "left_semi").join(known.withColumnRenamed("entity_name", "tgt").withColumn("known", F.lit(True)), "tgt", "left")
    return ends.select("src", "tgt", F.coalesce("known", F.lit(False)).alias("known"))


@query("""WITH t AS (SELECT n_name AS head, 'lies in' AS relation, r_name AS tail, 'd' || n_nationkey % 3 AS source_id FROM nation JOIN region ON n_regionkey = r_regionkey), e AS (SELECT DISTINCT unnest([head, tail]) AS entity, head || ' ' || relation || ' ' || tail AS line, source_id FROM t)
    SELECT entity, string_agg(DISTINCT line, ' | ' ORDER BY line) AS description, list_sort(list(DISTINCT source_id)) AS sources FROM e GROUP BY 1""")
def a08_triple_aggregate(spark, d):
    both = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return K.from_triples(both.select(F.col("n_name").alias("head"), F.lit("lies in").alias("relation"), F.col("r_name").alias("tail"), F.concat(F.lit("d"), F.col("n_nationkey") % 3).alias("source_id")))[0]


@query(f"""WITH p AS (SELECT p_brand AS name, p_type AS description, p_size % 5 AS a, p_size % 7 AS b FROM part), g AS (SELECT name, string_agg(DISTINCT description, ' | ' ORDER BY description) AS t FROM p GROUP BY 1)
    SELECT name, CASE WHEN len(string_split(trim(regexp_replace(t, '\\s+', ' ', 'g')), ' ')) > 50 THEN {_HEAD.format('t')} ELSE t END AS description, (SELECT list_sort(list(DISTINCT x)) FROM (SELECT unnest([a, b]) AS x FROM p WHERE p.name = g.name)) AS sources FROM g""")
def a09_merge_duplicates(spark, d):
    quoted = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('"'), "p_brand", F.lit('"'))).otherwise(F.col("p_brand"))
    return K.merge_duplicates(table(spark, d, "part").select(quoted.alias("name"), F.col("p_type").alias("description"), F.array(F.col("p_size") % 5, F.col("p_size") % 7).alias("sources")), 50, _head)


@query(f"""WITH e AS {_EDGES}, m AS {_MEMBERS} SELECT least(src, tgt) AS a, greatest(src, tgt) AS b, min(weight) AS weight FROM e JOIN m x ON x.node = src JOIN m y ON y.node = tgt WHERE (x.community % 5 = 1 AND y.community % 5 = 2) OR (x.community % 5 = 2 AND y.community % 5 = 1) GROUP BY ALL""")
def j10_link_lookup(spark, d):
    """Links between two sets of nodes, whichever way they are stored."""
    edges, m = _supplier_graph(spark, d)
    return K.links_between(edges, m.filter("community % 5 = 1").select("node"), m.filter("community % 5 = 2").select("node"))


@query("SELECT 's' || s_suppkey AS node, min(l_orderkey) AS source_id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey < 6 GROUP BY 1")
def j11_chunk_ids(spark, d):
    nodes = table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("node"), F.col("l_orderkey").alias("source_id")).unionByName(spark.range(1).select(F.lit("root").alias("node"), F.lit(0).cast("long").alias("source_id")))
    wanted = table(spark, d, "supplier").filter("s_nationkey < 6").select(F.concat(F.lit("s"), "s_suppkey").alias("node")).unionByName(spark.range(1).select(F.lit("root").alias("node")))
    return K.sources_of(nodes, wanted)


@query("SELECT s_suppkey AS node, s_name AS description FROM supplier WHERE s_nationkey < 6 AND s_suppkey % 2 = 0")
def j12_node_rows(spark, d):
    s = table(spark, d, "supplier")
    nodes = s.select(F.col("s_suppkey").alias("node"), F.col("s_name").alias("description"), (F.col("s_suppkey") % 2).alias("level"))
    return K.at_level(nodes, s.filter("s_nationkey < 6").select(F.col("s_suppkey").alias("node"))).select("node", "description")


@query("SELECT n_name AS node, coalesce(r_name, '') AS description FROM nation LEFT JOIN region ON r_regionkey = n_regionkey AND n_nationkey % 2 = 0")
def j13_community_lookup(spark, d):
    n = table(spark, d, "nation")
    known = n.filter("n_nationkey % 2 = 0").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("node"), F.col("r_name").alias("description"))
    return K.described(n.select(F.col("n_name").alias("node")), known)


@query("""WITH h AS (SELECT vec_id AS node, row_number() OVER (ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3)) DESC, vec_id) AS rank FROM embeddings QUALIFY rank <= 60)
    SELECT label AS community, node, row_number() OVER (PARTITION BY label ORDER BY rank) AS k FROM h JOIN embeddings ON vec_id = node QUALIFY k <= 3""")
def j17_key_entities(spark, d):
    from pyspark.sql import Window

    e = table(spark, d, "embeddings")
    hits = S.search(e, e.filter("vec_id = 3").select("embedding").first()[0], 60).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")))
    return K.key_entities(hits.select(F.col("vec_id").alias("node"), "rank"), e.select(F.col("label").alias("community"), F.col("vec_id").alias("node")), 3)


@query("""WITH m AS (SELECT s_nationkey AS community, s_suppkey AS node, s_suppkey || ': ' || s_name AS x, 2 + length(regexp_replace(s_name, '\\S', '', 'g')) AS n FROM supplier), r AS (SELECT *, sum(n) OVER (PARTITION BY community ORDER BY node ROWS UNBOUNDED PRECEDING) AS running FROM m)
    SELECT community, list_sort(list(node)) AS children, coalesce(string_agg(x, chr(10) ORDER BY node) FILTER (running <= 40), '') AS findings FROM r GROUP BY 1""")
def m09_packed_clusters(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("community"), F.col("s_suppkey").alias("node"), F.col("s_name").alias("description"))
    return K.packed_clusters(s, 40, lambda t: t)


@query(f"""WITH e AS {_EDGES}, m AS {_MEMBERS}, x AS (SELECT least(p.community, q.community) AS src, greatest(p.community, q.community) AS tgt, 'relationship<|>' || e.src || '<|>' || e.tgt || '<|>w' || weight AS line FROM e JOIN m p ON p.node = e.src JOIN m q ON q.node = e.tgt WHERE p.community <> q.community)
    SELECT src, tgt, CASE WHEN count(DISTINCT line) > 80 THEN (list_sort(list(DISTINCT line)))[1] ELSE string_agg(DISTINCT line, chr(10) ORDER BY line) END AS description, 2 AS level FROM x GROUP BY ALL""")
def m10_cluster_relations(spark, d):
    edges, members = _supplier_graph(spark, d)
    edges = edges.withColumn("description", F.concat(F.lit("w"), "weight"))
    return K.cluster_relations(edges, members, 1, 2, lambda t: F.split(t, "\n")[0])


@query("SELECT least(n_name, r_name) AS src, greatest(n_name, r_name) AS tgt, 1.0 AS weight FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 <> 3")
def q09_gleaned_edges(spark, d):
    """A first answer has half of the records, the following ones the rest, until the model says that there is no more."""
    both = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    chunks = both.select(F.concat(F.lit("c"), "n_nationkey").alias("chunk"), F.concat_ws("|", "n_name", "r_name", F.col("n_nationkey") % 4).alias("text"))
    part = lambda t, i: F.get(F.split(t, r"\|"), F.lit(i))
    entity = lambda t: F.concat(F.lit('("entity"<|>'), part(t, 0), F.lit("<|>NATION<|>a nation)"))
    relation = lambda t: F.concat(F.lit('("relationship"<|>'), part(t, 0), F.lit("<|>"), part(t, 1), F.lit("<|>lies in<|>1)<|COMPLETE|>"))
    records = K.extracted(chunks, entity, lambda t, so_far: F.when(part(t, 2) < 3, relation(t)).otherwise(""), 2, lambda so_far: ~F.contains(so_far, F.lit("relationship")))
    nodes, edges = K.graph_of_records(records)
    return edges.join(nodes.select(F.col("entity_name").alias("tgt")), "tgt", "left_semi").select("src", "tgt", "weight")


@query("SELECT upper(n_name) AS entity_name, 'NATION' AS entity_type, 'a nation' AS description, 'ent-' || md5(upper(n_name)) AS id FROM nation UNION ALL SELECT upper(r_name), 'UNKNOWN', 'UNKNOWN', 'ent-' || md5(upper(r_name)) FROM region")
def q10_ingested_entities(spark, d):
    """Extracted entities and the ends of relations that weren't extracted, merged, with ids by content, stored once in two runs."""
    from siltstone.sources.io import KeyedTable

    both = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    record = F.explode(F.array(F.concat(F.lit('"entity"<|>'), "n_name", F.lit("<|>nation<|>a nation")), F.concat(F.lit('"relationship"<|>'), "n_name", F.lit("<|>"), "r_name", F.lit("<|>in<|>1"))))
    nodes, _ = K.graph_of_records(both.select(F.concat(F.lit("c"), "n_nationkey").alias("chunk"), record.alias("record")))
    rows = G.settled(nodes.select("entity_name", "entity_type", "description", T.hash_id(F.col("entity_name"), "ent-").alias("id")), "entities")
    store = KeyedTable(spark, G.shared_path(spark, "entities"))
    for _ in range(2):
        store.upsert(store.missing(rows))
    return store.load().select("entity_name", "entity_type", "description", "id")


@query("""WITH t AS (SELECT n_name AS head, r_name AS tail, 'd' || n_nationkey AS source_id FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey = 1)
    SELECT entity, string_agg(DISTINCT line, ' | ' ORDER BY line) AS description, count(DISTINCT source_id) AS n FROM (SELECT unnest([head, tail]) AS entity, head || ' lies in ' || tail AS line, source_id FROM t) GROUP BY 1""")
def q12_extracted_graph(spark, d):
    """Layered extraction from a corpus, joined with its sources, merged to entities."""
    from .agents import layered_triples

    corpus = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("d"), "n_nationkey").alias("key"), F.concat_ws(" ", F.lit("1."), "n_name", F.lit("| lies in |"), "r_name").alias("text"))
    seeds = table(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_name").alias("entry"))
    found = layered_triples(corpus, seeds, lambda m: m.select(F.explode(T.triples(F.col("text"))).alias("t")).select("t.*"), 2)
    own = corpus.select(F.col("key").alias("source_id"), F.explode(T.triples(F.col("text"))).alias("t")).select("source_id", "t.*")
    triples = found.select("head", "relation", "tail").distinct().join(own, ["head", "relation", "tail"])
    return K.from_triples(triples)[0].select("entity", "description", F.size("sources").cast("long").alias("n"))


def tree_store(spark, d) -> K.TreeStore:
    """Suppliers below nations below regions below the root; suppliers have vectors and chunks."""
    s = table(spark, d, "supplier").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("s_suppkey"), "embedding"), "s_suppkey")
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    key = lambda letter, c: F.concat(F.lit(letter), c)
    nodes = s.select(key("s", "s_suppkey").alias("node"), F.col("s_name").alias("description"), "embedding", (F.col("s_suppkey") % 2).alias("level"), (F.col("s_suppkey") % 6).alias("chunk"))
    tree = s.select(key("s", "s_suppkey").alias("node"), key("n", "s_nationkey").alias("parent")).unionByName(n.select(key("n", "n_nationkey").alias("node"), key("r", "n_regionkey").alias("parent")))
    tree = tree.unionByName(r.select(key("r", "r_regionkey").alias("node"), F.lit("root").alias("parent")))
    told = n.select(key("n", "n_nationkey").alias("node"), F.col("n_name").alias("description")).unionByName(r.select(key("r", "r_regionkey").alias("node"), F.col("r_name").alias("description")))
    return K.TreeStore(nodes, tree, told)


@query("""WITH h AS (SELECT s_suppkey AS k, s_name, s_nationkey AS n, n_regionkey AS r, s_suppkey % 6 AS chunk, list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 2)) AS sc FROM supplier JOIN embeddings ON vec_id = s_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 2 = 0),
    t AS (SELECT *, row_number() OVER (ORDER BY sc DESC, 's' || k) AS pos FROM h QUALIFY pos <= 6), p AS (SELECT a.n = b.n AS same, a.r = b.r AS near, a.k AS ak, b.k AS bk, a.n AS an, b.n AS bn, a.r AS ar, b.r AS br FROM t a JOIN t b ON 's' || a.k < 's' || b.k),
    w AS (SELECT DISTINCT unnest(['s' || ak, 's' || bk, 'n' || an, 'n' || bn] || CASE WHEN same THEN [] ELSE ['r' || ar, 'r' || br] END || CASE WHEN same OR near THEN [] ELSE ['root'] END) AS node FROM p),
    c AS (SELECT 'n' || n_nationkey AS node, n_name AS d FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name FROM region), v AS (SELECT chunk, count(*) AS votes, min(pos) AS first FROM t GROUP BY 1 ORDER BY CASE WHEN count(*) > 1 THEN -count(*) ELSE 0 END, min(pos) LIMIT 3)
    SELECT 'entities' AS section, pos, 's' || k || ': ' || s_name AS text FROM t UNION ALL SELECT 'path', row_number() OVER (ORDER BY node), node FROM w UNION ALL SELECT 'aggregation', row_number() OVER (ORDER BY node), node || ': ' || d FROM w JOIN c USING (node)
    UNION ALL SELECT 'chunks', row_number() OVER (ORDER BY CASE WHEN votes > 1 THEN -votes ELSE 0 END, first), CAST(chunk AS VARCHAR) FROM v""")
def q13_tree_query(spark, d):
    vector = table(spark, d, "embeddings").filter("vec_id = 2").select("embedding").first()[0]
    out = K.tree_query(tree_store(spark, d), vector, 6, 0, 4, 3)
    return out.select("section", F.col("pos").cast("long").alias("pos"), "text")


@query(f"""WITH n AS (SELECT s_nationkey AS c, string_agg(s_name, chr(10) ORDER BY s_suppkey) AS t FROM supplier GROUP BY 1), a AS (SELECT c, {_HEAD.format('t')} AS report FROM n),
    z AS (SELECT n_regionkey AS r, sum(1 + length(regexp_replace(s_name, '\\S', '', 'g'))) AS tokens FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1),
    b AS (SELECT n_regionkey AS r, CASE WHEN any_value(tokens) > 30 THEN NULL ELSE string_agg(s_name, chr(10) ORDER BY s_suppkey) END AS t FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN z ON z.r = n_regionkey GROUP BY 1),
    q AS (SELECT n_regionkey AS r, string_agg(report, chr(10) ORDER BY '~' || c) AS t FROM a JOIN nation ON n_nationkey = c GROUP BY 1)
    SELECT 1 AS level, c AS community, report FROM a UNION ALL SELECT 0, b.r, {_HEAD.format('coalesce(b.t, q.t)')} FROM b JOIN q ON q.r = b.r""")
def q08_community_reports(spark, d):
    """Nations are described by their suppliers; regions by theirs too, or, if that is too long, by their nations' reports."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey"), "s_nationkey")
    of = lambda level, c: s.groupBy(F.lit(level).alias("level"), F.col(c).alias("community")).agg(F.array_sort(F.collect_set("s_suppkey")).alias("nodes"))
    texts = s.select(F.col("s_suppkey").alias("node"), F.col("s_name").alias("description"))
    return K.community_reports(G.settled(of(1, "s_nationkey").unionByName(of(0, "n_regionkey")), "schema"), texts, 30, _head)


@query("SELECT count(*) AS leaves, 0 AS orphans, 1 AS roots, count(*) AS stored FROM embeddings")
def m13_tree_build(spark, d):
    """Nodes with vectors to a cluster tree, stored as vectors by level and as rows; every parent is there."""
    from siltstone.sources.io import VectorTable

    nodes = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("node"), "embedding")
    links, made = K.cluster_tree(nodes, layers=2)
    links, made = G.settled(links, "links"), G.settled(made, "nodes")
    store = VectorTable(spark, G.shared_path(spark, "tree"), 64, "node")
    store.insert(made)
    missing = links.filter("parent <> 'root'").join(made.select(F.col("node").alias("parent")), "parent", "left_anti")
    one = links.agg(F.count(F.when(F.col("level") == 0, 1)).alias("leaves"), F.countDistinct(F.when(F.col("parent") == "root", F.col("parent"))).cast("int").alias("roots"))
    stored = store.table.load().filter("level = 0").agg(F.count("*").alias("stored"))
    return one.join(F.broadcast(missing.agg(F.count("*").cast("int").alias("orphans")))).join(F.broadcast(stored)).select("leaves", "orphans", "roots", "stored")


@query("SELECT count(*) AS total, sum(CASE WHEN item_id % 5 = 0 THEN 1 ELSE 0 END) AS error, sum(CASE WHEN item_id % 5 = 1 THEN 1 ELSE 0 END) AS na, sum(CASE WHEN item_id % 5 > 1 THEN 1 ELSE 0 END) AS success FROM benchmark")
def q17_question_batch(spark, d):
    """All questions at once: answers, errors of those without context, and the batch's statistics."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), "text")
    contexts = q.filter("question_id % 5 <> 0").select("question_id", F.concat(F.lit("context "), F.when(F.col("question_id") % 5 == 1, "N/A").otherwise("told")).alias("context"))
    found = K.answered(q, contexts, lambda p: F.when(F.contains(p, F.lit("N/A")), "N/A").otherwise(F.split(p, "\n")[0]))
    return E.statistics(found, "answer", "error")


@query("SELECT lang AS kind, count(*) AS n, sum(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END) AS hits, round(sum(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END) / count(*), 6) AS accuracy FROM documents GROUP BY ROLLUP (lang)")
def q20_answers_evaluated(spark, d):
    """A batch of questions answered and scored against gold answers, by kind and in all."""
    docs = table(spark, d, "documents")
    q = docs.select(F.col("doc_id").alias("question_id"), F.concat(F.lit("gold"), "doc_id").alias("text"), "lang")
    contexts = q.select("question_id", F.when(F.col("question_id") % 3 == 0, "").otherwise("none ").alias("context"))
    found = K.answered(q.select("question_id", "text"), contexts, lambda p: F.concat(F.lit('The answer to the question is "'), F.when(p.startswith("none"), "nothing").otherwise(F.trim(F.split(p, "\n")[1])), F.lit('"')))
    scored = found.join(q.select("question_id", F.col("lang").alias("kind"), F.col("text").alias("gold")), "question_id").withColumn("answer", T.extract_answer(F.col("answer")))
    return E.overlap_metrics(scored, "kind", "answer", "gold").withColumn("accuracy", F.round("accuracy", 6))


@query(f"SELECT conv_id, turn, role, md5(CASE WHEN role = 'user' THEN 'caption ' || turn ELSE {_HEAD.format('text')} END) AS summary FROM conversations")
def q24_summaries(spark, d):
    """Images keep their captions, texts are summarised."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", "text", F.when(F.col("role") == "user", "image").otherwise("text").alias("type"), F.concat(F.lit("caption "), "turn").alias("caption"))
    return K.per_document_summaries(c, _head).select("conv_id", "turn", "role", F.md5("summary").alias("summary"))


@query("""WITH t AS (SELECT r_regionkey AS title_id, list_distinct(string_split(lower(r_name || ' of the'), ' ')) AS w FROM region), b AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text || ' ' || CASE doc_id % 3 WHEN 0 THEN 'asia' WHEN 1 THEN 'europe' ELSE '' END), '\\s+'), lambda x: x <> '')) AS w FROM documents),
    s AS (SELECT doc_id, title_id, len(list_intersect(t.w, b.w)) AS n FROM b, t) SELECT doc_id AS block_id, coalesce(arg_min(title_id, (-n, title_id)) FILTER (n > 0), (SELECT min(r_regionkey) FROM region)) AS title_id FROM s GROUP BY 1""")
def q21_blocks_assigned(spark, d):
    """Blocks of material, each under the title that it shares most words with."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("block_id"), F.concat_ws(" ", "text", F.when(F.col("doc_id") % 3 == 0, "asia").when(F.col("doc_id") % 3 == 1, "europe").otherwise("")).alias("text"))
    titles = table(spark, d, "region").select(F.col("r_regionkey").alias("title_id"), F.concat("r_name", F.lit(" of the")).alias("title"))
    return K.assigned(docs, titles)


@query("SELECT n_name AS entity, CASE WHEN n_regionkey = 1 THEN n_name || chr(9) || 'in' || chr(9) || r_name ELSE 'x' || chr(9) || 'is' || chr(9) || 'y' END AS example FROM nation JOIN region ON n_regionkey = r_regionkey")
def f28_triple_examples(spark, d):
    """Known triples with the entity as head, whatever its case; fixed ones where there are none."""
    from siltstone.sources import io as IO

    both = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    path = f"{G.shared_path(spark, 'files')}/known.txt"
    IO.write(both.filter("n_regionkey = 1").select(F.concat_ws("\t", F.lower("n_name"), F.lit("in"), "r_name")), path)
    known = IO.read(spark, path).select(F.split("value", "\t").alias("p")).filter("size(p) = 3")
    found = both.select(F.col("n_name").alias("entity")).join(known, F.lower("entity") == F.lower(F.col("p")[0]), "left")
    return found.select("entity", F.when(F.col("p").isNotNull(), F.concat_ws("\t", "entity", F.col("p")[1], F.col("p")[2])).otherwise("x\tis\ty").alias("example"))


@query("SELECT doc_id, ['say', 'new york', '中文', '文字', '字'] || CASE WHEN doc_id % 2 = 0 THEN ['élan', 'x1'] ELSE [] END AS tokens FROM documents")
def f03_word_tokens(spark, d):
    t = F.concat(F.lit("Say, New York! 中文字 字"), F.when(F.col("doc_id") % 2 == 0, " Élan; x1").otherwise(" ..."))
    return table(spark, d, "documents").select("doc_id", T.word_tokens(t, ("New York",)).alias("tokens"))


@query("SELECT conv_id, turn, role, md5(role || text) AS text, turn AS chunk_id FROM conversations")
def c12_layout_blocks(spark, d):
    """Chunks of a page's layout: blocks of lines of spans; blocks without lines are left out."""
    span = lambda *parts: F.struct(F.array(*[F.struct(x.alias("text")) for x in parts]).alias("spans"))
    block = F.struct(F.col("turn").cast("long").alias("id"), F.array(F.lit(0.0), F.lit(1.0)).alias("bbox"), F.array(span(F.col("role")), span(F.col("text"))).alias("lines"))
    empty = F.struct(F.lit(99).cast("long").alias("id"), F.array(F.lit(0.0)).alias("bbox"), F.lit(None).cast("array<struct<spans: array<struct<text: string>>>>").alias("lines"))
    pages = table(spark, d, "conversations").select("conv_id", "turn", "role", F.to_json(F.struct(F.array(block, empty).alias("blocks"))).alias("layout"))
    return C.by_layout(pages, ["conv_id", "turn", "role"], "layout").select("conv_id", "turn", "role", F.md5("text").alias("text"), "chunk_id")


@query("""WITH t AS (SELECT source AS doc, doc_id % 3 AS page, 'content' AS type, doc_id AS pos, md5(text) AS text FROM documents UNION ALL SELECT source, doc_id % 3, 'serialized_table', doc_id, '|' || lang || '|' FROM documents WHERE doc_id % 4 = 0)
    SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY page, type, pos) - 1 AS id, page, type, text FROM t""")
def c10_table_chunks(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("doc"), (F.col("doc_id") % 3).alias("page"), "doc_id", "text", "lang")
    texts = docs.select("doc", "page", F.col("doc_id").alias("pos"), F.md5("text").alias("text"))
    tables = docs.filter("doc_id % 4 = 0").select("doc", "page", F.col("doc_id").alias("table_id"), F.concat(F.lit("|"), "lang", F.lit("|")).alias("text"))
    return C.with_table_chunks(texts, tables)


_TOK = "array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''), ' ')"


@query(f"""WITH p AS (SELECT source AS doc, doc_id AS page, {_TOK} AS t FROM documents WHERE source IN ('src0', 'src1', 'src2')), x AS (SELECT doc, string_agg(t, ' ' ORDER BY page) FILTER (t <> '') AS x FROM p GROUP BY 1), w AS (SELECT doc, x, string_split(x, ' ') AS w FROM x),
    c AS (SELECT doc, x, n AS chunk_no, array_to_string(w[n * 250 + 1:n * 250 + 300], ' ') AS chunk FROM (SELECT *, unnest(range(0, greatest(1, CAST(ceil((len(w) - 50) / 250.0) AS BIGINT)))) AS n FROM w)),
    e AS (SELECT doc, page, sum(length(t) + 1) OVER (PARTITION BY doc ORDER BY page ROWS UNBOUNDED PRECEDING) AS upto FROM p WHERE t <> '')
    SELECT c.doc, chunk_no, min(page) AS page, md5(any_value(chunk)) AS chunk FROM c JOIN e ON e.doc = c.doc AND e.upto >= strpos(x, chunk) GROUP BY c.doc, chunk_no""")
def c07_whole_document(spark, d):
    """Windows over all pages of a document; page: where the window's text first stands."""
    pages = table(spark, d, "documents").filter(F.col("source").isin("src0", "src1", "src2")).select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), "text")
    return C.by_whole_document(pages, 300, 50).select("doc", "chunk_no", "page", F.md5("chunk").alias("chunk"))


@query()
def c05_separator_chunks(spark, d):
    return C.by_separators(table(spark, d, "documents"), "text", ["doc_id"], [["the"], ["of", "the"], ["le"]], 60, 8)


@query("SELECT item_id, item_id AS a, 'x, y' AS b, 'z' || item_id AS c FROM benchmark")
def f11_lenient_pairs(spark, d):
    """Pairs of broken JSON, one of them an object."""
    t = F.concat(F.lit('Sure {"a": '), "item_id", F.lit(', b: "x, y", "o": {"c": z'), "item_id", F.lit("}"))
    j = parsing.by_batches(parsing.lenient_json, "string")(t)
    return table(spark, d, "benchmark").select("item_id", F.get_json_object(j, "$.a").cast("long").alias("a"), F.get_json_object(j, "$.b").alias("b"), F.get_json_object(j, "$.o.c").alias("c"))
