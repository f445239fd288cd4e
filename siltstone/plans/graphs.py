"""Graph queries. Nodes are suppliers, customers, nations and regions; edges their keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import graph as G
from siltstone.operators import leiden as L
from siltstone.operators import node2vec as V

from .catalog import query, table

_TREE = "(SELECT 's' || s_suppkey AS node, 'n' || s_nationkey AS parent FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 'root' FROM region UNION ALL SELECT 'root', NULL)"
_EDGES = "(SELECT o_custkey AS src, 100000 + l_suppkey AS tgt, count(*) AS weight FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)"


def _tree(spark, d):
    up = lambda t, node, parent, a, b: table(spark, d, t).select(F.concat(F.lit(a), F.col(node).cast("string")).alias("node"), (F.concat(F.lit(b), F.col(parent).cast("string")) if parent else F.lit("root")).alias("parent"))
    root = spark.range(1).select(F.lit("root").alias("node"), F.lit(None).cast("string").alias("parent"))
    return up("supplier", "s_suppkey", "s_nationkey", "s", "n").unionByName(up("nation", "n_nationkey", "n_regionkey", "n", "r")).unionByName(up("region", "r_regionkey", None, "r", "")).unionByName(root)


def _edges(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("src"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.lit(100000) + F.col("l_suppkey")).alias("tgt"))
    return o.join(li, "o_orderkey").groupBy("src", "tgt").agg(F.count("*").alias("weight"))


def _nodes(edges):
    return edges.select(F.explode(F.array("src", "tgt")).alias("node")).distinct()


@query("SELECT entity_name, first(entity_type ORDER BY n DESC, entity_type) AS entity_type, any_value(description) AS description FROM (SELECT c_mktsegment AS entity_name, 't' || c_nationkey % 3 AS entity_type, count(*) AS n FROM customer GROUP BY ALL) JOIN (SELECT c_mktsegment AS entity_name, string_agg(DISTINCT CAST(c_nationkey AS VARCHAR), '<SEP>' ORDER BY CAST(c_nationkey AS VARCHAR)) AS description FROM customer GROUP BY 1) USING (entity_name) GROUP BY 1")
def a04_merge_nodes(spark, d):
    r = table(spark, d, "customer").select(F.col("c_mktsegment").alias("entity_name"), F.concat(F.lit("t"), F.col("c_nationkey") % 3).alias("entity_type"), F.col("c_nationkey").cast("string").alias("description"), F.col("c_mktsegment").alias("source_id"))
    return G.merge_nodes(r).select("entity_name", "entity_type", "description")


@query("SELECT least(s, t) AS src, greatest(s, t) AS tgt, sum(w) AS weight, min(o) AS first FROM (SELECT l_suppkey AS s, l_partkey % 50 AS t, l_quantity AS w, l_orderkey AS o FROM lineitem) GROUP BY ALL")
def a05_merge_edges(spark, d):
    r = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 50).alias("tgt"), F.col("l_quantity").alias("weight"), F.col("l_orderkey").alias("order"), F.lit("").alias("description"), F.lit("").alias("source_id"))
    return G.merge_edges(r).select("src", "tgt", "weight", F.col("order").alias("first"))


@query("SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS entity_name, 'UNKNOWN' AS entity_type FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0)")
def a05_unknown_ends(spark, d):
    nodes = table(spark, d, "supplier").filter("s_acctbal >= 0").select(F.col("s_suppkey").cast("string").alias("entity_name"))
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("src"), F.col("l_suppkey").cast("string").alias("tgt"))
    return G.missing_ends(nodes, e)


@query("WITH h AS (SELECT l_linenumber + 10 * l_orderkey AS pos, l_suppkey AS chunk FROM lineitem), g AS (SELECT chunk, count(*) AS n, min(pos) AS pos FROM h GROUP BY 1) SELECT * FROM g ORDER BY CASE WHEN n > 1 THEN 0 ELSE 1 END, CASE WHEN n > 1 THEN -n ELSE 0 END, pos, chunk LIMIT 12")
def a10_chunk_votes(spark, d):
    h = table(spark, d, "lineitem").select((F.col("l_linenumber") + 10 * F.col("l_orderkey")).alias("pos"), F.col("l_suppkey").alias("chunk"))
    return G.chunk_votes(h, 12)


@query("SELECT n_regionkey AS community, count(*) AS votes, max(s_acctbal) AS rating FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <= 2 GROUP BY 1 ORDER BY votes DESC, rating DESC")
def a11_community_vote(spark, d):
    j = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).filter("n_regionkey <= 2")
    return j.groupBy(F.col("n_regionkey").alias("community")).agg(F.count("*").alias("votes"), F.max("s_acctbal").alias("rating")).orderBy(F.desc("votes"), F.desc("rating"))


@query("SELECT l_orderkey AS chunk, min(l_linenumber) AS first, count(DISTINCT l_suppkey) AS relations FROM lineitem GROUP BY 1")
def a12_relation_counts(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("chunk")).agg(F.min("l_linenumber").alias("first"), F.countDistinct("l_suppkey").alias("relations"))


@query(f"SELECT node, count(*) AS degree FROM (SELECT src AS node FROM {_EDGES} UNION ALL SELECT tgt FROM {_EDGES}) GROUP BY 1")
def a13_degrees(spark, d):
    return G.degrees(_edges(spark, d))


@query(f"WITH e AS {_EDGES}, g AS (SELECT node, count(*) AS n FROM (SELECT src AS node FROM e UNION ALL SELECT tgt FROM e) GROUP BY 1) SELECT src, tgt, a.n + b.n AS degree FROM e JOIN g a ON a.node = src JOIN g b ON b.node = tgt")
def a13_edge_degrees(spark, d):
    return G.edge_degrees(_edges(spark, d))


def _schema(spark, d):
    n = table(spark, d, "nation")
    s = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    one = s.select(F.lit(1).alias("level"), F.col("n_nationkey").alias("community"), F.col("s_suppkey").alias("node"))
    zero = s.select(F.lit(0).alias("level"), F.col("n_regionkey").alias("community"), F.col("s_suppkey").alias("node"))
    e = table(spark, d, "supplier").select(F.col("s_suppkey").alias("src"), ((F.col("s_suppkey") * 7) % 100 + 1).alias("tgt"))
    c = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), (F.col("s_suppkey") % 13).alias("chunk"))
    return G.community_schema(one.unionByName(zero), e, c)


_MEMBERS = "(SELECT 1 AS level, n_nationkey AS community, s_suppkey AS node FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 0, n_regionkey, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


@query(f"""WITH m AS {_MEMBERS}, g AS (SELECT level, community, count(DISTINCT node) AS n, count(DISTINCT node % 13) AS c FROM m GROUP BY ALL),
    e AS (SELECT level, community, count(DISTINCT least(node, (node * 7) % 100 + 1) || '-' || greatest(node, (node * 7) % 100 + 1)) AS k FROM m GROUP BY ALL)
    SELECT level, community, n AS n_nodes, k AS n_edges, round(c / (SELECT max(c) FROM g), 6) AS occurrence FROM g JOIN e USING (level, community)""")
def a14_community_schema(spark, d):
    return _schema(spark, d).select("level", "community", F.size("nodes").cast("long").alias("n_nodes"), F.size("edges").cast("long").alias("n_edges"), F.round("occurrence", 6).alias("occurrence"))


@query("SELECT DISTINCT 0 AS level, n_regionkey AS community, n_nationkey AS sub FROM nation JOIN supplier ON s_nationkey = n_nationkey")
def j19_sub_communities(spark, d):
    return G.sub_communities(_schema(spark, d))


@query("WITH s AS (SELECT s_nationkey, count(*) AS x FROM supplier GROUP BY 1) SELECT round(1 - sum(x * (x - 1)) / (sum(x) * (sum(x) - 1)), 8) AS sparsity FROM s")
def a15_sparsity(spark, d):
    return G.sparsity(table(spark, d, "supplier").select(F.col("s_nationkey").alias("community"))).select(F.round("sparsity", 8).alias("sparsity"))


@query("SELECT s_suppkey, s_acctbal, n_name FROM (SELECT * FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 20) JOIN nation ON s_nationkey = n_nationkey JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey")
def j07_hydrate(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    s = table(spark, d, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(20).join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.join(n, F.col("l_suppkey") == F.col("s_suppkey")).select("s_suppkey", "s_acctbal", "n_name")


@query(f"WITH e AS {_EDGES}, h AS (SELECT 100000 + s_suppkey AS node FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 10) SELECT node, src AS neighbour, weight AS shared FROM e JOIN h ON tgt = node")
def j08_one_hop(spark, d):
    h = table(spark, d, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(10).select((F.lit(100000) + F.col("s_suppkey")).alias("tgt"))
    return _edges(spark, d).join(F.broadcast(h), "tgt").select(F.col("tgt").alias("node"), F.col("src").alias("neighbour"), F.col("weight").alias("shared"))


@query(f"SELECT src, tgt, weight FROM {_EDGES} JOIN customer ON c_custkey = src JOIN supplier ON 100000 + s_suppkey = tgt WHERE c_nationkey = 3 AND s_nationkey = 5")
def j09_direct_relations(spark, d):
    e = _edges(spark, d)
    a = table(spark, d, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("node"))
    b = table(spark, d, "supplier").filter("s_nationkey = 5").select((F.lit(100000) + F.col("s_suppkey")).alias("node"))
    return e.join(a, e.src == a.node, "left_semi").join(b, e.tgt == b.node, "left_semi").select("src", "tgt", "weight")


@query(f"WITH e AS {_EDGES} SELECT src, tgt, weight FROM e ORDER BY weight DESC, src, tgt LIMIT 30")
def k17_ranked_edges(spark, d):
    return _edges(spark, d).orderBy(F.desc("weight"), "src", "tgt").limit(30)


@query(f"SELECT src, tgt, weight FROM {_EDGES} WHERE src = 1 OR tgt = 100007")
def g01_node_edges(spark, d):
    return _edges(spark, d).filter("src = 1 OR tgt = 100007")


@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT n_nationkey, 'new' FROM nation WHERE n_regionkey = 1")
def g02_upsert(spark, d):
    from siltstone.operators.relational import upsert

    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), "n_regionkey")
    return upsert(n.select("id", "name"), n.filter("n_regionkey = 1").select("id", F.lit("new").alias("name")), "id")


_UP = f"t AS MATERIALIZED {_TREE}, u AS MATERIALIZED (SELECT node AS src, parent AS tgt FROM t WHERE parent IS NOT NULL UNION SELECT parent, node FROM t WHERE parent IS NOT NULL)"


def _up(spark, d):
    return _tree(spark, d).filter("parent IS NOT NULL").select(F.col("node").alias("src"), F.col("parent").alias("tgt"))


@query(f"""WITH RECURSIVE {_UP}, p AS (SELECT node, [node] AS path FROM t WHERE node LIKE 'r%' UNION ALL SELECT u.tgt, list_append(p.path, u.tgt) FROM p JOIN u ON u.src = p.node WHERE len(p.path) < 4 AND NOT list_contains(p.path, u.tgt))
    SELECT path[1] AS start, node, len(path) - 1 AS hops, count(*) AS n FROM p WHERE len(path) > 1 GROUP BY ALL""")
def g03_bounded_paths(spark, d):
    start = _tree(spark, d).filter("node LIKE 'r%'").select("node")
    return G.paths(_up(spark, d), start, 3).groupBy("start", "node", "hops").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {_UP}, p AS (SELECT node AS start, node, 0 AS hops FROM t WHERE node LIKE 'n%' UNION SELECT p.start, u.tgt, p.hops + 1 FROM p JOIN u ON u.src = p.node WHERE p.hops < 4)
    SELECT start, node, min(hops) AS hops, min(hops) + 1 AS n FROM p GROUP BY ALL HAVING min(hops) > 0""")
def g04_shortest_paths(spark, d):
    start = _tree(spark, d).filter("node LIKE 'n%'").select("node")
    return G.shortest_paths(_up(spark, d), start, 4).select("start", "node", "hops", F.size("path").alias("n"))


@query(f"""WITH RECURSIVE t AS {_TREE}, p AS (SELECT node AS start, parent AS node, 1 AS hops, [node, parent] AS path FROM t WHERE parent IS NOT NULL
    UNION ALL SELECT p.start, t.parent, p.hops + 1, list_append(p.path, t.parent) FROM p JOIN t ON t.node = p.node WHERE t.parent IS NOT NULL AND p.hops < 5) SELECT start, node, hops, array_to_string(path, '>') AS path FROM p""")
def g05_directed_paths(spark, d):
    e = _tree(spark, d).filter("parent IS NOT NULL").select(F.col("node").alias("src"), F.col("parent").alias("tgt"))
    return G.paths(e, e.select(F.col("src").alias("node")), 4, directed=True).select("start", "node", "hops", F.array_join("path", ">").alias("path"))


@query(f"WITH e AS {_EDGES} SELECT src AS node, tgt AS other, 20 AS score FROM e WHERE src = 5 UNION ALL SELECT tgt, src, 20 FROM e WHERE tgt = 100003")
def g06_one_hop_edges(spark, d):
    """Edges of customer 5 and of supplier 3. With many customers a customer has the number 100003 too, so each end is asked on its own side."""
    e = _edges(spark, d).select("src", "tgt").filter("src = 5 OR tgt = 100003")
    ends = F.array(F.when(F.col("src") == 5, F.struct(F.col("src").alias("node"), F.col("tgt").alias("other"))), F.when(F.col("tgt") == 100003, F.struct(F.col("tgt").alias("node"), F.col("src").alias("other"))))
    return e.select(F.explode(F.array_compact(ends)).alias("e")).select("e.*", F.lit(20).alias("score"))


_FOREST = "(SELECT p_partkey AS src, p_partkey - p_partkey % 16 AS tgt FROM part WHERE p_partkey % 16 <> 0)"


@query(f"SELECT node, node - node % 16 AS component FROM (SELECT src AS node FROM {_FOREST} UNION SELECT tgt FROM {_FOREST})")
def g08_components(spark, d):
    e = table(spark, d, "part").filter("p_partkey % 16 <> 0").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") - F.col("p_partkey") % 16).alias("tgt"))
    return G.components(_nodes(e), e)


@query(f"WITH c AS (SELECT src AS node FROM {_FOREST} UNION SELECT tgt FROM {_FOREST}), g AS (SELECT node - node % 16 AS k, count(*) AS n FROM c GROUP BY 1 ORDER BY n DESC, k LIMIT 1) SELECT node FROM c, g WHERE node - node % 16 = k")
def g08_largest_component(spark, d):
    e = table(spark, d, "part").filter("p_partkey % 16 <> 0").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") - F.col("p_partkey") % 16).alias("tgt"))
    return G.largest_component(_nodes(e), e)


@query()
def g09_communities(spark, d):
    e = G.settled(_edges(spark, d), "edges")
    return L.community_levels(_nodes(e), e, 10)


@query()
def g11_walks(spark, d):
    e = G.settled(_edges(spark, d), "edges")
    return G.walks(e, _nodes(e), 6, 2)


@query()
def g11_node_vectors(spark, d):
    e = G.settled(_edges(spark, d), "edges")
    return V.node_vectors(_nodes(e), e, V.WalkParams(length=5, per_node=2, away=2.0, dims=16))


@query(f"WITH e AS {_EDGES} SELECT src, tgt, weight FROM e WHERE src IN (SELECT src FROM e WHERE tgt = 100001) AND tgt IN (100001, 100002, 100003)")
def g13_induced_edges(spark, d):
    e = G.settled(_edges(spark, d), "edges")
    near = e.filter("tgt = 100001").select(F.col("src").alias("node"))
    return e.filter(F.col("tgt").isin(100001, 100002, 100003)).join(near, F.col("src") == F.col("node"), "left_semi").select("src", "tgt", "weight")


@query(f"""WITH RECURSIVE t AS {_TREE}, p AS (SELECT node AS start, 0 AS pos, node FROM t WHERE node LIKE 's%' UNION ALL SELECT p.start, p.pos + 1, t.parent FROM p JOIN t ON t.node = p.node WHERE t.parent IS NOT NULL) SELECT * FROM p""")
def g14_ancestors(spark, d):
    t = _tree(spark, d)
    return G.ancestors(t, t.filter("node LIKE 's%'").select("node"), 4)


@query("SELECT 's' || a.s_suppkey AS a, 's' || b.s_suppkey AS b, CASE WHEN a.s_nationkey = b.s_nationkey THEN 'n' || a.s_nationkey WHEN x.n_regionkey = y.n_regionkey THEN 'r' || x.n_regionkey ELSE 'root' END AS node FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1 JOIN nation x ON x.n_nationkey = a.s_nationkey JOIN nation y ON y.n_nationkey = b.s_nationkey")
def g15_common_ancestor(spark, d):
    t = _tree(spark, d)
    chains = G.ancestors(t, t.filter("node LIKE 's%'").select("node"), 4)
    s = table(spark, d, "supplier").select("s_suppkey")
    pairs = s.join(s.withColumnRenamed("s_suppkey", "k"), F.col("k") == F.col("s_suppkey") + 1).select(F.concat(F.lit("s"), "s_suppkey").alias("a"), F.concat(F.lit("s"), "k").alias("b"))
    return G.common_ancestor(chains, pairs)


@query("SELECT r_name, string_agg(n_name, chr(9) || chr(9) ORDER BY n_name) AS description FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def g16_aggregation_text(spark, d):
    g = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("l"))
    return g.select("r_name", F.array_join("l", "\t\t").alias("description"))


@query("SELECT 's' || s_suppkey AS node, 'n' || s_nationkey AS parent FROM supplier WHERE s_nationkey >= 20")
def m12_orphans(spark, d):
    return G.orphans(_tree(spark, d).filter("NOT (node LIKE 'n2_')"))
