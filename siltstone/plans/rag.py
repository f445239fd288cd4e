"""Graph-augmented retrieval: context sections for six query modes over entities, edges, communities and chunks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import graph as G
from siltstone.operators import matching as M
from siltstone.operators import search as S
from siltstone.sources.schemas import QueryParam

from .catalog import query, table


@dataclass(frozen=True)
class Store:
    """entities (node, name, description, embedding, source_ids), edges (src, tgt, weight, description), communities (level, community, nodes, report, rating), chunks (chunk, text)."""

    entities: DataFrame
    edges: DataFrame
    communities: DataFrame
    chunks: DataFrame


def _section(df: DataFrame, name: str, text: str, order: list, budget: int) -> DataFrame:
    """section, pos, text: the longest prefix within budget tokens.

    A text has a token at least (others add nothing and are left out), so that no more than budget rows can be in the prefix;
    only so many come to the task that adds up.
    """
    sized = df.withColumn("_n", T.token_count(F.col(text))).filter("_n > 0")
    kept = S.within_budget(sized.orderBy(*order).limit(budget), "_n", order, budget)
    return kept.select(F.lit(name).alias("section"), F.row_number().over(Window.orderBy(*order)).alias("pos"), F.col(text).alias("text"))


def hits(s: Store, vector: list[float], k: int) -> DataFrame:
    """node, score, rank of the k nearest entities: k rows."""
    near = S.search(s.entities.select("node", "embedding"), vector, k, key="node").select("node", "score")
    return G.settled(near.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "node"))), "hits")


def entity_section(s: Store, h: DataFrame, p: QueryParam) -> DataFrame:
    own = s.entities.join(F.broadcast(h), "node").select("rank", F.concat_ws(": ", "name", "description").alias("text"))
    return _section(own, "entities", "text", ["rank"], p.entity_tokens)


def edge_section(s: Store, h: DataFrame, p: QueryParam) -> DataFrame:
    near = G.both_ways(s.edges).join(F.broadcast(h.select(F.col("node").alias("src"))), "src", "left_semi")
    canonical = near.select(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt"), "weight", "description").distinct()
    ranked = canonical.join(G.edge_degrees(canonical.select("src", "tgt")), ["src", "tgt"])
    return _section(ranked, "relations", "description", [F.desc("degree"), F.desc("weight"), "src", "tgt"], p.relation_tokens)


def chunk_section(s: Store, h: DataFrame, p: QueryParam) -> DataFrame:
    """Chunks of the hit entities, by entity rank, then by how many neighbours share them."""
    own = s.entities.join(F.broadcast(h), "node").select("node", "rank", F.explode("source_ids").alias("chunk"))
    near = G.both_ways(s.edges.select("src", "tgt")).join(F.broadcast(h.select(F.col("node").alias("src"))), "src", "left_semi").select("src", "tgt").distinct()
    shared = near.join(s.entities.select(F.col("node").alias("tgt"), F.explode("source_ids").alias("chunk")), "tgt").groupBy(F.col("src").alias("node"), "chunk").agg(F.count("*").alias("n"))
    g = own.join(shared, ["node", "chunk"], "left").groupBy("chunk").agg(F.min("rank").alias("rank"), F.max(F.coalesce("n", F.lit(0))).alias("n"))
    return _section(g.join(s.chunks, "chunk"), "sources", "text", ["rank", F.desc("n"), "chunk"], p.text_tokens)


def community_votes(s: Store, h: DataFrame, p: QueryParam) -> DataFrame:
    """level, community, nodes, report, rating, votes of communities down to the level in which hit entities lie."""
    flat = s.communities.filter(F.col("level") <= p.level).select("level", "community", F.explode("nodes").alias("node")).join(F.broadcast(h.select("node")), "node", "left_semi")
    votes = flat.groupBy("level", "community").agg(F.count("*").alias("votes"))
    return s.communities.join(votes, ["level", "community"])


def community_section(s: Store, h: DataFrame, p: QueryParam) -> DataFrame:
    order = [F.desc("votes"), F.desc("rating"), "level", "community"]
    found = community_votes(s, h, p)
    if p.one_community:
        found = found.orderBy(*order).limit(1)
    return _section(found, "communities", "report", order, p.community_tokens)


def bridge_section(s: Store, h: DataFrame, p: QueryParam) -> DataFrame:
    """Relations along a path through the key entities of the communities: in each, the first top_m hits."""
    inside = community_votes(s, h, p).select("level", "community", F.explode("nodes").alias("node")).join(F.broadcast(h), "node")
    key = inside.withColumn("k", F.row_number().over(Window.partitionBy("level", "community").orderBy("rank"))).filter(F.col("k") <= p.top_m)
    names = [r.node for r in key.groupBy("node").agg(F.min("rank").alias("rank")).orderBy("rank").limit(p.top_m).collect()]
    path = M.path_through(s.edges, names)
    on = s.edges.filter(F.col("src").isin(path) & F.col("tgt").isin(path)) if path else s.edges.filter("false")
    return _section(on, "bridge", "description", [F.desc("weight"), "src", "tgt"], p.bridge_tokens)


SECTIONS: dict[str, list[Callable[[Store, DataFrame, QueryParam], DataFrame]]] = {
    "hi_local": [entity_section, edge_section, chunk_section],
    "hi_global": [community_section, chunk_section],
    "hi_bridge": [bridge_section, chunk_section],
    "hi_nobridge": [entity_section, community_section, edge_section, chunk_section],
    "hi": [community_section, bridge_section, entity_section, chunk_section],
}


def context(s: Store, vector: list[float], p: QueryParam) -> DataFrame:
    """section, pos, text for the mode of p; naive takes the nearest entities' chunks alone."""
    if p.mode != "naive" and p.mode not in SECTIONS:
        raise ValueError(f"unknown mode: {p.mode}")
    h = hits(s, vector, p.top_k * (10 if p.mode == "hi_global" else 1))
    out = None
    for make in SECTIONS.get(p.mode, [chunk_section]):
        part = make(s, h, p)
        out = part if out is None else out.unionByName(part)
    return out


def toy_store(spark, d) -> Store:
    """Suppliers as entities, neighbours in a nation and a group as edges, nations and regions as communities, documents as chunks."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("node"), "embedding")
    sup = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_name").alias("name"), F.concat_ws(" ", F.lit("supplier in nation"), F.col("s_nationkey")).alias("description"), "s_nationkey", "s_acctbal")
    ent = sup.join(v, "node").withColumn("source_ids", F.array(F.col("node") % 50, F.col("node") % 31))
    beside = sup.select(F.col("node").alias("src"), F.lead("node").over(Window.partitionBy("s_nationkey").orderBy("node")).alias("tgt"), F.abs("s_acctbal").alias("weight"))
    across = sup.select(F.col("node").alias("src"), F.lead("node").over(Window.partitionBy(F.pmod(F.xxhash64("name"), F.lit(10))).orderBy("node")).alias("tgt"), F.lit(1.0).alias("weight"))
    edges = beside.unionByName(across).filter("tgt IS NOT NULL").groupBy("src", "tgt").agg(F.sum("weight").alias("weight"))
    edges = edges.withColumn("description", F.concat_ws(" ", F.lit("trade of"), F.col("src"), F.col("tgt")))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    of = sup.join(n, "s_nationkey")
    make = lambda level, c: of.groupBy(F.lit(level).alias("level"), F.col(c).cast("long").alias("community")).agg(F.array_sort(F.collect_set("node")).alias("nodes"), F.concat_ws(" ", F.lit("report"), F.first(c)).alias("report"), F.round(F.avg("s_acctbal"), 2).alias("rating"))
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("chunk"), "text")
    w = lambda df, name: G.settled(df, name)
    return Store(w(ent.select("node", "name", "description", "embedding", "source_ids"), "entities"), w(edges, "edges"), w(make(1, "s_nationkey").unionByName(make(0, "n_regionkey")), "communities"), chunks)


def _mode(mode):
    def run(spark, d):
        vector = table(spark, d, "embeddings").filter("vec_id = 6").select("embedding").first()[0]
        return context(toy_store(spark, d), vector, QueryParam(mode=mode, level=1, top_k=8, top_m=4))

    return run


for _number, _name in (("q02", "hi_local"), ("q03", "hi_global"), ("q04", "hi_bridge"), ("q05", "hi"), ("q06", "hi_nobridge"), ("q07", "naive")):
    _f = _mode(_name)
    _f.__name__ = f"{_number}_{_name}"
    query()(_f)
