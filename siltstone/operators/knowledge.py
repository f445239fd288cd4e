"""Knowledge graphs from text: entity merges, cluster trees, reports from the bottom up, extraction with gleaning, tree queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T

from . import cluster as M
from . import graph as G
from . import search as S
from .neighbours import LayoutParams, layout

#: Fixed value: what stands between the descriptions of one entity.
ANOTHER = " | Here is another description : "


def in_order(order: Column | str, value: Column | str, mark: str) -> Column:
    """An aggregate: the values in order, joined by mark."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order) if isinstance(order, str) else order, (F.col(value) if isinstance(value, str) else value).alias("_v"))))
    return F.array_join(F.transform(rows, lambda x: x["_v"]), mark)


def concat_merge(entities: DataFrame) -> DataFrame:
    """entity, description, source_id of entities (entity, line, description, source_id): all descriptions in order of lines, and the distinct sources as first met."""
    sources = entities.groupBy("entity", "source_id").agg(F.min("line").alias("line")).groupBy("entity").agg(in_order("line", "source_id", "|").alias("source_id"))
    return entities.groupBy("entity").agg(in_order("line", "description", ANOTHER).alias("description")).join(sources, "entity")


def last_relations(relations: DataFrame) -> DataFrame:
    """src, tgt, description of relations (src, tgt, line, description): of a pair's rows the last."""
    return relations.groupBy("src", "tgt").agg(F.max_by("description", "line").alias("description"))


def unquoted(name: Column) -> Column:
    return F.regexp_replace(name, '^"+|"+$', "")


def adapted(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (entity_name, ...) and relations (src, tgt, ...) with all names upper-case in quotes, so that ends equal nodes."""
    name = lambda c: F.concat(F.lit('"'), unquoted(F.upper(F.trim(c))), F.lit('"'))
    return entities.withColumn("entity_name", name("entity_name")), relations.withColumns({"src": name("src"), "tgt": name("tgt")})


def from_triples(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (entity, description, sources) and relations (src, tgt, relation, sources) of triples (head, relation, tail, source_id): an entity is described by the triples it stands in."""
    line = F.concat_ws(" ", "head", "relation", "tail")
    ends = triples.select(F.explode(F.array("head", "tail")).alias("entity"), line.alias("line"), "source_id").distinct()
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), " | ")
    entities = ends.groupBy("entity").agg(joined("line").alias("description"), F.array_sort(F.collect_set("source_id")).alias("sources"))
    relations = triples.groupBy(F.col("head").alias("src"), F.col("tail").alias("tgt")).agg(joined("relation").alias("relation"), F.array_sort(F.collect_set("source_id")).alias("sources"))
    return entities, relations


def merge_duplicates(entities: DataFrame, limit: int, shorten: Callable[[Column], Column]) -> DataFrame:
    """name, description, sources of entities (name, description, sources): quotes around names are taken off, equal names merged, and descriptions of more than limit tokens shortened."""
    g = entities.groupBy(unquoted(F.col("name")).alias("name")).agg(F.array_join(F.array_sort(F.collect_set("description")), " | ").alias("_d"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"))
    return g.select("name", F.when(T.token_count(F.col("_d")) > limit, shorten(F.col("_d"))).otherwise(F.col("_d")).alias("description"), "sources")


def links_between(edges: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """The first edge (src, tgt, weight) of each unordered pair of one node of a and one of b, in either direction."""
    both = G.both_ways(edges.select("src", "tgt", "weight")).join(a.select(F.col("node").alias("src")), "src", "left_semi").join(b.select(F.col("node").alias("tgt")), "tgt", "left_semi")
    pair = both.select(F.least("src", "tgt").alias("a"), F.greatest("src", "tgt").alias("b"), "weight")
    return pair.groupBy("a", "b").agg(F.min("weight").alias("weight"))


def sources_of(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, source_id of the wanted nodes other than root; of several rows the first source."""
    return nodes.join(wanted.filter("node <> 'root'"), "node", "left_semi").groupBy("node").agg(F.min("source_id").alias("source_id"))


def at_level(nodes: DataFrame, wanted: DataFrame, level: int = 0) -> DataFrame:
    """The wanted nodes' rows at one level."""
    return nodes.filter(F.col("level") == level).join(wanted, "node", "left_semi")


def described(names: DataFrame, communities: DataFrame) -> DataFrame:
    """node, description: that of the community of its name, '' without one."""
    return names.join(communities.select("node", "description"), "node", "left").select("node", F.coalesce("description", F.lit("")).alias("description"))


def key_entities(hits: DataFrame, members: DataFrame, most: int) -> DataFrame:
    """community, node, k: the first most hits (node, rank) in each community (community, node)."""
    inside = members.join(hits, "node")
    return inside.withColumn("k", F.row_number().over(Window.partitionBy("community").orderBy("rank", "node"))).filter(F.col("k") <= most).select("community", "node", "k")


def packed_clusters(members: DataFrame, budget: int, summary: Callable[[Column], Column]) -> DataFrame:
    """community, children, findings of members (community, node, description): their descriptions, as many as fit the token budget in order of nodes, summarised."""
    line = F.concat_ws(": ", "node", "description")
    kept = S.within_budget(members.select("community", "node", line.alias("_x"), T.token_count(line).alias("_n")), "_n", ["node"], budget, ["community"])
    text = kept.groupBy("community").agg(in_order("node", "_x", "\n").alias("_t"))
    children = members.groupBy("community").agg(F.array_sort(F.collect_set("node")).alias("children"))
    return children.join(text, "community", "left").select("community", "children", summary(F.coalesce("_t", F.lit(""))).alias("findings"))


def cluster_relations(edges: DataFrame, members: DataFrame, layer: int, depth: int, summary: Callable[[Column], Column]) -> DataFrame:
    """src, tgt, description, level of clusters with at least one direct edge between their members.

    The description is the list of these edges; one of more than (depth - layer) * 80 tokens is summarised. Found by joining
    edges with the members at both ends, not by comparing all pairs of clusters.
    """
    of = lambda c, name: members.select(F.col("node").alias(c), F.col("community").alias(name))
    across = edges.join(of("src", "a"), "src").join(of("tgt", "b"), "tgt").filter("a <> b")
    line = F.concat_ws("<|>", F.lit("relationship"), "src", "tgt", "description")
    g = across.groupBy(F.least("a", "b").alias("c"), F.greatest("a", "b").alias("e")).agg(F.array_join(F.array_sort(F.collect_set(line)), "\n").alias("_t"))
    text = F.when(T.token_count(F.col("_t")) > (depth - layer) * 80, summary(F.col("_t"))).otherwise(F.col("_t"))
    return g.select(F.col("c").alias("src"), F.col("e").alias("tgt"), text.alias("description"), F.lit(layer + 1).alias("level"))


def community_reports(schema: DataFrame, texts: DataFrame, budget: int, report: Callable[[Column], Column]) -> DataFrame:
    """level, community, report, from the deepest level up.

    schema: level, community, nodes; texts: node, description. A community whose nodes' descriptions are over the token budget
    is described by the reports of its sub-communities instead, and by the nodes that none of them holds. One round a level.
    """
    levels = sorted((r.level for r in schema.select("level").distinct().collect()), reverse=True)  # a few levels
    out = None
    flat = schema.select("level", "community", F.explode("nodes").alias("node")).join(texts, "node")
    sizes = flat.groupBy("level", "community").agg(F.sum(T.token_count(F.col("description"))).alias("tokens"))
    subs = G.settled(G.sub_communities(schema), "sub-communities")  # level, community, sub (of the next level)
    for level in levels:
        own = flat.filter(F.col("level") == level).join(sizes, ["level", "community"])
        # Nodes come first, in the order of their own type, then reports by the names of their sub-communities.
        plain = own.select("community", "node", F.lit("").alias("_sub"), F.lit(0).alias("_told"), F.col("description").alias("_x"), (F.col("tokens") > budget).alias("over"))
        if out is not None:
            below = subs.filter(F.col("level") == level).select("community", "sub")
            covered = below.join(flat.filter(F.col("level") == level + 1).select(F.col("community").alias("sub"), "node"), "sub").select("community", "node").distinct()
            rest = plain.join(covered.withColumn("_c", F.lit(True)), ["community", "node"], "left").filter("NOT over OR _c IS NULL").drop("_c")
            over = plain.filter("over").select("community").distinct()
            told = below.join(over, "community").join(out.filter(F.col("level") == level + 1).select(F.col("community").alias("sub"), "report"), "sub")
            plain = rest.unionByName(told.select("community", F.lit(None).cast(plain.schema["node"].dataType).alias("node"), F.col("sub").cast("string").alias("_sub"), F.lit(1).alias("_told"), F.col("report").alias("_x"), F.lit(True).alias("over")))
        made = plain.groupBy("community").agg(in_order(F.struct("_told", "node", "_sub").alias("_o"), "_x", "\n").alias("_t")).select(F.lit(level).alias("level"), "community", report(F.col("_t")).alias("report"))
        made = G.settled(made, "reports")
        out = made if out is None else out.unionByName(made)
    return out


def extracted(chunks: DataFrame, ask: Callable[[Column], Column], again: Callable[[Column, Column], Column], rounds: int, more: Callable[[Column], Column] | None = None) -> DataFrame:
    """chunk, record of chunks (chunk, text): a first answer, then up to rounds further ones (again, of text and answers so far), while more (of the answers) says so."""
    now = chunks.withColumn("_all", ask(F.col("text"))).withColumn("_go", F.lit(True))
    for _ in range(rounds):
        go = F.col("_go") & (more(F.col("_all")) if more else F.lit(True))
        now = now.withColumn("_go", F.coalesce(go, F.lit(False)))
        now = now.withColumn("_all", F.when(F.col("_go"), F.concat_ws("##", "_all", again(F.col("text"), F.col("_all")))).otherwise(F.col("_all")))
    parts = now.select("chunk", F.explode(T.split_by_markers(F.col("_all"), ["##", "<|COMPLETE|>"])).alias("_r"))
    return parts.select("chunk", F.regexp_replace("_r", r"^\(|\)$", "").alias("record")).filter("record <> ''")


def graph_of_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merged nodes and edges of extracted records (chunk, record), with UNKNOWN nodes for ends that weren't extracted."""
    e = records.select(T.entity_record(F.col("record"), F.col("chunk")).alias("e")).filter("e IS NOT NULL").select("e.*")
    r = records.select(T.relation_record(F.col("record"), F.col("chunk")).alias("r")).filter("r IS NOT NULL").select("r.*")
    nodes = G.merge_nodes(e)
    edges = G.merge_edges(r.select(F.col("src_id").alias("src"), F.col("tgt_id").alias("tgt"), "weight", F.lit(1).alias("order"), "description", "source_id"))
    blank = G.missing_ends(nodes, edges).withColumns({"description": F.lit("UNKNOWN"), "source_id": F.lit("")})
    return nodes.unionByName(blank.select(*nodes.columns)), edges


@dataclass(frozen=True)
class TreeStore:
    """nodes (node, description, embedding, level, chunk), tree (node, parent; null at the root), communities (node, description) of a cluster tree."""

    nodes: DataFrame
    tree: DataFrame
    communities: DataFrame


def level_filter(mode: int) -> Column:
    """0: level 0 only; 1: levels above 0; 2: all."""
    return {0: F.col("level") == 0, 1: F.col("level") > 0, 2: F.lit(True)}[mode]


def tree_query(s: TreeStore, vector: list[float], k: int, mode: int, depth: int, chunks: int) -> DataFrame:
    """section, pos, text: the entities nearest by inner product, the nodes on their ways to their common ancestors, those nodes' descriptions, and the chunks most entities come from."""
    near = S.search(s.nodes, vector, k, key="node", metric="ip", where=level_filter(mode))
    hits = G.settled(near.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("score"), "node"))).select("node", "description", "chunk", "pos"), "hits")  # k rows
    chains = G.settled(G.ancestors(s.tree, hits.select("node"), depth), "chains")
    pairs = hits.select(F.col("node").alias("a")).join(F.broadcast(hits.select(F.col("node").alias("b"))), F.col("a") < F.col("b"))  # of k hits
    meet = G.common_ancestor(chains, pairs)
    ends = meet.select(F.col("a").alias("start"), F.col("node").alias("top")).unionByName(meet.select(F.col("b").alias("start"), F.col("node").alias("top"))).distinct()
    reach = chains.select("start", F.col("node").alias("top"), F.col("pos").alias("last")).join(ends, ["start", "top"]).groupBy("start").agg(F.max("last").alias("last"))
    path = G.settled(chains.join(F.broadcast(reach), "start").filter("pos <= last").select("node").distinct(), "path")
    told = path.join(s.communities, "node").select("node", "description")
    votes = G.chunk_votes(hits.select(F.col("pos"), "chunk"), chunks)
    number = lambda df, *order: df.withColumn("pos", F.row_number().over(Window.orderBy(*order)))  # noqa: E731  a few rows
    parts = [
        hits.select(F.lit("entities").alias("section"), "pos", F.concat_ws(": ", "node", "description").alias("text")),
        number(path, "node").select(F.lit("path").alias("section"), "pos", F.col("node").alias("text")),
        number(told, "node").select(F.lit("aggregation").alias("section"), "pos", F.concat_ws(": ", "node", "description").alias("text")),
        number(votes.withColumnRenamed("pos", "first"), (F.col("n") > 1).desc(), F.when(F.col("n") > 1, -F.col("n")).otherwise(0), "first", "chunk").select(F.lit("chunks").alias("section"), "pos", F.col("chunk").cast("string").alias("text")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def clustered(nodes: DataFrame, vector: str, dim: int, most: int, threshold: float | None = None, neighbours: int | None = None) -> DataFrame:
    """node, community: vectors brought to dim dimensions and clustered by the mixture of least BIC of up to most components; with threshold a node may be in several.

    With neighbours, the dimensions are those of a layout that keeps so many nearest neighbours together, else main directions.
    """
    if neighbours:
        placed = layout(nodes, vector, LayoutParams(dim=dim, neighbours=neighbours))
        features = placed.select("node", array_to_vector("features").alias("features"))
    else:
        features = M.reduced(nodes, vector, dim)
    model = M.mixture(features, "features", most)
    if model is None:
        return nodes.select("node", F.lit(0).alias("community"))
    if threshold is None:
        return M.hard_labels(model, features).select("node", "community")
    return M.soft_labels(model, features, threshold).select("node", F.explode("labels").alias("community"))


def cluster_tree(nodes: DataFrame, dim: int = 4, most: int = 50, layers: int = 5, least: int = 4) -> tuple[DataFrame, DataFrame]:
    """Rows (node, parent, level) of a tree over nodes (node, embedding), and all its nodes with embeddings and levels.

    Nodes of a level are clustered, a cluster becomes a node with its members' mean; when no more than least nodes are left,
    or layers are made, or clusters no longer get fewer, what is left gets the root.
    """
    now, level, links, made = nodes.select("node", F.transform("embedding", lambda x: x.cast("double")).alias("embedding")), 0, None, None
    size = now.select(F.max(F.size("embedding"))).first()[0] or 0
    mean = F.array(*[F.avg(F.get("embedding", F.lit(i))) for i in range(size)])
    n = now.count()
    while True:
        here = now.withColumn("level", F.lit(level))
        made = here if made is None else made.unionByName(here)
        if n <= least or level == layers:
            up, following = now.select("node", F.lit("root").alias("parent")), None
        else:
            members = G.settled(clustered(now, "embedding", min(dim, size), most).withColumn("parent", F.concat(F.lit(f"c{level + 1}-"), "community")), "members")
            up = members.select("node", "parent")
            following = G.settled(now.join(up, "node").groupBy("parent").agg(mean.alias("embedding")).withColumnRenamed("parent", "node"), "layer")
            count = following.count()
            if count >= n:
                up, following = now.select("node", F.lit("root").alias("parent")), None
            n = count
        rows = up.withColumn("level", F.lit(level))
        links = rows if links is None else links.unionByName(rows)
        if following is None:
            return links, made
        now, level = following, level + 1


def answered(questions: DataFrame, contexts: DataFrame, answer: Callable[[Column], Column]) -> DataFrame:
    """question_id, answer, error of questions (question_id, text) over contexts (question_id, context): a question without context is an error, not a failed job."""
    asked = questions.join(contexts, "question_id", "left")
    prompt = F.when(F.col("context").isNotNull(), F.concat_ws("\n", "context", "text"))
    return asked.select("question_id", F.when(prompt.isNotNull(), answer(prompt)).alias("answer"), F.when(prompt.isNull(), F.lit("no context")).alias("error"))


def per_document_summaries(hits: DataFrame, summary: Callable[[Column], Column]) -> DataFrame:
    """hits (type, caption, text, ...) with summary: an image's caption, a text's summary."""
    return hits.withColumn("summary", F.when(F.col("type") == "image", F.col("caption")).otherwise(summary(F.col("text"))))


def assigned(blocks: DataFrame, titles: DataFrame) -> DataFrame:
    """block_id, title_id: each block under the title that shares most of its words, of equals the first; blocks that share none under the first title of all."""
    words = lambda c: F.explode(F.array_distinct(T.tokens(F.lower(F.col(c))))).alias("w")
    shared = blocks.select("block_id", words("text")).join(F.broadcast(titles.select("title_id", words("title"))), "w").groupBy("block_id", "title_id").agg(F.count("*").alias("n"))
    best = shared.groupBy("block_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "title_id"))["title_id"].alias("title_id"))
    first = titles.agg(F.min("title_id").alias("_first"))  # one row
    return blocks.select("block_id").join(best, "block_id", "left").join(F.broadcast(first)).select("block_id", F.coalesce("title_id", "_first").alias("title_id"))
