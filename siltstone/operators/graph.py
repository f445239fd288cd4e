"""Graph operators over node and edge DataFrames: merging, degrees, paths, components, communities, trees."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEP = "<SEP>"


def shared_root(spark: SparkSession) -> str:
    """The shared checkpoint folder. One on this machine serves where none is set, but only if all executors run here too."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="checkpoints-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


_owned: set[str] = set()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's own part of the shared folder, which is deleted when the driver ends."""
    own = f"{shared_root(spark)}/app-{spark.sparkContext.applicationId}"
    if own not in _owned:
        _owned.add(own)
        atexit.register(_delete, spark, own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    """Removes a folder, if the session is still there to do it."""
    if spark.sparkContext._jsc is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, so that loops don't grow their plans."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def joined_set(c: Column | str) -> Column:
    return F.array_join(F.array_sort(F.collect_set(c)), SEP)


def merge_nodes(records: DataFrame) -> DataFrame:
    """entity_name, entity_type (most frequent, of equals the smallest), description, source_id (distinct, sorted, joined)."""
    kinds = records.groupBy("entity_name", "entity_type").agg(F.count("*").alias("n"))
    best = kinds.groupBy("entity_name").agg(F.min(F.struct((-F.col("n")).alias("n"), "entity_type"))["entity_type"].alias("entity_type"))
    rest = records.groupBy("entity_name").agg(joined_set("description").alias("description"), joined_set("source_id").alias("source_id"))
    return best.join(rest, "entity_name")


def merge_edges(records: DataFrame) -> DataFrame:
    """src, tgt (ordered), weight (sum), order (least), description, source_id of all records of a pair; blank ends are left out."""
    ok = records.filter((F.col("src").cast("string") != " ") & (F.col("tgt").cast("string") != " ")).withColumns({"a": F.least("src", "tgt"), "b": F.greatest("src", "tgt")})
    agg = [F.sum("weight").alias("weight"), F.min("order").alias("order"), joined_set("description").alias("description"), joined_set("source_id").alias("source_id")]
    return ok.groupBy(F.col("a").alias("src"), F.col("b").alias("tgt")).agg(*agg)


def missing_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ends of edges that aren't nodes, as nodes of type UNKNOWN."""
    ends = edges.select(F.col("src").alias("entity_name")).unionByName(edges.select(F.col("tgt").alias("entity_name"))).distinct()
    return ends.join(nodes.select("entity_name"), "entity_name", "left_anti").withColumn("entity_type", F.lit("UNKNOWN"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Each undirected edge from either end."""
    rest = [c for c in edges.columns if c not in ("src", "tgt")]
    return edges.select("src", "tgt", *rest).unionByName(edges.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"), *rest))


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree; a loop counts twice."""
    return edges.select(F.explode(F.array("src", "tgt")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def edge_degrees(edges: DataFrame) -> DataFrame:
    d = degrees(edges)
    return edges.select("src", "tgt").join(d.select(F.col("node").alias("src"), F.col("degree").alias("_a")), "src").join(d.select(F.col("node").alias("tgt"), F.col("degree").alias("_b")), "tgt").select("src", "tgt", (F.col("_a") + F.col("_b")).alias("degree"))


def paths(edges: DataFrame, start: DataFrame, most: int, directed: bool = False) -> DataFrame:
    """start, node, hops, path (array of nodes) of all simple paths of 1 to most edges from start (column node)."""
    step = edges.select("src", "tgt") if directed else both_ways(edges.select("src", "tgt")).distinct()
    here = start.select(F.col("node").alias("start"), "node", F.array("node").alias("path"))
    out = None
    for hops in range(1, most + 1):
        here = here.join(step, F.col("node") == F.col("src")).filter(~F.array_contains("path", F.col("tgt")))
        here = here.select("start", F.col("tgt").alias("node"), F.concat("path", F.array("tgt")).alias("path"))
        found = here.select("start", "node", F.lit(hops).alias("hops"), "path")
        out = found if out is None else out.unionByName(found)
    return out


def shortest_paths(edges: DataFrame, start: DataFrame, most: int, directed: bool = False) -> DataFrame:
    """start, node, hops, path: one shortest path (the smallest by nodes) to every node within most edges.

    Breadth first: each round extends only the frontier by new nodes, so that paths aren't enumerated.
    """
    step = edges.select("src", "tgt") if directed else both_ways(edges.select("src", "tgt")).distinct()
    seen = start.select(F.col("node").alias("start"), "node", F.lit(0).alias("hops"), F.array("node").alias("path"))
    front = seen
    for hops in range(1, most + 1):
        nxt = front.join(step, F.col("node") == F.col("src")).select("start", F.col("tgt").alias("node"), F.concat("path", F.array("tgt")).alias("path"))
        nxt = nxt.groupBy("start", "node").agg(F.min("path").alias("path")).join(seen.select("start", "node"), ["start", "node"], "left_anti")
        front = settled(nxt.select("start", "node", F.lit(hops).alias("hops"), "path"), "frontier")
        seen = seen.unionByName(front)
    return seen.filter("hops > 0")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component: the smallest node reachable. Least labels spread to neighbours and jump to their labels' labels until nothing changes."""
    step = settled(both_ways(edges.select("src", "tgt")).filter("src <> tgt").distinct(), "edges")
    labels = settled(nodes.select("node", F.col("node").alias("component")), "labels")
    while True:
        near = step.join(labels.select(F.col("node").alias("tgt"), "component"), "tgt").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node", "left").select("node", F.least("component", F.coalesce("near", "component")).alias("component"), F.col("component").alias("old"))
        jump = lower.select(F.col("node").alias("component"), F.col("component").alias("next"))
        now = settled(lower.join(jump, "component", "left").select("node", F.least("component", F.coalesce("next", "component")).alias("component"), "old"), "labels")
        if now.filter("component <> old").isEmpty():
            return now.select("node", "component")
        labels = now.select("node", "component")


def largest_component(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes of the largest component, of equals that with the smallest node."""
    found = components(nodes, edges)
    best = found.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return found.join(F.broadcast(best.select("component")), "component").select("node")


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = 10) -> DataFrame:
    """node, community by weighted label propagation with fixed tie-breaks: the heaviest neighbouring label, of equals the smallest."""
    step = settled(both_ways(edges.select("src", "tgt", "weight")).filter("src <> tgt"), "edges")
    labels = settled(nodes.select("node", F.col("node").alias("community")), "labels")
    for i in range(rounds):
        votes = step.join(labels.select(F.col("node").alias("tgt"), "community"), "tgt").groupBy(F.col("src").alias("node"), "community").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("node").agg(F.min(F.struct((-F.col("w")).alias("w"), "community"))["community"].alias("new"))
        # Half of the nodes move in a round, else two could trade labels for ever.
        turn = F.pmod(F.xxhash64("node"), F.lit(2)) == i % 2
        now = settled(labels.join(best, "node", "left").select("node", F.when(turn, F.coalesce("new", "community")).otherwise(F.col("community")).alias("community"), F.col("community").alias("old")), "labels")
        labels = now.select("node", "community")
        if i > 1 and now.filter("community <> old").isEmpty():
            break
    return labels


def community_schema(members: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """level, community, nodes, edges, chunk_ids, occurrence from members (level, community, node), edges, chunks (node, chunk)."""
    inside = edges.select("src", "tgt").join(members.withColumnRenamed("node", "src"), "src").select("level", "community", F.concat_ws("-", F.least("src", "tgt").cast("string"), F.greatest("src", "tgt").cast("string")).alias("edge"))
    e = inside.groupBy("level", "community").agg(F.array_sort(F.collect_set("edge")).alias("edges"))
    n = members.join(chunks, "node", "left").groupBy("level", "community").agg(F.array_sort(F.collect_set("node")).alias("nodes"), F.array_sort(F.collect_set("chunk")).alias("chunk_ids"))
    out = n.join(e, ["level", "community"], "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<string>")))
    most = out.agg(F.max(F.size("chunk_ids")).alias("_most"))
    return out.join(F.broadcast(most)).withColumn("occurrence", F.size("chunk_ids") / F.col("_most")).drop("_most")


def sub_communities(schema: DataFrame) -> DataFrame:
    """level, community, sub: communities one level down whose nodes all lie in it. Joined through nodes, not by comparing all pairs."""
    up = schema.select("level", "community", F.explode("nodes").alias("node"))
    down = schema.select((F.col("level") - 1).alias("level"), F.col("community").alias("sub"), F.size("nodes").alias("n"), F.explode("nodes").alias("node"))
    return down.join(up, ["level", "node"]).groupBy("level", "community", "sub", "n").agg(F.count("*").alias("m")).filter("m = n").select("level", "community", "sub")


def ancestors(tree: DataFrame, start: DataFrame, most: int) -> DataFrame:
    """start, pos, node: the chain from each start node (column node) up to its root. tree: node, parent (null at the root)."""
    here = start.select(F.col("node").alias("start"), F.lit(0).alias("pos"), "node")
    out = here
    up = tree.filter("parent IS NOT NULL").select("node", "parent")
    for pos in range(1, most + 1):
        here = here.join(up, "node").select("start", F.lit(pos).alias("pos"), F.col("parent").alias("node"))
        out = out.unionByName(here)
    return out


def common_ancestor(chains: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, node: the lowest node on both chains of each pair."""
    left = pairs.join(chains.select(F.col("start").alias("a"), F.col("pos").alias("pa"), "node"), "a")
    both = left.join(chains.select(F.col("start").alias("b"), F.col("pos").alias("pb"), "node"), ["b", "node"])
    return both.groupBy("a", "b").agg(F.min(F.struct(F.col("pa") + F.col("pb"), "node"))["node"].alias("node"))


def orphans(tree: DataFrame) -> DataFrame:
    """Nodes whose parent isn't in the tree."""
    return tree.filter("parent IS NOT NULL").join(tree.select(F.col("node").alias("parent")), "parent", "left_anti").select("node", "parent")


def chunk_votes(hits: DataFrame, k: int) -> DataFrame:
    """chunk, n, pos: k chunks of hits (pos, chunk): those met more than once by count, then others as first met."""
    g = hits.groupBy("chunk").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    return g.orderBy((F.col("n") > 1).cast("int").desc(), F.when(F.col("n") > 1, F.col("n")).otherwise(0).desc(), "pos", "chunk").limit(k)


def sparsity(members: DataFrame) -> DataFrame:
    """One row: 1 - sum of x * (x - 1) over n * (n - 1), for cluster sizes x of n members."""
    sizes = members.groupBy("community").agg(F.count("*").alias("x"))
    return sizes.agg((1 - F.sum(F.col("x") * (F.col("x") - 1)) / (F.sum("x") * (F.sum("x") - 1))).alias("sparsity"))


def walks(edges: DataFrame, starts: DataFrame, length: int, per_node: int, seed: int = 42) -> DataFrame:
    """walk (array of nodes): per_node walks of at most length nodes from each start, by hashed choices that don't change between runs."""
    near = both_ways(edges.select("src", "tgt")).distinct().groupBy("src").agg(F.array_sort(F.collect_list("tgt")).alias("near"))
    here = starts.select("node", F.explode(F.sequence(F.lit(1), F.lit(per_node))).alias("n")).select(F.array("node").alias("walk"), "n")
    for i in range(1, length):
        last = F.element_at("walk", -1)
        pick = F.pmod(F.xxhash64("walk", "n", F.lit(seed + i)), F.size("near")).cast("int")
        here = here.join(near, last == F.col("src"), "left").select(F.when(F.col("near").isNotNull(), F.concat("walk", F.array(F.get("near", pick)))).otherwise(F.col("walk")).alias("walk"), "n")
    return here.select("walk")
