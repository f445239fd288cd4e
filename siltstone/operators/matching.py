"""Dictionary matches, keyword graph search, and answers over named subjects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph as G
from .graph import settled

#: A word's characters, marks that belong to a letter included.
WORD = r"\p{L}\p{N}\p{M}_"


def pieces(text: Column) -> Column:
    """Words, and all other characters but white space one by one."""
    return F.regexp_extract_all(text, F.lit(rf"[{WORD}]+|[^{WORD}\s]"), F.lit(0))


def occurrences(text: Column, entry: Column) -> Column:
    """How often entry stands in text on word boundaries; occurrences may overlap."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(entry, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.regexp_count(text, F.concat(F.lit(rf"(?<![{WORD}])(?="), quoted, F.lit(rf"(?![{WORD}]))")))


def match_dictionary(docs: DataFrame, key: str, text: str, entries: DataFrame, entry: str) -> DataFrame:
    """key, entry, n: how often each entry stands in each row's text on word boundaries, case aside.

    An entry is looked for only in texts that hold its rarest piece; both tables are joined by that piece, so neither has to fit
    anywhere, and a frequent piece matters only to entries that have no rarer one. The join gives pairs of a text's number and
    an entry; the text itself moves once, to its entries.
    """
    names = settled(entries.select(F.lower(F.trim(entry)).alias("entry")).filter("entry <> ''").distinct(), "entries")
    rows = settled(docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), F.lower(F.col(text)).alias("_low")), "texts")
    parts = names.select("entry", F.explode(F.array_distinct(pieces(F.col("entry")))).alias("piece"))
    wanted = settled(parts.select("piece").distinct(), "pieces")
    # Texts are cut once, and only pieces of some entry are kept.
    has = settled(rows.select("_row", F.explode(F.array_distinct(pieces(F.col("_low")))).alias("piece")).join(wanted, "piece", "left_semi"), "held")
    often = has.groupBy("piece").agg(F.count("*").alias("df"))
    # An entry with a piece that no text has can't stand anywhere.
    rarest = parts.join(often, "piece", "left").groupBy("entry").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "piece")).alias("r")).select("entry", "r.piece")
    held = has.join(rarest, "piece").groupBy("_row").agg(F.collect_list("entry").alias("_entries"))
    found = rows.join(held, "_row").select("_key", F.explode(F.transform("_entries", lambda e: F.struct(e.alias("entry"), occurrences(F.col("_low"), e).alias("n")))).alias("m"))
    return found.select(F.col("_key").alias(key), "m.entry", F.col("m.n").cast("long").alias("n")).filter("n > 0")


def keyword_graph_search(edges: DataFrame, nodes: DataFrame, question: str, k: int, hops: int = 4) -> DataFrame:
    """src, tgt, score: relations for the nodes (node, name) that the question names.

    One name: its edges, 20 points each. Several: on the shortest path between each pair of names, 15 points an edge and 5 more
    for the first and last.
    """
    words = [w.lower() for w in question.split()]
    named = nodes.filter(F.lower("name").isin(words)).select("node")
    names = [r.node for r in named.orderBy("node").limit(len(words)).collect()]
    if len(names) < 2:
        near = G.both_ways(edges.select("src", "tgt")).filter(F.col("src").isin(names)) if names else edges.select("src", "tgt").filter("false")
        return near.select(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt"), F.lit(20).alias("score")).orderBy("src", "tgt").limit(k)
    paths = G.shortest_paths(edges, named, hops).join(named, "node", "left_semi").filter("start < node")
    steps = paths.select(F.posexplode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.element_at("path", i).alias("a"), F.element_at("path", i + 1).alias("b")))).alias("i", "e"), F.size("path").alias("n"))
    points = 15 + F.when(F.col("i") == 0, 5).otherwise(0) + F.when(F.col("i") == F.col("n") - 2, 5).otherwise(0)
    scored = steps.select(F.least("e.a", "e.b").alias("src"), F.greatest("e.a", "e.b").alias("tgt"), points.alias("score"))
    return scored.groupBy("src", "tgt").agg(F.sum("score").alias("score")).orderBy(F.desc("score"), "src", "tgt").limit(k)


def path_through(edges: DataFrame, required: list, hops: int = 5) -> list:
    """Nodes of shortest paths from each required node to the next, put together; a node that can't be reached is just added.

    required has a few nodes; only their paths come to the driver.
    """
    if not required:
        return []
    spark, kind = edges.sparkSession, edges.schema["src"].dataType.simpleString()
    found = G.shortest_paths(edges, spark.createDataFrame([(x,) for x in dict.fromkeys(required)], f"node {kind}"), hops)
    between = {(r.start, r.node): r.path for r in found.filter(F.col("node").isin(required)).collect()}
    out = [required[0]]
    for a, b in zip(required, required[1:]):
        out += between[(a, b)][1:] if (a, b) in between else [b]
    return out


def conditional(condition: Column, yes: Column, no: Column) -> Column:
    return F.when(condition, yes).otherwise(no)
