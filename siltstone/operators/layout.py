"""Document layout: resolved references, page assembly, blocks of parsed pages, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve_references(body: DataFrame, items: DataFrame, groups: DataFrame) -> DataFrame:
    """doc, pos, sub, kind, idx, group, text for body references (doc, pos, kind, idx).

    A reference of kind 'groups' stands for the group's members (doc, group, sub, kind, idx), others for themselves; items
    (doc, kind, idx, text) that don't exist are left out.
    """
    own = body.filter("kind <> 'groups'").select("doc", "pos", F.lit(0).alias("sub"), "kind", "idx", F.lit(None).cast("long").alias("group"))
    inside = body.filter("kind = 'groups'").select("doc", "pos", F.col("idx").alias("group")).join(groups, ["doc", "group"])
    return own.unionByName(inside.select("doc", "pos", "sub", "kind", "idx", "group")).join(items, ["doc", "kind", "idx"])


def assemble_pages(blocks: DataFrame, order: list[str], text: str = "text") -> DataFrame:
    """doc, page, n, text: blocks of each page in order, one line each."""
    g = blocks.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_x")))).alias("_l"))
    return g.select("doc", "page", F.size("_l").alias("n"), F.array_join(F.transform("_l", lambda x: x["_x"]), "\n").alias("text"))


def page_blocks(pages: DataFrame) -> DataFrame:
    """doc, page (from 1), block_type, block_id, text of pages (doc, page_idx, paras, tables, images); empty text and images without a file are left out."""
    out = None
    for kind, column in (("text", "paras"), ("table", "tables"), ("image", "images")):
        one = pages.select("doc", (F.col("page_idx") + 1).alias("page"), F.lit(kind).alias("block_type"), F.posexplode(column).alias("block_id", "text"))
        out = one if out is None else out.unionByName(one)
    return out.filter("text IS NOT NULL AND trim(text) <> ''")


def markdown_table(grid: Column) -> Column:
    """array<array<string>> as a Markdown table: the first row is the head; an empty grid gives an empty text."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    head = F.get(grid, F.lit(0))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(head, lambda x: F.lit("---")), " | "), F.lit(" |"))
    body = F.transform(F.slice(grid, 2, F.greatest(F.size(grid) - 1, F.lit(0))), line)
    return F.when(F.size(grid) > 0, F.array_join(F.concat(F.array(line(head), rule), body), "\n")).otherwise("")


def strip_html(html: Column) -> Column:
    """Text of a page: scripts, styles, comments, navigation and tags removed, entities resolved, white space collapsed."""
    from siltstone.functions.text import unescape

    body = F.regexp_replace(html, r"(?is)<(script|style|nav|head)\b.*?</\1>|<!--.*?-->", " ")
    lines = F.regexp_replace(F.regexp_replace(body, r"(?i)<br\s*/?>|</p>|</h[1-6]>|</li>|</div>", "\n"), r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(unescape(lines), r"[ \t\r]+", " "), r" ?\n[ \n]*", "\n"))
