"""Sources and sinks: each query writes files from the tables, reads them back by its operator, and returns what it read."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import graph as G
from siltstone.operators import search as S
from siltstone.sources import io as IO

from .catalog import query, table


def _path(spark, name: str) -> str:
    """A new place for a file called name in the shared folder."""
    return f"{G.shared_path(spark, 'files')}/{name}"


def _written(df, name: str, **how) -> str:
    path = _path(df.sparkSession, name)
    IO.write(df, path, **how)
    return path


def _one_document(df, name: str) -> str:
    """All rows as one JSON array in one file; for small tables."""
    path = _path(df.sparkSession, name)
    df.agg(F.to_json(F.collect_list(F.struct(*df.columns)), {"pretty": "true"}).alias("value")).coalesce(1).write.text(path)
    return path


@query("SELECT unnest(['csv', 'json', 'jsonl', 'parquet']) AS kind, count(*) AS n, CAST(sum(s_suppkey * 3 + s_nationkey) AS BIGINT) AS total FROM supplier")
def s01_read_by_extension(spark, d):
    sup, out = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), None
    for kind in ("csv", "json", "jsonl", "parquet"):
        path = _written(sup, f"supplier.{kind}") if kind != "json" else _one_document(sup, "supplier.json")
        rows = IO.read(spark, path, sup.schema)
        one = rows.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.sum(F.col("s_suppkey") * 3 + F.col("s_nationkey")).alias("total"))
        out = one if out is None else out.unionByName(one)
    return out.select("kind", "n", "total")


@query("SELECT n_name, CASE WHEN n_regionkey = 1 THEN 2 ELSE 1 END AS n FROM nation")
def s02_write_and_append(spark, d):
    n = table(spark, d, "nation").select("n_name", "n_regionkey")
    path = _written(n.filter("n_regionkey = 2"), "nation.csv")
    IO.write(n, path)  # overwrites
    IO.write(n.filter("n_regionkey = 1"), path, "append")
    return IO.read(spark, path).groupBy("n_name").agg(F.count("*").cast("int").alias("n"))


@query("SELECT md5(line) AS line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1")
def s03_text_lines(spark, d):
    path = _written(table(spark, d, "documents").select("text"), "documents.txt")
    return IO.read(spark, path).groupBy(F.md5("value").alias("line")).agg(F.count("*").alias("n"))


@query("SELECT page_id, md5(html) AS html, url FROM pages")
def s04_csv(spark, d):
    """Quotes, commas and line breaks in values come back as they were."""
    pages = table(spark, d, "pages").select("page_id", "html", "url")
    return IO.read(spark, _written(pages, "pages.csv"), pages.schema).select("page_id", F.md5("html").alias("html"), "url")


@query("SELECT r_regionkey, r_name, n_nationkey, n_name FROM region JOIN nation ON n_regionkey = r_regionkey")
def s05_json_documents(spark, d):
    """One JSON document a file, over several lines."""
    n = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.collect_list(F.struct("n_nationkey", "n_name")).alias("nations"))
    docs = table(spark, d, "region").join(n, "r_regionkey").select("r_regionkey", F.to_json(F.struct("r_regionkey", "r_name", "nations"), {"pretty": "true"}).alias("value"))
    path = _path(spark, "regions.json")
    docs.write.partitionBy("r_regionkey").text(path)  # a document each
    rows = IO.read(spark, path, "r_regionkey int, r_name string, nations array<struct<n_nationkey: int, n_name: string>>")
    return rows.select("r_regionkey", "r_name", F.explode("nations").alias("n")).select("r_regionkey", "r_name", "n.*")


@query("SELECT lang, CAST(sum(length(text) + 1) AS BIGINT) AS n_chars, count(*) AS n_docs FROM documents GROUP BY 1")
def s08_markdown_whole_files(spark, d):
    """Whole files, one row each, in folders by language."""
    path = _path(spark, "notes.md")
    table(spark, d, "documents").select("lang", F.concat(F.lit("\x01"), "text").alias("value")).write.partitionBy("lang").text(path)
    files = IO.read(spark, path)
    return files.groupBy("lang").agg((F.sum(F.length("value")) - F.sum(F.size(F.split("value", "\x01")) - 1)).alias("n_chars"), F.sum(F.size(F.split("value", "\x01")) - 1).cast("long").alias("n_docs"))


@query("SELECT conv_id, turn, role, md5(text) AS text FROM conversations")
def s09_jsonl(spark, d):
    c = table(spark, d, "conversations")
    return IO.read(spark, _written(c, "conversations.jsonl"), c.schema).select("conv_id", "turn", "role", F.md5("text").alias("text"))


@query("SELECT c_custkey, c_name FROM customer UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3")
def s10_jsonl_append(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    path = _written(c, "customer.jsonl")
    IO.write(c.filter("c_nationkey = 3"), path, "append")
    return IO.read(spark, path, c.schema).select("c_custkey", "c_name")


@query("SELECT unnest(['csv', 'jsonl', 'parquet', 'txt']) AS kind, count(*) AS n, CAST(sum(length(p_name)) AS BIGINT) AS chars FROM part")
def s11_sinks(spark, d):
    p, out = table(spark, d, "part").select("p_name"), None
    for kind in ("csv", "jsonl", "parquet", "txt"):
        rows = IO.read(spark, _written(p, f"part.{kind}")).toDF("x")
        one = rows.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.sum(F.length("x")).alias("chars"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT n_name AS line FROM nation UNION ALL SELECT r_name FROM region")
def s12_line_list(spark, d):
    path = _written(table(spark, d, "nation").select("n_name"), "names.txt")
    IO.write(table(spark, d, "region").select("r_name"), path, "append")
    return IO.read(spark, path).select(F.col("value").alias("line"))


@query("SELECT doc_id, n_chars, lang FROM documents WHERE n_chars >= 200")
def s13_block_scan(spark, d):
    """A folder of block files, of which some have a column more."""
    docs, path = table(spark, d, "documents").select("doc_id", "n_chars", "lang", "source"), _path(spark, "blocks")
    IO.write(docs.filter("source < 'src5'").drop("source"), f"{path}/a.parquet")
    IO.write(docs.filter("NOT source < 'src5'"), f"{path}/b.parquet")
    return IO.read_blocks(spark, path).filter("n_chars >= 200").select("doc_id", "n_chars", "lang")


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS segment, CAST(NULL AS VARCHAR) AS extra FROM customer UNION ALL SELECT s_suppkey, NULL, s_name FROM supplier")
def s14_union_of_keys(spark, d):
    """Records with different keys, as CSV of all keys' columns, loaded in bulk."""
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.col("c_mktsegment")).alias("segment"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("extra"))
    path = _written(IO.united([c, s]), "records.csv")
    return IO.read(spark, path, "c_custkey long, extra string, segment string").select("c_custkey", "segment", "extra")


@query("SELECT vec_id, '[' || label || ',' || (label + 1) || ']' AS list, '{\"a\":' || label || '}' AS record, CASE WHEN label = 3 THEN NULL ELSE 'x' || label END AS word FROM embeddings")
def s15_plain_values(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.array("label", F.col("label") + 1).alias("list"), F.struct(F.col("label").alias("a")).alias("record"), F.when(F.col("label") == 3, "").otherwise(F.concat(F.lit("x"), "label")).alias("word"))
    return IO.flatten_values(e)


@query("SELECT term, count(DISTINCT doc_id) AS df, count(*) AS total FROM (SELECT doc_id, unnest(string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS term FROM documents) WHERE term IN ('of', 'and', 'haing') GROUP BY 1")
def s16_index_load(spark, d):
    """An inverted index written to files; postings of a few terms read from it."""
    path = _path(spark, "text-index")
    S.build_index(table(spark, d, "documents"), "doc_id", "text", path)
    index = S.open_index(spark, "doc_id", path)
    return index.postings.filter(F.col("term").isin("of", "and", "haing")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))


@query("SELECT true AS there, true AS deleted, false AS left_over, CAST(sum(len(string_split(r_name, ' '))) AS BIGINT) AS n FROM region")
def s17_index_delete(spark, d):
    path, r = _path(spark, "region-index"), table(spark, d, "region")
    S.build_index(r, "r_regionkey", "r_name", path)
    index = S.open_index(spark, "r_regionkey", path)
    n = index.postings.count()
    deleted = S.delete_path(spark, path)
    left = S.open_index(spark, "r_regionkey", path)
    return spark.range(1).select(F.lit(index is not None).alias("there"), F.lit(bool(deleted)).alias("deleted"), F.lit(left is not None).alias("left_over"), F.lit(n).cast("long").alias("n"))


_NEAR = "SELECT e.vec_id, e.label FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 5) q WHERE {} ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id LIMIT 12"


def _collection(spark, d):
    e = table(spark, d, "embeddings")
    return e, e.filter("vec_id = 5").select("embedding").first()[0], IO.VectorTable(spark, _path(spark, "vectors"), 64)


@query(_NEAR.format("true"))
def s18_vector_collection(spark, d):
    e, q, c = _collection(spark, d)
    c.insert(e)
    return c.search(q, 12).select("vec_id", "label")


@query(_NEAR.format("e.vec_id % 3 <> 0 AND e.label < 8"))
def s19_batched_insert(spark, d):
    """Rows inserted in batches, some of them twice, searched under a condition."""
    e, q, c = _collection(spark, d)
    for part in ("vec_id % 3 = 1", "vec_id % 3 = 2", "vec_id % 3 = 1 AND label = 2"):
        c.insert(e.filter(part))
    return c.search(q, 12, "label < 8").select("vec_id", "label")


@query(_NEAR.format("e.label < 5"))
def s20_delete_rows(spark, d):
    e, q, c = _collection(spark, d)
    c.insert(e)
    c.delete("label >= 5")
    return c.search(q, 12).select("vec_id", "label")


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def s21_create_tables(spark, d):
    """A table of the catalog, created if absent and loaded in two inserts."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    name = f"nation_{G.shared_path(spark, 'x')[-32:]}"  # the path's uuid
    path = _path(spark, name)
    for _ in range(2):
        IO.create_table(spark, name, "n_nationkey int, n_name string, n_regionkey int", path)
    for part in ("n_regionkey < 2", "n_regionkey >= 2"):
        n.filter(part).write.insertInto(name)
    out = G.settled(spark.table(name).groupBy("n_regionkey").agg(F.count("*").alias("n")), "counted")
    IO.drop_table(spark, name)
    return out


@query("SELECT 25 AS before, 0 AS emptied, 3 AS again, false AS there FROM region WHERE r_regionkey = 0")
def s22_delete_and_drop(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    name = f"nation_{G.shared_path(spark, 'x')[-32:]}"  # the path's uuid
    IO.create_table(spark, name, "n_nationkey int, n_name string", _path(spark, name))
    counts = []
    for part in ("true", None, "n_nationkey < 3"):
        if part is None:
            IO.delete_all(spark, name)
        else:
            n.filter(part).write.insertInto(name)
        spark.catalog.refreshTable(name)
        counts.append(spark.table(name).count())
    IO.drop_table(spark, name)
    return spark.range(1).select(*[F.lit(x).alias(c) for x, c in zip(counts, ("before", "emptied", "again"))], F.lit(spark.catalog.tableExists(name)).alias("there"))


_GRAPH = "SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS tgt, CASE WHEN s_nationkey % 3 = 0 THEN '' ELSE 'in' END AS type, s_suppkey % 4 AS chunk FROM supplier"


@query(f"WITH g AS ({_GRAPH}), f AS (SELECT src, tgt, type, CAST(chunk AS VARCHAR) AS chunk_id FROM g WHERE type <> '' AND chunk <> 0) SELECT src, tgt, type, chunk_id, (SELECT count(DISTINCT x) FROM (SELECT src AS x FROM f UNION ALL SELECT tgt FROM f)) AS n_nodes FROM f")
def s23_graph_csv(spark, d):
    s = table(spark, d, "supplier")
    rows = s.select(F.concat(F.lit("s"), "s_suppkey").alias("head"), F.concat(F.lit("n"), "s_nationkey").alias("tail"), F.when(F.col("s_nationkey") % 3 == 0, "").otherwise("in").alias("type"), F.lit("x, y").alias("unused"), F.when(F.col("s_suppkey") % 4 > 0, (F.col("s_suppkey") % 4).cast("string")).alias("chunk"))
    path = _path(spark, "graph.csv")
    rows.write.csv(path, header=True, escape='"')
    nodes, edges = IO.read_graph_csv(spark, path)
    return edges.crossJoin(F.broadcast(nodes.agg(F.count("*").alias("n_nodes"))))


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey < 4")
def s24_delete_all_and_reload(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    graph = IO.KeyedTable(spark, _path(spark, "nodes"))
    graph.upsert(s)
    graph.clear()
    graph.upsert(s.filter("id < 4"))
    return graph.load()


@query("SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)) DESC, vec_id) AS r FROM embeddings) WHERE r <= 2")
def s26_document_indexes(spark, d):
    """Vectors by document; a second run adds only documents that aren't there."""
    e = table(spark, d, "embeddings")
    store = IO.KeyedTable(spark, _path(spark, "document-vectors"), "vec_id")
    for part in (e.filter("label < 6"), e):
        store.upsert(store.missing(part))
    q = e.filter("vec_id = 7").select("embedding").first()[0]
    from siltstone.functions import vectors as V

    scored = store.load().withColumn("score", V.dot(F.col("embedding"), F.array(*[F.lit(float(x)) for x in q])))
    return S.first_n(scored, ["label"], [F.desc("score"), "vec_id"], 2).select("label", "vec_id")


@query("SELECT conv_id AS id, arg_max(md5(text), (turn, md5(text))) AS value FROM conversations WHERE NOT conv_id IN (SELECT conv_id FROM conversations WHERE conv_id % 11 = 0) GROUP BY 1")
def s32_key_value(spark, d):
    """A key-value store written turn by turn; the last write of a key wins, and some keys are deleted."""
    c = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("id"), "turn").agg(F.max(F.md5("text")).alias("value"))
    store, last = IO.KeyedTable(spark, _path(spark, "pairs")), table(spark, d, "conversations").agg(F.max("turn")).first()[0]
    c = G.settled(c, "turns")
    for turn in range(min(last, 3) + 1):
        store.upsert(c.filter(F.col("turn") == turn).select("id", "value") if turn < 3 else G.settled(c.filter("turn >= 3").groupBy("id").agg(F.max_by("value", "turn").alias("value")), "rest"))
    store.delete("id % 11 = 0")
    return store.load()


@query("SELECT s_suppkey AS src, s_nationkey + 1000000 AS tgt, s_name AS name FROM supplier")
def s33_graph_saved_and_loaded(spark, d):
    s, path = table(spark, d, "supplier"), _path(spark, "graph")
    IO.write(s.select(F.col("s_suppkey").alias("node"), F.col("s_name").alias("name")), f"{path}/nodes.parquet")
    IO.write(s.select(F.col("s_suppkey").alias("src"), (F.col("s_nationkey") + 1000000).alias("tgt")), f"{path}/edges.parquet")
    nodes, edges = (IO.read(spark, f"{path}/{x}.parquet") for x in ("nodes", "edges"))
    return edges.join(nodes, edges.src == nodes.node).select("src", "tgt", "name")


@query(_NEAR.format("e.vec_id < 400"))
def s34_index_persisted(spark, d):
    """A collection opened anew finds what was stored."""
    e, q, c = _collection(spark, d)
    c.insert_missing(e.filter("vec_id < 300"))
    c.insert_missing(e.filter("vec_id < 400"))
    return IO.VectorTable(spark, c.table.path, 64).search(q, 12).select("vec_id", "label")


@query("SELECT source || '_final' AS stem, count(*) AS n FROM documents WHERE source IN ('src1', 'src2') GROUP BY 1")
def s37_skip_stems(spark, d):
    docs, path = table(spark, d, "documents"), _path(spark, "submissions")
    for source, ending in (("src1", "final"), ("src2", "final"), ("src2", "debug"), ("src3", "debug")):
        IO.write(docs.filter(F.col("source") == source).select("doc_id"), f"{path}/{source}_{ending}.jsonl")
    rows = spark.read.schema("doc_id long").json(f"{path}/*.jsonl")
    return IO.skip_stems(rows, "_debug").groupBy("stem").agg(F.count("*").alias("n"))


@query("SELECT source AS doc_name, doc_id FROM documents WHERE source IN ('src1', 'src4')")
def s40_file_stem(spark, d):
    docs, path = table(spark, d, "documents"), _path(spark, "merged")
    for source in ("src1", "src4"):
        IO.write(docs.filter(F.col("source") == source).select("doc_id"), f"{path}/{source}.jsonl")
    return IO.with_file_name(spark.read.schema("doc_id long").json(f"{path}/*.jsonl")).select("doc_name", "doc_id")


@query("SELECT 2 AS n, 1 AS small, 407 AS bytes FROM region WHERE r_regionkey = 0")
def s41_file_statistics(spark, d):
    """PDF files below a folder; nothing is deleted."""
    path = _path(spark, "pdf")
    for name, body in (("a.pdf", b"1234567"), ("b/c.pdf", b"1234" * 100), ("e.txt", b"no")):
        IO.put_file(spark, f"{path}/{name}", body)
    return IO.file_statistics(IO.find_files(spark, path)).select(F.col("n").cast("int").alias("n"), F.col("small").cast("int").alias("small"), F.round(F.col("gb") * 1e9).cast("int").alias("bytes"))


@query("SELECT 'a.pdf' AS name FROM region WHERE r_regionkey = 0 UNION ALL SELECT 'B.PDF' FROM region WHERE r_regionkey = 0")
def s36_pdf_list(spark, d):
    return spark.createDataFrame([(x,) for x in IO.pdf_paths(["x/a.pdf", "x/B.PDF", "x/c.txt", "x/pdf"])], "path string").select(F.regexp_extract("path", "[^/]+$", 0).alias("name"))


@query("SELECT DISTINCT source AS doc_name, md5(text) AS hash_code, length(text) AS n FROM documents WHERE source IN ('src1', 'src2', 'src3')")
def s47_corpus(spark, d):
    """A folder of JSONL corpora, a file each, and the text of each hash code."""
    docs, path = table(spark, d, "documents"), _path(spark, "corpus")
    for source in ("src1", "src2", "src3"):
        IO.write(docs.filter(F.col("source") == source).select(F.md5("text").alias("hash_code"), "text"), f"{path}/{source}.jsonl")
    corpus = IO.corpus_of(spark, path)
    return corpus.select("doc_name", "hash_code").distinct().join(IO.chunk_texts(corpus), "hash_code").select("doc_name", "hash_code", F.length("text").alias("n"))


@query("SELECT n_name AS name, 'PERSON' AS entity_type, 'd' || n_regionkey AS source_id, 1 AS n FROM nation UNION ALL SELECT r_name, 'PERSON', 'd' || r_regionkey, count(*) FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL")
def s48_triple_records(spark, d):
    both = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lines = both.select(F.concat(F.lit("<"), "n_name", F.lit(">\t<in>\t<"), "r_name", F.lit(">")).alias("triple"), F.concat(F.lit("d"), "n_regionkey").alias("source_id"))
    lines = IO.read(spark, _written(lines, "triples.jsonl"), lines.schema)
    entities, relations = IO.triple_records(lines)
    ends = relations.select(F.explode(F.array("src", "tgt")).alias("entity_name")).groupBy("entity_name").agg(F.count("*").alias("n"))
    return entities.join(ends, "entity_name").select(F.col("entity_name").alias("name"), "entity_type", "source_id", "n")


@query("SELECT r_name AS title, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def s45_reports_saved(spark, d):
    """Payloads appended one call after the other, and Markdown reports, each a file."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    path = _path(spark, "payloads.jsonl")
    for part in ("n_nationkey % 2 = 0", "n_nationkey % 2 = 1"):
        IO.write(n.filter(part).select("r_name", "n_name"), path, "append")
    text = IO.read(spark, path, "r_name string, n_name string").groupBy("r_name").agg(F.concat(F.lit("# "), "r_name", F.lit("\n"), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("* "), "n_name"))), "\n")).alias("value"))
    report = _path(spark, "report.md")
    text.write.partitionBy("r_name").text(report)
    files = IO.read(spark, report)
    return files.select(F.regexp_extract("value", "^# ([^\n]*)", 1).alias("title"), F.size(F.regexp_extract_all("value", F.lit("(?m)^\\* "), F.lit(0))).cast("long").alias("n"))
