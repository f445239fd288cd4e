"""Collections, indexes, chunkers and community levels on toy inputs."""

from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import parsing
from siltstone.functions import text as T
from siltstone.operators import chunks, graph, search
from siltstone.operators import knowledge as K
from siltstone.sources import io


def test_every_query_row_is_a_query(spark, monkeypatch):
    """Repeated and null ids, over several blocks of queries and vectors."""
    rng = np.random.default_rng(3)
    vectors = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(50)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(3)
    queries = [(1, vectors[3][1]), (2, vectors[4][1]), (2, vectors[5][1]), (3, vectors[6][1]), (None, vectors[7][1]), (None, vectors[8][1]), (4, None)]
    q = spark.createDataFrame(queries, "query_id long, embedding array<float>")

    def plain(x, k):
        size = lambda v: float(np.sqrt(sum(c * c for c in v)))
        score = lambda v: round(float(np.dot(x, v)) / (size(x) * size(v)), 10) + 0.0 if size(x) and size(v) else 0.0
        return sorted(((-score(v), i) for i, v in vectors))[:k]

    want = Counter((d, i, n + 1) for d, x in queries if x is not None for n, (_, i) in enumerate(plain(x, 4)))
    for block, rows in ((2, 7), (4096, 1024)):
        monkeypatch.setattr(search, "QUERY_BLOCK", block)
        monkeypatch.setattr(search, "ROW_BLOCK", rows)
        got = search.batched_search(q, df, 4).collect()
        assert Counter((r.query_id, r.vec_id, r["rank"]) for r in got) == want


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6), st.integers(1, 9), st.integers(0, 40))
def test_best_keeps_the_k_best_with_ties(k, lines, seed):
    rng = np.random.default_rng(seed)
    held = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
    score, ids = rng.integers(0, 4, (lines, 30)).astype(float), rng.permutation(30)
    for i in range(0, 30, 7):
        held = search._best(score[:, i : i + 7], ids[i : i + 7], held, k)
    want = [(x, -s, i) for x in range(lines) for s, i in sorted(zip(-score[x], ids))[:k]]
    assert list(zip(*(v.tolist() for v in held))) == want


def test_index_is_built_once_and_anew_for_other_files(spark, tmp_path):
    path = f"file://{tmp_path}/docs.parquet"
    spark.createDataFrame([(1, "a b a"), (2, ""), (3, None), (4, "b c")], "doc_id long, text string").write.parquet(path)
    one, two = (search.index_of(spark.read.parquet(path)) for _ in range(2))
    assert one.postings.inputFiles() == two.postings.inputFiles()
    assert sorted(map(tuple, one.postings.select("doc_id", "term", "tf", "length").collect())) == [(1, "a", 2, 3), (1, "b", 1, 3), (4, "b", 1, 2), (4, "c", 1, 2)]
    assert [r.doc_id for r in search.bm25(one, ["a"], 5).collect()] == [1]
    spark.createDataFrame([(9, "a")], "doc_id long, text string").write.mode("append").parquet(path)
    assert search.index_of(spark.read.parquet(path)).stats.first().n == 5


def test_keyed_table_merges_its_segments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(io.KeyedTable, "SEGMENTS", 3)
    table = io.KeyedTable(spark, f"file://{tmp_path}/t")
    assert table.load() is None and not table.drop()
    for i in range(6):
        table.upsert(spark.createDataFrame([(1, i), (10 + i, i)], "id int, v int"))
    assert sorted(map(tuple, table.load().collect())) == [(1, 5), *((10 + i, i) for i in range(6))]
    assert table._version() > 1
    assert [r.id for r in table.missing(spark.createDataFrame([(1,), (99,)], "id int")).collect()] == [99]
    table.delete("v < 5")
    table.delete("v IS NULL")
    assert sorted(map(tuple, table.load().collect())) == [(1, 5), (15, 5)]
    table.clear()
    assert table.load().count() == 0 and table.drop() and table.load() is None


def test_collection_refuses_vectors_of_another_size(spark, tmp_path):
    c = io.VectorTable(spark, f"file://{tmp_path}/c", 2)
    c.insert(spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<float>"))
    for bad in ([1.0], None):
        with pytest.raises(ValueError):
            c.insert(spark.createDataFrame([(2, bad)], "vec_id long, embedding array<float>"))
    c.insert_missing(spark.createDataFrame([(1, [0.0, 9.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>"))
    assert [r.vec_id for r in c.search([1.0, 0.1], 2).collect()] == [1, 3]


def test_chunks_end_after_separators():
    words = lambda s: s.split()
    cut = lambda s, size, overlap: [" ".join(c) for c in chunks.separator_chunks(words(s), [["."], ["!", "!"]], size, overlap)]
    assert cut("a b . c d ! ! e f g . h", 4, 0) == ["a b .", "c d ! !", "e f g .", "h"]
    assert cut("a b . c d ! ! e f g . h", 7, 0) == ["a b . c d ! !", "e f g . h"]
    assert cut("a b . c d ! ! e f g . h", 7, 2) == ["a b . c d ! !", "! ! e f g . h"]
    assert cut("a b . c d e f", 3, 2) == ["a b .", "b . c"]
    assert cut("a b c d e f g", 3, 1) == ["a b c", "c d e", "e f g"]
    assert cut("", 3, 1) == [] and cut("a", 3, 1) == ["a"]


def test_lenient_pairs():
    f = parsing.lenient_object
    assert f('{"a": 1, b: "x, y", "c": tRue, d: null, "e": 2.5, f: word}') == {"a": 1, "b": "x, y", "c": True, "d": None, "e": 2.5, "f": "word"}
    assert f('so: {"a": {"b": 1}, "c": [1}') == {"so": {"a": {"b": 1}, "c": "[1"}}
    assert f("") == f(None) == f("no pairs") == f(":") == {}
    assert f('"a": "open') == {"a": "open"}


def test_word_tokens(spark):
    t = spark.createDataFrame([("The U.S. bank, 中文分词 x 字 New York2",), ("",), (None,)], "t string")
    got = [r[0] for r in t.select(T.word_tokens(F.col("t"), ("u.s. bank", "分词"))).collect()]
    assert got == [["the", "u.s. bank", "中文", "文分", "分词", "x", "字", "new", "york2"], [], None]


def test_reports_go_from_the_bottom_up(spark):
    schema = spark.createDataFrame([(1, 1, ["a", "b"]), (1, 2, ["c"]), (0, 7, ["a", "b", "c", "d"])], "level int, community int, nodes array<string>")
    texts = spark.createDataFrame([("a", "one two"), ("b", "three"), ("c", "four"), ("d", "five")], "node string, description string")
    report = lambda c: F.concat(F.lit("<"), F.replace(c, F.lit("\n"), F.lit("+")), F.lit(">"))
    got = {(r.level, r.community): r.report for r in K.community_reports(schema, texts, 100, report).collect()}
    assert got == {(1, 1): "<one two+three>", (1, 2): "<four>", (0, 7): "<one two+three+four+five>"}
    got = {(r.level, r.community): r.report for r in K.community_reports(schema, texts, 3, report).collect()}
    assert got[(0, 7)] == "<five+<one two+three>+<four>>"


def test_free_names():
    assert io.next_free_name([], "a.txt") == "a.txt"
    assert io.next_free_name(["a.txt", "a(1).txt"], "a.txt") == "a(2).txt"


def test_reports_of_numbered_nodes(spark):
    """Nodes of any type: a community over the budget takes the reports of its sub-communities, by name, after its other nodes, by number."""
    schema = spark.createDataFrame([(1, 2, [1, 2]), (1, 10, [3]), (0, 7, [1, 2, 3, 20, 100])], "level int, community long, nodes array<long>")
    texts = spark.createDataFrame([(1, "one two"), (2, "three"), (3, "four"), (20, "five"), (100, "six")], "node long, description string")
    report = lambda c: F.concat(F.lit("<"), F.replace(c, F.lit("\n"), F.lit("+")), F.lit(">"))
    got = {(r.level, r.community): r.report for r in K.community_reports(schema, texts, 3, report).collect()}
    assert got == {(1, 2): "<one two+three>", (1, 10): "<four>", (0, 7): "<five+six+<four>+<one two+three>>"}


def test_equal_queries_are_searched_once(spark):
    from siltstone.operators import multihop

    seen = []

    def retrieve(queries):
        seen.append(sorted(r.query for r in queries.collect()))
        return queries.select("_q", F.lit(1).alias("rank"), F.concat(F.lit("about "), "query").alias("text"))

    questions = spark.createDataFrame([(i, f"q{i % 3}") for i in range(12)] + [(99, None)], "id int, question string")
    critic = lambda question, memory: F.struct(F.when(F.size(memory) > 1, F.concat_ws("+", memory)).alias("answer"), F.lit("the same").alias("query"))
    found = multihop.answer_questions(questions.filter("id < 50"), retrieve, lambda question, query, texts: F.get(texts, F.lit(0)), critic, 3)
    assert {r.id: r.answer for r in found.collect()} == {i: f"about q{i % 3}+about the same" for i in range(12)}
    assert seen == [["q0", "q1", "q2"], ["the same"]]


def test_words_are_counted_where_their_rows_are_read(spark):
    rows = [(1, "b a b\n a  b"), (2, ""), (3, None), (4, "x " * 5000 + "y")]
    plan = search.postings(spark.createDataFrame(rows, "id long, body string"), "id", "body")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    for more in ([], [(1, "c b a a c"), (1, "a b"), (None, "a b"), (None, "b b"), (None, "b")]):
        docs = spark.createDataFrame(rows + more, "id long, body string")
        own = docs.select("id", T.tokens(F.col("body")).alias("t")).withColumn("length", F.size("t"))
        want = own.select("id", "length", F.explode("t").alias("term")).groupBy("id", "length", "term").agg(F.count("*").alias("tf"))
        got = search.postings(docs, "id", "body").select(want.columns)
        assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
