"""Operators on toy inputs: edge cases and properties."""

import json
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import providers, vectors
from siltstone.functions import text as T
from siltstone.operators import chunks, cluster, evaluation, graph, relational, search
from siltstone.sources import io
from siltstone.streaming import streams


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(1)).select(column).first()[0]


def test_cosine_of_zero_and_equal_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0], [1.0, 0.0]), (2, [3.0, 4.0], [3.0, 4.0])], "id int, a array<float>, b array<float>")
    assert [round(r[0], 9) for r in df.orderBy("id").select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0]


def test_search_breaks_ties_by_key(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in (5, 3, 9)] + [(1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in search.search(df, [1.0, 0.0], 2).collect()] == [3, 5]
    q = df.filter("vec_id = 1").select(F.col("vec_id").alias("query_id"), "embedding")
    assert [(r.vec_id, r["rank"]) for r in search.batched_search(q, df, 2).orderBy("rank").collect()] == [(1, 1), (3, 2)]


def test_batched_search_without_queries(spark):
    df = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert search.batched_search(df.filter("false").select(F.col("vec_id").alias("query_id"), "embedding"), df, 2).count() == 0


def test_min_max_of_equal_and_negative_scores(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, -1.0)], "id int, s double")
    assert [r.x for r in search.min_max(df, "s", "x").orderBy("id").collect()] == [1.0, 1.0, 0.0]


def test_budget_of_nothing(spark):
    df = spark.createDataFrame([(1, 5), (2, 5)], "id int, n int")
    assert search.within_budget(df, "n", ["id"], 0).count() == 0
    assert search.within_budget(df, "n", ["id"], 9).count() == 1


def test_asof_takes_equal_times(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t int")
    right = spark.createDataFrame([("a", 5, 50), ("a", 3, 30)], "k string, t int, v int")
    got = {(r.k, r.t): r.right_v for r in relational.asof_join(left, right, "k", "t", ["v"]).collect()}
    assert got == {("a", 5): 50, ("a", 1): None, ("b", 9): None}


def test_range_join_equals_plain_join(spark):
    p = spark.range(200).select(F.col("id").alias("x"))
    r = spark.createDataFrame([(0, 5, 17), (1, 17, 17), (2, 90, 131)], "r int, lo int, hi int")
    a = relational.range_join(p, r, "x", "lo", "hi", 10.0).select("x", "r").collect()
    b = p.join(r, (F.col("x") >= F.col("lo")) & (F.col("x") < F.col("hi"))).select("x", "r").collect()
    assert sorted(a) == sorted(b)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .,\n", max_size=200), st.integers(2, 40), st.integers(0, 1))
def test_size_splits_cover_the_text(text, size, overlap):
    parts, out, before = chunks.split_by_size(text, size, overlap, chunks.STOPS["en"]), "", ""
    for p in parts:
        assert 0 < len(p) <= size
        out += p[overlap:] if len(before) > overlap else p  # a piece no longer than the overlap is just followed
        before = p
    assert out == text


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n", max_size=200), st.integers(1, 30))
def test_recursive_splits_are_small_and_keep_the_letters(text, size):
    parts = chunks.recursive_split(text, size)
    assert all(len(p) <= size for p in parts)
    assert "".join("".join(parts).split()) == "".join(text.split())


def test_overlap_must_be_smaller():
    with pytest.raises(ValueError):
        chunks.split_by_size("abc", 3, 3, " ")


@pytest.mark.parametrize("n, expected", [(0, []), (1, [1]), (9, [9]), (10, [10]), (11, [10, 3]), (30, [10, 10, 10, 6])])
def test_token_windows(spark, n, expected):
    df = spark.createDataFrame([(1, " ".join("x" * n))], "id int, t string")
    assert [r.n_tokens for r in chunks.by_fixed_tokens(df, "t", 10, 2, ["id"]).orderBy("chunk_no").collect()] == expected


def test_records(spark):
    f = lambda r: spark.range(1).select(T.relation_record(F.lit(r), F.lit("c"))).first()[0]
    assert f('"relationship"<|>a<|>b<|>d<|>x').weight == 1.0
    assert f('"relationship"<|>a<|>b<|>d<|>2.5').weight == 2.5
    assert f('"relationship"<|>a<|>b') is None and f('"entity"<|>a<|>b<|>d<|>1') is None


def test_glyphs(spark):
    got = spark.range(1).select(T.clean_glyphs(F.lit("/dollar.tnum/five.pl.tnum glyph<1>/B.cap/zero")), T.glyph_count(F.lit("/dollar.tnum/five.pl.tnum glyph<1>/B.cap/zero"))).first()
    assert tuple(got) == ("$5 B/zero", 4)


def test_tool_call_takes_the_last(spark):
    assert spark.range(1).select(T.tool_call(F.lit("nothing"))).first()[0] is None


def test_headers_without_any(spark):
    df = spark.createDataFrame([(1, "just text"), (2, ""), (3, "#x\n# y")], "id int, t string")
    got = [(r.id, r.level, r.header, r.content) for r in chunks.by_headers(df, "t", "id").orderBy("id", "section").collect()]
    assert got == [(1, 0, "", "just text"), (3, 0, "", "#x"), (3, 1, "y", "")]


EDGES = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (10, 11), (11, 12), (12, 10), (20, 20)]


@pytest.fixture(scope="module")
def toy(spark):
    e = spark.createDataFrame(EDGES, "src long, tgt long").withColumn("weight", F.lit(1.0))
    return e, e.select(F.explode(F.array("src", "tgt")).alias("node")).distinct()


def test_components(toy):
    e, n = toy
    got = {r.node: r.component for r in graph.components(n, e).collect()}
    assert got == {**{i: 1 for i in range(1, 7)}, 10: 10, 11: 10, 12: 10, 20: 20}
    assert sorted(r.node for r in graph.largest_component(n, e).collect()) == [1, 2, 3, 4, 5, 6]


def test_paths_exist_and_are_shortest(spark, toy):
    e, _ = toy
    start = spark.createDataFrame([(1,), (10,), (99,)], "node long")
    found = graph.shortest_paths(e, start, 5).collect()
    pairs = {frozenset(x) for x in EDGES}
    assert all(frozenset(x) in pairs for r in found for x in zip(r.path, r.path[1:]))
    assert {(r.start, r.node): r.hops for r in found} == {**{(1, i): i - 1 for i in range(2, 7)}, (10, 11): 1, (10, 12): 1}


def test_a_loop_counts_twice(toy):
    assert {r.node: r.degree for r in graph.degrees(toy[0]).collect()}[20] == 2


def test_communities_keep_components_apart(toy):
    e, n = toy
    got = {r.node: r.community for r in graph.communities(n, e).collect()}
    assert {got[i] for i in (1, 2, 3)}.isdisjoint({got[i] for i in (10, 11, 12)})


def test_walks_follow_edges(spark, toy):
    pairs = {frozenset(x) for x in EDGES}
    w = [r.walk for r in graph.walks(toy[0], spark.createDataFrame([(1,), (77,)], "node long"), 5, 3).collect()]
    assert len(w) == 6 and all(frozenset(x) in pairs for p in w for x in zip(p, p[1:]))


@pytest.mark.parametrize("kind, actual, predicted, score", [
    ("number", "100", "100.9", 1.0), ("number", "100", "101", 0.0), ("number", "0", "0", 0.0), ("number", "-5", "-5", 0.0), ("number", "5", "x", 0.0), ("name", " A", "a ", 1.0),
    ("boolean", "True", "true", 1.0), ("names", "a,b", "b, c", 1 / 3), ("name", "N/A", "N/A", 1.0), ("name", "N/A", "x", 0.0),
])
def test_answer_scores(spark, kind, actual, predicted, score):
    got = spark.range(1).select(evaluation.answer_score(F.lit(kind), F.lit(actual), F.lit(predicted))).first()[0]
    assert got == pytest.approx(score)


def test_mixture_labels(spark):
    rows = [(i, [float(i % 7) / 10 + (5 if i % 2 else 0), float(i % 3) / 10]) for i in range(60)]
    f = cluster.reduced(spark.createDataFrame(rows, "node long, embedding array<double>"), "embedding", 2)
    model = cluster.mixture(f, "features", 4, candidates=[2])
    got = cluster.hard_labels(model, cluster.soft_labels(model, f, 0.5).drop("probability", "prediction")).collect()
    assert len(got) == 60 and all(r.labels in ([r.community], []) for r in got)


@pytest.mark.parametrize("extension", ["jsonl", "csv", "parquet"])
def test_round_trip(spark, tmp_path, extension):
    df = spark.createDataFrame([(1, 'a "q", b\nc'), (2, None)], "id long, t string")
    io.write(df, f"{tmp_path}/x.{extension}")
    assert sorted(map(tuple, io.read(spark, f"{tmp_path}/x.{extension}", "id long, t string").collect())) == [(1, 'a "q", b\nc'), (2, None)]


def test_unknown_extension(spark):
    with pytest.raises(ValueError):
        io.read(spark, "/x/y.exe")


def test_keyed_table_keeps_the_last_write(spark, tmp_path):
    t = io.KeyedTable(spark, f"file://{tmp_path}/t")
    t.upsert(spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int"))
    t.upsert(spark.createDataFrame([("b", 2), ("c", 2)], "id string, v int"))
    assert sorted(map(tuple, t.load().select("id", "v").collect())) == [("a", 1), ("b", 2), ("c", 2)]
    assert [r.id for r in t.missing(spark.createDataFrame([("c",), ("z",)], "id string")).collect()] == ["z"]


def test_cache_asks_the_model_once(spark, tmp_path):
    t = io.KeyedTable(spark, f"file://{tmp_path}/c")
    df = spark.createDataFrame([("One. Two",), ("One. Two",), ("Three",)], "p string")
    assert sorted(r.answer for r in providers.cached_answers(df, "p", t).collect()) == ["One", "One", "Three"]
    assert t.load().count() == 2


def test_stream_windows_and_ingest(spark, sf_dir, tmp_path):
    path = f"{tmp_path}/events"
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(path)
    stream = streams.read_stream(spark, path, events.schema, 1)
    got = streams.run_to_end(streams.windowed_counts(stream, "1 day", "60 days"), "counts", "complete", f"{tmp_path}/c1")
    assert got.agg(F.sum("n")).first()[0] == events.count()
    t = io.KeyedTable(spark, f"file://{tmp_path}/seen", "event_id")
    for i in (1, 2):  # the second run reads all again and adds nothing
        streams.ingest_unseen(streams.read_stream(spark, path, events.schema), t, "event_id", f"{tmp_path}/c{i + 1}").awaitTermination()
    assert t.load().count() == events.count()


def test_first_json(spark):
    got = spark.range(1).select(T.first_json(F.lit('x {"a": "1"} y'))).first()[0]
    assert json.loads(got) == {"a": "1"}


def test_one_row_a_key_whatever_the_segments(spark, tmp_path):
    """Against a dict over writes that repeat keys, in one write too, null ones included; merges come every few writes."""
    rng = np.random.default_rng(8)
    t, kept = io.KeyedTable(spark, f"file://{tmp_path}/random", "k"), {}
    t.SEGMENTS = 3
    for n in range(9):
        rows = [(None if k == 5 else int(k), int(a), None if b == 3 else f"b{b}", {"m": int(b)}) for k, a, b in rng.integers(0, 6, (rng.integers(1, 9), 3))]
        fresh = {}
        for k, a, b, m in rows:  # of one write the largest counts: by a, b (null lowest), k, m
            fresh[k] = max(fresh.get(k, (-1, "", {})), (a, b or "", m), key=lambda x: (x[0], x[1], str(x[2])))
        kept |= fresh
        t.upsert(spark.createDataFrame(rows, "k long, a long, b string, m map<string, long>").repartition(1 + n % 3))
        assert {r.k: (r.a, r.b or "", r.m) for r in t.load().collect()} == kept
        assert t.load().count() == len(kept)


def test_runs_of_a_stream_with_late_rows_equal_those_of_the_batch(spark, tmp_path):
    """Files in an order in which rows come late, join runs, or come too late; runs are given once, when the watermark has passed."""
    rng = np.random.default_rng(5)
    base = 1_700_000_000
    rows = [(int(u), base + int(t), float(v), "abc"[int(v) % 3]) for u, t, v in zip(rng.integers(0, 5, 300), np.sort(rng.integers(0, 90_000, 300)), rng.integers(0, 9, 300))]
    order = sorted(range(300), key=lambda i: (rows[i][1] // 4000 + int(rng.integers(0, 2)), i))  # up to two hours out of order
    for n in range(6):
        part = [rows[i] for i in order[50 * n : 50 * n + 50]] + ([(0, base + 10, 1.0, "late")] if n == 5 else []) + [(None, base, 1.0, "a")]
        df = spark.createDataFrame(part, "user_id long, t long, value double, event_type string").select("user_id", F.timestamp_seconds("t").alias("ts"), "value", "event_type")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.02)
    stream = streams.read_stream(spark, f"file://{tmp_path}/in", df.schema, 1)
    got = streams.run_to_files(streams.user_runs(stream, 1800, "4 hours"), f"file://{tmp_path}/out", f"file://{tmp_path}/state").collect()
    want, end = [], max(r[1] for r in rows) - 4 * 3600
    for u in range(5):
        mine = sorted((t, k, v) for w, t, v, k in rows if w == u)
        runs = []
        for t, k, v in mine:
            if runs and t < runs[-1][-1][0] + 1800:
                runs[-1].append((t, k, v))
            else:
                runs.append([(t, k, v)])
        want += [(u, r[0][0], r[-1][0], len(r), sum(x[2] for x in r), r[0][1], r[-1][1]) for r in runs if r[-1][0] + 1800 < end]
    assert sorted((r.user_id, int(r["first"].timestamp()), int(r["last"].timestamp()), r.n, r.total, r.first_type, r.last_type) for r in got) == sorted(want)
    assert len(want) > 20


def test_whole_document_in_blocks(spark):
    """Chunks and first pages as a search through the whole text finds them, also over several blocks, repeats and partial words."""
    rng = np.random.default_rng(7)
    pages = [("a", i, " ".join(rng.choice(["x", "yx", "xy", "z z", "q"], 40))) for i in range(60)]  # words that end or start with others
    pages += [("b", i, "again and again " * 10) for i in range(30)] + [("c", 1, "one"), ("d", 3, "someone"), ("d", 4, "one"), ("e", 1, None), ("f", 2, " "), ("f", 5, "ab cd")]
    df = spark.createDataFrame(pages, "doc string, page long, text string").repartition(5)
    for size, overlap in ((5, 2), (3, 1), (30, 5)):
        want = {}
        for doc in "abcdef":
            texts = [(p, " ".join((t or "").split())) for d, p, t in pages if d == doc]
            texts = [(p, t) for p, t in sorted(texts) if t]
            words, text = [w for _, t in texts for w in t.split()], " ".join(t for _, t in texts)
            ends = np.cumsum([len(t) + 1 for _, t in texts])
            for n in range(max(1, -(-(len(words) - overlap) // (size - overlap))) if words else 0):
                chunk = " ".join(words[n * (size - overlap) :][:size])
                want[doc, n] = texts[int(np.sum(ends < text.index(chunk) + 1))][0], chunk
        got = {(r.doc, r.chunk_no): (r.page, r.chunk) for r in chunks.by_whole_document(df, size, overlap).collect()}
        assert got == want


def test_chunks_go_out_by_the_megabyte():
    """A batch of many texts doesn't give one batch of all their chunks."""
    texts = pa.RecordBatch.from_pydict({"id": list(range(8)), "text": ["ab " * 200_000] * 7 + [None]})
    out = list(chunks.cut_batches("text", ["id"], lambda t: [t[i : i + 3000] for i in range(0, len(t), 3000)])(iter([texts])))
    assert len(out) > 3 and max(b.nbytes for b in out) < 1_200_000
    assert [(r["id"], r["chunk_no"]) for b in out for r in b.select(["id", "chunk_no"]).to_pylist()] == [(i, n) for i in range(7) for n in range(200)]


def test_a_user_has_one_timer_for_all_open_runs():
    class Handle:
        timers, value = [], None

        def getValueState(self, *_):  # noqa: N802
            return self

        def registerTimer(self, at):  # noqa: N802
            self.timers.append(at)

        get = lambda self: self.value
        update = lambda self, x: setattr(self, "value", x)
        clear = lambda self: setattr(self, "value", None)

    class Now:
        getCurrentWatermarkInMs = lambda self: 25_000  # noqa: E731, N815

    h, runs = Handle(), streams._Runs(1000)
    runs.init(h)
    assert list(runs.handleInputRows((7,), iter([{"us": s * 1_000_000, "value": 1.0, "event_type": "a"} for s in (10, 20, 20.5, 30)]), Now())) == []
    assert h.timers == [11_001]
    got = [(r.first, r.last, r.n, r.total) for r in runs.handleExpiredTimer((7,), Now(), None)]
    assert got == [(10_000_000, 10_000_000, 1, 1.0), (20_000_000, 20_500_000, 2, 2.0)]
    assert h.timers == [11_001, 31_001]
    assert list(runs.handleExpiredTimer((7,), Now(), None)) == [] and h.timers[-1] == 31_001
