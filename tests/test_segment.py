"""Chinese words against all possible cuts; chunkers as table functions; breaks of meaning."""

import random
from functools import partial

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import segment
from siltstone.operators import chunks

COUNTS = {"北京": 50, "大学": 40, "北京大学": 30, "大学生": 20, "生活": 25, "学生": 30, "活": 5, "的": 200, "中心": 18, "京大": 2, "北": 6, "心": 7, "研究": 33, "研究生": 21, "生命": 22, "命": 4, "起源": 9, "源": 1}
BOOK = segment.Dictionary(COUNTS)


def all_cuts(run):
    if not run:
        return [[]]
    return [[run[:j], *rest] for j in range(1, len(run) + 1) if j == 1 or run[:j] in BOOK.cost for rest in all_cuts(run[j:])]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="北京大学生活的中心研究命起源龙", max_size=9))
def test_the_cheapest_of_all_cuts(run):
    cost = lambda ws: round(sum(BOOK.cost.get(w, BOOK.unknown) for w in ws), 6)
    assert cost(BOOK.cut(run)) == min(map(cost, all_cuts(run))) and "".join(BOOK.cut(run)) == run
    full = BOOK.every(run)
    assert sorted(w for w in full if len(w) > 1) == sorted(run[i:j] for i in range(len(run)) for j in range(i + 2, len(run) + 1) if run[i:j] in COUNTS)


def test_columns_of_texts(spark):
    df = spark.createDataFrame([("北京大学生活中心 MIT Lab2",), ("研究生命起源",), ("",), (None,)], "t string")
    got = [tuple(r) for r in df.select(segment.segmented(F.col("t"), BOOK), segment.segmented(F.col("t"), BOOK, full=True)).collect()]
    assert got[0][0] == ["北京大学", "生活", "中心", "mit", "lab2"] and got[1][0] == ["研究", "生命", "起源"]
    assert got[0][1][:4] == ["北京", "北京大学", "京大", "大学"] and got[2] == ([], []) and got[3] == (None, None)
    own = segment.dictionary(spark.createDataFrame(list(COUNTS.items()), "word string, n long"), user=("命起源",))
    assert own.cut("研究生命起源") == ["研究生", "命起源"]


def test_boundaries(spark):
    df = spark.createDataFrame([("北京大学生活", 0, 4), ("北京大学生活", 1, 3), ("北京大学生活", 2, 4), ("an ox", 3, 5), ("axe", 0, 2)], "t string, a int, b int")
    assert [r[0] for r in df.select(segment.on_boundary(F.col("t"), F.col("a"), F.col("b"), BOOK)).collect()] == [True, False, True, True, False]


def test_words_are_learned_from_texts(spark):
    rng = random.Random(1)
    known = ["电脑", "葡萄牙", "图书馆员"]
    filler = [chr(0x4E00 + i) for i in range(60)]
    rows = [("".join(rng.choice(known) if rng.random() < 0.3 else rng.choice(filler) for _ in range(20)),) for _ in range(150)] + [(None,), ("abc",)]
    found = {r.word for r in segment.learned(spark.createDataFrame(rows, "t string"), "t", cohesion=8.0).filter(F.length("word") > 1).collect()}
    assert set(known) <= found and all(any(w in k for k in known) for w in found)


def test_table_functions_equal_the_functions(spark):
    chunks.register(spark)
    text = "One, two three. Four five! " * 9
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "k int, t string")
    df.createOrReplaceTempView("chunk_texts")
    got = spark.sql("SELECT k, c.chunk_no, c.chunk FROM chunk_texts, LATERAL split_by_size(t, 40, 5, '.!?, ') c").collect()
    want = chunks.by_function(df, "t", ["k"], partial(chunks.split_by_size, size=40, overlap=5, stops=".!?, ")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 3
    got = spark.sql("SELECT k, c.chunk_no, c.chunk FROM chunk_texts, LATERAL recursive_split(t, 30) c").collect()
    want = chunks.by_function(df, "t", ["k"], partial(chunks.recursive_split, size=30)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 3
    rows = spark.createDataFrame([("a", 3, "x y"), ("a", 1, "p q r"), ("a", 2, "s"), ("a", 4, "1 2 3 4 5 6"), ("b", 1, None), ("b", 2, "z"), ("c", 1, "")], "g string, n int, t string")
    rows.createOrReplaceTempView("chunk_rows")
    got = spark.sql("SELECT * FROM packed_chunks(TABLE(chunk_rows) PARTITION BY g ORDER BY (n), 't', 4)").collect()
    assert sorted(map(tuple, got)) == [("a", 0, 2, "p q r s"), ("a", 1, 1, "x y"), ("a", 2, 1, "1 2 3 4 5 6"), ("b", 0, 1, "z")]


@pytest.mark.parametrize("kind", ["percentile", "deviation", "quartiles", "gradient"])
def test_breaks_of_meaning(spark, kind):
    rng = np.random.default_rng(6)
    topics = rng.normal(size=(4, 12))
    rows = [(d, i, f"s{d}x{i} word word", (topics[(i // 6 + d) % 4] + 0.15 * rng.normal(size=12)).tolist()) for d in range(3) for i in range(24)] + [(9, 0, "alone", [1.0] * 12), (8, 0, "u", [1.0] * 12), (8, 1, "v", [0.5] * 12)]
    df = spark.createDataFrame(rows, "d long, i long, t string, v array<double>")
    amount = {"deviation": 1.5, "quartiles": 1.5}.get(kind)
    got = {}
    for r in chunks.semantic_breaks(df, "d", "i", "v", 0.85, kind, amount).collect():
        got.setdefault(r.d, {})[r.i] = r.group
    for d in range(3):
        x = np.array([r[3] for r in rows if r[0] == d])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        far = 1 - (x[1:] * x[:-1]).sum(1)
        shown = np.gradient(far) if kind == "gradient" else far
        q1, q3 = np.percentile(far, [25, 75])
        bound = {"percentile": np.percentile(far, 85), "deviation": far.mean() + 1.5 * far.std(), "quartiles": far.mean() + 1.5 * (q3 - q1), "gradient": np.percentile(shown, 85)}[kind]
        assert [got[d][i] for i in range(24)] == [0, *np.cumsum(shown > bound).tolist()]
    assert got[9] == {0: 0}
    parts = chunks.semantic_chunks(df, "d", "i", "t", "v", 5, percent=0.85, kind=kind, amount=amount).collect()
    assert " ".join(c for *_, c in sorted((r.group, r.chunk_no, r.chunk) for r in parts if r.d == 1)) == " ".join(r[2] for r in rows if r[0] == 1)
    assert all(len(r.chunk.split()) <= 10 for r in parts) and max(r.chunk_no for r in parts) > 0
