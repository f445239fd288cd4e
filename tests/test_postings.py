"""The positional index against plain counts over the texts."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import graph, postings


def corpus():
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(30)]
    weight = 1 / np.arange(1, 31)
    rows = [(i, f"file {'W1' if i % 50 == 0 else 'x'}", " ".join(rng.choice(words, rng.integers(1, 40), p=weight / weight.sum()))) for i in range(600)]
    rows += [(1000, None, "W29 w29  w28"), (1001, "rare", None), (1002, "", ""), (1003, "y", "to be or not to be to be")]
    return rows


@pytest.fixture(scope="module")
def index(spark):
    import siltstone.operators.postings as P

    old, P.BLOCK = P.BLOCK, 16
    docs = spark.createDataFrame(corpus(), "id long, name string, body string").repartition(5)
    path = graph.shared_path(spark, "positions")
    postings.build(docs, "id", ["name", "body"], path)
    P.BLOCK = old
    return postings.open_index(spark, "id", path)


def tokens(t):
    return (t or "").lower().split()


def plain_bm25(rows, fields, terms, k):
    best = {}
    for f in fields:
        texts = {r[0]: tokens(r[f]) for r in rows}
        known = [len(texts[r[0]]) for r in rows if r[f] is not None]
        mean = sum(known) / len(known)
        df = {t: sum(t in x for x in texts.values()) for t in terms}
        for i, x in texts.items():
            tf = Counter(x)
            if any(tf[t] for t in terms):
                s = sum(math.log(1 + (len(rows) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(x) / mean)) for t in set(terms) if tf[t])
                best[i] = max(best.get(i, 0), s)
    return sorted(((-round(s, 4), i) for i, s in best.items()))[:k]


@pytest.mark.parametrize("query, k", [("w29 w28", 5), ("w0", 10), ("w5 W7 w29 w5", 20), ("rare", 3), ("w0 w1 w2 w3", 700)])
def test_best_documents_by_skipping_blocks(index, query, k):
    got = postings.multi_match(index, ["name", "body"], query, k).collect()
    assert [(-r.score, r.id) for r in got] == plain_bm25(corpus(), [1, 2], list(dict.fromkeys(query.lower().split())), k)
    assert {r.stage for r in got} == {"match"}


def test_all_documents_where_no_word_is_known(index):
    for q in ("zzz", "", "  "):
        got = postings.multi_match(index, ["name", "body"], q, 7).collect()
        assert [r.id for r in got] == list(range(7)) and {r.stage for r in got} == {"all"}


@pytest.mark.parametrize("words", ["w0 w1", "w2 w0 w1", "to be to be", "to be", "w29 w28", "nothing at", "w3", ""])
def test_phrases(index, words):
    want, p = {}, words.split()
    for i, _, t in corpus():
        x = tokens(t)
        n = sum(x[j : j + len(p)] == p for j in range(len(x) - len(p) + 1)) if p else 0
        if n:
            want[i] = n
    assert {r.id: r.n for r in postings.phrase(index, "body", words).collect()} == want
    assert [r.id for r in postings.match_phrase(index, "body", words, 3).collect()] == sorted(want, key=lambda i: (-want[i], i))[:3]


def test_all_terms_by_natural_relevance(index):
    got = [(r.id, r.score) for r in postings.fulltext(index, "body", ["w3", "w9"], 8).collect()]
    rows = {i: Counter(tokens(t)) for i, _, t in corpus()}
    df = {t: sum(t in c for c in rows.values()) for t in ("w3", "w9")}
    want = {i: sum(c[t] * math.log10(len(rows) / df[t]) ** 2 for t in df) for i, c in rows.items() if all(c[t] for t in df)}
    assert got == [(i, pytest.approx(want[i], abs=1e-6)) for i in sorted(want, key=lambda i: (-round(want[i], 6), i))[:8]]


def test_blocks_are_skipped_and_only_the_index_is_read(index):
    best = postings.ranked(index, ["body"], ["w29"], 3)
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    listed = set(re.search(r"block#\d+L? IN \(([^)]*)\)", plan)[1].split(",")) if " IN (" in plan.split("block#", 1)[1] else set(re.search(r"block#\d+L? INSET ([^)]*)\)", plan)[1].split(","))
    blocks = index.postings.filter("field = 'body' AND term = 'w29'").select("block").distinct().count()
    assert postings.SEEDS <= len(listed) < blocks
    scans = best._jdf.queryExecution().executedPlan().toString().split("FileScan parquet")[1:]
    assert scans and all("/positions-" in x.split("PartitionFilters")[0] for x in scans)
    assert any("In(block" in x.split("PushedFilters: ")[1].split("ReadSchema")[0] for x in scans)


def test_an_index_of_files_is_built_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one = postings.index_of(docs, "doc_id", ["text"])
    assert postings.index_of(docs, "doc_id", ["text"]).postings.inputFiles() == one.postings.inputFiles()
    n = one.postings.select(F.sum("n")).first()[0]
    assert n == docs.select(F.size(F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != ""))).alias("n")).agg(F.sum("n")).first()[0]


def test_blocks_end_by_words_and_repeated_keys_stay_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK_WORDS", 60)
    rows = corpus() + [(1003, "y", "or to be  or not TO BE"), (None, "z", "to be")]
    docs = spark.createDataFrame(rows, "id long, name string, body string").coalesce(1)
    path = graph.shared_path(spark, "positions")
    postings.build(docs, "id", ["body"], path)
    index = postings.open_index(spark, "id", path)
    per = {r.block: r.s for r in index.postings.groupBy("block").agg(F.sum("words").alias("s")).collect()}
    assert sum(per.values()) == sum(len(tokens(r[2])) for r in rows) and len(per) > 50
    assert max(per.values()) < 60 + 40  # what a block has before its last document, and that
    got = sorted(map(tuple, postings.phrase(index, "body", "to be").collect()), key=str)
    assert got == [(1003, 2), (1003, 3), (None, 1)]
