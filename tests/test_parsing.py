"""Parsers, rate limits, retries and bounded loops."""

import json
import re

import pytest
from pyspark.sql import functions as F

from siltstone.functions import parsing, providers
from siltstone.operators import ann, graph, matching, multihop
from siltstone.plans import agents, rag
from siltstone.sources.schemas import QueryParam


@pytest.mark.parametrize("text, expected", [
    ('a {"x": {"y": 1}} b {"z": 2}', {"x": {"y": 1}}), ('{"a": "}"}', {"a": "}"}), ("{bad} then {\"a\": 1}", {"a": 1}), ("none", None), ("", None), (None, None), ('{"a": 1', None),
])
def test_first_object(text, expected):
    found = parsing.first_object(text)
    assert (json.loads(found) if found else None) == expected


def test_lenient_object():
    assert parsing.lenient_object('answer: yes, n: 3, f: 1.5, ok: true, no: null, in: {a: 1}') == {"answer": "yes", "n": 3, "f": 1.5, "ok": True, "no": None, "in": {"a": 1}}
    assert parsing.object_or_pairs("nothing here") is None


def test_longest_names_first():
    assert parsing.extract_names("Is Acme Holdings larger than ACME?", ["Acme", "Acme Holdings", "Ac"]) == ["Acme Holdings", "Acme"]
    assert parsing.extract_names("Acme Holdings only", ["Acme", "Acme Holdings"]) == ["Acme Holdings"]
    assert parsing.extract_names(None, ["x"]) == []


def test_token_bucket_never_exceeds_its_rate():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    bucket = agents.TokenBucket(60, lambda: now[0], sleep)
    for _ in range(90):
        bucket.wait()
    assert now[0] == pytest.approx(30, abs=1)


def test_retries_raise_the_last_failure():
    calls = []

    def fail():
        calls.append(1)
        raise ValueError(len(calls))

    with pytest.raises(ValueError, match="3"):
        agents.with_retries(fail, 3, sleep=lambda s: None)


def test_questions_are_answered_in_rounds(spark):
    """A vector index as the tool; one question needs two hops, one never ends, one is null, one comes twice."""
    e = providers.HashingEmbedder(32)
    texts = ["paris is in france", "france is in europe", "cats sleep", "rome is in italy", "italy is in europe"]
    chunks = spark.createDataFrame([(i, t, v) for i, (t, v) in enumerate(zip(texts, e(texts)))], "chunk_id long, text string, embedding array<float>")
    index = ann.VectorIndex.create(chunks, graph.shared_path(spark, "ann"), ann.IndexParams(32, key="chunk_id", cells=2, nprobe=2))
    retrieve = multihop.vector_retriever(index, "text", lambda c: providers.embed(c, e), 2, refine=None)
    rows = [(1, "where is paris"), (2, "where is rome"), (3, "who are you"), (4, None), (2, "where is rome")]
    questions = spark.createDataFrame(rows, "id long, question string")
    extract = lambda question, query, found: F.array_join(F.filter(found, lambda t: F.startswith(t, F.substring_index(query, " ", -1))), "; ")
    last = lambda m: F.try_element_at(m, F.lit(-1))
    end = lambda m: F.substring_index(last(m), " ", -1)
    critic = lambda question, m: F.struct(F.when(end(m) == "europe", end(m)).alias("answer"), F.concat(F.lit("where is "), end(m)).alias("query"))
    got = sorted(map(tuple, multihop.answer_questions(questions, retrieve, extract, critic, 3).collect()), key=str)
    none = "Insufficient information."
    rome = (2, "where is rome", "europe", 2, ["rome is in italy", "italy is in europe"])
    assert got == [(1, "where is paris", "europe", 2, ["paris is in france", "france is in europe"]), rome, rome, (3, "who are you", none, 3, []), (4, None, none, 3, [])]


def test_report_keeps_order(spark):
    df = spark.createDataFrame([(2, "B", "two. x"), (1, "A", "one. x")], "pos int, title string, block string")
    assert agents.report("T", df) == "# T\n\n## A\n\none\n\n## B\n\ntwo"


def test_path_through_required_nodes(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8)], "src long, tgt long")
    assert matching.path_through(e, [1, 3, 9]) == [1, 2, 3, 9]


def test_modes(spark, sf_dir):
    store = rag.toy_store(spark, sf_dir)
    for mode in (*rag.SECTIONS, "naive"):
        got = rag.context(store, [0.1] * 64, QueryParam(mode=mode, level=1, top_k=5, top_m=3, text_tokens=500)).collect()
        assert len({(r.section, r.pos) for r in got}) == len(got)
        assert sum(len(r.text.split()) for r in got if r.section == "sources") <= 500
    with pytest.raises(ValueError):
        rag.context(store, [0.0] * 64, QueryParam(mode="other"))


def test_boundary_is_about_letters_of_any_alphabet(spark):
    at = lambda t, a, b: spark.range(1).select(parsing.on_word_boundary(F.lit(t), F.lit(a), F.lit(b))).first()[0]
    assert at("ab", 0, 2) and not at("éab", 1, 3) and at("é ab!", 2, 4)


def plain_matches(rows, names):
    word, out = re.compile(r"[\w\u0300-\u036f]"), []
    for k, t in rows:
        low = (t or "").lower()
        for e in {x.strip().lower() for x in names} - {""}:
            at = [i for i in range(len(low)) if low.startswith(e, i) and not (i and word.match(low[i - 1])) and not word.match(low[i + len(e) : i + len(e) + 1])]
            if at:
                out.append((k, e, len(at)))
    return out


def test_dictionary_entries_are_found_where_they_stand(spark):
    rows = [
        (1, "AT&T and O'Neil write C++ at U.S. Bank"), (2, "the new-york times of new  york"), (2, "new york, AT&T, at&t"), (3, None), (4, ""), (5, "a a a a, \\E x\\Ey ++ (c++) İstanbul stanbul"), (6, "New York, new york; newyork x york"),
        (None, "york"), (7, "e\u0301t\u0301 et"),
    ]
    names = ["AT&T", "O'Neil", "C++", "U.S. Bank", "new york", "new  york", "york", "a a", "\\E", "++", "stanbul", "", " York ", "e", "et", "nowhere to be found", "new nowhere"]
    docs, entries = spark.createDataFrame(rows, "k long, t string"), spark.createDataFrame([(x,) for x in names] + [(None,)], "e string")
    got = sorted(((r.k, r.entry, r.n) for r in matching.match_dictionary(docs, "k", "t", entries, "e").collect()), key=str)
    assert got == sorted(plain_matches(rows, names), key=str)
    assert (5, "stanbul", 1) in got and (5, "a a", 3) in got and (5, "++", 1) in got and (7, "e", 1) not in got


def test_grids_are_chosen_once_a_row(spark):
    """The boxes of a grid don't choose it anew for each side of each tile."""
    boxes = spark.range(3).select(F.size(parsing.tile_boxes(parsing.tile_grid(F.col("id") + 1, F.lit(10)), 448)).alias("n"))
    assert boxes._jdf.queryExecution().optimizedPlan().toString().count("array_min") == 1


def test_texts_are_cut_into_pieces_once(spark):
    """Counting the pieces and joining them read the same table of pieces that entries have."""
    docs, entries = spark.createDataFrame([(1, "new york and more")], "k long, t string"), spark.createDataFrame([("new york",)], "e string")
    found = matching.match_dictionary(docs, "k", "t", entries, "e")
    assert "array_distinct(regexp_extract_all(_low" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [(1, "new york", 1)]
