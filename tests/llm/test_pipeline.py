"""The corpus pipeline: each stage on what its predecessor kept, against the brute-force versions of the operators."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import quality
from test_operators import check_packing, library_ids, near_brute, quality_brute, rows, words


def test_stages(spark, docs, labels, sf_dir):
    now, columns = docs, docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "substrings", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = rows(now)
        now = stage(spark, now, sf_dir).cache()
        after = rows(now) if "text" in now.columns else []
        if name != "packing":
            assert now.columns == columns
        if name == "quality":
            p = quality.QualityParams()
            want = quality_brute(before, labels.collect(), p)
            assert sorted(d for d, _ in after) == sorted(b[0] for b, s in want if not b[-1] and s >= p.threshold)
        if name == "language":
            assert sorted(after) == sorted(before)
        if name == "near_duplicates":
            assert sorted(d for d, _ in after) == sorted(d for d, _, c in near_brute(before, percent=80) if d == c)
        if name == "substrings":
            assert Counter(d for d, _ in after) == Counter(d for d, _ in before)
            low = {}
            for d, t in before:
                w = words(t)
                for i in range(len(w) - 12):
                    low[tuple(w[i : i + 13])] = min(d, low.get(tuple(w[i : i + 13]), d))
            kept = dict(after)
            for d, t in before:
                w = words(t)
                gone = {j for i in range(len(w) - 12) if low[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
                assert kept[d].encode() == b" ".join(x for j, x in enumerate(w) if j not in gone)
            assert now.filter(F.length("text") != F.col("n_chars")).count() == 0
        if name == "packing":
            check_packing(now.collect(), before, library_ids("word_bpe_49k.json", before), 4096)


def test_near_duplicates_from_80_percent(spark, docs, sf_dir):
    """Pairs of 200 words, of which the second has from 1 to 14 changed: similarities from 0.95 down to below 0.60."""
    data = []
    for i in range(140):
        text = [f"p{i}w{j}" for j in range(200)]
        data.append((i, " ".join(text)))
        for j in range(1 + i % 14):
            text[5 + 14 * j] = f"changed{j}"
        data.append((1000 + i, " ".join(text)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, df, sf_dir).collect())
    want = {p: sorted(d for d, _, c in near_brute(data, percent=p) if d == c) for p in (80, 85)}
    assert got == want[80] != want[85]
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, sf_dir).collect()
    assert sorted(r.doc_id for r in kept) == sorted(d for d, _, c in near_brute(rows(docs), percent=80) if d == c)


def test_run_equals_the_stages(spark, sf_dir):
    now = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf_dir).cache()
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    piece = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")  # which range a sequence lies in depends on the sampled bounds
    whole = lambda df: {d: (n, crc) for d, n, crc in df.groupBy("doc_id").agg(F.max("doc_tokens"), F.sum("length")).collect()}
    assert whole(got) == whole(now) and now.columns == got.columns and set(piece) <= set(now.columns)


def test_one_row_of_a_doc_id_stays(spark):
    data = [(1, "one two three four five six seven", "a"), (1, "one two three four five six seven", "b"), (1, "another text of more than five words", "a"), (2, "x y z", "c"), (None, "x", None), (None, "x", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, `a.b` string")
    got = [sorted(map(str, corpus_pipeline.near_duplicate_stage(spark, x, "").collect())) for x in (df, df.orderBy(F.desc("text")).repartition(3))]
    assert got[0] == got[1] and len(got[0]) == 4


def test_odd_rows_pass(spark, odd, none, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for df in (odd, none):
        now = df
        for _, stage in corpus_pipeline.STAGES[1:]:
            now = stage(spark, now, str(tmp_path)).cache()
            now.count()
        assert corpus_pipeline.quality_stage(spark, df, str(tmp_path)).columns == df.columns
    assert corpus_pipeline.quality_stage(spark, none, str(tmp_path)).count() == 0
    dotted = odd.withColumnRenamed("_row", "a.b").withColumn("n", F.lit(1)).withColumn("n_chars", F.lit(None).cast("long"))
    for _, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, dotted, str(tmp_path)).columns == dotted.columns
