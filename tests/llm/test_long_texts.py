"""Texts longer than the blocks in which operators take them, between short ones."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from siltstone.llm import bpe, fingerprint, lang_id, license_scan, lm_scoring, near_dup, packing, quality, substring, wavelet
from test_operators import check_packing, library_ids, near_brute, quality_brute, rows, substring_brute, words


@pytest.fixture(scope="module")
def long(spark):
    """2.5 MB, the same with some words changed, and short texts; ids in the order of rows."""
    rng = np.random.default_rng(9)
    vocabulary = ["".join(rng.choice(list("etaoinshrdluéà"), rng.integers(2, 9))) for _ in range(3000)]
    text = rng.choice(vocabulary, 440_000).tolist()
    other = list(text)
    for i in range(0, len(other), 4001):
        other[i] = "changed"
    data = [(1, "short one before\nand a line"), (2, " ".join(text)), (3, "between"), (4, " ".join(other) + "\nReleased under the MIT License."), (5, " ".join(text[:200])), (6, None)]
    assert len(data[1][1].encode()) > 2_200_000
    return spark.createDataFrame(data, "doc_id long, text string").coalesce(1)


def test_lm(long):
    net, _ = lm_scoring.train(long, lm_scoring.LmParams(words=200, classes=16, rounds=1))
    got = {r.doc_id: r for r in lm_scoring.score(long, net).collect()}
    for d, t in rows(long):
        assert got[d].n_tokens == len(words(t))
    whole = long.filter("doc_id = 2")
    parts = [r.log_likelihood for r in lm_scoring.score(whole.select("doc_id", F.concat("text", F.lit(" ")).alias("text")), net).collect()]
    assert got[2].log_likelihood == pytest.approx(parts[0]) and got[2].log_likelihood < got[5].log_likelihood < 0


def test_near_duplicates_and_substrings(long):
    got = near_dup.near_duplicates(long).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == near_brute(rows(long))
    got = substring.dedup_substrings(long).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == substring_brute(rows(long))


def test_language_and_quality(spark, long, labels, docs):
    model = lang_id.train(docs)
    got = {r.doc_id: r for r in lang_id.predict(long, model).collect()}
    assert got[6].lang_pred == "und" and got[2].bits > 1e6
    raw = np.frombuffer(rows(long)[1][1].encode(), np.uint8)
    assert got[2].bits == pytest.approx(model.lengths(raw, np.array([0, len(raw)])).min() / lang_id.UNIT)
    p = quality.QualityParams(buckets=1024)
    trusted = spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int")
    want = Counter(b for b, _ in quality_brute(rows(long), trusted.collect(), p))
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality(long, trusted, p).collect()) == want


def test_fingerprints_and_licenses(long):
    p = fingerprint.FingerprintParams()
    got = {r.doc_id: r for r in fingerprint.fingerprints(long).collect()}
    assert all(got[d].fingerprint == fingerprint.digests([t or ""], p)[2][0].hex() for d, t in rows(long))
    assert got[2].near_edited > 0.5
    found = {r.doc_id: r.family for r in license_scan.scan(long).collect()}
    assert found[4] == "MIT" and found[2] == "none"


def test_tokenizers(spark, long):
    twice = long.withColumn("text", F.when(F.col("doc_id") == 2, F.repeat(F.concat("text", F.lit("\n")), 4)).otherwise(F.col("text")))  # 10 MB
    data = rows(twice)
    path = P.path("byte_bpe_multi_50k.tiktoken")
    codec = bpe.BpeParams(path, P.PATTERN)
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.Codec(path, P.PATTERN).ranks.rank, special_tokens={})
    want = {d: hashlib.sha256(",".join(map(str, known.encode_ordinary(t or ""))).encode()).hexdigest() for d, t in data}
    assert {r.doc_id: r.ids_sha256 for r in bpe.encode(twice, codec, ids=False).collect()} == want
    want = {d: (len(x), zlib.crc32(x.tobytes())) for (d, _), x in zip(data, library_ids("byte_bpe_50k.json", data))}
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in wavelet.token_files(twice, wavelet.TokenFileParams(P.path("byte_bpe_50k.json"))).collect()} == want
    check_packing(packing.pack(twice, packing.PackingParams(P.path("word_bpe_49k.json"))).collect(), data, library_ids("word_bpe_49k.json", data), 4096)
