"""CSV files with line breaks in quotes: many tasks give what one task gives."""

import csv
import io
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.sources import csv_ranges as R


def put(path, rows, ending="\n", last=True):
    out = io.StringIO()
    csv.writer(out, lineterminator=ending).writerows(rows)
    text = out.getvalue()
    with open(path, "w", newline="") as f:
        f.write(text if last else text.removesuffix(ending))
    return f"file://{path}"


def random_rows(n, seed):
    rng = np.random.default_rng(seed)
    bits = ["a", "b,", '"', "\n", "x\ny", " ", "é", "1", '""', "\n\n"]
    return [[str(i), "".join(rng.choice(bits, rng.integers(1, 12))) + ".", str(rng.integers(100))] for i in range(n)]


def plain(spark, path, **options):
    return sorted(tuple(r) for r in spark.read.csv(path, header=True, multiLine=True, escape='"', **options).collect())


@pytest.fixture
def small_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda n: (spark.conf.set("spark.sql.files.maxPartitionBytes", str(n)), spark.conf.set("spark.sql.files.openCostInBytes", "1"))
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("size, last", [(37, True), (113, True), (113, False), (1000, False), (10**8, True)])
def test_ranges_of_any_size_give_the_same_rows(spark, tmp_path, small_ranges, size, last):
    rows = [["id", "te\nxt", "n"], *random_rows(20 if size < 100 else 60, size)]
    path = put(tmp_path / "x.csv", rows, last=last)
    want = sorted(map(tuple, rows[1:]))
    small_ranges(size)
    got = R.read_csv(spark, path, infer=False)
    assert got.columns == ["id", "te\nxt", "n"]
    assert sorted(map(tuple, got.collect())) == want == plain(spark, path)
    assert size > 1000 or R._lines(spark, path).rdd.getNumPartitions() > 2  # several tasks read the file


def test_a_record_longer_than_many_ranges(spark, tmp_path, small_ranges):
    rows = [["a", "b"], ["1", "long\n" * 300], ["2", "x"], ["3", '"\n' * 100], ["4", "y"]]
    path = put(tmp_path / "x.csv", rows)
    small_ranges(64)
    assert sorted(map(tuple, R.read_csv(spark, path, infer=False).collect())) == sorted(map(tuple, rows[1:]))


def test_several_files_types_and_nulls(spark, tmp_path, small_ranges):
    for k in range(3):
        put(tmp_path / f"{k}.csv", [["k", "t", "x"], *[[str(100 * k + i), f"line\n{i}", ""] for i in range(20)]], ending="\r\n" if k == 1 else "\n")
    path = f"file://{tmp_path}"
    small_ranges(50)
    got = R.read_csv(spark, path, emptyValue="", nullValue="\\N")
    assert dict(got.dtypes)["k"] == "int" and dict(got.dtypes)["t"] == "string"
    assert sorted((r.k, r.t) for r in got.collect()) == [(100 * k + i, f"line\n{i}") for k in range(3) for i in range(20)]
    own = R.read_csv(spark, path, "k long, t string, x string")
    assert own.schema.simpleString() == "struct<k:bigint,t:string,x:string>" and own.agg(F.sum("k")).first()[0] == sum(100 * k + i for k in range(3) for i in range(20))


def test_empty_files_and_headers_alone(spark, tmp_path):
    open(tmp_path / "none.csv", "w").close()
    assert R.read_csv(spark, f"file://{tmp_path}/none.csv", "a int").count() == 0
    assert R.read_csv(spark, f"file://{tmp_path}/none.csv").columns == []
    head = R.read_csv(spark, put(tmp_path / "head.csv", [["a", "b", ""]]))
    assert head.columns == ["a", "b", "_c2"] and head.count() == 0
    plain_one = R.read_csv(spark, put(tmp_path / "nohead.csv", [["1", "x"], ["2", "y\nz"]]), header=False)
    assert sorted(map(tuple, plain_one.collect())) == [(1, "x"), (2, "y\nz")]


def test_each_byte_range_is_read_by_its_own_task(spark, tmp_path, small_ranges):
    path = put(tmp_path / "x.csv", [["a", "b"], *[[str(i), "q\n" * (i % 5)] for i in range(20_000)]])
    small_ranges(os.path.getsize(tmp_path / "x.csv") // 16)
    starts = R.range_starts(R._lines(spark, path)).collect()
    assert len(starts) >= 16 and any(r.inside for r in starts) and not all(r.inside for r in starts)
    assert R.read_csv(spark, path, "a int, b string").agg(F.sum("a")).first()[0] == sum(range(20_000))
