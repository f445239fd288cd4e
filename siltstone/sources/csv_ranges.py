"""CSV files with line breaks inside quotes, read by many tasks at once.

Spark reads a multi-line CSV file in one task, as a byte range doesn't show whether it begins inside quotes. Here each byte
range counts its quotes first; the parities of the ranges before it in its file then tell how it begins. Lines are put
together to records from the true starts; a record that lies across ranges is put together from their ends. Spark's own
parser then reads each record.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.session import importable

WHOLE, HEAD, TAIL = 0, 1, 2


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Array]]:
    """(file, start of the byte range, lines): the lines of a range are in the file's order, in one run or several that follow each other."""
    for b in batches:
        if not b.num_rows:
            continue
        path, start = b.column("path").dictionary_encode(), b.column("start").to_numpy()
        code = path.indices.to_numpy()
        new = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (start[1:] != start[:-1])]))
        for i, j in zip(new, np.append(new[1:], len(code))):
            yield path.dictionary[code[i]].as_py(), int(start[i]), b.column("value").slice(i, j - i)


def _quotes(lines: pa.Array, quote: str) -> np.ndarray:
    return pc.count_substring(lines, quote).to_numpy(zero_copy_only=False).astype(np.int64)


def range_starts(lines: DataFrame, quote: str = '"') -> DataFrame:
    """path, start, inside: whether each byte range begins inside quotes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], int] = {}
        for path, start, part in _runs(batches):
            seen[path, start] = seen.get((path, start), 0) + int(_quotes(part, quote).sum())
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in seen], pa.string()), pa.array([s for _, s in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())], ["path", "start", "n"])

    counts = lines.mapInArrow(run, "path string, start long, n long")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row a byte range
    return counts.select("path", "start", (F.coalesce(F.sum("n").over(before), F.lit(0)) % 2 == 1).alias("inside"))


def _parts(lines: DataFrame, inside: set[tuple[str, int]], quote: str) -> DataFrame:
    """path, start, kind, first, text: records that lie in a range, and the ends of those that don't. first: the file's first record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, odd, held, tail, fresh = None, 0, [], False, False

        def row(kind: int, first: bool) -> pa.RecordBatch:
            return _batch([here[0]], [here[1]], [kind], [first], ["\n".join(held)])

        def close() -> Iterator[pa.RecordBatch]:
            if held:  # open at the range's end
                yield row(TAIL if tail else HEAD, fresh and not tail)

        for path, start, part in _runs(batches):
            if (path, start) != here:
                yield from close()
                here, held = (path, start), []
                odd = int(here in inside)
                tail, fresh = bool(odd), start == 0
            ends = (odd + np.cumsum(_quotes(part, quote))) % 2
            begins = np.concatenate([[odd], ends[:-1]]) == 0
            odd = int(ends[-1])
            at = np.flatnonzero(begins)
            if held or not len(at) or at[0]:  # goes on with what is open
                n = int(at[0]) if len(at) else len(part)
                held += part.slice(0, n).to_pylist()
                if n == len(part) and odd:
                    continue
                if held:
                    yield row(TAIL if tail else WHOLE, fresh and not tail)
                    held, fresh, tail = [], fresh and tail, False
                if n == len(part):
                    continue
            tail = False
            size = np.diff(np.append(at, len(part)))
            if odd:  # the last record is still open
                held, at, size = part.slice(int(at[-1])).to_pylist(), at[:-1], size[:-1]
            if len(at):
                if (size == 1).all():
                    texts = part.slice(int(at[0]), len(at))
                else:
                    body = part.to_pylist()
                    texts = pa.array(["\n".join(body[i : i + n]) for i, n in zip(at.tolist(), size.tolist())], pa.string())
                first = np.zeros(len(at), bool)
                first[0], fresh = fresh, False
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(at), pa.string()), pa.array(np.full(len(at), start)), pa.array(np.full(len(at), WHOLE, np.int32)), pa.array(first), texts], NAMES)
        yield from close()

    return lines.mapInArrow(run, "path string, start long, kind int, first boolean, text string")


NAMES = ["path", "start", "kind", "first", "text"]


def _batch(*columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()))], NAMES)


def records(spark: SparkSession, path: str | list[str], quote: str = '"') -> DataFrame:
    """path, first, text: all records of CSV files, line breaks inside quotes kept as line feeds.

    A quote within quotes is doubled, and an unquoted field holds none; else the count of quotes says nothing. The driver holds
    a line for each byte range that begins inside quotes.
    """
    lines = _lines(importable(spark), path)
    inside = {(r.path, r.start) for r in range_starts(lines, quote).filter("inside").collect()}
    parts = _parts(lines, inside, quote)
    whole = parts.filter(F.col("kind") == WHOLE).select("path", "first", "text")
    if not inside:
        return whole
    cut = parts.filter(F.col("kind") != WHOLE)
    number = F.max(F.when(F.col("kind") == HEAD, F.col("start"))).over(Window.partitionBy("path").orderBy("start", F.desc("kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    spans = cut.withColumn("_own", number).groupBy("path", "_own").agg(F.max("first").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return whole.unionByName(spans.select("path", "first", "text"))


def _names(header: str, sep: str) -> list[str]:
    found = next(csv.reader(io.StringIO(header, newline=""), delimiter=sep), [])
    found = [n or f"_c{i}" for i, n in enumerate(found)]
    low = [n.lower() for n in found]
    return [n if low.count(n.lower()) == 1 else f"{n}{i}" for i, n in enumerate(found)]


def read_csv(spark: SparkSession, path: str | list[str], schema: str | T.StructType | None = None, header: bool = True, infer: bool = True, **options) -> DataFrame:
    """CSV files as ``spark.read.csv(multiLine=True)`` gives them, by many tasks a file.

    Every file has a header if header is set; the names are those of the first file by path; with a schema, columns count by place. Other options go to Spark's parser. Lines
    end with a line feed, or with a carriage return before it. Rows don't know their file (``records`` does).
    """
    options = {"escape": '"'} | options
    found = records(spark, path, options.get("quote", '"'))
    body, names = found, None
    if header:
        top = found.filter("first").orderBy("path").select("text").first()
        names = _names(top.text.removeprefix("\ufeff").rstrip("\r"), options.get("sep", ",")) if top else []
        body = found.filter("NOT first")
    text = F.regexp_replace(F.regexp_replace("text", "\r$", ""), "\r\n", "\n")
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    elif infer:
        reader = reader.option("inferSchema", True)
    if schema is None and (names == [] or (names and body.isEmpty())):  # nothing to infer from
        return spark.createDataFrame([], T.StructType([T.StructField(n, T.StringType()) for n in names]))
    strings = getattr(body.select(text.alias("value"))._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    out = DataFrame(reader._jreader.csv(strings), spark)
    if schema is not None or names is None:
        return out
    kept = [_column(out, i, n) for i, n in enumerate(names)]
    return out.select(*kept)


def _column(df: DataFrame, i: int, name: str) -> Column:
    return (F.col(df.columns[i]) if i < len(df.columns) else F.lit(None).cast("string")).alias(name)
