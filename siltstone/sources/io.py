"""Readers and writers by file extension, keyed tables, and corpus statistics."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .csv_ranges import read_csv

_EXTENSIONS = {".txt": "text", ".csv": "csv", ".json": "json", ".jsonl": "jsonl", ".md": "whole", ".parquet": "parquet", ".yaml": "yaml", ".yml": "yaml", ".xlsx": "xlsx"}


#: How a null stands in CSV files, so that it isn't an empty string.
NULL_MARK = "\\N"


def kind_of(path: str) -> str:
    extension = os.path.splitext(path.rstrip("/"))[1].lower()
    if extension not in _EXTENSIONS:
        raise ValueError(f"unsupported file type: {extension or path}")
    return _EXTENSIONS[extension]


def read(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """The file or folder at path as a DataFrame, by its extension.

    .txt: lines (value), cut at line feeds; .md: whole files (value); .csv with header, read by byte ranges; .json: one document a file; .jsonl: one a line. Give a
    schema for large inputs: it saves the pass that infers one. .yaml and .xlsx are read on the driver and need their libraries.
    """
    kind, reader = kind_of(path), spark.read if schema is None else spark.read.schema(schema)
    if kind == "text":
        return spark.read.text(path, lineSep="\n")
    if kind == "whole":
        return spark.read.text(path, wholetext=True)
    if kind == "csv":
        return read_csv(spark, path, schema, nullValue=NULL_MARK, emptyValue="")
    if kind == "json":
        return reader.json(path, multiLine=True)
    if kind == "jsonl":
        return reader.json(path)
    if kind == "parquet":
        return reader.parquet(path)
    if kind == "yaml":
        import yaml

        text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
        data = yaml.safe_load(text)
        return spark.read.json(spark.sparkContext.parallelize([json.dumps(x) for x in (data if isinstance(data, list) else [data])]))
    import pandas

    return spark.createDataFrame(pandas.read_excel(path))


def write(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """df at path by its extension; mode append or overwrite. Spark writes a folder of part files."""
    kind, writer = kind_of(path), df.write.mode(mode)
    if kind in ("text", "whole"):
        writer.text(path)
    elif kind == "csv":
        writer.csv(path, header=True, escape='"', nullValue=NULL_MARK, emptyValue="")
    elif kind in ("json", "jsonl"):
        writer.json(path)
    elif kind == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"can't write {kind}")


def flatten_values(df: DataFrame) -> DataFrame:
    """Arrays, structs and maps as JSON strings, for stores of plain columns; empty strings become null."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            c = F.to_json(c)
        elif isinstance(f.dataType, T.StringType):
            c = F.nullif(c, F.lit(""))
        out.append(c.alias(f.name))
    return df.select(out)


def with_file_name(df: DataFrame, name: str = "doc_name") -> DataFrame:
    """The stem of the file, or of the folder that Spark wrote in its place, that each row was read from."""
    return df.withColumn(name, F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?(?:/[^/]*=[^/]*)*(?:/part-[^/]*)?$", 1))


def skip_stems(df: DataFrame, ending: str, name: str = "stem") -> DataFrame:
    """df with its files' stems, without those that end so."""
    return with_file_name(df, name).filter(~F.col(name).endswith(ending))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of one Parquet file, or of all that lie below a folder; a column that some lack is null there."""
    return spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").parquet(path)


def united(frames: list[DataFrame]) -> DataFrame:
    """All rows under the union of the frames' columns, in the order of their names, as plain values: nested ones as JSON, '' as null."""
    whole = None
    for one in frames:
        flat = flatten_values(one)
        whole = flat if whole is None else whole.unionByName(flat, allowMissingColumns=True)
    return whole.select(*[F.col(f"`{c}`") for c in sorted(whole.columns)])


def read_graph_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (name) and edges (src, tgt, type, chunk_id) of a CSV with header; columns count by place: head, tail, type, any, chunk.

    Rows in which one of those four is empty are left out; nodes are distinct.
    """
    rows = read_csv(spark, path, infer=False)
    rows = rows.toDF(*[f"_{i}" for i in range(len(rows.columns))])
    full = rows.select(*[F.trim(f"_{i}").alias(c) for i, c in ((0, "src"), (1, "tgt"), (2, "type"), (4, "chunk_id"))])
    full = full.filter(" AND ".join(f"{c} IS NOT NULL AND {c} <> ''" for c in full.columns))
    nodes = full.select(F.explode(F.array("src", "tgt")).alias("name")).distinct()
    return nodes, full


def corpus_of(spark: SparkSession, path: str, schema: str = "hash_code string, text string") -> DataFrame:
    """doc_name, hash_code, text of all JSONL files in a folder."""
    return with_file_name(spark.read.schema(schema).json(f"{path.rstrip('/')}/*.jsonl"))


def chunk_texts(corpus: DataFrame) -> DataFrame:
    """hash_code, text: one text for each hash code, of several the smallest."""
    return corpus.groupBy("hash_code").agg(F.min("text").alias("text"))


def triple_records(rows: DataFrame, kind: str = "PERSON") -> tuple[DataFrame, DataFrame]:
    """Entities (entity_name, entity_type, description, source_id) and relations (src, tgt, description, weight, source_id) of rows (triple, source_id); a triple is head, relation and tail between tabs, in <> or not."""
    parts = F.transform(F.split("triple", "\t"), lambda x: F.regexp_replace(F.trim(x), r"^<|>$", ""))
    t = rows.select(parts.alias("p"), "source_id").filter("size(p) = 3").select(*[F.get("p", F.lit(i)).alias(c) for i, c in enumerate(("src", "relation", "tgt"))], "source_id")
    ends = t.select(F.explode(F.array("src", "tgt")).alias("entity_name"), "source_id").distinct()
    entities = ends.select("entity_name", F.lit(kind).alias("entity_type"), F.lit("").alias("description"), "source_id")
    return entities, t.select("src", "tgt", F.col("relation").alias("description"), F.lit(1.0).alias("weight"), "source_id")


def find_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """path, length, modificationTime of all files under path that match; contents aren't read. Files without a byte aren't listed."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")


def pdf_paths(paths: list[str]) -> list[str]:
    """Those of a list of paths that end in .pdf, in any case."""
    return [p for p in paths if p.lower().endswith(".pdf")]


def put_file(spark: SparkSession, path: str, body: bytes) -> None:
    """A small file on any file system, written from the driver."""
    at, system = _fs(spark, path)
    out = system.create(at, True)
    try:
        out.write(bytearray(body))
    finally:
        out.close()


def next_free_name(taken: list[str], name: str) -> str:
    """name, or with the first number in brackets before its ending under which it isn't taken."""
    stem, extension = os.path.splitext(name)
    numbered = (name if not i else f"{stem}({i}){extension}" for i in range(len(taken) + 1))
    return next(x for x in numbered if x not in taken)


def file_statistics(files: DataFrame) -> DataFrame:
    """n, gb and small (under 100 bytes, too few for a document) of find_files; nothing is deleted."""
    return files.agg(F.count("*").alias("n"), (F.sum("length") / 1e9).alias("gb"), F.sum((F.col("length") < 100).cast("int")).alias("small"))


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _whole_folders(spark: SparkSession, path: str, letter: str) -> list[int]:
    """Numbers of the folders letter<number> below path that were written to the end, ascending."""
    at, system = _fs(spark, path)
    if not system.exists(at):
        return []
    names = [x.getPath().getName() for x in system.listStatus(at)]
    return sorted(int(n[1:]) for n in names if n[:1] == letter and n[1:].isdigit() and system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def _unordered(kind: T.DataType) -> bool:
    """Whether values of a type have no order: maps, and what holds them."""
    if isinstance(kind, T.ArrayType):
        return _unordered(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_unordered(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.MapType, T.VariantType))


class KeyedTable:
    """A key to record table on any file system: the last write of a key wins, and of rows of one key in one write the largest.

    Rows are compared column by column in the order of their names, null below all else; a column that doesn't order counts as
    its JSON. A null key is a key like others. A write adds a segment of one row a key and doesn't touch what is stored; after
    SEGMENTS of them all are merged into the next version's first. One writer at a time; readers of older segments and versions
    aren't disturbed.
    """

    SEGMENTS = 16

    def __init__(self, spark: SparkSession, path: str, key: str = "id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def _version(self) -> int:
        at, system = _fs(self.spark, self.path)
        names = [x.getPath().getName() for x in system.listStatus(at)] if system.exists(at) else []
        return max((int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and _whole_folders(self.spark, f"{self.path}/{n}", "s")), default=0)

    def _segments(self) -> DataFrame | None:
        """All stored rows with the number of their segment, _s."""
        version, out = self._version(), None
        for n in _whole_folders(self.spark, f"{self.path}/v{version}", "s"):
            one = self.spark.read.parquet(f"{self.path}/v{version}/s{n}").withColumn("_s", F.lit(n))
            out = one if out is None else out.unionByName(one)
        return out

    def load(self) -> DataFrame | None:
        rows, several = self._segments(), len(_whole_folders(self.spark, f"{self.path}/v{self._version()}", "s")) > 1
        if rows is None or not several:
            return None if rows is None else rows.drop("_s")
        columns = [F.col(f"`{c}`") for c in rows.columns if c != "_s"]
        return rows.groupBy(F.col(f"`{self.key}`").alias("_k")).agg(F.max_by(F.struct(*columns), "_s").alias("_r")).select("_r.*")

    def _one_a_key(self, rows: DataFrame) -> DataFrame:
        """The largest row of each key."""
        ordered = [F.to_json(F.struct(f"`{f.name}`")) if _unordered(f.dataType) else F.col(f"`{f.name}`") for f in sorted(rows.schema.fields, key=lambda f: f.name)]
        whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
        return rows.groupBy(F.col(f"`{self.key}`").alias("_k")).agg(F.max_by(whole, F.struct(*[c.alias(f"_{i}") for i, c in enumerate(ordered)])).alias("_r")).select("_r.*")

    def upsert(self, new: DataFrame) -> None:
        """Adds new and replaces rows with its keys."""
        version = self._version()
        numbers = _whole_folders(self.spark, f"{self.path}/v{version}", "s")
        self._one_a_key(new).write.mode("overwrite").parquet(f"{self.path}/v{max(version, 1)}/s{max(numbers, default=0) + 1}")
        if len(numbers) + 1 > self.SEGMENTS:
            self._replace(self.load())

    def _replace(self, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/v{self._version() + 1}/s1")

    def missing(self, keys: DataFrame) -> DataFrame:
        """keys that aren't stored."""
        from siltstone.operators.relational import missing_keys

        rows = self._segments()
        return keys if rows is None else missing_keys(keys, rows.select(self.key), self.key)

    def delete(self, condition: str) -> None:
        old = self.load()
        if old is not None:
            self._replace(old.filter(f"NOT coalesce({condition}, false)"))

    def clear(self) -> None:
        """Deletes all rows; the table stays."""
        self.delete("true")

    def drop(self) -> bool:
        """Deletes the table; whether there was one."""
        at, system = _fs(self.spark, self.path)
        return system.delete(at, True)


class VectorTable:
    """A collection of rows with a key and a vector of a fixed size, searched exactly (flat, cosine)."""

    def __init__(self, spark: SparkSession, path: str, dim: int, key: str = "vec_id", vector: str = "embedding"):
        self.dim, self.key, self.vector, self.table = dim, key, vector, KeyedTable(spark, path, key)

    def insert(self, rows: DataFrame) -> None:
        """Adds rows; those whose vector hasn't the table's size are refused, all or none."""
        if not rows.filter(F.coalesce(F.size(self.vector), F.lit(-1)) != self.dim).isEmpty():
            raise ValueError(f"vectors must have {self.dim} values")
        self.table.upsert(rows)

    def insert_missing(self, rows: DataFrame) -> None:
        """Adds rows whose key isn't stored."""
        self.insert(self.table.missing(rows))

    def search(self, query: list[float], k: int, where: str = "true") -> DataFrame:
        from siltstone.operators.search import search

        return search(self.table.load().filter(where), query, k, self.vector, self.key)

    def delete(self, condition: str) -> None:
        self.table.delete(condition)

    def drop(self) -> bool:
        return self.table.drop()


def create_table(spark: SparkSession, name: str, columns: str, path: str) -> None:
    """A Parquet table of the session's catalog at path, if it isn't there; its database too."""
    if "." in name:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {name.rsplit('.', 1)[0]}")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet LOCATION '{path}'")


def delete_all(spark: SparkSession, name: str) -> None:
    """Empties a table of the catalog."""
    spark.createDataFrame([], spark.table(name).schema).write.insertInto(name, overwrite=True)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
