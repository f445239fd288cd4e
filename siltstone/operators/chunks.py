"""Chunkers: one row to many rows. Fixed steps are sequences and slices; data-dependent ones run over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from siltstone.functions.text import tokens
from siltstone.session import importable

from .graph import settled
from .relational import running


def by_tokens(df: DataFrame, text: str, size: int, overlap: int, keep: list[str], words: Column | None = None) -> DataFrame:
    """keep, chunk_no, n_tokens, chunk: windows of size tokens, each size - overlap after the last; short ones at the end stay."""
    own = df.select(*keep, (tokens(F.col(text)) if words is None else words).alias("_t")).filter(F.size("_t") > 0)
    own = own.select(*keep, "_t", F.posexplode(F.sequence(F.lit(0), F.size("_t") - 1, F.lit(size - overlap))).alias("chunk_no", "_at"))
    part = F.slice("_t", F.col("_at") + 1, size)
    return own.select(*keep, "chunk_no", F.size(part).alias("n_tokens"), F.array_join(part, " ").alias("chunk"))


def by_fixed_tokens(df: DataFrame, text: str, size: int, overlap: int, keep: list[str]) -> DataFrame:
    """As by_tokens, but no window starts where the one before already reached the end."""
    own = df.select(*keep, tokens(F.col(text)).alias("_t")).filter(F.size("_t") > 0)
    count = F.greatest(F.lit(1), F.ceil((F.size("_t") - overlap) / (size - overlap))).cast("int")
    own = own.select(*keep, "_t", F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk_no"))
    part = F.slice("_t", F.col("chunk_no") * (size - overlap) + 1, size)
    return own.select(*keep, "chunk_no", F.size(part).alias("n_tokens"), F.array_join(part, " ").alias("chunk"))


def by_chars(df: DataFrame, text: str, limit: int, overlap: int, keep: list[str]) -> DataFrame:
    """keep, chunk_id (from 1), chunk: windows of limit characters."""
    own = df.filter(F.length(text) > 0).select(*keep, F.col(text).alias("_x"), F.posexplode(F.sequence(F.lit(0), F.length(text) - 1, F.lit(limit - overlap))).alias("_n", "_at"))
    return own.select(*keep, (F.col("_n") + 1).alias("chunk_id"), F.substring(F.col("_x"), F.col("_at") + 1, F.lit(limit)).alias("chunk"))


def by_paragraph(df: DataFrame, text: str, keep: list[str], mark: str = "\n\n") -> DataFrame:
    """keep, pos, paragraph: trimmed non-empty parts between marks."""
    own = df.select(*keep, F.posexplode(F.split(text, mark)).alias("pos", "_x"))
    return own.select(*keep, "pos", F.trim("_x").alias("paragraph")).filter("paragraph <> ''")


def by_headers(df: DataFrame, text: str, key: str, least: int = 1, most: int = 6) -> DataFrame:
    """key, section, level, header, content: Markdown sections by headers of levels least to most.

    Lines before the first header make a section of level 0. A header needs a blank after its signs; content is trimmed.
    """
    least, most = max(1, min(6, least)), max(max(1, min(6, least)), min(6, most))
    lines = df.filter(F.trim(text) != "").select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    sign = F.regexp_extract(F.trim("line"), rf"^(#{{{least},{most}}}) ", 1)
    lines = lines.withColumn("level", F.length(sign))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("section", F.sum((F.col("level") > 0).cast("int")).over(w))
    header = F.max(F.when(F.col("level") > 0, F.trim(F.expr("substring(trim(line), level + 2)"))))
    body = F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("pos", "line"))))
    text_of = F.regexp_replace(F.array_join(F.transform(body, lambda x: x["line"]), "\n"), r"^\s+|\s+$", "")
    return lines.groupBy(key, "section").agg(F.max("level").alias("level"), F.coalesce(header, F.lit("")).alias("header"), text_of.alias("content"))


def fill_pages(df: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """doc, page, text for pages 1 to each document's last, missing ones empty."""
    last = df.groupBy(doc).agg(F.max(page).alias("_last")).select(doc, F.explode(F.sequence(F.lit(1), F.col("_last"))).alias(page))
    return last.join(df.select(doc, page, text), [doc, page], "left").withColumn(text, F.coalesce(text, F.lit("")))


#: Characters after which a chunk may end, by language.
STOPS = {"en": " \n\t.,!?", "zh": "。，！？；：\n "}


def split_by_size(text: str, size: int, overlap: int, stops: str) -> list[str]:
    """Pieces of at most size characters that end after a stop if there is one; each begins overlap before the last one's end.

    A piece always begins after the one before, so that this ends.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            stop = max(text.rfind(c, start, end) for c in stops)
            end = stop + 1 if stop > start else end
        out.append(text[start:end])
        if end >= len(text):
            break
        start = max(end - overlap, start + 1)
    return out


def recursive_split(text: str, size: int, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Pieces of at most size characters, cut at the first separator that makes them small enough, merged greedily."""
    if len(text) <= size:
        return [text] if text else []
    mark = next((s for s in separators if s == "" or s in text), "")
    rest = separators[separators.index(mark) + 1 :] or ("",)
    if mark == "":
        return [text[i : i + size] for i in range(0, len(text), size)]
    out, held = [], ""
    for part in text.split(mark):
        joined = held + mark + part if held else part
        if len(joined) <= size:
            held = joined
            continue
        if held:
            out.append(held)
        smaller = recursive_split(part, size, rest) if len(part) > size else [part]
        out += smaller[:-1]
        held = smaller[-1] if smaller else ""
    return [*out, held] if held else out


#: Characters of chunks that are sent on together, and what a chunk counts besides its own.
HELD_CHARS, CHUNK_COST = 1 << 20, 100


def cut_batches(text: str, keep: list[str], cut):
    """The Arrow function of by_function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers, chunks, held = [], [], [], 0
            texts = batch.column(text)
            for i in range(batch.num_rows):
                # One text at a time is a Python string, and chunks go out by the megabyte, so a worker holds no more with more rows.
                for n, c in enumerate(cut(x) if (x := texts[i].as_py()) else []):
                    rows.append(i), numbers.append(n), chunks.append(c)
                    held += len(c) + CHUNK_COST
                    if held >= HELD_CHARS:
                        yield made(batch, rows, numbers, chunks)
                        rows, numbers, chunks, held = [], [], [], 0
            if rows:
                yield made(batch, rows, numbers, chunks)

    def made(batch: pa.RecordBatch, rows: list[int], numbers: list[int], chunks: list[str]) -> pa.RecordBatch:
        index = pa.array(rows, pa.int64())
        return pa.RecordBatch.from_arrays([*(batch.column(k).take(index) for k in keep), pa.array(numbers, pa.int32()), pa.array(chunks, pa.string())], [*keep, "chunk_no", "chunk"])

    return run


def by_function(df: DataFrame, text: str, keep: list[str], cut) -> DataFrame:
    """keep, chunk_no, chunk for every string of cut(text); cut is a function of one string."""
    own = df.select(*keep, text)
    fields = [own.schema[k] for k in keep] + [T.StructField("chunk_no", T.IntegerType()), T.StructField("chunk", T.StringType())]
    return own.mapInArrow(cut_batches(text, keep, cut), T.StructType(fields))


def semantic_breaks(df: DataFrame, key: str, pos: str, vector: str, percent: float = 0.95, kind: str = "percentile", amount: float | None = None) -> DataFrame:
    """key, pos, group: consecutive sentences, with a new group where the distance to the one before is above a bound of its document.

    kind: percentile (of the distances), deviation (their mean and amount, 3 if not given, standard deviations), quartiles
    (their mean and amount, 1.5, times the range between the quartiles), or gradient: the percentile of the distances' slopes,
    which are compared in their place. A document of one distance has no slope, and so no break.
    """
    from siltstone.functions.vectors import cosine

    w = Window.partitionBy(key).orderBy(pos)
    far = df.withColumn("_d", 1 - cosine(F.col(vector), F.lag(vector).over(w)))
    mean, last = F.avg("_d"), F.col("_d")
    if kind == "gradient":
        before, after = F.lag("_d").over(w), F.lead("_d").over(w)
        slope = F.when(before.isNull(), after - F.col("_d")).when(after.isNull(), F.col("_d") - before).otherwise((after - before) / 2)
        far, last = far.withColumn("_s", F.when(F.col("_d").isNotNull(), slope)), F.col("_s")
    bounds = {
        "percentile": F.percentile("_d", percent), "deviation": mean + (3 if amount is None else amount) * F.stddev_pop("_d"),
        "quartiles": mean + (1.5 if amount is None else amount) * (F.percentile("_d", 0.75) - F.percentile("_d", 0.25)), "gradient": F.percentile(last, percent),
    }
    cut = far.groupBy(key).agg(bounds[kind].alias("_cut"))
    far = far.join(cut, key).withColumn("_new", F.coalesce(last > F.col("_cut"), F.lit(False)).cast("int"))
    return far.withColumn("group", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).select(key, pos, "group")


def semantic_chunks(df: DataFrame, key: str, pos: str, text: str, vector: str, size: int, **how) -> DataFrame:
    """key, group, chunk_no, chunk: sentences of each group joined by blanks; one of more than twice size tokens is cut again, to size at most."""
    groups = semantic_breaks(df, key, pos, vector, **how).join(df.select(key, pos, text), [key, pos])
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, text))), lambda x: x[text]), " ")
    joined = groups.groupBy(key, "group").agg(whole.alias("_text"))
    long = F.size(tokens(F.col("_text"))) > 2 * size
    small = joined.filter(~long).select(key, "group", F.lit(0).alias("chunk_no"), F.col("_text").alias("chunk"))
    cut = by_tokens(joined.filter(long), "_text", size, 0, [key, "group"]).select(key, "group", "chunk_no", "chunk")
    return small.unionByName(cut)


def separator_chunks(tokens: list[str], separators: list[list[str]], size: int, overlap: int) -> list[list[str]]:
    """Chunks of at most size tokens that end after separators where they can.

    Tokens are cut after each separator, neighbouring parts put together while they fit, and each chunk but the first begins
    with the last overlap tokens of the chunk before, cut at size. If all is one part longer than size, it is cut into windows
    of size, overlap shared, and a last window that holds nothing new is left out.
    """
    by_first: dict[str, list[list[str]]] = {}
    for s in separators:
        by_first.setdefault(s[0], []).append(s)
    edges, i = [], 0
    while i < len(tokens):
        hit = next((s for s in by_first.get(tokens[i], ()) if tokens[i : i + len(s)] == s), None)
        i += len(hit) if hit else 1
        if hit:
            edges.append(i)
    if tokens and (not edges or edges[-1] < len(tokens)):
        edges.append(len(tokens))
    starts = [0]
    for before, edge in zip(edges, edges[1:]):
        if edge - starts[-1] > size:
            starts.append(before)
    if len(starts) == 1 and len(tokens) > size:
        return [tokens[a : a + size] for a in range(0, len(tokens), size - overlap) if min(size, len(tokens) - a) > overlap]
    spans = list(zip(starts, [*starts[1:], len(tokens)])) if tokens else []
    return [tokens[max(a - overlap, spans[n - 1][0]) if n else a : b][: size if n and overlap else None] for n, (a, b) in enumerate(spans)]


def by_separators(df: DataFrame, text: str, keep: list[str], separators: list[list[str]], size: int, overlap: int) -> DataFrame:
    """keep, chunk_no, chunk by separator_chunks of the text's words."""
    return by_function(df, text, keep, lambda x: [" ".join(c) for c in separator_chunks(x.split(), separators, size, overlap)])


#: Chunks that start in one block of a whole document, and two primes for sums of word hashes.
BLOCK_CHUNKS, PRIMES = 64, (2147483647, 2147483629)


def _window_keys(hashes: np.ndarray, n: int, most: int) -> np.ndarray:
    """A number of 62 bits for the words inside each window of n words, without its first and last. most: words of the longest block, by which all blocks count alike."""
    count, inner, out = len(hashes) - n + 1, max(0, n - 2), np.zeros(max(0, len(hashes) - n + 1), np.int64)
    for prime, base, shift in ((PRIMES[0], 1000003, 0), (PRIMES[1], 69069, 32)):
        power = np.ones(most + 1, np.uint64)
        done = 1
        while done < len(power):  # powers by doubling
            part = power[:done][: len(power) - done]
            power[done : done + len(part)] = part * np.uint64(pow(base, done, prime)) % np.uint64(prime)
            done += len(part)
        terms = (hashes >> np.uint64(shift)) % np.uint64(prime) * power[: len(hashes)] % np.uint64(prime)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])
        at = np.arange(count) + min(1, inner)
        inside = (sums[at + inner] - sums[at]) % np.uint64(prime) * power[most - at] % np.uint64(prime)
        out = (out << 31) | inside.astype(np.int64)
    return out


def _windows(size: int, step: int, chunks: bool):
    """Rows of blocks (_doc, _block, _total, _pieces) to windows as long as a chunk: those that are chunks, with their text, or all, of equals the first in the block."""

    def block(doc, number: int, total: int, pieces: list) -> Iterator[pa.RecordBatch]:
        words = pc.split_pattern(pa.array([p["_x"] for p in pieces], pa.string()), " ").flatten()
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy()
        hashes = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object))[codes]
        page = np.repeat(np.arange(len(pieces)), [p["_x"].count(" ") + 1 for p in pieces])
        count = max(1, -(-(total - size) // step) + 1)
        last, start = total - (count - 1) * step, number * BLOCK_CHUNKS * step
        for n in {size, last} if count > 1 else {last}:
            keys = _window_keys(hashes, n, BLOCK_CHUNKS * step + size)[: BLOCK_CHUNKS * step]
            if chunks:
                take = np.arange(0, len(keys), step)
                numbers = (take + start) // step
                take = take[(numbers < count) & ((numbers == count - 1) == (n == last) if size != last else True)]
            else:
                take = np.flatnonzero(~pd.DataFrame({"k": keys, "a": codes[: len(keys)], "b": codes[n - 1 : n - 1 + len(keys)]}).duplicated().to_numpy())
            if not len(take):
                continue
            own = {"n": pa.array(np.full(len(take), n, np.int32)), "key": pa.array(keys[take]), "first": words.take(pa.array(take)), "last": words.take(pa.array(take + n - 1))}
            if chunks:
                own |= {"chunk_no": pa.array(((take + start) // step).astype(np.int32)), "chunk": pa.array([" ".join(words[i : i + n].to_pylist()) for i in take], pa.string())}
            else:
                own |= {"at": pa.array(take + start), "_page": pa.array([pieces[i]["page"] for i in page[take]])}
            yield doc, own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.schema.field("doc").type, batch.schema.field("pieces").type.value_type.field("page").type
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                for doc, own in block(one.column("doc"), one.column("block")[0].as_py(), one.column("total")[0].as_py(), one.column("pieces")[0].as_py()):
                    if "_page" in own:
                        own["page"] = own.pop("_page").cast(kinds[1])
                    yield pa.RecordBatch.from_pydict({"doc": doc.take(pa.array(np.zeros(len(own["n"]), np.int64))), **own})

    return run


def by_whole_document(pages: DataFrame, size: int, overlap: int) -> DataFrame:
    """doc, chunk_no, page, chunk of pages (doc, page, text): windows of tokens over all pages in order; page: where the chunk's text first stands in the document.

    A document of any length lies in blocks of so many chunks, each with the words that its last ones need of the next. A text
    equals a chunk where the words between its first and last are the same, its first ends with the chunk's and its last
    starts with the chunk's; so places and chunks are joined by a hash of the words between, and the first place counts.
    """
    importable(pages.sparkSession)
    step, kinds = size - overlap, dict(pages.dtypes)
    span = BLOCK_CHUNKS * step
    own = pages.filter("doc IS NOT NULL").select("doc", "page", F.array_join(tokens(F.col("text")), " ").alias("_x")).filter("_x <> ''").withColumn("_n", F.regexp_count("_x", F.lit(" ")) + 1)
    placed = running(own, ["doc"], ["page", "_x"], F.col("_n"), "_at")
    placed = settled(placed.join(placed.groupBy("doc").agg(F.sum("_n").alias("total")), "doc"), "placed")
    begin, end = F.col("block") * span, (F.col("block") + 1) * span + size
    held = placed.withColumn("block", F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("_at") - size) / span)), F.floor((F.col("_at") + F.col("_n") - 1) / span))))
    low = F.greatest(F.lit(0), begin - F.col("_at"))
    words = F.slice(F.split("_x", " "), (low + 1).cast("int"), F.greatest(F.lit(0), F.least(F.col("_n"), end - F.col("_at")) - low).cast("int"))
    held = held.select("doc", "block", "total", F.struct((F.col("_at") + low).alias("_at"), "page", F.array_join(words, " ").alias("_x")).alias("p")).filter("p._x <> ''")
    blocks = settled(held.groupBy("doc", "block").agg(F.first("total").alias("total"), F.array_sort(F.collect_list("p")).alias("pieces")), "blocks")
    at = f"doc {kinds['doc']}, n int, key long, first string, last string"
    chunks = settled(blocks.mapInArrow(_windows(size, step, True), f"{at}, chunk_no int, chunk string"), "chunks")
    places = blocks.mapInArrow(_windows(size, step, False), f"{at}, at long, page {kinds['page']}")
    same = ["doc", "n", "key"]
    asked = chunks.select(*same, "first", "last").distinct()
    # Chunks are the small side; a sort of all places would spill.
    met = places.join(asked.select(*same).distinct().hint("shuffle_hash"), same, "left_semi").groupBy(*same, "first", "last").agg(F.min(F.struct("at", "page")).alias("p"))
    met = met.withColumnsRenamed({"first": "_first", "last": "_last"}).join(asked, same)
    fits = F.when(F.col("n") == 1, F.contains("_first", F.col("first"))).otherwise(F.endswith("_first", F.col("first")) & F.startswith("_last", F.col("last")))
    first = met.filter(fits).groupBy(*same, "first", "last").agg(F.min("p")["page"].alias("page"))
    return chunks.join(first, [*same, "first", "last"]).select("doc", "chunk_no", "page", "chunk")


def with_table_chunks(texts: DataFrame, tables: DataFrame) -> DataFrame:
    """doc, id, page, type, text: chunks (doc, page, pos, text) and after those of a page its serialised tables (doc, page, table_id, text), numbered through each document."""
    both = texts.select("doc", "page", F.lit("content").alias("type"), "pos", "text").unionByName(tables.select("doc", "page", F.lit("serialized_table").alias("type"), F.col("table_id").alias("pos"), "text"))
    w = Window.partitionBy("doc").orderBy("page", "type", "pos")
    return both.select("doc", (F.row_number().over(w) - 1).alias("id"), "page", "type", "text")


#: Layout of a parsed page.
PAGE_LAYOUT = "blocks array<struct<id: long, bbox: array<double>, lines: array<struct<spans: array<struct<text: string>>>>>>"


def by_layout(pages: DataFrame, keep: list[str], layout: str) -> DataFrame:
    """keep, chunk_id, bbox, text: a chunk for each block with lines of a page's layout (JSON), of all its spans' texts."""
    blocks = pages.select(*keep, F.explode(F.from_json(layout, PAGE_LAYOUT)["blocks"]).alias("b")).filter("b.lines IS NOT NULL")
    text = F.array_join(F.transform(F.flatten(F.transform("b.lines", lambda line: line["spans"])), lambda s: s["text"]), "")
    return blocks.select(*keep, F.col("b.id").alias("chunk_id"), F.col("b.bbox").alias("bbox"), text.alias("text"))


@F.udtf(returnType="chunk_no int, chunk string")
class SplitBySize:
    """Table function: split_by_size(text, size, overlap, stops)."""

    def eval(self, text: str, size: int, overlap: int, stops: str):
        for n, c in enumerate(split_by_size(text, size, overlap, stops) if text else ()):
            yield n, c


@F.udtf(returnType="chunk_no int, chunk string")
class RecursiveSplit:
    """Table function: recursive_split(text, size)."""

    def eval(self, text: str, size: int):
        for n, c in enumerate(recursive_split(text, size) if text else ()):
            yield n, c


@F.udtf
class PackedChunks:
    """Table function over a table with partitions and an order: packed_chunks(TABLE(t) PARTITION BY .. ORDER BY .., name of the text column, size).

    Rows of a partition are put together, in order, to chunks of at most size words, cut nowhere; it gives the partition's key,
    a number, the rows in the chunk and its text. A row of more words is a chunk of its own; rows without words are left out.
    The key is the table's first column. A partition goes through one task, row by row, so its rows should have a bound.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, text: AnalyzeArgument, size: AnalyzeArgument) -> AnalyzeResult:
        key = rows.dataType.fields[0]
        return AnalyzeResult(T.StructType([key, T.StructField("chunk_no", T.IntegerType()), T.StructField("n_rows", T.IntegerType()), T.StructField("chunk", T.StringType())]))

    def __init__(self):
        self.key, self.parts, self.words, self.number = None, [], 0, 0

    def _give(self):
        yield self.key, self.number, len(self.parts), " ".join(self.parts)
        self.parts, self.words, self.number = [], 0, self.number + 1

    def eval(self, row, text: str, size: int):
        self.key = row[0]
        x = row[text]
        n = len(x.split()) if x else 0
        if not n:
            return
        if self.parts and self.words + n > size:
            yield from self._give()
        self.parts.append(x)
        self.words += n

    def terminate(self):
        if self.parts:
            yield from self._give()


def register(spark: SparkSession) -> None:
    """The chunkers as table functions of SQL: split_by_size, recursive_split, packed_chunks."""
    importable(spark)
    for name, f in (("split_by_size", SplitBySize), ("recursive_split", RecursiveSplit), ("packed_chunks", PackedChunks)):
        spark.udtf.register(name, f)
