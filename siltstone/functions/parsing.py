"""Parsers of model output and names that built-in expressions can't express: Arrow-batched functions over whole columns."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def first_object(text: str | None) -> str | None:
    """The first complete JSON object in text, by a stack of braces outside of strings; None without one."""
    depth, start, inside, skip = 0, None, False, False
    for i, c in enumerate(text or ""):
        if skip:
            skip = False
        elif inside:
            inside, skip = c != '"', c == "\\"
        elif c == '"':
            inside = depth > 0
        elif c == "{":
            start, depth = (i if depth == 0 else start), depth + 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                try:
                    return json.dumps(json.loads(text[start : i + 1].replace("\n", "")), ensure_ascii=False)
                except ValueError:
                    start = None
    return None


def scalar(raw: str):
    """A JSON null, boolean (in any case), number or string as its value; anything else as the text without outer quotes."""
    raw = raw.strip()
    try:
        value = json.loads(raw.lower() if raw.lower() in ("null", "true", "false") else raw)
    except ValueError:
        return raw.strip('"')
    return raw if isinstance(value, (list, dict)) else value


class _Pairs:
    """Reads key: value pairs out of text that is nearly JSON, one character after the other."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def _upto(self, stops: str) -> str:
        """What stands before the next of stops, which is passed."""
        start = self.at
        while self.at < len(self.text) and self.text[self.at] not in stops:
            self.at += 1
        self.at += 1
        return self.text[start : self.at - 1]

    def _blank(self) -> str:
        """The next character that isn't white space; empty at the end."""
        while self.text[self.at : self.at + 1].isspace():
            self.at += 1
        return self.text[self.at : self.at + 1]

    def _inner(self) -> str:
        """What stands between the brace here and the one that closes it, or the end."""
        start, depth = self.at + 1, 0
        while self.at < len(self.text):
            depth += {"{": 1, "}": -1}.get(self.text[self.at], 0)
            self.at += 1
            if not depth:
                return self.text[start : self.at - 1]
        return self.text[start:]

    def read(self) -> dict:
        out: dict = {}
        while self.at < len(self.text):
            words = self._upto(":").replace('"', " ").replace("{", " ").replace(",", " ").split()  # the key is the last word before a colon
            if self.at > len(self.text) or not words:
                continue
            here = self._blank()
            if here == "{":
                out[words[-1]] = _Pairs(self._inner()).read()
            elif here == '"':
                self.at += 1
                out[words[-1]] = self._upto('"')
            else:
                out[words[-1]] = scalar(self._upto(",}"))
        return out


def lenient_object(text: str | None) -> dict:
    """Key: value pairs of malformed JSON: the last word before each colon, and an object in braces, a quoted string, or what stands up to a comma or brace."""
    return _Pairs(text or "").read()


def lenient_json(text: str | None) -> str:
    """lenient_object as JSON."""
    return json.dumps(lenient_object(text), ensure_ascii=False)


def object_or_pairs(text: str | None) -> str | None:
    """The first complete object, else what lenient_object finds, as JSON; None if there is neither."""
    found = first_object(text)
    if found is not None:
        return found
    pairs = lenient_object(text)
    return json.dumps(pairs, ensure_ascii=False) if pairs else None


def extract_names(text: str | None, names: list[str]) -> list[str]:
    """Names in text, the longest first; each one found is taken out before the next is looked for."""
    out = []
    for name in sorted(set(names), key=lambda n: (-len(n), n)):
        found = re.search(re.escape(name) + r"(?:\W|$)", text or "", re.I)
        if found:
            out.append(name)
            text = re.sub(re.escape(name) + r"(?=\W|$)", "", text, flags=re.I)
    return out


def rewrite_citations(text: Column, numbers: dict[str, int]) -> Column:
    """[source] marks as [n]; unknown ones are taken out; links with an address stay. numbers: a few sources."""
    for source, n in numbers.items():
        text = F.replace(text, F.lit(f"[{source}]"), F.lit(f"\x01{n}\x02"))
    return F.translate(F.regexp_replace(text, r"\[[^\]\[]+\](?!\()", ""), "\x01\x02", "[]")


def by_batches(f, kind: str, **fixed):
    """A column function that applies f to each value."""

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([f(v, **fixed) for v in values.where(values.notna(), None)], dtype=object)

    return run


def json_object(text: Column) -> Column:
    return by_batches(object_or_pairs, "string")(text)


def names_in(text: Column, names: list[str]) -> Column:
    """array<string>; names: a list that fits the driver, sent to the workers with the function."""
    return by_batches(extract_names, "array<string>", names=names)(text)


def cluster_summary(text: Column) -> Column:
    """struct(entity_name, entity_description, findings array<struct(summary, explanation)>) of an answer with numbered findings."""
    name = F.regexp_extract(text, r"[Aa]ggregate[ _]entity[ _]?(?:name)?:\s*([^\n]+)", 1)
    description = F.regexp_extract(text, r"[Dd]escription:\s*([^\n]+)", 1)
    heads = F.regexp_extract_all(text, F.lit(r"(?m)^\s*(?:finding |summary )?\d+[.:]\s*([^\n:]+):\s*([^\n]+)"), F.lit(1))
    bodies = F.regexp_extract_all(text, F.lit(r"(?m)^\s*(?:finding |summary )?\d+[.:]\s*([^\n:]+):\s*([^\n]+)"), F.lit(2))
    findings = F.transform(F.arrays_zip(heads.alias("a"), bodies.alias("b")), lambda x: F.struct(F.trim(x["a"]).alias("summary"), F.trim(x["b"]).alias("explanation")))
    return F.struct(F.trim(name).alias("entity_name"), F.trim(description).alias("entity_description"), findings.alias("findings"))


def on_word_boundary(text: Column, start: Column, end: Column) -> Column:
    """Whether no word character stands right before start (from 0) or at end."""
    word = r"^(?U)\w$"
    before, after = F.substring(text, start, F.lit(1)), F.substring(text, end + 1, F.lit(1))
    return ~(F.coalesce((start > 0) & before.rlike(word), F.lit(False))) & ~F.coalesce(after.rlike(word), F.lit(False))


def tile_grid(width: Column, height: Column, most: int = 12) -> Column:
    """struct(columns, rows) with at most most tiles whose shape is nearest to width over height; of equals the one with fewest tiles."""
    grids = sorted(((c, r) for c in range(1, most + 1) for r in range(1, most + 1) if c * r <= most), key=lambda g: (g[0] * g[1], g))
    shape = width / height
    options = F.array(*[F.struct(F.abs(shape - F.lit(c / r)).alias("far"), F.lit(c * r).alias("n"), F.lit(c).alias("columns"), F.lit(r).alias("rows")) for c, r in grids])
    return _once(F.array_min(options), lambda best: F.struct(best["columns"].alias("columns"), best["rows"].alias("rows")))


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once a row, however often then uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def tile_boxes(grid: Column, size: int) -> Column:
    """array<struct(left, top, right, bottom)> of a grid's tiles, row by row."""

    def boxes(g: Column) -> Column:
        left = lambda i: (i % g["columns"]) * size
        top = lambda i: F.floor(i / g["columns"]).cast("int") * size
        return F.transform(F.sequence(F.lit(0), g["columns"] * g["rows"] - 1), lambda i: F.struct(left(i).alias("left"), top(i).alias("top"), (left(i) + size).alias("right"), (top(i) + size).alias("bottom")))

    return _once(grid, boxes)
