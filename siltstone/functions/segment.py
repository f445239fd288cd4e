"""Words of Chinese text by a dictionary: the most probable cut, all words that stand in it, and a dictionary learned from texts.

Runs of Chinese characters are cut by dynamic programming over the words that start at each place; a character that starts no
known word stands alone, at the price of a word seen once less than ever. Other scripts are cut into words of letters and digits.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A dictionary of more words isn't sent to the tasks.
MOST_WORDS = 2_000_000
HAN = "一-鿿"
_PARTS = re.compile(rf"[{HAN}]+|[^\W{HAN}]+")


class Dictionary:
    """Words with counts; user words count as the most frequent one."""

    def __init__(self, counts: dict[str, int], user: tuple[str, ...] = ()):
        top = max(counts.values(), default=1)
        self.counts = {w: max(int(n), 1) for w, n in counts.items() if w} | {w: max(counts.get(w, 0), top) for w in user if w}
        self.total = sum(self.counts.values()) + 1
        self.longest = max(map(len, self.counts), default=1)
        self.cost = {w: math.log(self.total / n) for w, n in self.counts.items()}
        self.unknown = math.log(self.total * 2)

    def starts(self, run: str, i: int) -> list[tuple[int, float]]:
        """(end, cost) of the words that start at i, and of the character alone."""
        found = [(j, self.cost[run[i:j]]) for j in range(i + 1, min(len(run), i + self.longest) + 1) if run[i:j] in self.cost]
        return found if found and found[0][0] == i + 1 else [(i + 1, self.unknown), *found]

    def cut(self, run: str) -> list[str]:
        """The words of least cost; of equals those that are longer from the left."""
        best: list[tuple[float, int]] = [(0.0, 0)] * (len(run) + 1)
        for i in range(len(run) - 1, -1, -1):
            best[i] = min((round(c + best[j][0], 9), -j) for j, c in self.starts(run, i))
        out, i = [], 0
        while i < len(run):
            j = -best[i][1]
            out.append(run[i:j])
            i = j
        return out

    def every(self, run: str) -> list[str]:
        """All known words in run by place and length; a character that no known word of two or more covers, alone."""
        spans = [(i, j) for i in range(len(run)) for j, _ in self.starts(run, i) if run[i:j] in self.cost and j > i + 1]
        held = {k for i, j in spans for k in range(i, j)}
        return [run[i:j] for i, j in sorted(spans + [(k, k + 1) for k in range(len(run)) if k not in held])]


def words(text: str | None, book: Dictionary, full: bool = False) -> list[str] | None:
    """Words of a text in order; Latin ones in lower case."""
    if text is None:
        return None
    out: list[str] = []
    for part in _PARTS.findall(text):
        out += (book.every(part) if full else book.cut(part)) if "一" <= part[0] <= "鿿" else [part.lower()]
    return out


def edges(text: str | None, book: Dictionary) -> list[int] | None:
    """Places, ascending, at which a word starts or ends."""
    if text is None:
        return None
    found = set()
    for m in _PARTS.finditer(text):
        at = m.start()
        for w in book.cut(m[0]) if "一" <= m[0][0] <= "鿿" else [m[0]]:
            found |= {at, at + len(w)}
            at += len(w)
    return sorted(found)


def dictionary(rows: DataFrame, user: tuple[str, ...] = ()) -> Dictionary:
    """Of rows (word, n): at most MOST_WORDS of them, as it goes to every task."""
    found = rows.limit(MOST_WORDS + 1).toPandas()
    if len(found) > MOST_WORDS:
        raise ValueError(f"a dictionary has at most {MOST_WORDS} words")
    return Dictionary(dict(zip(found["word"], found["n"])), user)


def segmented(text: Column, book: Dictionary, full: bool = False) -> Column:
    """array<string>: words of a column of texts."""

    @F.pandas_udf("array<string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([words(x, book, full) for x in part], dtype=object)

    return run(text)


def on_boundary(text: Column, start: Column, end: Column, book: Dictionary) -> Column:
    """Whether places start to end (from 0) of a text stand on word boundaries.

    In Chinese that is so if a word of the text starts at start or ends at end; elsewhere if no word character stands before
    or after.
    """

    @F.pandas_udf("array<int>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([edges(x, book) for x in part], dtype=object)

    from .parsing import on_word_boundary

    han = F.substring(text, start + 1, end - start).rlike(rf"[{HAN}]")
    at = run(text)
    return F.when(han, F.array_contains(at, start) | F.array_contains(at, end)).otherwise(on_word_boundary(text, start, end))


def learned(texts: DataFrame, text: str, longest: int = 4, least: int = 5, cohesion: float = 20.0) -> DataFrame:
    """word, n: runs of up to longest Chinese characters that are seen least times, and cohesion times as often as chance would put their two parts together, however they are cut.

    Characters count as words too. All texts are counted, before the shuffle; there is no list to begin with.
    """
    runs = texts.select(F.explode(F.regexp_extract_all(text, F.lit(rf"[{HAN}]+"), F.lit(0))).alias("r"))
    size = F.length("r")
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda k: F.when(size >= k, F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.substring(F.col("r"), i, k))).otherwise(F.array().cast("array<string>"))))
    counts = runs.select(F.explode(grams).alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter((F.col("n") >= least) | (F.length("word") == 1))
    total = counts.filter(F.length("word") == 1).agg(F.sum("n").alias("total"))
    cuts = counts.filter(F.length("word") > 1).select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("i"))
    cuts = cuts.select("word", "n", F.expr("substring(word, 1, i)").alias("a"), F.expr("substring(word, i + 1)").alias("b"))
    part = lambda c: counts.select(F.col("word").alias(c), F.col("n").alias(f"n_{c}"))
    full = cuts.join(part("a"), "a").join(part("b"), "b").join(F.broadcast(total))
    kept = full.groupBy("word", "n").agg(F.min(F.col("n") * F.col("total") / (F.col("n_a") * F.col("n_b"))).alias("least")).filter(F.col("least") >= cohesion)
    return kept.select("word", "n").unionByName(counts.filter(F.length("word") == 1).select("word", "n"))
