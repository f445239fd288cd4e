"""Masked pseudo-likelihood: a bidirectional window network predicts every token from its neighbours on both sides.

Tokens are words (A-Z lower-cased). Frequent words of all documents are symbols of their own, and their number follows the
corpus; all others fall into classes by their last letters. The network adds an embedding for each neighbour by its place and
takes tanh. From that a softmax over groups of symbols gives the group, and a softmax over the group's symbols the symbol, so
that probabilities are exact and a token costs two small dense products, not one over all symbols. A word of a class then has
its own probability in it, from the counts over all documents: P(word) = P(class) P(word | class).

Both softmaxes start from the frequencies of the whole corpus and are trained in numpy, data-parallel: in each round every
task trains on all positions of its own documents, and parameters and Adagrad state are averaged, weighted by positions.
Texts are cut into words once to count them and once to write them as symbols; training and scoring read the symbols. A
document's score is the sum of the log-probabilities of its tokens, each given its neighbours.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as at
from .shared import prepare, texts, written

#: Sums of parameters and log-probabilities are kept as whole numbers of this part, so that their order doesn't matter.
UNIT = 1 << 20
#: Positions that weigh as one where parameters are averaged; with it the sums stay below 2^63 up to 10^14 positions.
WEIGHT = 1 << 10


@dataclass(frozen=True)
class LmParams:
    #: So many most frequent words are symbols of their own, and with them every word seen own_count times.
    words: int = 4096
    own_count: int = 5000
    #: Classes of all other words.
    classes: int = 256
    #: Neighbours on each side.
    reach: int = 2
    dim: int = 16
    rounds: int = 2
    rate: float = 0.2
    batch: int = 8192
    #: Counts of up to so many words (16 bytes each) are sent to every task; those of rarer words are joined.
    listed: int = 2_000_000

    @property
    def symbols(self) -> int:
        return 1 + self.words + self.classes  # 0 stands outside of the text


CHUNK = 4096


def _groups(frequency: np.ndarray) -> np.ndarray:
    """Bounds of groups of symbols that descend by frequency: as many as the root of their number, alike in the sum of roots of frequencies."""
    n = len(frequency)
    share = np.cumsum(np.sqrt(frequency + 0.5))
    wanted = max(1, round(np.sqrt(n)))
    cut = np.searchsorted(share, share[-1] * np.arange(1, wanted) / wanted) + 1
    return np.unique(np.concatenate([[0], np.minimum(cut, n), [n]])) if n else np.zeros(1, np.int64)


class Network:
    """Vocabulary and parameters. frequency: of the outside (not looked at), of the vocabulary's words and of the classes."""

    def __init__(self, p: LmParams, vocabulary: np.ndarray, frequency: np.ndarray):
        self.p = p
        self.order = np.argsort(vocabulary)
        self.sorted = vocabulary[self.order]
        self.first = 1 + len(vocabulary)  # class
        rng = np.random.Generator(np.random.PCG64(5))
        v, d = self.first + p.classes, p.dim
        by = np.argsort(-frequency[1:], kind="stable")  # symbols, less one, by the place of their parameters
        self.place = np.zeros(v, np.int64)
        self.place[1 + by] = np.arange(v - 1)
        weight = frequency[1:][by] + 0.5
        self.bounds = _groups(frequency[1:][by])
        self.group = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        mass = np.add.reduceat(weight, self.bounds[:-1])
        self.inner = (rng.standard_normal((2 * p.reach * v, d)) * 0.1).astype(np.float32)  # neighbour k's symbol s: row k * v + s
        self.inner[np.arange(2 * p.reach) * v] = 0
        self.top = (rng.standard_normal((len(mass), d)) * 0.05).astype(np.float32)
        self.top_bias = np.log(mass / mass.sum()).astype(np.float32)
        self.outer = (rng.standard_normal((v - 1, d)) * 0.05).astype(np.float32)
        self.bias = np.log(weight / mass[self.group]).astype(np.float32)
        self.squares = [np.full_like(x, 1e-6) for x in self.values()]
        self.class_size = frequency[self.first :]
        self.listed, self.units = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.rare: DataFrame | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rare": None}  # not for tasks

    def values(self) -> list[np.ndarray]:
        return [self.inner, self.top, self.top_bias, self.outer, self.bias]

    def flat(self) -> np.ndarray:
        """Parameters and the roots of the sums of their squared gradients."""
        return np.concatenate([x.ravel() for x in self.values()] + [np.sqrt(x).ravel() for x in self.squares]).astype(np.float64)

    def load(self, flat: np.ndarray) -> None:
        here = 0
        for many, root in ((self.values(), False), (self.squares, True)):
            for x in many:
                part = flat[here : here + x.size].reshape(x.shape)
                x[...] = part * part if root else part
                here += x.size

    def symbols(self, h: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """Symbols of words with hashes h, of which those outside of the vocabulary fall into the classes tail."""
        out = self.first + tail.astype(np.int64)
        if len(self.sorted):
            place = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
            known = self.sorted[place] == h
            out[known] = self.order[place[known]] + 1
        return out

    def within_class(self, h: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log P(word | symbol) = log n - log (class size + 1) in units, and which words aren't listed: their log n is left out.

        A word that was never counted has the probability of one counted once, whose log n is 0.
        """
        out, unlisted = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at_ = np.flatnonzero(own >= self.first)
        if len(at_):
            out[at_] = np.rint(-np.log(self.class_size + 1) * UNIT).astype(np.int64)[own[at_] - self.first]
            n, missing = np.zeros(len(at_), np.int64), np.ones(len(at_), bool)
            if len(self.listed):
                place = np.minimum(np.searchsorted(self.listed, h[at_]), len(self.listed) - 1)
                missing = self.listed[place] != h[at_]
                n = np.where(missing, 0, self.units[place])
            out[at_] += n
            unlisted[at_] = missing
        return out, unlisted

    def neighbours(self, own: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Rows of inner for the neighbours of each place, one line a neighbour."""
        r, v = self.p.reach, self.first + self.p.classes
        padded = np.zeros(len(own) + r * len(bounds), np.int64)
        place = np.arange(len(own)) + r * (at.row_of(bounds) + 1)
        padded[place] = own
        return np.stack([padded[place + k] + v * i for i, k in enumerate((*range(-r, 0), *range(1, r + 1)))])

    def hidden(self, near: np.ndarray) -> np.ndarray:
        total = self.inner.take(near[0], axis=0)
        for x in near[1:]:
            total += self.inner.take(x, axis=0)
        # tanh x = 1 - 2 / (1 + exp 2x), as exp is vectorised; beyond 40 it is 1.
        total += total
        np.exp(np.minimum(total, 80, out=total), out=total)
        total += 1
        np.divide(-2, total, out=total)
        total += 1
        return total

    def _by_group(self, place: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int, int]]]:
        """An order of the places by group, and for each group that occurs its number, and its bounds among all symbols and in that order."""
        group = self.group[place].astype(np.uint16)
        order = np.argsort(group, kind="stable")
        edges = np.searchsorted(group[order], np.arange(len(self.bounds))).tolist()
        low = self.bounds.tolist()
        return order, [(g, low[g], low[g + 1], edges[g], edges[g + 1]) for g in range(len(low) - 1) if edges[g] < edges[g + 1]]

    def _biases(self, weights: np.ndarray, bias: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, bool]]:
        """For each group, its biases less what no logit can be above, and whether some logit may then be too small for exp."""
        reach = np.abs(weights).sum(1)  # all of hidden lies between -1 and 1
        high, low = np.maximum.reduceat(bias + reach, bounds[:-1]), np.maximum.reduceat(bias - reach, bounds[:-1])
        less = bias - np.repeat(high, np.diff(bounds))
        return [(less[a:b, None], x) for a, b, x in zip(bounds[:-1].tolist(), bounds[1:].tolist(), (high - low > 60).tolist())]

    def log_probabilities(self, own: np.ndarray, near: np.ndarray) -> np.ndarray:
        """log P(symbol | neighbours) of each place; near as neighbours gives it."""
        out, place, size = np.zeros(len(own)), self.place[own], 2 * self.p.batch
        (top_bias,), biases = self._biases(self.top, self.top_bias, np.array([0, len(self.top)])), self._biases(self.outer, self.bias, self.bounds)
        for i in range(0, len(own), size):
            y = place[i : i + size]
            order, parts = self._by_group(y)
            y, h = y[order], self.hidden(near[:, i : i + size].take(order, axis=1))
            value = _chosen(self.top @ h.T, *top_bias, self.group[y])
            for g, lo, hi, x, z in parts:
                if hi - lo > 1:
                    value[x:z] += _chosen(self.outer[lo:hi] @ h[x:z].T, *biases[g], y[x:z] - lo)
            out[i + order] = value
        return out

    def train(self, own: np.ndarray, near: np.ndarray) -> None:
        """One pass of Adagrad over the examples."""
        place = self.place[own]
        _, top_square, top_bias_square, outer_square, bias_square = self.squares
        grad, grad_bias = np.zeros_like(self.outer), np.zeros_like(self.bias)
        for i in range(0, len(own), self.p.batch):
            y = place[i : i + self.p.batch]
            order, parts = self._by_group(y)
            y, x = y[order], near[:, i : i + self.p.batch].take(order, axis=1)
            h = self.hidden(x)
            (top_bias,), biases = self._biases(self.top, self.top_bias, np.array([0, len(self.top)])), self._biases(self.outer, self.bias, self.bounds)
            e = _errors(self.top @ h.T, *top_bias, self.group[y])
            back = e.T @ self.top
            grad[:], grad_bias[:] = 0, 0
            for g, lo, hi, a, b in parts:
                if hi - lo > 1:
                    part = _errors(self.outer[lo:hi] @ h[a:b].T, *biases[g], y[a:b] - lo)
                    back[a:b] += part.T @ self.outer[lo:hi]
                    np.matmul(part, h[a:b], out=grad[lo:hi])
                    part.sum(1, out=grad_bias[lo:hi])
            back *= 1 - h * h
            self._step(self.top, top_square, e @ h)
            self._step(self.top_bias, top_bias_square, e.sum(1))
            self._step(self.outer, outer_square, grad)
            self._step(self.bias, bias_square, grad_bias)
            for row in x:  # each neighbour has rows of its own
                rows, some = _summed(row, back)
                total = self.squares[0].take(rows, axis=0)
                total += some * some
                self.squares[0][rows] = total
                self.inner[rows] = self.inner.take(rows, axis=0) - self.p.rate * some / np.sqrt(total)

    def _step(self, value: np.ndarray, square: np.ndarray, grad: np.ndarray) -> None:
        square += grad * grad
        value -= self.p.rate * grad / np.sqrt(square)


def _chosen(z: np.ndarray, bias: np.ndarray, wide: bool, y: np.ndarray) -> np.ndarray:
    """log softmax of each column of z + bias at y; z is used up."""
    z += bias
    if wide:
        z -= z.max(0)
    out = z[y, np.arange(len(y))].astype(np.float64)
    return out - np.log(np.exp(z, out=z).sum(0))


def _errors(z: np.ndarray, bias: np.ndarray, wide: bool, y: np.ndarray) -> np.ndarray:
    """softmax of each column of z + bias, less one at y; z is used up."""
    z += bias
    if wide:
        z -= z.max(0)
    np.exp(z, out=z)
    z *= 1 / z.sum(0)
    z[y, np.arange(len(y))] -= 1
    return z


def _summed(key: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and the sums of their values, row by row."""
    low = key.min()
    order = np.argsort((key - low).astype(np.uint16) if key.max() - low < 1 << 16 else key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    values = values.take(order, axis=0)
    if values.shape[1] % 2:
        return key[first], np.add.reduceat(values, first)
    return key[first], np.add.reduceat(values.view(np.complex64), first).view(np.float32)  # two sums at a time


def _words(column: pa.Array, classes: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of rows i to j with the hashes of their words, the classes that they would fall into, and the rows' bounds."""
    buf, offs = at.utf8(column)
    for i, j in at.blocks(offs):
        low = at.LOWER[buf[offs[i] : offs[j]]]
        starts, ends, bounds = at.words(low, offs[i : j + 1] - offs[i])
        last = low[np.maximum(ends - 1, 0)].astype(np.uint64)
        for k in (2, 3):  # up to three bytes, whatever they spell
            last = last * np.uint64(256) + np.where(ends - k >= starts, low[np.maximum(ends - k, 0)], 0).astype(np.uint64)
        yield i, j, at.span_hashes(low, starts, ends), (at.mix(last) % np.uint64(classes)).astype(np.int32), bounds


def _count_words(classes: int):
    def give(parts: list) -> pa.RecordBatch:
        h, tail, n = (np.concatenate(x) for x in zip(*parts))
        own, first, where = np.unique(h, return_index=True, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(tail[first]), pa.array(np.bincount(where, n).astype(np.int64))], ["word", "class", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for _, _, h, tail, _ in _words(batch.column("text"), classes):
                own, first, n = np.unique(h, return_index=True, return_counts=True)
                parts.append((own, tail[first], n))
                size += len(own)
                if size > 1 << 20:
                    yield give(parts)
                    parts, size = [], 0
        if parts:
            yield give(parts)

    return run


def _averaged(trained: DataFrame, size: int) -> np.ndarray | None:
    """The mean of the tasks' parameters: sums of groups of tasks first, then of the groups."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(len(table.column("v")[0].as_py()), np.int64)
        for x in table.column("v"):
            total += np.asarray(x.values)
        return pa.table({"chunk": table.column("chunk")[:1], "v": pa.array([total], pa.list_(pa.int64())), "n": pa.array([sum(table.column("n").to_pylist())], pa.int64())})

    some = trained.groupBy("chunk", F.pmod("task", F.lit(256)).alias("salt")).applyInArrow(add, "chunk int, v array<long>, n long")
    rows = some.groupBy("chunk").applyInArrow(add, "chunk int, v array<long>, n long").toArrow()  # as many numbers as parameters
    if not rows.num_rows:
        return None
    rows = rows.sort_by("chunk").combine_chunks()
    sizes, n = pa.compute.list_value_length(rows.column("v")).to_numpy(), rows.column("n").to_numpy()
    return (pa.compute.list_flatten(rows.column("v")).to_numpy() / UNIT / np.repeat(n, sizes))[:size]


def _network(counts: DataFrame, p: LmParams) -> Network:
    """An untrained network for the words of counts (word, class, n)."""
    top = counts.orderBy(F.desc("n"), "word").limit(p.words).toArrow()
    if top.num_rows and top.column("n")[-1].as_py() >= p.own_count:
        top = counts.filter(F.col("n") >= p.own_count).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    words, n = top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy()
    classes = np.zeros(p.classes)
    for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect():  # a row for each class
        classes[r["class"]] = r.n
    np.subtract.at(classes, top.column("class").to_numpy(), n)
    return Network(p, words, np.concatenate([[0], n, classes]))


def _list_words(network: Network, counts: DataFrame) -> None:
    """Gives the network the counts of the most frequent words; those of the others stay a table. A word seen once needs none."""
    more = counts.filter("n > 1")
    steps = more.groupBy(F.floor(8 * F.log2("n")).alias("step")).agg(F.min("n").alias("least"), F.count("*").alias("words")).orderBy(F.desc("step")).collect()  # at most 512 rows
    total, least = 0, None
    for r in steps:
        total += r.words
        if total > network.p.listed:
            break
        least = r.least
    units = more.select("word", "n", F.rint(F.log("n") * UNIT).cast("long").alias("units"))
    if least is not None:
        found = units.filter(F.col("n") >= least).select("word", "units").toArrow()
        word = found.column("word").to_numpy().view(np.uint64)
        order = np.argsort(word)
        network.listed, network.units = word[order], found.column("units").to_numpy()[order]
    if total > network.p.listed:
        network.rare = units.filter(F.col("n") < least if least is not None else F.lit(True)).select("word", "units")


def _as_symbols(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, symbols (four bytes each), inside (units of the classes' part of the score), rest (words whose counts are to be joined) of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(network)
    joined = network.rare is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for i, j, h, tail, bounds in _words(batch.column("text"), own.p.classes):
                found = own.symbols(h, tail)
                inside, unlisted = own.within_class(h, found)
                total = np.concatenate([[0], np.cumsum(inside)])
                some = np.concatenate([[0], np.cumsum(unlisted & joined)])[bounds]
                raw = pa.py_buffer(found.astype("<i4").tobytes())
                columns = [
                    batch.column("doc_id").slice(i, j - i), pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((4 * bounds).astype(np.int32)), raw]), pa.array(total[bounds[1:]] - total[bounds[:-1]]),
                    pa.ListArray.from_arrays(pa.array(some.astype(np.int32)), pa.array(h[unlisted & joined].view(np.int64))),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "symbols", "inside", "rest"])

    return docs.mapInArrow(run, "doc_id long, symbols binary, inside long, rest array<long>")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Blocks of rows of some hundred thousand tokens with their symbols and the rows' bounds."""
    for batch in batches:
        raw, offs = at.utf8(batch.column("symbols"))
        for i, j in at.blocks(offs, 1 << 21):
            yield batch.slice(i, j - i), np.frombuffer(raw[offs[i] : offs[j]].tobytes(), "<i4"), (offs[i : j + 1] - offs[i]) // 4


def train(docs: DataFrame, p: LmParams = LmParams()) -> tuple[Network, DataFrame]:
    """The trained network and docs (doc_id, text) as symbols. Frequencies are from all words, parameters from all positions of all documents."""
    prepare(docs.sparkSession)
    counts = written(docs.mapInArrow(_count_words(p.classes), "word long, class int, n long").groupBy("word").agg(F.min("class").alias("class"), F.sum("n").alias("n")), "words")
    network = _network(counts, p)
    _list_words(network, counts)
    coded = written(_as_symbols(docs, network), "symbols")
    for _ in range(p.rounds):
        shared = docs.sparkSession.sparkContext.broadcast(network)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            own, seen = copy.deepcopy(shared.value), 0
            for _, symbols, bounds in _places(batches):
                if len(symbols):
                    own.train(symbols, own.neighbours(symbols, bounds))
                    seen += len(symbols)
            if seen:
                weight = -(-seen // WEIGHT)  # as whole numbers: sums don't depend on their order
                flat = np.rint(own.flat() * UNIT).astype(np.int64) * weight
                for chunk, k in enumerate(range(0, len(flat), CHUNK)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([chunk], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([flat[k : k + CHUNK]], pa.list_(pa.int64())), pa.array([weight], pa.int64())],
                        ["chunk", "task", "v", "n"],
                    )

        mean = _averaged(coded.select("symbols").mapInArrow(run, "chunk int, task int, v array<long>, n long"), len(network.flat()))
        if mean is None:
            break  # no text at all
        network.load(mean)
    return network, coded


def _scored(coded: DataFrame, network: Network) -> DataFrame:
    """The result for documents as symbols."""
    shared = coded.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, key = shared.value, TaskContext.get().partitionId() << 33
        for batch, symbols, bounds in _places(batches):
            whole = np.rint(own.log_probabilities(symbols, own.neighbours(symbols, bounds)) * UNIT).astype(np.int64)
            total = np.concatenate([[0], np.cumsum(whole)])
            units = total[bounds[1:]] - total[bounds[:-1]] + batch.column("inside").to_numpy()
            columns = [batch.column("doc_id"), pa.array(np.diff(bounds)), pa.array(units)]
            if joined:
                columns += [pa.array(np.arange(key, key + len(units))), batch.column("rest")]
                key += len(units)
            yield pa.RecordBatch.from_arrays(columns, names)

    joined = network.rare is not None
    kinds = {"doc_id": "long", "n_tokens": "long", "units": "long"} | ({"key": "long", "rest": "array<long>"} if joined else {})
    names = list(kinds)
    rows = coded.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in kinds.items()))
    if joined:
        rows = written(rows, "scores")
        more = rows.select("key", F.explode("rest").alias("word")).join(network.rare, "word").groupBy("key").agg(F.sum("units").alias("more"))
        rows = rows.join(more, "key", "left").withColumn("units", F.col("units") + F.coalesce("more", F.lit(0)))
    total = F.col("units") / F.lit(float(UNIT))
    mean = F.when(F.col("n_tokens") > 0, total / F.col("n_tokens"))
    return rows.select("doc_id", "n_tokens", total.alias("log_likelihood"), mean.alias("mean_log_likelihood"), F.exp(-mean).alias("perplexity"))


def score(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, log_likelihood, mean_log_likelihood, perplexity for every row.

    A null, empty or blank text has no tokens: log_likelihood 0, mean and perplexity null. Whole texts are scored; repeated
    rows score alike; an empty table gives an empty result. Other columns are not looked at.
    """
    prepare(docs.sparkSession)
    return _scored(_as_symbols(texts(docs, id_col, text_col), network), network)


def pseudo_likelihood(docs: DataFrame, p: LmParams = LmParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """train and score on the same documents; the result is that of score."""
    network, coded = train(texts(docs, id_col, text_col), p)
    return _scored(coded, network)
