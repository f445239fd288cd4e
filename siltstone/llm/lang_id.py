"""Language identification by prediction by partial matching (PPM).

Training counts, for each language, how often each byte follows each context of up to three bytes. The contexts that occur
often enough form that language's variable-order context tree. The statistics are then frozen: for each context kept in any
tree, the code length of each next byte is worked out once by escaping from the longest known context to shorter ones, with
symbols already seen in longer contexts excluded, down to equal odds for all remaining bytes. Code lengths are whole
numbers of 1/4096 bit, so that sums are exact. A text is coded under every language; the shortest code wins.

Scoring looks up two arrays: the last three bytes give the longest kept context, that and the next byte give the code
lengths under all languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrowtext as at
from .shared import prepare, texts

UNIT = 4096
#: What stands before a text, as three bytes.
START = 10


@dataclass(frozen=True)
class LangParams:
    #: Training texts a language, on average: rows are taken by a hash of doc_id (of the text where that is null) at the rate docs_per_lang / rows. A bound on the labelled sample.
    docs_per_lang: int = 600
    #: Contexts of 2 and 3 bytes are kept from so many occurrences on (in a language), of those the most frequent.
    min_count: int = 24
    max_contexts: int = 6000


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, four bytes as one number, count) of each batch: the byte with the three before it."""
    for batch in batches:
        langs = batch.column(0).to_pylist()
        buf, offs = at.utf8(batch.column(1))
        names = sorted(set(langs))
        for k, name in enumerate(names):
            found: list[np.ndarray] = []
            for i in (i for i, x in enumerate(langs) if x == name):
                b = np.concatenate([np.full(3, START, np.uint8), buf[offs[i] : offs[i + 1]]]).astype(np.uint32)
                if len(b) > 3:
                    found.append((b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:])
            if found:
                grams, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def training_counts(train: DataFrame, p: LangParams) -> DataFrame:
    """lang, gram, n over the training sample; train: doc_id, text, lang."""
    train = train.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = train.groupBy("lang").agg(F.count("*").alias("rows"))  # a row for each language
    rate = F.least(F.lit(1.0), F.lit(float(p.docs_per_lang)) / F.col("rows"))
    own = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    sample = train.join(F.broadcast(sizes), "lang").filter(F.pmod(own, F.lit(1 << 30)) < rate * (1 << 30))
    return sample.select("lang", "text").mapInArrow(_pairs, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Frozen statistics: langs, the byte alphabet, context states and code lengths."""

    def __init__(self, rows: list[tuple[str, int, int]], p: LangParams):
        self.langs = sorted({r[0] for r in rows})
        grams = {x: [] for x in self.langs}
        for lang, gram, n in rows:
            grams[lang].append((gram, n))
        data = {x: np.array(sorted(v), dtype=np.int64).reshape(-1, 2) for x, v in grams.items()}
        seen = np.zeros(256, bool)
        seen[START] = True
        for v in data.values():
            seen[v[:, 0] & 255] = True
        self.alphabet = np.flatnonzero(seen)
        self.symbol = np.full(256, len(self.alphabet), np.int32)  # one class for all bytes never seen
        self.symbol[self.alphabet] = np.arange(len(self.alphabet))
        a = self.size = len(self.alphabet) + 1
        counts = {}  # by language and order: contexts (as numbers of that many symbols), dense counts of the next symbol
        kept: dict[int, set[int]] = {1: set(), 2: set(), 3: set()}
        for lang, v in data.items():
            s = [self.symbol[(v[:, 0] >> k) & 255].astype(np.int64) for k in (24, 16, 8, 0)]
            by_order = {0: (np.zeros(1, np.int64), np.bincount(s[3], v[:, 1], a).reshape(1, a))}
            for order in (1, 2, 3):
                ctx = sum(s[3 - order + k] * a ** (order - 1 - k) for k in range(order))
                own, at_ = np.unique(ctx, return_inverse=True)
                total = np.bincount(at_, v[:, 1])
                if order > 1:
                    ok = np.flatnonzero(total >= p.min_count)
                    ok = ok[np.argsort(-total[ok], kind="stable")[: p.max_contexts // 2]]
                    keep = np.zeros(len(own), bool)
                    keep[ok] = True
                else:
                    keep = np.ones(len(own), bool)
                place = np.cumsum(keep) - 1
                use = keep[at_]
                dense = np.bincount(place[at_[use]] * a + s[3][use], v[use, 1], int(keep.sum()) * a).reshape(-1, a)
                by_order[order] = (own[keep], dense)
                kept[order] |= set(own[keep].tolist())
            counts[lang] = by_order
        # A kept context needs its shorter ones, so that each state's parents are states too.
        kept[2] |= {c % a**2 for c in kept[3]}
        kept[1] |= {c % a for c in kept[2]}
        self.states = [(0, 0)] + [(o, c) for o in (1, 2, 3) for c in sorted(kept[o])]
        table = np.zeros(a**3, np.int32)
        for number, (order, c) in enumerate(self.states):
            if order:
                table.reshape(a ** (3 - order), a**order)[:, c] = number  # longer contexts come later and win
        self.state_of = table
        self.cost = np.zeros((len(self.states) * a, max(1, len(self.langs))), np.int32)
        for k, lang in enumerate(self.langs):
            self.cost[:, k] = self._lengths(counts[lang], a).reshape(-1)

    def _lengths(self, by_order: dict, a: int) -> np.ndarray:
        """Code lengths of every symbol in every state under one language."""
        n = len(self.states)
        order = np.array([o for o, _ in self.states])
        ctx = np.array([c for _, c in self.states])
        left = np.ones((n, a), bool)  # symbols not excluded yet
        scale = np.ones(n)  # probability of having escaped so far
        prob = np.zeros((n, a))
        weight = np.ones(a)
        weight[-1] = 256 - len(self.alphabet)  # the last symbol stands for so many bytes
        for o in (3, 2, 1, 0):
            own, dense = by_order[o]
            sub = ctx % a**o if o else np.zeros(n, np.int64)
            place = np.searchsorted(own, sub)
            place[place >= len(own)] = 0
            rows = np.flatnonzero((order >= o) & (own[place] == sub)) if len(own) else np.zeros(0, np.int64)
            c = dense[place[rows]] * left[rows]
            total, distinct = c.sum(1), (c > 0).sum(1)
            some = total > 0
            rows, c, total, distinct = rows[some], c[some], total[some], distinct[some]
            whole = (total + distinct)[:, None]
            prob[rows] += scale[rows, None] * c / whole
            scale[rows] *= distinct / whole[:, 0]
            left[rows] &= c == 0
        rest = (left * weight).sum(1)
        prob += left * (scale / np.maximum(rest, 1))[:, None]  # each remaining byte alike
        return np.rint(-np.log2(np.maximum(prob, 1e-30)) * UNIT).astype(np.int32)

    def lengths(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Code length of each row under each language, in 1/4096 bits."""
        out = np.zeros((len(offs) - 1, self.cost.shape[1]), np.int64)
        a = self.size
        for i, j in at.blocks(offs, 1 << 20):
            for lo in range(int(offs[i]), int(offs[j]), 1 << 20):  # a longer row in pieces
                hi = min(int(offs[j]), lo + (1 << 20))
                s = self.symbol[buf[max(lo - 3, 0) : hi]]
                s = np.concatenate([np.full(3 - min(lo, 3), self.symbol[START], np.int32), s])
                x, y, z = s[:-3].copy(), s[1:-2].copy(), s[2:-1].copy()
                first = offs[i:j][(offs[i:j] >= lo) & (offs[i:j] < hi)] - lo
                for shift, parts in ((0, (x, y, z)), (1, (x, y)), (2, (x,))):
                    put = first + shift
                    put = put[put < hi - lo]
                    for part in parts:
                        part[put] = self.symbol[START]
                code = self.state_of[(x * a + y) * a + z] * a + s[3:]
                cost = self.cost[code]
                edges = np.clip(offs[i : j + 1] - lo, 0, hi - lo)
                full = np.flatnonzero(edges[:-1] < edges[1:])
                if len(full):
                    out[i + full] += np.add.reduceat(cost, edges[full], axis=0, dtype=np.int64)
        return out


def train(docs: DataFrame, p: LangParams = LangParams()) -> Model:
    """docs: doc_id, text, lang. The counts of the bounded sample come to the driver: at most some ten thousand a language."""
    prepare(docs.sparkSession)
    return Model([tuple(r) for r in training_counts(docs, p).collect()], p)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", row: bool = False) -> DataFrame:
    """doc_id, lang_pred, score, bits (of the shortest code) for every row.

    lang_pred is 'und', score 0, for a null text, one without a letter, or a model without languages. score is the posterior
    probability of the prediction with equal priors. Equal code lengths: the first language by name. Whole texts are coded;
    repeated rows are predicted alike; an empty table gives an empty result. With row, the input row comes along as _row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by max_contexts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            buf, offs = at.utf8(batch.column("text"))
            lengths = m.lengths(buf, offs)
            best = lengths.argmin(1)
            short = lengths.min(1)
            bits = (lengths - short[:, None]) / UNIT
            score = 1 / np.exp2(-np.minimum(bits, 1000)).sum(1)
            ok = batch.column("_letter").to_numpy(zero_copy_only=False).astype(bool) & bool(m.langs)
            langs = np.array([*m.langs, "und"], dtype=object)[np.where(ok, best, len(m.langs))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(np.where(ok, score, 0.0)), pa.array(short / UNIT), *([batch.column("_row")] if row else [])],
                ["doc_id", "lang_pred", "score", "bits", *(["_row"] if row else [])],
            )

    prepare(docs.sparkSession)
    own = texts(docs, id_col, text_col, row).withColumn("_letter", F.col("text").rlike(r"\p{L}"))
    schema = T.StructType.fromDDL("doc_id long, lang_pred string, score double, bits double")
    return own.mapInArrow(run, T.StructType(schema.fields + ([own.schema["_row"]] if row else [])))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
