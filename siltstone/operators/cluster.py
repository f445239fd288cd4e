"""Clustering of vectors: reduction, Gaussian mixtures chosen by BIC, layers of summaries. On Spark's own estimators."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import settled, sparsity


def reduced(df: DataFrame, vector: str, dim: int, name: str = "features") -> DataFrame:
    """vector projected on its dim main directions; ``neighbours.layout`` keeps neighbours together instead."""
    own = df.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    return PCA(k=dim, inputCol="_v", outputCol=name).fit(own).transform(own).drop("_v")


def _bic(likely: float, n: int, dim: int, k: int) -> float:
    free = k * (dim + dim * (dim + 1) / 2) + k - 1
    return -2 * likely + free * math.log(max(n, 2))


class One:
    """A mixture of one component, in the form of a fitted model: everything has it with probability 1."""

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("probability", array_to_vector(F.array(F.lit(1.0)))).withColumn("prediction", F.lit(0))


def _bic_of_one(df: DataFrame, features: str, n: int, dim: int) -> float:
    """BIC of one Gaussian in closed form, from means and covariances (with the least spread that keeps it finite)."""
    x = [F.get(vector_to_array(features), F.lit(i)) for i in range(dim)]
    rows = df.select(*[c.alias(f"x{i}") for i, c in enumerate(x)])
    pairs = [(i, j) for i in range(dim) for j in range(i + 1)]
    found = rows.agg(*[F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    cov = np.zeros((dim, dim))
    for (i, j), c in zip(pairs, found):
        cov[i, j] = cov[j, i] = c or 0.0
    logdet = float(np.log(np.maximum(np.linalg.eigvalsh(cov), 1e-12)).sum())
    return n * (dim * math.log(2 * math.pi) + logdet + dim) + (dim + dim * (dim + 1) / 2) * math.log(max(n, 2))


#: Beyond so many components a mixture is fitted in blocks of rows and components.
MANY = 64
_EPS = np.finfo(float).eps


class Many:
    """A mixture of very many components, with the steps of Spark's own estimator in matrix form.

    Each row meets each component in each step, as in any such fit, so with clusters of bounded size the work grows with the
    square of the rows. A task holds a block of rows by components and the sums of each component; the driver holds the
    components.
    """

    #: Rows and components that meet at a time.
    ROWS, COMPONENTS = 64, 2048

    def __init__(self, weights: np.ndarray, means: np.ndarray, covs: np.ndarray, features: str):
        self.weights, self.means, self.covs, self.features, self.likely = weights, means, covs, features, None

    @classmethod
    def fit(cls, df: DataFrame, features: str, k: int, seed: int, rounds: int, tol: float = 0.01) -> Many:
        """From the components that Spark's estimator starts with; so many rounds, or until the likelihood changes by no more than tol."""
        spark = df.sparkSession
        found = GaussianMixture(k=k, featuresCol=features, seed=seed, maxIter=0).fit(df)
        rows = found.gaussiansDF.collect()
        model = cls(np.array(found.weights), np.array([r.mean.toArray() for r in rows]), np.array([r.cov.toArray() for r in rows]), features)
        dim = model.means.shape[1]
        i, j = np.tril_indices(dim)
        x = df.select(vector_to_array(features).alias("x")).repartition(2 * spark.sparkContext.defaultParallelism).cache()
        try:
            before = 0.0
            for _ in range(rounds):
                step = model._step()
                parts = x.mapInArrow(step, "component int, sums array<double>")
                total = [F.sum(F.get("sums", F.lit(c))).alias(f"s{c}") for c in range(1 + dim + len(i))]
                got = parts.groupBy("component").agg(*total).toPandas().sort_values("component").to_numpy()
                likely, s = got[0, 1], got[1:, 1:]  # component -1: the likelihood
                w = s[:, 0]
                means = s[:, 1 : 1 + dim] / w[:, None]
                covs = np.empty((k, dim, dim))
                covs[:, i, j] = covs[:, j, i] = s[:, 1 + dim :] / w[:, None] - means[:, i] * means[:, j]
                model = cls(w / w.sum(), means, covs, features)
                model.likely = likely
                if abs(likely - before) <= tol:
                    break
                before = likely
            return model
        finally:
            x.unpersist()

    def _roots(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """root, at, c of each component: weight times density is exp(c - |x root - at|^2 / 2); directions without spread don't count."""
        d, u = np.linalg.eigh(self.covs)
        dim = d.shape[1]
        ok = d > _EPS * d.max(axis=1, keepdims=True) * dim
        scale = np.sqrt(np.where(ok, 1 / np.where(ok, d, 1), 0))
        root = u * scale[:, None, :]
        with np.errstate(divide="ignore"):
            c = np.log(self.weights) - 0.5 * (dim * math.log(2 * math.pi) + np.log(np.where(ok, d, 1)).sum(axis=1))
        return root, np.einsum("kd,kde->ke", self.means, root), c

    def _blocks(self) -> Callable:
        """x to (rows, probabilities before they are scaled), block by block.

        The exponent is one product of matrices with the squares and products of x. Components so narrow that it would lose
        digits get theirs from differences.
        """
        root, at, c = self._roots()
        k, dim = at.shape
        i, j = np.tril_indices(dim)
        middle = self.means.mean(axis=0)
        near = np.einsum("kd,kde->ke", self.means - middle, root)
        exact = np.einsum("kde,kfe->kdf", root, root)
        theta = np.vstack([c - 0.5 * (near**2).sum(axis=1), np.einsum("ke,kde->dk", near, root), np.where(i == j, -0.5, -1.0)[:, None] * exact[:, i, j].T])
        sharp = np.einsum("kdd->k", exact)

        def run(x: np.ndarray):
            reach = ((x - middle) ** 2).sum(axis=1).max(initial=0.0)
            narrow = np.flatnonzero(sharp * reach > 1e7)
            for a in range(0, len(x), self.ROWS):
                own = x[a : a + self.ROWS]
                y = own - middle
                phi = np.column_stack([np.ones(len(y)), y, y[:, i] * y[:, j]])
                p = np.empty((len(y), k))
                for b in range(0, k, self.COMPONENTS):
                    part = phi @ theta[:, b : b + self.COMPONENTS]
                    np.exp(part, out=part)
                    np.add(part, _EPS, out=p[:, b : b + self.COMPONENTS])
                for b in range(0, len(narrow), self.COMPONENTS):
                    n = narrow[b : b + self.COMPONENTS]
                    z = np.einsum("nkd,kde->nke", own[:, None] - self.means[n], root[n])
                    p[:, n] = np.exp(c[n] - 0.5 * (z**2).sum(axis=2)) + _EPS
                yield own, p

        return run

    def _step(self) -> Callable:
        k, dim = self.means.shape
        i, j = np.tril_indices(dim)
        blocks = self._blocks()

        def run(batches):
            import pyarrow as pa

            sums, likely, any_rows = np.zeros((k, 1 + dim + len(i))), 0.0, False
            for b in batches:
                if not b.num_rows:
                    continue
                any_rows = True
                for x, p in blocks(b.column(0).flatten().to_numpy().reshape(b.num_rows, -1)):
                    total = p.sum(axis=1)
                    likely += np.log(total).sum()
                    phi = np.column_stack([np.ones(len(x)), x, x[:, i] * x[:, j]]) / total[:, None]
                    for a in range(0, k, self.COMPONENTS):
                        sums[a : a + self.COMPONENTS] += p[:, a : a + self.COMPONENTS].T @ phi
            if any_rows:
                out = np.vstack([np.full(sums.shape[1], likely), sums])
                for a in range(0, k + 1, 4096):
                    part = out[a : a + 4096]
                    own = pa.array(np.arange(a, a + len(part), dtype=np.int32) - 1)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1]), pa.array(part.ravel()))
                    yield pa.record_batch([own, lists], names=["component", "sums"])

        return run

    def _told(self, each: Callable, kind: str) -> Column:
        blocks = self._blocks()

        @F.pandas_udf(kind)
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for v in parts:
                yield pd.Series([y for _, p in (blocks(np.stack(v.to_list())) if len(v) else ()) for y in each(p)], dtype=object)

        return run(vector_to_array(self.features))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", self._told(lambda p: p.argmax(axis=1).tolist(), "int"))

    def above(self, df: DataFrame, threshold: float) -> DataFrame:
        """df with prediction and labels."""
        found = lambda p: [np.flatnonzero(y).tolist() for y in p > threshold * p.sum(axis=1, keepdims=True)]
        return self.transform(df).withColumn("labels", self._told(found, "array<int>"))


def mixture(df: DataFrame, features: str, most: int, seed: int = 7, tolerance: float = 1e-3, candidates: list[int] | None = None, starts: int = 1, size: int | None = None):
    """The fitted mixture of least BIC among 1 to most components (or candidates); stops when BIC no longer falls by tolerance.

    starts: each is fitted from so many seeds, and the likeliest counts. size: at least as many components as clusters of so
    many rows need. None without rows.
    """
    df = df.cache()
    try:
        n, best, best_bic, best_k = df.count(), None, None, 1
        if not n:
            return None
        dim = len(df.select(features).first()[0])
        one = lambda k, s: Many.fit(df, features, k, s, 30) if k > MANY else GaussianMixture(k=k, featuresCol=features, seed=s, maxIter=30).fit(df)
        fit = lambda k: max((one(k, seed + i) for i in range(starts)), key=lambda m: m.likely if k > MANY else m.summary.logLikelihood)
        for k in candidates or range(1, min(most, max(n - 1, 1)) + 1):
            model = fit(k) if k > 1 else One()
            bic = _bic(model.likely if k > MANY else model.summary.logLikelihood, n, dim, k) if k > 1 else _bic_of_one(df, features, n, dim)
            if best_bic is not None and bic > best_bic - abs(best_bic) * tolerance:
                break
            best, best_bic, best_k = model, bic, k
        least = min(n // size, n - 1) if size else 1
        return fit(least) if least > best_k else best
    finally:
        df.unpersist()


def soft_labels(model, df: DataFrame, threshold: float) -> DataFrame:
    """df with labels: all clusters with a probability above threshold; beyond MANY components without the column of probabilities."""
    if isinstance(model, Many):
        return model.above(df, threshold)
    p = vector_to_array("probability")
    return model.transform(df).withColumn("labels", F.filter(F.transform(p, lambda x, i: F.when(x > threshold, i)), lambda i: i.isNotNull()))


def hard_labels(model, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("community", F.col("prediction"))


def layers(nodes: DataFrame, summarise: Callable[[DataFrame], DataFrame], most: int = 5, dim: int = 4, change: float = 0.05) -> list[DataFrame]:
    """Layers of nodes (node, embedding), each made by summarise from the clusters (community, node, embedding) of the one below.

    Ends at most layers, at two nodes or fewer, or when the clusters' sparsity changes by less than change. The loop runs on
    the driver; every layer is written to the shared folder.
    """
    out, before = [nodes], None
    for _ in range(most):
        if out[-1].count() <= 2:
            break
        features = reduced(out[-1], "embedding", dim)
        model = mixture(features, "features", 50)
        if model is None:
            break
        members = settled(hard_labels(model, features).select("community", "node", "embedding"), "members")
        now = sparsity(members).first()[0]
        out.append(settled(summarise(members), "layer"))
        if before is not None and now is not None and abs(now - before) <= change * max(abs(before), 1e-9):
            break
        before = now
    return out
