"""Planted data sets. Every draw is keyed by (seed, stream, indices), so the output doesn't depend on partitioning."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..plans.ship import ship
from .counts import Counts

BLOCK_SUPPORTS = ((1,), (2,), (3,), (4,), (5,), (1, 2, 3), (1, 2, 4), (2, 3, 5))
TREE_SUPPORTS = ((1, 2, 3), (1, 2, 4), (1, 5, 6), (1, 5, 7), (1, 2), (1, 5))
CORRELATED_SUPPORTS = ((1,), (2,), (3,), (1, 3), (2, 3), (1, 2))
EPS = 2.220446049250313e-16


@dataclass
class Simulated:
    counts: Counts
    factors: np.ndarray  # K x M
    truth: DataFrame  # i, grp, true_support_size, true_support_label
    loadings: DataFrame  # i, k, l
    supports: Sequence[Sequence[int]]


def normalize_rows(x: np.ndarray, eps: float = EPS) -> np.ndarray:
    x = np.maximum(x, eps)
    return x / x.sum(1, keepdims=True)


def sparse_factors(K: int, M: int, seed: int, shape: float = 0.1, rate: float = 0.01) -> np.ndarray:
    return normalize_rows(np.random.default_rng([seed, 1]).gamma(shape, 1 / rate, (K, M)))


def correlate(factors: np.ndarray, a: int, b: int, mix: float) -> np.ndarray:
    """Row b becomes mostly row a."""
    out = factors.copy()
    out[b] = mix * out[a] + (1 - mix) * out[b]
    return normalize_rows(out)


def with_duplicates(factors: np.ndarray, rows: Sequence[int], seed: int, weight: float = 0.94) -> np.ndarray:
    """Noisy copies of rows, appended."""
    noise = sparse_factors(len(rows), factors.shape[1], seed)
    return np.vstack([factors, normalize_rows(weight * factors[list(rows)] + (1 - weight) * noise)])


def support_label(support: Sequence[int]) -> str:
    return ",".join(map(str, sorted(set(support))))


def pad_support(support: Sequence[int], D: int) -> list[int]:
    return [support[d % len(support)] for d in range(D)]


def simulate(spark: SparkSession, N: int, supports: Sequence[Sequence[int]], shapes: Sequence[float], factors: np.ndarray, seed: int, shuffled: bool = False) -> Simulated:
    """Gamma loadings on each group's support, Poisson counts. N must be divisible by the number of groups; ``shuffled`` deals groups in a seeded order."""
    S, M = len(supports), factors.shape[1]
    if N % S:
        raise ValueError("N must be divisible by the number of groups")
    grp = np.repeat(np.arange(S), N // S)
    if shuffled:
        grp = np.random.default_rng([seed, 2]).permutation(grp)
    frame = pd.DataFrame({"i": np.arange(1, N + 1), "g": grp})
    supports = [list(s) for s in supports]

    def draw(i: int, g: int) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng([seed, 3, i])
        load = np.zeros(len(factors))
        for k in supports[g]:
            load[k - 1] += rng.gamma(shapes[g])
        return load, rng.poisson(load @ factors)

    def cells(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for i, g in zip(p.i, p.g, strict=True):
                _, y = draw(i, g)
                m = np.flatnonzero(y)
                yield pd.DataFrame({"i": i, "m": (m + 1).astype(np.int32), "y": y[m].astype(float)})

    def loads(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for i, g in zip(p.i, p.g, strict=True):
                load, _ = draw(i, g)
                k = np.flatnonzero(load)
                yield pd.DataFrame({"i": i, "k": (k + 1).astype(np.int32), "l": load[k]})

    ship(spark)
    base = spark.createDataFrame(frame)
    counts = base.mapInPandas(cells, "i long, m int, y double")
    features = spark.createDataFrame(pd.DataFrame({"m": np.arange(1, M + 1, dtype=np.int32), "name": [f"f{m:06d}" for m in range(1, M + 1)]}), "m int, name string")
    totals = base.select("i").join(counts.groupBy("i").agg({"y": "sum"}).withColumnRenamed("sum(y)", "total"), "i", "left").fillna(0.0, ["total"])
    sizes = [len(set(s)) for s in supports]
    truth = pd.DataFrame({"i": frame.i, "grp": grp + 1, "true_support_size": [sizes[g] for g in grp], "true_support_label": [support_label(supports[g]) for g in grp]})
    return Simulated(Counts(counts, features, totals), factors, spark.createDataFrame(truth), base.mapInPandas(loads, "i long, k int, l double"), supports)


def block(spark: SparkSession, N: int = 240, M: int = 250, seed: int = 101, K: int = 5) -> Simulated:
    return simulate(spark, N, BLOCK_SUPPORTS, [10.0] * 5 + [20.0] * 3, sparse_factors(K, M, seed), seed)


def tree(spark: SparkSession, N: int = 240, M: int = 280, seed: int = 201, K: int = 7) -> Simulated:
    return simulate(spark, N, TREE_SUPPORTS, [18.0] * 6, sparse_factors(K, M, seed), seed)


def duplicate_dictionary(spark: SparkSession, N: int = 240, M: int = 260, seed: int = 1001) -> tuple[Simulated, np.ndarray]:
    """Block data from five factors, and a dictionary with two of them repeated."""
    sim = simulate(spark, N, BLOCK_SUPPORTS, [8.0] * 5 + [14.0] * 3, sparse_factors(5, M, seed), seed)
    return sim, with_duplicates(sim.factors, (0, 1), seed + 1)


def correlated(spark: SparkSession, N: int = 180, M: int = 260, seed: int = 2001, mix: float = 0.96) -> Simulated:
    return simulate(spark, N, CORRELATED_SUPPORTS, [5.0, 5.0, 8.0, 10.0, 10.0, 10.0], correlate(sparse_factors(5, M, seed), 0, 1, mix), seed)


def duplicate_vector(spark: SparkSession, M: int = 2000, seed: int = 5) -> Simulated:
    """One sample; factor 11 is factor 1 again, and factors are not normalised."""
    f = np.random.default_rng([seed, 1]).gamma(0.1, 100.0, (10, M))
    f = np.maximum(np.vstack([f, f[:1]]), EPS)
    load = np.zeros(11)
    load[:3] = (1.0, 2.0, 3.0)
    y = np.random.default_rng([seed, 3]).poisson(load @ f)
    m = np.flatnonzero(y)
    counts = spark.createDataFrame(pd.DataFrame({"i": 1, "m": (m + 1).astype(np.int32), "y": y[m].astype(float)}), "i long, m int, y double")
    features = spark.createDataFrame(pd.DataFrame({"m": np.arange(1, M + 1, dtype=np.int32), "name": [f"f{m:06d}" for m in range(1, M + 1)]}), "m int, name string")
    samples = spark.createDataFrame([(1, float(y.sum()))], "i long, total double")
    truth = spark.createDataFrame([(1, 1, 3, "1,2,3")], "i long, grp int, true_support_size int, true_support_label string")
    loads = spark.createDataFrame([(1, k + 1, float(load[k])) for k in range(3)], "i long, k int, l double")
    return Simulated(Counts(counts, features, samples), f, truth, loads, [[1, 2, 3]])
