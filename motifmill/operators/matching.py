"""Assignments between small label sets: learned to true factors, clusters to groups. Tables of labels are small; samples are only counted."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sums that differ by less, relative to the largest score, are equal.
TIE = 1e-10


@dataclass
class Match:
    learned_to_true: list[int | None]  # 1-based
    similarity: np.ndarray

    @property
    def cosines(self) -> list[float]:
        return [float(self.similarity[k, t - 1]) for k, t in enumerate(self.learned_to_true) if t is not None]

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(k + 1, t, float(self.similarity[k, t - 1]) if t else None) for k, t in enumerate(self.learned_to_true)]
        return spark.createDataFrame(rows, "learned_factor int, matched_true_factor int, cosine double")

    def mapping(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k + 1, t) for k, t in enumerate(self.learned_to_true)], "k int, true_k int")


def row_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a @ b.T / np.outer(np.sqrt((a**2).sum(1)), np.sqrt((b**2).sum(1)))


def _shortest_paths(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A cheapest perfect matching of a square matrix: the column of each row, and potentials of rows and columns.

    Rows enter one by one, each along the shortest path of reduced costs to a free column; potentials keep all reduced costs non-negative.
    """
    n = len(cost)
    u, v = np.zeros(n), np.zeros(n)
    row_of = np.full(n, -1)
    for start in range(n):
        distance, via = np.full(n, np.inf), np.full(n, -1)
        done = np.zeros(n, bool)
        row, reached, column = start, 0.0, -1
        while row >= 0:
            step = reached + cost[row] - u[row] - v
            shorter = ~done & (step < distance)
            distance[shorter], via[shorter] = step[shorter], row
            column = int(np.argmin(np.where(done, np.inf, distance)))
            reached = distance[column]
            done[column] = True
            row = row_of[column]
        passed = done & (np.arange(n) != column)
        u[row_of[passed]] += reached - distance[passed]
        u[start] += reached
        v[passed] -= reached - distance[passed]
        while column >= 0:  # turn the path over
            row = via[column]
            before = np.flatnonzero(row_of == row)
            row_of[column] = row
            column = int(before[0]) if row != start else -1
    column_of = np.empty(n, int)
    column_of[row_of] = np.arange(n)
    return column_of, u, v


def _another_way(tight: np.ndarray, column_of: np.ndarray, row: int, to: int) -> np.ndarray | None:
    """The matching changed along tight edges so that row gets column ``to``, without touching rows before it; None if that can't be."""
    free, holder = column_of[row], int(np.flatnonzero(column_of == to)[0])
    if holder < row:
        return None
    row_of = np.argsort(column_of)
    via, seen, queue = {}, {to}, [holder]
    while queue:
        r = queue.pop()
        for c in np.flatnonzero(tight[r]):
            c = int(c)
            if c in seen or (c != free and row_of[c] <= row):
                continue
            seen.add(c)
            via[c] = r
            if c == free:
                out = column_of.copy()
                while True:
                    r = via[c]
                    c, out[r] = int(column_of[r]), c
                    if r == holder:
                        out[row] = to
                        return out
            queue.append(int(row_of[c]))
    return None


def best_assignment(score: np.ndarray) -> list[int]:
    """Columns of distinct assignment with the largest sum, one for each row; the first in lexicographic order among equals. Rows <= columns, of any number."""
    n, m = score.shape
    if n > m:
        raise ValueError("more rows than columns")
    cost = np.zeros((m, m))  # rows that are not there cost nothing
    cost[:n] = -score
    column_of, u, v = _shortest_paths(cost)
    # Every best assignment uses only edges without reduced cost.
    tight = cost - u[:, None] - v <= TIE * max(1.0, float(np.abs(score).max(initial=0.0)))
    for row in range(n):
        for to in np.flatnonzero(tight[row]):
            if to == column_of[row]:
                break
            changed = _another_way(tight, column_of, row, int(to))
            if changed is not None:
                column_of = changed
                break
    return [int(c) for c in column_of[:n]]


def greedy_assignment(score: np.ndarray) -> list[int]:
    """The largest free cell again and again (column-major first among equals); rows left without a column get -1."""
    s = score.astype(float).copy()
    out = [-1] * len(s)
    for _ in range(min(s.shape)):
        c, r = divmod(int(np.argmax(s.T)), len(s))
        out[r] = c
        s[r], s[:, c] = -np.inf, -np.inf
    return out


def match_factors(learned: np.ndarray, true: np.ndarray) -> Match:
    """One to one; both have the same number of rows."""
    if len(learned) != len(true):
        raise ValueError("use match_rectangular for different numbers of factors")
    sim = row_cosine(learned, true)
    return Match([c + 1 for c in best_assignment(sim)], sim)


def match_rectangular(learned: np.ndarray, true: np.ndarray) -> Match:
    """Every true factor gets a learned one; learned ones left over have none (nearest true: see similarity)."""
    sim = row_cosine(learned, true)
    to = best_assignment(sim.T)
    out: list[int | None] = [None] * len(learned)
    for t, k in enumerate(to):
        out[k] = t + 1
    return Match(out, sim)


def all_permutations(n: int) -> list[tuple[int, ...]]:
    return list(itertools.permutations(range(1, n + 1)))


def contingency(labels: DataFrame) -> np.ndarray:
    """Counts by (z, grp) of rows that have both: labels in order, 0 where a pair doesn't occur."""
    rows = labels.where("z is not null and grp is not null").groupBy("z", "grp").count().toPandas()
    z, g = np.unique(rows.z, return_inverse=True)[1], np.unique(rows.grp, return_inverse=True)[1]
    table = np.zeros((z.max() + 1, g.max() + 1), np.int64) if len(rows) else np.zeros((0, 0), np.int64)
    np.add.at(table, (z, g), rows["count"].to_numpy())
    return table


def cluster_accuracy(labels: DataFrame, method: str = "optimal") -> float:
    """Share of samples in matched cells of (z, grp). Clusters may be more or fewer than groups."""
    table = contingency(labels)
    if not table.size:
        return 0.0
    if method == "greedy":
        to = greedy_assignment(table)
        right = sum(table[r, c] for r, c in enumerate(to) if c >= 0)
    else:
        n = max(table.shape)
        padded = np.zeros((n, n))
        padded[: table.shape[0], : table.shape[1]] = table
        right = sum(padded[r, c] for r, c in enumerate(best_assignment(padded)))
    return float(right / table.sum())


def similarity_frame(spark: SparkSession, sim: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(k + 1, t + 1, float(v)) for (k, t), v in np.ndenumerate(sim)], "k int, true_k int, cosine double")


def permutation_match(similarity: DataFrame, K: int) -> DataFrame:
    """k, true_k of the best one-to-one match, for K small enough to list the permutations: scored by a join, the first best one kept."""
    spark = similarity.sparkSession
    perms = [(n, k, t) for n, p in enumerate(all_permutations(K)) for k, t in enumerate(p, 1)]
    table = F.broadcast(spark.createDataFrame(perms, "perm int, k int, true_k int"))  # K * K! rows
    scored = similarity.join(table, ["k", "true_k"])
    total = scored.groupBy("perm").agg(F.round(F.sum("cosine"), 12).alias("total"))
    best = total.agg(F.max_by("perm", F.struct("total", F.negative("perm"))).alias("perm"))
    return scored.join(best, "perm").select("k", "true_k", "cosine")
