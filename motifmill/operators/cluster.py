"""k-means on normalised loading scores, one way at every size.

Each start draws candidates in a few rounds over all rows, several at once and far rows first (k-means||); the candidates, weighted by the rows
nearest to them, are clustered at the driver, and Lloyd steps over all rows follow. All starts share every pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans.ship import ship
from ..plans.written import write

EPS = 1e-12
STARTS = 20
#: Rounds of candidates, and candidates of a round for each cluster.
ROUNDS = 5
OVERSAMPLING = 2
#: Lloyd steps that all starts get; the best one goes on to STEPS.
TRIAL_STEPS = 10
STEPS = 50
#: A centre that moves less stands still.
STILL = 1e-12


def normalized(x: np.ndarray) -> np.ndarray:
    x = np.maximum(x, EPS)
    return x / x.sum(1, keepdims=True)


def assign(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre (lowest index first) and its squared distance."""
    columns = np.ascontiguousarray(x.T)
    z, least = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
    for s, c in enumerate(centers):
        d = np.zeros(len(x))
        for k, v in enumerate(columns):
            d += (v - c[k]) ** 2
        nearer = d < least
        z[nearer] = s
        least[nearer] = d[nearer]
    return z, least


def _uniform(i: np.ndarray, seed: int, start: int, centre: int) -> np.ndarray:
    """A number in (0, 1) of each row id, whatever the partition."""
    salt = np.random.SeedSequence([seed, start, centre]).generate_state(1, np.uint64)[0]
    x = i.astype(np.int64).view(np.uint64) ^ salt
    for _ in range(2):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)


def _drawn(i: np.ndarray, x: np.ndarray, centers: list[np.ndarray], n: int, seed: int) -> list[tuple[int, float, int, np.ndarray]]:
    """(start, key, id, row) of the n rows of each start with the largest keys: draws without replacement by squared distance to its centres."""
    out = []
    for r, c in enumerate(centers):
        d = assign(x, c)[1] if len(c) else np.ones(len(x))
        key = np.full(len(x), -np.inf)
        np.divide(np.log(_uniform(i, seed, r, len(c))), d, out=key, where=d > 0)
        far = np.flatnonzero(key >= np.partition(key, -n)[-n]) if n < len(key) else np.arange(len(key))
        best = far[np.lexsort((i[far], -key[far]))[:n]]
        out += [(r, float(key[k]), int(i[k]), x[k]) for k in best if key[k] > -np.inf]
    return out


def _sums(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """For each start and centre: sum of its rows, their number and their squared distances."""
    R, S, K = centers.shape
    total = np.zeros((R, S, K + 2))
    for r, c in enumerate(centers):
        z, d = assign(x, c)
        for k, v in enumerate([*x.T, None, d]):
            total[r, :, k] = np.bincount(z, v, len(c))
    return total


class Rows:
    """Passes over packed rows (i, scores) where they are; a task returns a few rows of each start, or its sums."""

    def __init__(self, scores: DataFrame):
        self.scores = scores

    def draw(self, centers: list[np.ndarray], n: int, seed: int) -> list[np.ndarray]:
        """n new candidates of each start, fewer if no more rows lie apart from its centres. n rows a start come to the driver."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: list[tuple] = []
            for i, x in _blocks(batches):
                best = sorted([*best, *_drawn(i, x, centers, n, seed)], key=lambda t: (t[0], -t[1], t[2]))
                kept, count = [], dict.fromkeys(range(len(centers)), 0)
                for t in best:
                    count[t[0]] += 1
                    if count[t[0]] <= n:
                        kept.append(t)
                best = kept
            if best:
                r, key, ids, rows = zip(*best, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(key), pa.array(ids, pa.int64()), pa.array([x.tolist() for x in rows])], names=["r", "key", "i", "x"])

        got = self.scores.mapInArrow(run, "r long, key double, i long, x array<double>")
        first = got.withColumn("nth", F.row_number().over(W.partitionBy("r").orderBy(F.desc("key"), "i"))).where(F.col("nth") <= n)  # n rows of each task and start
        out: list[list] = [[] for _ in centers]
        for row in first.orderBy("r", "nth").collect():
            out[row.r].append(row.x)
        K = next((len(x) for rows in out for x in rows), 0)
        return [np.array(rows).reshape(len(rows), K) for rows in out]

    def sums(self, centers: np.ndarray) -> np.ndarray:
        R, S, K = centers.shape

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((R, S, K + 2))
            for _, x in _blocks(batches):
                total += _sums(x, centers)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["k", "v"])

        got = self.scores.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
        total = np.zeros(R * S * (K + 2))
        total[got.k] = got.v
        return total.reshape(R, S, K + 2)


def _matrix(scores: pa.Array) -> np.ndarray:
    """Column by column in memory."""
    return np.asfortranarray(scores.flatten().to_numpy(zero_copy_only=False).reshape(len(scores), -1))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        if b.num_rows:
            yield b["i"].to_numpy(zero_copy_only=False).astype(np.int64), normalized(_matrix(b["scores"]))


def moved(total: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Means of the clusters; an empty one keeps its centre."""
    n = total[..., -2:-1]
    return np.where(n > 0, total[..., :-2] / np.maximum(n, 1), centers)


def reclustered(x: np.ndarray, weight: np.ndarray, S: int, rng: np.random.Generator, tries: int = 5) -> np.ndarray:
    """S centres of weighted candidates: seeded by weighted squared distance, then weighted Lloyd steps; the best of a few tries. S times ROUNDS times OVERSAMPLING rows."""
    best, least = None, np.inf
    for _ in range(tries):
        c = x[[rng.choice(len(x), p=weight / weight.sum())]]
        while len(c) < S:
            far = weight * assign(x, c)[1]
            at = rng.choice(len(x), p=far / far.sum()) if far.sum() > 0 else len(c) % len(x)
            c = np.vstack([c, x[at]])
        for _ in range(STEPS):
            z, _ = assign(x, c)
            mass = np.bincount(z, weight, S)[:, None]
            new = np.where(mass > 0, np.stack([np.bincount(z, weight * x[:, k], S) for k in range(x.shape[1])], 1) / np.maximum(mass, EPS), c)
            if np.abs(new - c).max() <= STILL:
                break
            c = new
        within = float((weight * assign(x, c)[1]).sum())
        if within < least - 1e-12:
            best, least = c, within
    return best


def starts_of(rows: Rows, S: int, seed: int, starts: int) -> np.ndarray:
    """starts x S x K centres."""
    found = rows.draw([np.zeros((0, 0))] * starts, 1, seed)
    for _ in range(ROUNDS):
        more = rows.draw(found, OVERSAMPLING * S, seed)
        found = [np.vstack([a, b]) if len(b) else a for a, b in zip(found, more, strict=True)]
    most = max(map(len, found))
    # Candidates repeated to one length: the first of equal ones gets all rows, the others none.
    padded = np.stack([np.vstack([c, np.repeat(c[:1], most - len(c), 0)]) for c in found])
    weight = rows.sums(padded)[:, :, -2]
    return np.stack([reclustered(c, w, S, np.random.default_rng([seed, r])) for r, (c, w) in enumerate(zip(padded, weight, strict=True))])


def lloyd(rows: Rows, S: int, seed: int, starts: int = STARTS, steps: int = STEPS) -> np.ndarray:
    """Centres with the smallest within sum of squares after TRIAL_STEPS, moved on until they stand still (``steps`` in all). All starts share each pass over the rows."""
    centers = starts_of(rows, S, seed, starts)
    for _ in range(min(TRIAL_STEPS, steps)):
        new = moved(rows.sums(centers), centers)
        still = np.abs(new - centers).max() <= STILL
        centers = new
        if still:
            break
    best, least = 0, np.inf
    for r, within in enumerate(rows.sums(centers)[:, :, -1].sum(1)):
        if within < least - 1e-12:
            best, least = r, within
    one = centers[best : best + 1]
    for _ in range(steps - TRIAL_STEPS):
        new = moved(rows.sums(one), one)
        if np.abs(new - one).max() <= STILL:
            break
        one = new
    return one[0]


def kmeans(scores: DataFrame, S: int, seed: int = 0, steps: int = STEPS) -> tuple[np.ndarray, DataFrame]:
    """Centres and (i, z 1-based) of packed scores (i, scores). Every start and step is over all rows."""
    ship(scores.sparkSession)
    scores, _ = write(scores.select("i", "scores"), "kmeans-scores")
    centers = lloyd(Rows(scores), S, seed, steps=steps)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = assign(normalized(_matrix(b["scores"])), centers)[0] if b.num_rows else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([b["i"], pa.array(z.astype(np.int32) + 1)], names=["i", "z"])

    return centers, scores.select("i", "scores").mapInArrow(label, "i long, z int")


def motifs_from_scores(scores: DataFrame, S: int, D: int, seed: int, min_share: float = 0.10, allow_repeats: bool = True) -> np.ndarray:
    """S x D motifs (1-based) from cluster centres: factors with at least min_share, largest first, recycled to D."""
    from .fits import recycled

    centers, _ = kmeans(scores, S, seed)
    share = centers / np.maximum(centers.sum(1, keepdims=True), EPS)
    if allow_repeats:
        return np.array([recycled(c, D, min_share) for c in share])
    return np.array([np.argsort(-c, kind="stable")[:D] + 1 for c in share])
