"""Counts cut by blocks of features, for factors that don't fit one machine.

A sample's cells are one piece for each block. Factors are a table with a row for each block, and a pass lets the pieces of a block meet that row:
what comes out are parts of the samples' sums, added up by sample, and parts of the block's sums, which stay a table. Only vectors whose
length does not depend on the number of features come to the driver. A block that many samples use is dealt out in slices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.batch import Batch
from ..sources.counts import Counts
from .ship import ship
from .sweep import ROWS, batch_of, state_of
from .written import drop, write

#: Features of a block.
FEATURES = 4096
#: Pieces that meet one copy of a block.
PIECES = 20_000
#: Slices whose sums are added up together before those of the block.
FAN = 64


@dataclass
class Table:
    """A written table that is dropped when the next one has taken its place."""

    rows: DataFrame
    path: str

    @classmethod
    def of(cls, df: DataFrame, name: str) -> Table:
        return cls(*write(df, name))

    def then(self, df: DataFrame, name: str) -> Table:
        new = Table.of(df, name)
        drop(self.path)
        return new


@dataclass
class Factors:
    """K rows of factors by block: rows (blk, f: K x width doubles); a row of factors is f / scale."""

    table: Table
    scale: np.ndarray
    size: int

    @property
    def K(self) -> int:
        return len(self.scale)

    @property
    def rows(self) -> DataFrame:
        return self.table.rows

    @property
    def block(self) -> Callable[[bytes], np.ndarray]:
        """K x width factors from a row's f; holds the scale alone, so tasks can have it."""
        scale = self.scale[:, None]
        return lambda raw: np.frombuffer(raw).reshape(len(scale), -1) / scale

    def frame(self) -> DataFrame:
        """k, m, f."""
        size, block, K = self.size, self.block, self.K

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for blk, raw in zip(b["blk"].to_pylist(), b["f"].to_pylist(), strict=True):
                    f = block(raw)
                    w = f.shape[1]
                    cells = [np.repeat(np.arange(1, K + 1, dtype=np.int32), w), np.tile(np.arange(w, dtype=np.int32) + blk * size + 1, K), f.ravel()]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], names=["k", "m", "f"])

        ship(self.rows.sparkSession)
        return self.rows.mapInArrow(run, "k int, m int, f double")


def by_block(rows: DataFrame, run: Callable[[int, list[bytes | None]], np.ndarray], *columns: str) -> DataFrame:
    """blk, f from each row's binary columns."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                blk = b["blk"][at].as_py()
                f = run(blk, [b[c][at].as_py() for c in columns])
                yield pa.RecordBatch.from_arrays([pa.array([blk], pa.int32()), pa.array([np.ascontiguousarray(f, float).tobytes()], pa.binary())], names=["blk", "f"])

    ship(rows.sparkSession)
    return rows.select("blk", *columns).mapInArrow(each, "blk int, f binary")


def totals(rows: DataFrame, run: Callable[..., np.ndarray], size: int, *columns: str) -> np.ndarray:
    """Sum over all rows of run(columns of a batch); a vector of ``size``, whatever the number of features."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += run(*(b[c].to_pylist() for c in columns))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["k", "v"])

    ship(rows.sparkSession)
    cells = rows.select(*columns).mapInArrow(each, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(size)
    out[cells.k] = cells.v
    return out


def normalised(raw: DataFrame, K: int, size: int, before: Table | None = None) -> Factors:
    """Factors from rows (blk, f) that are not normalised: their sums over all blocks become the scale."""
    table = Table.of(raw, "factors") if before is None else before.then(raw, "factors")
    return Factors(table, totals(table.rows, lambda fs: sum(np.frombuffer(f).reshape(K, -1).sum(1) for f in fs), K, "f"), size)


def factors_by(spark: SparkSession, M: int, K: int, size: int, values: Callable[[np.ndarray], np.ndarray]) -> Factors:
    """values(1-based numbers of features) gives K rows."""
    blocks = spark.range(-(-M // size)).select(F.col("id").cast("int").alias("blk"))
    return normalised(by_block(blocks, lambda blk, _: values(np.arange(blk * size + 1, min((blk + 1) * size, M) + 1))), K, size)


def factors_from(factors: DataFrame, K: int, size: int, least: float) -> Factors:
    """From a complete table (k, m, f), both 1-based."""
    blk = F.floor((F.col("m") - 1) / size).cast("int").alias("blk")
    cells = factors.groupBy(blk).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "m", "f"))), lambda c: c["f"]).alias("fs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fs = [np.maximum(np.array(x.as_py()), least).tobytes() for x in b["fs"]]
            yield pa.RecordBatch.from_arrays([b["blk"], pa.array(fs, pa.binary())], names=["blk", "f"])

    ship(factors.sparkSession)
    return normalised(cells.mapInArrow(run, "blk int, f binary"), K, size)


#: (batch of pieces, their samples' states, the block's factors) -> rows for the samples, a vector for the block; either may be None.
Kernel = Callable[[Batch, np.ndarray, np.ndarray], tuple[np.ndarray | None, np.ndarray | None]]


@dataclass
class Blocks:
    pieces: DataFrame  # blk, i, mi (1-based in the block), y
    slices: DataFrame  # blk, n: slices that its pieces are dealt to
    samples: DataFrame  # i, total
    M: int
    size: int

    def meet(self, state: DataFrame, width: int, factors: Factors, kernel: Kernel, take: list[tuple[int, int]] | None = None) -> DataFrame:
        """i or blk (the other is null), slice, v: what the pieces with their samples' state (i, total, state) make of their blocks.

        take: ranges of the state's columns that the kernel gets, all of them if None. Each piece carries them through two shuffles.
        """
        if take is not None:
            width = sum(hi - lo for lo, hi in take)
            state = state.withColumn("state", F.concat(*(F.substring("state", 8 * lo + 1, 8 * (hi - lo)) for lo, hi in take)))
        own = F.pmod(F.xxhash64("i"), F.col("n")).cast("int").alias("slice")
        left = self.pieces.join(self.slices, "blk").select("blk", "i", "mi", "y", own).join(state.select("i", "total", "state"), "i")
        right = factors.rows.join(self.slices, "blk").select("blk", "f", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("slice"))
        block = factors.block

        def run(a: pa.Table, b: pa.Table) -> pa.Table:
            i, blk, v = [], [], []
            if a.num_rows and b.num_rows:
                f, total = block(b["f"][0].as_py()), None
                for part in a.combine_chunks().to_batches(max_chunksize=ROWS):
                    rows, sums = kernel(batch_of(part), state_of(part, width), f)
                    if rows is not None:
                        i += part["i"].to_pylist()
                        v += [r.tobytes() for r in np.ascontiguousarray(rows, float)]
                    if sums is not None:
                        total = sums if total is None else total + sums
                blk = [None] * len(i)
                if total is not None:
                    i, blk, v = [*i, None], [*blk, b["blk"][0].as_py()], [*v, np.ascontiguousarray(total, float).tobytes()]
            n = a["slice"][0].as_py() if a.num_rows else 0
            return pa.table({"i": pa.array(i, pa.int64()), "blk": pa.array(blk, pa.int32()), "slice": pa.array([n] * len(i), pa.int32()), "v": pa.array(v, pa.binary())})

        ship(state.sparkSession)
        return left.groupBy("blk", "slice").cogroup(right.groupBy("blk", "slice")).applyInArrow(run, "i long, blk int, slice int, v binary")

    def update(self, state: DataFrame, width: int, met: DataFrame, sums: int, step: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
        """i, total, state after step(ids, totals, states, sums of the sample's parts); samples without cells have sums of 0.

        A sample's state and parts are one run of a sorted range, so a sample may have any number of blocks.
        """
        none = F.lit(None)
        parts = met.where("i is not null").select("i", none.cast("double").alias("total"), none.cast("binary").alias("state"), "v")
        both = state.select("i", "total", "state", none.cast("binary").alias("v")).union(parts)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last: pa.RecordBatch | None = None  # the last sample so far, and its sums
            held = np.zeros((1, sums))
            for b in batches:
                own = b["state"].is_valid().to_numpy(zero_copy_only=False)
                parts = np.frombuffer(b"".join(b["v"].drop_null().to_pylist())).reshape(-1, sums)
                got = np.vstack([held, np.zeros((int(own.sum()), sums))])
                np.add.at(got, np.cumsum(own)[~own], parts)
                rows = b.filter(pa.array(own)).select(["i", "total", "state"])
                if last is not None:
                    rows = pa.Table.from_batches([last, rows]).combine_chunks().to_batches()[0]
                else:
                    got = got[1:]
                n = rows.num_rows - 1
                if n > 0:
                    yield _stepped(rows.slice(0, n), got[:n], width, step)
                if n >= 0:
                    last, held = rows.slice(n), got[n:]
            if last is not None:
                yield _stepped(last, held, width, step)

        ship(state.sparkSession)
        return both.repartition("i").sortWithinPartitions("i", F.col("state").isNull()).mapInArrow(run, "i long, total double, state binary")

    def block_sums(self, met: DataFrame) -> DataFrame:
        """blk, v: the sums of each block, by slices first."""
        part = F.floor(F.col("slice") / FAN).cast("int")
        fine = met.where("blk is not null").select("blk", part.alias("part"), "v")
        return _added(_added(fine).withColumn("part", F.lit(0))).select("blk", "v")


def _stepped(rows: pa.RecordBatch, got: np.ndarray, width: int, step: Callable) -> pa.RecordBatch:
    new = step(rows["i"].to_numpy(), rows["total"].to_numpy(zero_copy_only=False), state_of(rows, width), got)
    return pa.RecordBatch.from_arrays([rows["i"], rows["total"], pa.array([r.tobytes() for r in np.ascontiguousarray(new, float)], pa.binary())], names=["i", "total", "state"])


def _added(rows: DataFrame) -> DataFrame:
    """blk, part, v: vectors of a (blk, part) added up, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["blk", "part", "v"])

        for b in batches:
            for at in range(b.num_rows):
                k, v = (b["blk"][at].as_py(), b["part"][at].as_py()), np.frombuffer(b["v"][at].as_py())
                if k == key:
                    total = total + v
                else:
                    if key is not None:
                        yield out()
                    key, total = k, v
        if key is not None:
            yield out()

    ship(rows.sparkSession)
    return rows.repartition("blk", "part").sortWithinPartitions("blk", "part").mapInArrow(run, "blk int, part int, v binary")


def cut(counts: Counts, size: int = FEATURES, pieces: int = PIECES) -> Blocks:
    """Pieces are written once. One has at most a block's cells."""
    blk = F.floor((F.col("m") - 1) / size).cast("int")
    cells = counts.counts.select("i", blk.alias("blk"), ((F.col("m") - 1) % size + 1).cast("int").alias("at"), "y")
    packed = cells.groupBy("i", "blk").agg(F.sort_array(F.collect_list(F.struct("at", "y"))).alias("c")).select("blk", "i", F.col("c.at").alias("mi"), F.col("c.y").alias("y"))
    rows, _ = write(packed, "pieces")
    slices, _ = write(rows.groupBy("blk").agg(F.ceil(F.count(F.lit(1)) / pieces).cast("int").alias("n")), "slices")  # one row a block
    samples, _ = write(counts.samples.select("i", F.col("total").cast("double").alias("total")), "samples")
    return Blocks(rows, slices, samples, counts.n_features(), size)


def first_state(samples: DataFrame, start: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """i, total, state = start(ids, totals)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                new = np.ascontiguousarray(start(b["i"].to_numpy(zero_copy_only=False), b["total"].to_numpy(zero_copy_only=False)), float)
                yield pa.RecordBatch.from_arrays([b["i"], b["total"], pa.array([r.tobytes() for r in new], pa.binary())], names=["i", "total", "state"])

    ship(samples.sparkSession)
    return samples.select("i", "total").mapInArrow(run, "i long, total double, state binary")
