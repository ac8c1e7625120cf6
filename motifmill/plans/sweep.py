"""One pass over packed samples with state: new rows are written, sums over all samples come back as one vector.

A pass reads counts and state side by side and shuffles nothing but the sums, which are added up on the executors cell by cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.batch import Batch
from .ship import ship
from .written import drop, write

#: A pass writes a sample's features and counts as bytes, which go to and from the tasks without a step for each cell.
SCHEMA = "i long, mi binary, y binary, total double, state binary, sums array<double>"
#: Samples in one vectorised batch.
ROWS = 2048


@dataclass
class Passed:
    rows: DataFrame
    path: str
    sums: np.ndarray

    def samples(self) -> DataFrame:
        return self.rows.where("i is not null").drop("sums")

    def drop(self) -> None:
        drop(self.path)


def _cells(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Values of all rows, and where each row's begin, of an array column or its bytes."""
    if pa.types.is_binary(column.type):
        at = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset) if len(column) else np.zeros(1, np.int32)
        data = column.buffers()[2]
        flat = np.frombuffer(data, np.uint8, at[-1] - at[0], at[0]) if data is not None else np.zeros(0, np.uint8)
        return flat.view(kind), (at - at[0]) // np.dtype(kind).itemsize
    at = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]], at - at[0]


def _bytes(column: pa.Array, kind: type) -> pa.Array:
    if pa.types.is_binary(column.type):
        return column
    flat, at = _cells(column, kind)
    ends = (at * np.dtype(kind).itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat, kind))])


def batch_of(b: pa.RecordBatch) -> Batch:
    (m, at), (y, _) = _cells(b["mi"], np.int32), _cells(b["y"], np.float64)
    return Batch(b.num_rows, np.repeat(np.arange(b.num_rows), np.diff(at)), m.astype(np.int64) - 1, y, b["total"].to_numpy(zero_copy_only=False))


def state_of(b: pa.RecordBatch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(b["state"].to_pylist()), float).reshape(b.num_rows, width)


def with_state(b: pa.RecordBatch, state: np.ndarray) -> pa.RecordBatch:
    flat = np.ascontiguousarray(state, float)
    n = b.num_rows
    cells = pa.array([r.tobytes() for r in flat], pa.binary())
    return pa.RecordBatch.from_arrays([b["i"], _bytes(b["mi"], np.int32), _bytes(b["y"], np.float64), b["total"], cells, pa.nulls(n, pa.list_(pa.float64()))], names=["i", "mi", "y", "total", "state", "sums"])


def sweep(rows: DataFrame, step: Callable[[np.ndarray, Batch, np.ndarray | None], tuple[np.ndarray, np.ndarray]], width: int | None, size: int) -> Passed:
    """step(ids, batch, state) -> (new state, sums of the batch); width: columns of the state that rows have, or None for none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size)
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                b = whole.slice(lo, ROWS)
                state, s = step(b["i"].to_numpy(), batch_of(b), None if width is None else state_of(b, width))
                sums += s
                yield with_state(b, state)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.float64()), pa.nulls(1, pa.binary()), pa.array([sums], pa.list_(pa.float64()))], names=["i", "mi", "y", "total", "state", "sums"])

    ship(rows.sparkSession)
    out, path = write(rows.mapInArrow(run, SCHEMA), "pass")
    cells = out.where("i is null").select(F.posexplode("sums").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    sums = np.zeros(size)
    sums[cells.k] = cells.v
    return Passed(out, path, sums)


def unpack(samples: DataFrame, width: int, cells: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """Long rows from the state: cells(ids, state) gives columns of equal length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                out = cells(part["i"].to_numpy(), state_of(part, width))
                yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in out.values()], names=list(out))

    ship(samples.sparkSession)
    return samples.select("i", "state").mapInArrow(run, schema)


def uniform(seed: int, ids: np.ndarray, width: int) -> np.ndarray:
    """Draws in (0, 1) keyed by (seed, id, column): the same under any partitioning."""
    x = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(width, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    x = x + np.uint64((seed * 0x2545F4914F6CDD1D + 0x632BE59BD9B4E019) % (1 << 64))
    for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(mult)
    x = x ^ (x >> np.uint64(31))
    return ((x >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


def exponential(seed: int, ids: np.ndarray, width: int) -> np.ndarray:
    """Gamma(1, 1) draws."""
    return -np.log(uniform(seed, ids, width))
