"""Sparse count matrices: counts(i, m, y > 0) with explicit sample and feature dimensions, and their packed form."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans.scan import row_numbers
from ..plans.ship import ship
from ..plans.written import write

#: Names that one task puts in order; more are put in order by ranges.
ONE_TASK = 1_000_000


@dataclass
class Counts:
    counts: DataFrame  # i, m, y
    features: DataFrame  # m, name
    samples: DataFrame  # i, total
    #: The samples are those with counts, and their totals the sums of these.
    own_totals: bool = False

    def packed(self) -> DataFrame:
        """i, mi, y, total: one row for each sample, those without counts too. A row has a cell for each feature of the sample; plans/blocks.py cuts them."""
        if self.own_totals:
            ship(self.counts.sparkSession)
            cells = self.counts.select("i", F.col("m").cast("int").alias("m"), F.col("y").cast("double").alias("y"))
            return cells.repartition("i").sortWithinPartitions("i", "m").mapInArrow(_rows_of_cells, "i long, mi array<int>, y array<double>, total double")
        pairs = self.counts.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("m", "y"))).alias("c"))
        rows = self.samples.select("i", "total").join(pairs, "i", "left")
        return rows.select("i", F.coalesce("c.m", F.array().cast("array<int>")).alias("mi"), F.coalesce("c.y", F.array().cast("array<double>")).alias("y"), "total")

    def n_features(self) -> int:
        return self.features.count()


def _rows_of_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells in order of i, one row for each; the last sample of a batch may go on in the next one."""
    held: list[tuple[np.ndarray, ...]] = []
    for b in batches:
        i, m, y = (b[c].to_numpy(zero_copy_only=False) for c in ("i", "m", "y"))
        if not len(i):
            continue
        cut = int(np.searchsorted(i, i[-1]))
        if held and (cut or held[0][0][0] != i[-1]):
            yield _row_batch([*held, (i[:cut], m[:cut], y[:cut])])
            held = []
        elif cut:
            yield _row_batch([(i[:cut], m[:cut], y[:cut])])
        held.append((i[cut:], m[cut:], y[cut:]))
    if held:
        yield _row_batch(held)


def _row_batch(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    i, m, y = (np.concatenate(x) for x in zip(*parts, strict=True))
    at = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
    ends = np.append(at, len(i)).astype(np.int32)
    columns = [pa.array(i[at]), pa.ListArray.from_arrays(ends, m), pa.ListArray.from_arrays(ends, y), pa.array(np.add.reduceat(y, at))]
    return pa.RecordBatch.from_arrays(columns, names=["i", "mi", "y", "total"])


def ranked_features(names: DataFrame) -> DataFrame:
    """m (1-based rank of the name), name, of distinct names, whatever their number."""
    if names.limit(ONE_TASK + 1).count() <= ONE_TASK:
        return names.select(F.row_number().over(W.orderBy("name")).alias("m"), "name")
    return row_numbers(names.select("name"), "name", name="m").select(F.col("m").cast("int").alias("m"), "name")


def counts_from(df: DataFrame, sample: str | Column, feature: str | Column, value: str | Column | None = None, features: DataFrame | None = None, samples: DataFrame | None = None) -> Counts:
    """Count rows (or sum a value) by sample and feature. ``features`` (name) and ``samples`` (i) add members without counts.

    Rows with a null sample or feature are left out; sums that are not positive are not cells. The cells and the features' names are written once,
    as fits and summaries read them again and again.
    """
    s = F.col(sample) if isinstance(sample, str) else sample
    f = F.col(feature) if isinstance(feature, str) else feature
    y = F.lit(1.0) if value is None else (F.col(value) if isinstance(value, str) else value).cast("double")
    cells = df.select(s.cast("long").alias("i"), f.alias("name"), y.alias("y")).where("i is not null and name is not null")
    cells, _ = write(cells.groupBy("i", "name").agg(F.sum("y").alias("y")).where("y > 0"), "cells")
    names, _ = write((cells if features is None else features).select("name").distinct(), "names")
    dim = ranked_features(names)
    counts = cells.join(dim, "name").select("i", "m", "y")
    totals = cells.groupBy("i").agg(F.sum("y").alias("total"))
    if samples is not None:
        totals = samples.select(F.col("i").cast("long").alias("i")).distinct().join(totals, "i", "left").select("i", F.coalesce("total", F.lit(0.0)).alias("total"))
    return Counts(counts, dim, totals, features is None and samples is None)


def top_features(df: DataFrame, sample: str, feature: str, top: int) -> DataFrame:
    """The features found in most samples, ties by name: a bounded vocabulary."""
    seen = df.select(sample, feature).distinct().groupBy(F.col(feature).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return seen.orderBy(F.desc("n"), "name").limit(top).select("name")


def tokens(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each [a-z]+ token of the lower-cased text."""
    return documents.select(F.col(id_col), F.explode(F.regexp_extract_all(F.lower(text_col), F.lit("[a-z]+"), F.lit(0))).alias("token"))


def row_totals(c: DataFrame) -> DataFrame:
    return c.groupBy("i").agg(F.sum("y").alias("total"))


def column_totals(c: DataFrame, features: DataFrame) -> DataFrame:
    """Totals of all features, those without counts too."""
    sums = c.groupBy("m").agg(F.sum("y").alias("total"))
    return features.join(sums, "m", "left").select("m", "name", F.coalesce("total", F.lit(0.0)).alias("total"))


def sparsity_profile(c: Counts) -> DataFrame:
    """n_samples, n_features, nnz, total, max_y, density: one row."""
    cells = c.counts.agg(F.count(F.lit(1)).alias("nnz"), F.sum("y").alias("total"), F.max("y").alias("max_y"))
    n = c.samples.agg(F.count(F.lit(1)).alias("n_samples"))
    m = c.features.agg(F.count(F.lit(1)).alias("n_features"))
    one = cells.crossJoin(n).crossJoin(m)  # three rows of one
    return one.select("n_samples", "n_features", "nnz", "total", "max_y", (F.col("nnz") / (F.col("n_samples") * F.col("n_features"))).alias("density"))


def customer_by(spark: SparkSession, sf_dir: str, column: str) -> Counts:
    """Line items by customer and a column of part."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    lines = t("lineitem").select("l_orderkey", "l_partkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(t("part").select("p_partkey", column), F.col("l_partkey") == F.col("p_partkey"))
    return counts_from(lines, "o_custkey", column)
