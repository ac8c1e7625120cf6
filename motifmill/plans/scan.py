"""Prefix scans along an order: rows are dealt out by ranges of the order, each range is scanned on its own, and one carry row a range links them.

No range holds more than its share of the rows unless many rows agree in the whole order; columns that tell them apart belong to the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .written import write

PART, AT = "_scan_part", "_scan_at"


def in_ranges(df: DataFrame, *order: str, parts: int | None = None) -> DataFrame:
    """df with its range (PART) and its place in it (AT, from 0), written once so that both stay."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return write(dealt.select("*", F.spark_partition_id().alias(PART), inside.alias(AT)), "ranges")[0]


def row_numbers(df: DataFrame, *order: str, name: str = "n", parts: int | None = None) -> DataFrame:
    """df with a column of numbers from 1 along the order."""
    ranged = in_ranges(df, *order, parts=parts)
    sizes = ranged.groupBy(PART).count()  # one row a range
    before = W.orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    carry = sizes.select(F.col(PART), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(carry), PART).withColumn(name, F.col("_before") + F.col(AT) + 1).drop(PART, AT, "_before")


def change_numbers(df: DataFrame, order: list[str], values: list[str], name: str = "run", parts: int | None = None) -> DataFrame:
    """df with the number (from 1) of the stretch of equal values it is in, along the order; nulls are equal to nulls.

    First pass: changes inside a range, and for each range its first and last values and how many changes it has. The carry rows, one a range,
    say whether a range goes on with the last stretch of the one before. Second pass: changes so far plus the carry.
    """
    ranged = in_ranges(df, *order, parts=parts)
    here = W.partitionBy(PART).orderBy(AT)
    now: Column = F.struct(*(F.col(v) for v in values))
    changed = F.when(F.col(AT) == 0, 0).otherwise(F.when(now.eqNullSafe(F.lag(now).over(here)), 0).otherwise(1))
    inner = ranged.withColumn("_changed", changed)
    edges = inner.groupBy(PART).agg(F.min_by(now, AT).alias("head"), F.max_by(now, AT).alias("tail"), F.sum("_changed").alias("inside"))
    along = W.orderBy(PART)  # one row a range
    edges = edges.withColumn("opens", F.when(F.col("head").eqNullSafe(F.lag("tail").over(along)) & F.lag(PART).over(along).isNotNull(), 0).otherwise(1))
    earlier = along.rowsBetween(W.unboundedPreceding, -1)
    carry = edges.select(PART, (F.coalesce(F.sum(F.col("inside") + F.col("opens")).over(earlier), F.lit(0)) + F.col("opens")).alias("_carry"))
    return inner.withColumn("_inside", F.sum("_changed").over(here)).join(F.broadcast(carry), PART).withColumn(name, F.col("_inside") + F.col("_carry")).drop(PART, AT, "_changed", "_inside", "_carry")
