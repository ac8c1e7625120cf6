"""Row-wise algebra over array columns, and its long-form counterparts over a partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

EPS = 1e-12


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def log_sum_exp(x: Column) -> Column:
    top = F.array_max(x)
    return top + F.ln(total(F.transform(x, lambda v: F.exp(v - top))))


def softmax(x: Column) -> Column:
    z = log_sum_exp(x)
    return F.transform(x, lambda v: F.exp(v - z))


def normalize(x: Column, eps: float = EPS) -> Column:
    """Clamp first, then divide by the sum."""
    low = F.transform(x, lambda v: F.greatest(v, F.lit(eps)))
    s = total(low)
    return F.transform(low, lambda v: v / s)


def entropy(x: Column) -> Column:
    """Of a distribution, over ln of its length; null for a single entry."""
    h = total(F.transform(x, lambda p: F.when(p > 0, -p * F.ln(p)).otherwise(F.lit(0.0))))
    return F.when(F.size(x) > 1, h / F.ln(F.size(x).cast("double")))


def argmax(x: Column) -> Column:
    """1-based place of the maximum, the first of equals."""
    return F.array_position(x, F.array_max(x)).cast("int")


def recycle(x: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda d: F.element_at(x, ((d - 1) % F.size(x) + 1).cast("int")))


def support_label(ids: Column) -> Column:
    """Distinct ids in numeric order, joined by commas."""
    return F.array_join(F.transform(F.array_sort(F.array_distinct(ids)), lambda v: v.cast("string")), ",")


def top_label(scores: Column, n: Column) -> Column:
    """Label of the n largest scores; lower ids first among equals."""
    ranked = F.array_sort(F.transform(scores, lambda v, k: F.struct((-v).alias("v"), (k + 1).alias("k"))))
    return support_label(F.transform(F.slice(ranked, F.lit(1), n), lambda r: r["k"]))


def x_log_x(p: Column) -> Column:
    return F.when(p > 0, p * F.ln(p)).otherwise(F.lit(0.0))


def softmax_over(df: DataFrame, keys: Sequence[str], score: str, out: str) -> DataFrame:
    """Long form: exp(score) over its sum within keys, shifted by the maximum."""
    w = W.partitionBy(*keys)
    e = F.exp(F.col(score) - F.max(score).over(w))
    return df.withColumn(out, e).withColumn(out, F.col(out) / F.sum(out).over(w))


def share_over(df: DataFrame, keys: Sequence[str], value: str, out: str, eps: float | None = None) -> DataFrame:
    v = F.col(value) if eps is None else F.greatest(F.col(value), F.lit(eps))
    return df.withColumn(out, v / F.sum(v).over(W.partitionBy(*keys)))


def log_sum_exp_by(df: DataFrame, keys: Sequence[str], score: str, out: str) -> DataFrame:
    top = df.withColumn("_top", F.max(score).over(W.partitionBy(*keys)))
    return top.groupBy(*keys).agg((F.max("_top") + F.ln(F.sum(F.exp(F.col(score) - F.col("_top"))))).alias(out))


def cosine(a: DataFrame, b: DataFrame, row_a: str, row_b: str, on: str, va: str, vb: str) -> DataFrame:
    """row_a, row_b, cosine of all pairs of rows of two small long matrices that share a column (pairs without one have no row)."""
    na = a.groupBy(row_a).agg(F.sqrt(F.sum(F.col(va) * F.col(va))).alias("_na"))
    nb = b.groupBy(row_b).agg(F.sqrt(F.sum(F.col(vb) * F.col(vb))).alias("_nb"))
    ab = a.join(b, on).groupBy(row_a, row_b).agg(F.sum(F.col(va) * F.col(vb)).alias("_ab"))
    return ab.join(na, row_a).join(nb, row_b).select(row_a, row_b, (F.col("_ab") / (F.col("_na") * F.col("_nb"))).alias("cosine"))
