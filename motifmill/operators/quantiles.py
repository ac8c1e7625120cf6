"""Exact quantiles by selection: cut points of a bounded sketch bracket a rank, rows below and inside the bracket are counted, and only what
is inside is looked at again.

No task keeps more than a sketch or a bracket of a group's values, however large the group is; sketches and counts are merged before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans.written import drop, write

#: Parts that a bracket is cut into, by ranks; the sketch's error is a small part of one.
CUTS = 256
#: Values of a bracket that are put in order; more are cut again.
MOST = 10_000


def _bracket(span: DataFrame, cuts: DataFrame, n: int) -> DataFrame:
    """Narrower lo and hi around the rank, one cut more on each side than the sketch's error needs."""
    c = cuts.select(F.col("g").alias("cg"), F.col("lo").alias("cl"), F.col("hi").alias("ch"), "cuts")
    both = span.join(c, span.g.eqNullSafe(c.cg) & (span.lo == c.cl) & (span.hi == c.ch))
    at = F.floor((F.col("at") - F.col("before")) / F.col("inside") * n).cast("int")
    low = F.when(at >= 1, F.element_at("cuts", F.greatest(at, F.lit(1)))).otherwise(F.col("lo"))
    high = F.when(at + 3 <= n + 1, F.element_at("cuts", F.least(at + 3, F.lit(n + 1)))).otherwise(F.col("hi"))
    return both.select("g", "at", "before", "lo", "hi", low.alias("low"), high.alias("high"))


def quantiles(df: DataFrame, value: str, probs: dict[str, float], by: list[str] | None = None, cuts: int = CUTS, most: int = MOST) -> DataFrame:
    """The columns of ``by`` and one column for each name of probs: quantiles with linear interpolation between ranks.

    Null and NaN values don't count; a group without any has no row, and neither has an empty table. A null group is a group like others.
    """
    keys = list(by or [])
    group: Column = F.struct(*(F.col(f"`{k}`") for k in keys)) if keys else F.struct(F.lit(0).alias("all"))
    rows, _ = write(df.select(group.alias("g"), F.col(f"`{value}`").cast("double").alias("v")).where("v is not null and not isnan(v)"), "quantile-rows")
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    ranks = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), (F.lit(float(p)) * (F.col("n") - 1)).alias("rank")) for name, p in probs.items()))).alias("q")
    asked, _ = write(sizes.select("g", "n", "lo", "hi", ranks).select("g", "n", "lo", "hi", "q.*"), "quantiles")
    # A rank (from 0) of a group, the bracket it is in, the rows inside the bracket and those below it.
    places = asked.select("g", F.explode(F.array(F.floor("rank"), F.ceil("rank"))).alias("at"), "lo", "hi", F.col("n").alias("inside"), F.lit(0).cast("long").alias("before")).distinct()
    wanted, path = write(places, "ranks")
    todo = (F.col("inside") > most) & (F.col("lo") < F.col("hi"))
    while wanted.where(todo).limit(1).count():
        span = wanted.where(todo)
        held = span.select(F.col("g").alias("hg"), "lo", "hi").distinct()
        sketch = rows.join(held, rows.g.eqNullSafe(held.hg) & F.col("v").between(F.col("lo"), F.col("hi"))).groupBy("g", "lo", "hi").agg(F.percentile_approx("v", [k / cuts for k in range(cuts + 1)], 40 * cuts).alias("cuts"))
        near = _bracket(span, sketch, cuts).withColumnRenamed("g", "ng")
        v, mid = F.col("v"), (F.col("v") > F.col("low")) & (F.col("v") < F.col("high"))
        count = lambda c: F.sum(c.cast("long"))
        counted = rows.join(near, rows.g.eqNullSafe(near.ng) & v.between(F.col("lo"), F.col("high"))).groupBy("g", "at", "before", "low", "high").agg(
            count(v < F.col("low")).alias("under"), count(v == F.col("low")).alias("n_low"), count(mid).alias("n_mid"), count((v == F.col("high")) & (v > F.col("low"))).alias("n_high"), F.min(F.when(mid, v)).alias("mid_lo"), F.max(F.when(mid, v)).alias("mid_hi")
        )
        # The ends of the bracket are values of their own, so what is between them always gets less, whatever the ties.
        below = F.col("before") + F.col("under")
        of_low, of_mid = F.col("at") - below < F.col("n_low"), F.col("at") - below < F.col("n_low") + F.col("n_mid")
        pick = lambda low, mid, high: F.when(of_low, low).when(of_mid, mid).otherwise(high)
        counted = counted.select("g", "at", pick(F.col("low"), F.col("mid_lo"), F.col("high")).alias("lo"), pick(F.col("low"), F.col("mid_hi"), F.col("high")).alias("hi"), pick(F.col("n_low"), F.col("n_mid"), F.col("n_high")).alias("inside"), pick(below, below + F.col("n_low"), below + F.col("n_low") + F.col("n_mid")).alias("before"))
        done = wanted.where(~todo)
        old = path
        wanted, path = write(done.union(counted), "ranks")
        drop(old)
    found = _values(rows, wanted)
    ends = [found.select(F.col("g").alias(f"g{k}"), F.col("at").alias(f"at{k}"), F.col("x").alias(f"x{k}")) for k in (0, 1)]
    both = asked
    for k, at in enumerate((F.floor("rank"), F.ceil("rank"))):
        both = both.join(ends[k], both.g.eqNullSafe(ends[k][f"g{k}"]) & (at == ends[k][f"at{k}"]))
    part = F.col("rank") - F.floor("rank")
    values = both.select("g", "name", ((1 - part) * F.col("x0") + part * F.col("x1")).alias("x"))
    out = values.groupBy("g").agg(*(F.max(F.when(F.col("name") == name, F.col("x"))).alias(name) for name in probs))
    return out.select(*(F.col("g")[k].alias(k) for k in keys), *probs)


def _values(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """g, at, x: the value at each rank; the bracket's rows are put in order, unless they are all equal."""
    open_ = wanted.where("lo < hi").withColumnRenamed("g", "wg")
    ordered = rows.join(open_, rows.g.eqNullSafe(open_.wg) & F.col("v").between(F.col("lo"), F.col("hi")))
    nth = F.row_number().over(W.partitionBy("g", "at").orderBy("v")) - 1  # at most MOST rows
    picked = ordered.withColumn("nth", nth).where(F.col("nth") == F.col("at") - F.col("before")).select("g", "at", F.col("v").alias("x"))
    return wanted.where("lo = hi").select("g", "at", F.col("lo").alias("x")).union(picked)


def with_quantiles(stats: DataFrame, df: DataFrame, value: str, probs: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """stats (one row for each group of ``by``) with the quantiles of df beside it; null for groups without values."""
    keys = list(by or [])
    q = quantiles(df, value, probs, keys).select(*(F.col(k).alias(f"_q_{k}") for k in keys), *probs)
    on = reduce(lambda a, b: a & b, (stats[k].eqNullSafe(q[f"_q_{k}"]) for k in keys), F.lit(True))
    return stats.join(q, on, "left").drop(*(f"_q_{k}" for k in keys))
