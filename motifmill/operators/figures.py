"""The tables behind the diagnostic figures: one row for each mark, ready for any plotting tool."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans.scan import change_numbers
from . import summaries as S


def elbo_curve(history: DataFrame) -> DataFrame:
    """iter, elbo, gain over the evaluation before (null for the first). One row an iteration, so one ordered window is enough."""
    return history.withColumn("gain", F.col("elbo") - F.lag("elbo").over(W.orderBy("iter")))


def support_cells(labels: DataFrame, truth: DataFrame) -> DataFrame:
    """i, grp, k, recovered, expected: the cells of the recovered-support figure."""
    split = lambda df, c: df.select("i", F.explode(F.split(F.col(c), ",").cast("array<int>")).alias("k"))
    a = split(labels, "label").withColumn("recovered", F.lit(True))
    b = split(truth, "true_support_label").withColumn("expected", F.lit(True))
    x = a.join(b, ["i", "k"], "full_outer").join(truth.select("i", "grp"), "i")
    return x.select("i", "grp", "k", F.coalesce("recovered", F.lit(False)).alias("recovered"), F.coalesce("expected", F.lit(False)).alias("expected"))


def rank_heatmap(sizes: DataFrame, truth: DataFrame) -> DataFrame:
    """grp, rank, mean share of a sample's size in its effect of that rank."""
    r = S.ranked_effects(sizes).withColumn("share", F.col("size") / F.sum("size").over(W.partitionBy("i")))
    return r.join(truth, "i").groupBy("grp", "rank").agg(F.avg("share").alias("share"))


def ranked_gamma(effects: DataFrame, sizes: DataFrame) -> DataFrame:
    """i, rank, k, p: distributions of the effects in order of size."""
    return effects.join(S.ranked_effects(sizes).select("i", "d", "rank"), ["i", "d"]).select("i", "rank", "k", "p")


def gamma_heatmap(effects: DataFrame, sizes: DataFrame, truth: DataFrame) -> DataFrame:
    """grp, rank, k, mean p."""
    return ranked_gamma(effects, sizes).join(truth, "i").groupBy("grp", "rank", "k").agg(F.avg("p").alias("p"))


def factor_ids(sizes: DataFrame, truth: DataFrame) -> DataFrame:
    """grp, rank, top_factor, n: which factor the effect of each rank points at."""
    return S.ranked_effects(sizes).join(truth, "i").groupBy("grp", "rank", "top_factor").agg(F.count(F.lit(1)).alias("n"))


def representative(sizes: DataFrame, truth: DataFrame) -> DataFrame:
    """grp, i: the sample of each group whose largest size is closest to the group's mean, lowest id first."""
    top = S.ranked_effects(sizes).where("rank = 1").join(truth, "i")
    gap = top.withColumn("gap", F.round(F.abs(F.col("size") - F.avg("size").over(W.partitionBy("grp"))), 9))
    return gap.groupBy("grp").agg(F.min_by("i", F.struct("gap", "i")).alias("i"))


def run_boundaries(labels: DataFrame, order: str, value: str, within: str) -> DataFrame:
    """within, run (from 1 in each), value, first, last, n: stretches of equal values along an order, as axis bands.

    A prefix scan, so one ``within`` may have all rows. Rows are in the order of (within, order, value).
    """
    numbered = change_numbers(labels.select(within, order, value), [within, order, value], [within, value], name="_run")
    runs = numbered.groupBy(within, "_run", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))
    first = runs.groupBy(F.col(within).alias("_within")).agg(F.min("_run").alias("_first"))
    both = runs.join(first, runs[within].eqNullSafe(first["_within"]))
    return both.select(within, (F.col("_run") - F.col("_first") + 1).alias("run"), value, "first", "last", "n")


def competing_diagnostics(scores: DataFrame, members: DataFrame, truth: DataFrame) -> DataFrame:
    """grp, true_k, k, mean share within the set of competing factors."""
    return S.conditional_shares(scores, members).join(truth, "i").groupBy("grp", "true_k", "k").agg(F.avg("share").alias("share"))


def metric_by_seed(results: DataFrame, metric: str) -> DataFrame:
    return results.select("scenario", "method", "seed", F.col(metric).alias("value")).where("value is not null")
