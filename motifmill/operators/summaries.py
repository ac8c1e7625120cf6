"""Posterior summaries and diagnostics as DataFrame aggregations. Undefined values are null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.arrays import EPS, share_over, support_label, x_log_x
from .quantiles import with_quantiles

#: Ties go to the lowest index.
_best = lambda value, key: F.max_by(key, F.struct(F.col(value), F.negative(F.col(key))))


def loading_scores(effects: DataFrame) -> DataFrame:
    """i, k, score = sum over effects of p * alpha / lambda."""
    return effects.groupBy("i", "k").agg(F.sum(F.col("p") * F.col("alpha") / F.col("lambda")).alias("score"))


def inclusion_probability(effects: DataFrame) -> DataFrame:
    """i, k, pip = 1 - product of (1 - p); product is null-safe and exact for p = 1."""
    return effects.groupBy("i", "k").agg((1 - F.product(1 - F.col("p"))).alias("pip"))


def effect_sizes(effects: DataFrame) -> DataFrame:
    """i, d, size, top_factor, top_gamma, entropy (over ln K)."""
    x = effects.groupBy("i", "d").agg(F.sum(F.col("p") * F.col("alpha") / F.col("lambda")).alias("size"), _best("p", "k").alias("top_factor"), F.max("p").alias("top_gamma"), F.sum(-x_log_x(F.col("p"))).alias("h"), F.count(F.lit(1)).alias("n"))
    return x.select("i", "d", "size", "top_factor", "top_gamma", F.when(F.col("n") > 1, F.col("h") / F.ln("n")).alias("entropy"))


def ranked_effects(sizes: DataFrame) -> DataFrame:
    """rank by size; sizes that agree to nine digits are ties, which go to the lower slot."""
    return sizes.withColumn("rank", F.row_number().over(W.partitionBy("i").orderBy(F.round("size", 9).desc(), "d")))


def effect_rank_summary(sizes: DataFrame) -> DataFrame:
    r = ranked_effects(sizes)
    means = r.groupBy("rank").agg(F.avg("size").alias("mean_size"), F.avg("entropy").alias("mean_entropy"), F.avg("top_gamma").alias("mean_top_gamma"))
    return with_quantiles(means, r, "size", {"median_size": 0.5}, ["rank"]).select("rank", "mean_size", "median_size", "mean_entropy", "mean_top_gamma")


def extra_mass(sizes: DataFrame, truth: DataFrame) -> DataFrame:
    """i, grp, extra: share of a sample's size in effects ranked beyond its true support. 0 if there are none."""
    r = ranked_effects(sizes).join(truth, "i")
    out = F.sum(F.when(F.col("rank") > F.col("true_support_size"), F.col("size")).otherwise(0.0))
    return r.groupBy("i", "grp").agg((out / F.greatest(F.sum("size"), F.lit(EPS))).alias("extra"))


def extra_mass_summary(extra: DataFrame, by: str | None = None) -> DataFrame:
    mean = F.avg("extra").alias("mean")
    return with_quantiles(extra.groupBy(by).agg(mean) if by else extra.agg(mean), extra, "extra", {"median": 0.5, "q90": 0.9}, [by] if by else None)


def normalized_entropy(scores: DataFrame, value: str = "score") -> DataFrame:
    """i, entropy of a sample's scores as shares, over ln K."""
    s = share_over(scores, ["i"], value, "_p", EPS)
    x = s.groupBy("i").agg(F.sum(-x_log_x(F.col("_p"))).alias("h"), F.count(F.lit(1)).alias("n"))
    return x.select("i", F.when(F.col("n") > 1, F.col("h") / F.ln("n")).alias("entropy"))


def usage_fractions(scores: DataFrame, value: str = "score") -> DataFrame:
    """k, usage: a factor's share of all scores."""
    by = scores.groupBy("k").agg(F.sum(value).alias("v"))
    return by.crossJoin(F.broadcast(by.agg(F.sum("v").alias("t")))).select("k", (F.col("v") / F.col("t")).alias("usage"))


def assignment_scores(effects: DataFrame) -> DataFrame:
    """i, k, score = sum over effects of p."""
    return effects.groupBy("i", "k").agg(F.sum("p").alias("score"))


def support_labels(scores: DataFrame, sizes: DataFrame, value: str = "score") -> DataFrame:
    """i, label: the true_support_size factors with the largest scores."""
    r = scores.withColumn("rank", F.row_number().over(W.partitionBy("i").orderBy(F.round(value, 9).desc(), "k"))).join(sizes.select("i", "true_support_size"), "i")
    return r.where("rank <= true_support_size").groupBy("i").agg(support_label(F.collect_list("k")).alias("label"))


def support_accuracy(labels: DataFrame, truth: DataFrame) -> DataFrame:
    x = truth.join(labels, "i", "left")
    return x.agg(F.avg(F.when(F.col("label") == F.col("true_support_label"), 1.0).otherwise(0.0)).alias("support_accuracy"), F.count(F.lit(1)).alias("n"))


def recovered_patterns(labels: DataFrame, truth: DataFrame) -> DataFrame:
    return labels.join(truth.select("i", "grp"), "i").groupBy("grp", "label").agg(F.count(F.lit(1)).alias("n"))


def map_to_true(scores: DataFrame, mapping: DataFrame) -> DataFrame:
    """i, k (true), score; learned factors mapped to null drop out. mapping: k (learned), true_k."""
    return scores.join(F.broadcast(mapping.where("true_k is not null")), "k").groupBy("i", F.col("true_k").alias("k")).agg(F.sum("score").alias("score"))


def slot_beta(alpha: DataFrame, omega: DataFrame, rates: DataFrame) -> DataFrame:
    """s, d, beta_mean = weighted mean of alpha / rate."""
    x = alpha.join(omega, ["i", "s"]).join(rates, ["s", "d"])
    sums = x.groupBy("s", "d").agg(F.sum(F.col("w") * F.col("a") / F.col("rate")).alias("b"), F.sum("w").alias("t"))
    return sums.select("s", "d", (F.col("b") / F.greatest("t", F.lit(EPS))).alias("beta_mean"))


def motif_scores(beta: DataFrame, motif: DataFrame, priors: DataFrame) -> DataFrame:
    """s, k, score = sum over slots of scale * beta * p."""
    x = motif.join(beta, ["s", "d"]).join(priors, ["s", "d"])
    return x.groupBy("s", "k").agg(F.sum(F.col("slot_scale") * F.col("beta_mean") * F.col("p")).alias("score"))


def motif_entropy(motif: DataFrame) -> DataFrame:
    x = motif.groupBy("s", "d").agg(F.sum(-x_log_x(F.col("p"))).alias("h"), F.count(F.lit(1)).alias("n"), F.max("p").alias("top_gamma"))
    return x.select("s", "d", F.when(F.col("n") > 1, F.col("h") / F.ln("n")).alias("gamma_entropy"), "top_gamma")


def slot_activity(beta: DataFrame, motif: DataFrame, priors: DataFrame) -> DataFrame:
    x = beta.join(priors, ["s", "d"]).join(motif_entropy(motif), ["s", "d"])
    x = x.withColumns({"effective_beta": F.col("beta_mean") * F.col("slot_scale"), "prior_mean": F.col("alpha0") / F.greatest("lambda0", F.lit(EPS))})
    s = W.partitionBy("s")
    share = lambda c: F.col(c) / F.greatest(F.sum(c).over(s), F.lit(EPS))
    return x.select(F.col("s").alias("submanifold"), F.col("d").alias("slot"), "beta_mean", "slot_scale", "effective_beta", share("effective_beta").alias("beta_fraction"), "prior_mean", share("prior_mean").alias("prior_fraction"), "gamma_entropy", "top_gamma")


def flagged_slots(activity: DataFrame, prior: float = 0.05, beta: float = 0.05, entropy: float = 0.80) -> DataFrame:
    ard, b = F.col("prior_fraction") >= prior, F.col("beta_fraction") >= beta
    diffuse = (F.col("beta_fraction") < beta) & (F.col("gamma_entropy") >= entropy)
    return activity.withColumns({"active_ard": ard, "active_beta": b, "active_ard_or_beta": ard | b, "inactive_diffuse": diffuse, "active_diffuse_heuristic": ~diffuse})


def dimension_selection(flagged: DataFrame) -> DataFrame:
    n = lambda c: F.sum(F.col(c).cast("long"))
    return flagged.groupBy("submanifold").agg(n("active_ard").alias("D_hat_ard"), n("active_beta").alias("D_hat_beta"), n("active_ard_or_beta").alias("D_hat_ard_or_beta"), n("active_diffuse_heuristic").alias("D_hat_diffuse_heuristic"), F.max("prior_fraction").alias("max_prior_fraction"), F.min(F.when(F.col("active_ard"), F.col("prior_fraction"))).alias("min_active_prior_fraction"))


def gamma_uncertainty(motif: DataFrame) -> DataFrame:
    e = motif_entropy(motif)
    return e.agg(F.avg("gamma_entropy").alias("mean_gamma_entropy"), F.max("gamma_entropy").alias("max_gamma_entropy"), F.avg("top_gamma").alias("mean_top_gamma"), F.min("top_gamma").alias("min_top_gamma"))


def no_uncertainty(spark) -> DataFrame:
    """The same row for methods without motifs."""
    return spark.range(1).select(*(F.lit(None).cast("double").alias(c) for c in ("mean_gamma_entropy", "max_gamma_entropy", "mean_top_gamma", "min_top_gamma")))


def top_two(motif: DataFrame) -> DataFrame:
    """s, d, top_factor, top_gamma, second_factor, second_gamma, gap."""
    g = motif.groupBy("s", "d").agg(F.array_sort(F.collect_list(F.struct(F.negative("p").alias("q"), "k"))).alias("g"))
    one, two = F.col("g")[0], F.try_element_at("g", F.lit(2))
    return g.select("s", "d", one["k"].alias("top_factor"), (-one["q"]).alias("top_gamma"), two["k"].alias("second_factor"), (-two["q"]).alias("second_gamma"), (two["q"] - one["q"]).alias("gap"))


def pair_split(motif: DataFrame, k1: int, k2: int) -> DataFrame:
    """s, d, mass, split = 2 min / mass, targeted = mass * 2 min, of two factors that could stand for each other."""
    at = lambda k: F.sum(F.when(F.col("k") == k, F.col("p")).otherwise(0.0))
    x = motif.groupBy("s", "d").agg(at(k1).alias("p1"), at(k2).alias("p2"))
    mass, low = F.col("p1") + F.col("p2"), F.least("p1", "p2")
    return x.select("s", "d", mass.alias("mass"), F.when(mass > 0, 2 * low / mass).alias("split"), (mass * 2 * low).alias("targeted"))


def group_responsibility(omega: DataFrame, truth: DataFrame) -> DataFrame:
    return omega.join(truth, "i").groupBy("grp", "s").agg(F.avg("w").alias("w"))


def submanifold_match(mean: DataFrame) -> DataFrame:
    """s, grp: the group with the largest mean responsibility."""
    return mean.groupBy("s").agg(_best("w", "grp").alias("grp"), F.max("w").alias("w"))


def competing_sets(nearest: DataFrame) -> DataFrame:
    """true_k, factors: learned factors that share a nearest true one."""
    return nearest.groupBy(F.col("nearest_true").alias("true_k")).agg(support_label(F.collect_list("k")).alias("factors"), F.count(F.lit(1)).alias("n")).where("n > 1")


def nearest_true(similarity: DataFrame) -> DataFrame:
    """k (learned), nearest_true, cosine."""
    return similarity.groupBy("k").agg(_best("cosine", "true_k").alias("nearest_true"), F.max("cosine").alias("cosine"))


def candidate_sets(similarity: DataFrame, top: int = 3) -> DataFrame:
    """true_k, k: factors nearest to a true one, and its ``top`` most similar ones."""
    near = nearest_true(similarity).select(F.col("nearest_true").alias("true_k"), "k")
    r = similarity.withColumn("rank", F.row_number().over(W.partitionBy("true_k").orderBy(F.desc("cosine"), "k")))
    return near.union(r.where(F.col("rank") <= top).select("true_k", "k")).distinct()


def conditional_shares(scores: DataFrame, members: DataFrame, value: str = "score") -> DataFrame:
    """i, true_k, k, share within a candidate set; 0 where the set has no score."""
    x = scores.join(F.broadcast(members), "k")
    t = F.sum(value).over(W.partitionBy("i", "true_k"))
    return x.select("i", "true_k", "k", F.when(t > 0, F.col(value) / t).otherwise(0.0).alias("share"))


def set_entropy(shares: DataFrame) -> DataFrame:
    """true_k, mean entropy within the set over ln of its size."""
    x = shares.groupBy("i", "true_k").agg(F.sum(-x_log_x(F.col("share"))).alias("h"), F.count(F.lit(1)).alias("n"))
    return x.where("n > 1").groupBy("true_k").agg(F.avg(F.col("h") / F.ln("n")).alias("mean_entropy"), F.max("n").alias("n"))


def group_share(scores: DataFrame, truth: DataFrame, value: str = "score") -> DataFrame:
    """grp, k, mean, share within the group."""
    m = scores.join(truth, "i").groupBy("grp", "k").agg(F.avg(value).alias("mean"))
    return share_over(m, ["grp"], "mean", "share")


def branch_pivot(shares: DataFrame, K: int) -> DataFrame:
    """One row for each group, a column for each factor."""
    at = [F.sum(F.when(F.col("k") == k, F.col("share")).otherwise(0.0)).alias(f"k{k}") for k in range(1, K + 1)]
    return shares.groupBy("grp").agg(*at)


def score_labels(scores: DataFrame, top: int = 3) -> DataFrame:
    """s, label: the top factors of a motif with their scores, as text."""
    r = scores.withColumn("rank", F.row_number().over(W.partitionBy("s").orderBy(F.desc("score"), "k"))).where(F.col("rank") <= top)
    parts = F.sort_array(F.collect_list(F.struct("rank", F.format_string("%d:%.2f", F.col("k").cast("int"), F.col("score")).alias("t"))))
    return r.groupBy("s").agg(F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("label"))


def motif_table(hard: DataFrame) -> DataFrame:
    """s, label: distinct factors of a hard motif."""
    return hard.groupBy("s").agg(support_label(F.collect_list("k")).alias("label"))


def translate_motifs(hard: DataFrame, mapping: DataFrame) -> DataFrame:
    return hard.join(F.broadcast(mapping), "k", "left").select("s", "d", F.col("true_k").alias("k"))


def slot_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """n_changed, n: slots of hard motifs that differ."""
    x = before.select("s", "d", F.col("k").alias("a")).join(after.select("s", "d", F.col("k").alias("b")), ["s", "d"])
    return x.agg(F.sum((~F.col("a").eqNullSafe(F.col("b"))).cast("long")).alias("n_changed"), F.count(F.lit(1)).alias("n"))


def extra_slots(activity: DataFrame, true_dims: DataFrame) -> DataFrame:
    """Slots ranked by effective_beta in their component; extra beyond its true dimension. true_dims: submanifold, true_dim."""
    r = activity.withColumn("rank", F.row_number().over(W.partitionBy("submanifold").orderBy(F.desc("effective_beta"), "slot")))
    return r.join(true_dims, "submanifold").withColumn("extra", F.col("rank") > F.col("true_dim"))


def extra_slot_summary(ranked: DataFrame) -> DataFrame:
    part = ranked.groupBy("submanifold").agg(F.sum(F.when(F.col("extra"), F.col("beta_fraction")).otherwise(0.0)).alias("mass"))
    e = ranked.where("extra").agg(F.count(F.lit(1)).alias("n_extra"), F.avg("beta_fraction").alias("mean_extra_fraction"), F.max("beta_fraction").alias("max_extra_fraction"), F.avg("gamma_entropy").alias("mean_extra_entropy"))
    return e.crossJoin(part.agg(F.avg("mass").alias("mean_extra_mass")))  # one row each


def soft_scores(omega: DataFrame, scores: DataFrame) -> DataFrame:
    """i, k, score = responsibilities times motif scores."""
    return omega.join(scores, "s").groupBy("i", "k").agg(F.sum(F.col("w") * F.col("score")).alias("score"))


def max_responsibility(omega: DataFrame) -> DataFrame:
    return omega.groupBy("i").agg(F.max("w").alias("w"), _best("w", "s").alias("z_hat"))


def summarize_values(df: DataFrame, value: str, by: str) -> DataFrame:
    stats = df.groupBy(by).agg(F.avg(value).alias("mean"), F.when(F.count(value) >= 2, F.stddev_samp(value)).alias("sd"), F.max(value).alias("max"))
    return with_quantiles(stats, df, value, {"median": 0.5, "q25": 0.25, "q75": 0.75}, [by]).select(by, "mean", "sd", "median", "q25", "q75", "max")


METRICS = ("cluster_accuracy", "support_accuracy", "mean_factor_cosine", "min_factor_cosine", "mean_max_responsibility", "mean_gamma_entropy")


def benchmark_summary(results: DataFrame) -> DataFrame:
    """scenario, method, n_seed, mean and sd of each metric; null where a method has none, sd from two seeds on."""
    stats = [F.countDistinct("seed").alias("n_seed")]
    for m in METRICS:
        stats += [F.avg(m).alias(f"{m}_mean"), F.when(F.count(m) >= 2, F.stddev_samp(m)).alias(f"{m}_sd")]
    return results.groupBy("scenario", "method").agg(*stats)
