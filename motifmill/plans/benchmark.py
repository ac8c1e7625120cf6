"""Fit the three methods to a planted data set and put their recovery metrics side by side."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fits, matching
from ..operators import summaries as S
from ..operators.cluster import kmeans
from ..sources.simulate import Simulated

COLUMNS = "method string, cluster_accuracy double, support_accuracy double, mean_factor_cosine double, min_factor_cosine double, mean_max_responsibility double, mean_gamma_entropy double, max_gamma_entropy double, mean_top_gamma double, min_top_gamma double"


def _row(sim: Simulated, method: str, factors, scores: DataFrame, labels: DataFrame, responsibility: float | None = None, motif: DataFrame | None = None) -> DataFrame:
    spark = sim.truth.sparkSession
    match = matching.match_factors(factors, sim.factors)
    mapped = S.map_to_true(scores, match.mapping(spark))
    support = S.support_accuracy(S.support_labels(mapped, sim.truth), sim.truth).collect()[0]["support_accuracy"]
    clusters = matching.cluster_accuracy(labels.join(sim.truth, "i"))
    u = (None,) * 4 if motif is None else tuple(S.gamma_uncertainty(motif).collect()[0])
    return spark.createDataFrame([(method, clusters, support, float(sum(match.cosines) / len(match.cosines)), min(match.cosines), responsibility, *u)], COLUMNS)


def _packed(scores: DataFrame) -> DataFrame:
    return scores.groupBy("i").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "score"))), lambda x: x["score"]).alias("scores"))


def nmf_method(sim: Simulated, K: int, S_: int, D: int, seed: int, nmf_iters: int = 60, **_) -> DataFrame:
    fit = fits.poisson_nmf(sim.counts, K, nmf_iters, seed)
    scores = fit.loadings_df().withColumnRenamed("l", "score")
    _, z = kmeans(_packed(scores), S_, seed)
    return _row(sim, "NMF and k-means", fit.factors, scores, z)


def effects_method(sim: Simulated, K: int, S_: int, D: int, seed: int, mf_max_iters: int = 25, mf_nmf_iters: int = 50, **_) -> DataFrame:
    fit = fits.mf_susie(sim.counts, K, D, mf_max_iters, seed=seed, nmf_iters=mf_nmf_iters, elbo_every=5, tol=5e-4, min_iters=12, patience=2)
    scores = S.loading_scores(fit.effects_df())
    _, z = kmeans(fit.scores(), S_, seed)
    return _row(sim, "effects and k-means", fit.factors, scores, z)


def soft_method(sim: Simulated, K: int, S_: int, D: int, seed: int, mf_max_iters: int = 25, mf_nmf_iters: int = 50, mos_max_iters: int = 12, mos_n_inner: int = 3, surplus_slots: str = "repeat", update_slot_scale: bool = False, **_) -> DataFrame:
    fit = fits.soft_mixture(sim.counts, K, S_, D, mos_max_iters, mos_n_inner, mf_max_iters, mf_nmf_iters, seed, surplus_slots=surplus_slots, update_slot_scale=update_slot_scale, gamma_step_ramp=8, F_step_ramp=12, patience=2)
    omega = fit.responsibilities_df()
    scores = S.soft_scores(omega, S.motif_scores(fit.beta_df(), fit.motifs_df(), fit.priors_df()))
    top = S.max_responsibility(omega)
    sure = top.agg(F.avg("w")).collect()[0][0]
    return _row(sim, "soft motifs", fit.factors, scores, top.select("i", F.col("z_hat").alias("z")), sure, fit.motifs_df())


METHODS: tuple[Callable[..., DataFrame], ...] = (nmf_method, effects_method, soft_method)


def run_one(sim: Simulated, K: int, S_: int, D: int, seed: int, **options) -> DataFrame:
    out = None
    for method in METHODS:
        row = method(sim, K, S_, D, seed, **options)
        out = row if out is None else out.unionByName(row)
    return out


def run_seeds(scenario: str, make: Callable[[int], Simulated], seeds: Iterable[int], K: int, S_: int, D: int, **options) -> DataFrame:
    out = None
    for seed in seeds:
        row = run_one(make(seed), K, S_, D, seed, **options).withColumns({"scenario": F.lit(scenario), "seed": F.lit(seed)})
        out = row if out is None else out.unionByName(row)
    return out
