"""Fits that are compared side by side: frozen against learned parameters, given dictionaries, and their uncertainty under several seeds."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fits, matching
from ..operators import summaries as S
from ..operators.cluster import motifs_from_scores
from ..operators.fits import MixtureFit
from ..sources import simulate
from ..sources.simulate import Simulated


def _init_motifs(sim: Simulated, factors: np.ndarray, S_: int, D: int, seed: int, iters: int) -> np.ndarray:
    effects = fits.mf_susie_fixed(sim.counts, factors, D, iters, seed=seed)
    return motifs_from_scores(effects.scores(), S_, D, seed)


def soft_pair(sim: Simulated, K: int, S_: int, D: int, seed: int, max_iters: int = 18, n_inner: int = 3, **ladder) -> dict[str, MixtureFit]:
    """From one start: with the effects fit's factors kept, and with factors learned along."""
    learned = fits.soft_mixture(sim.counts, K, S_, D, max_iters, n_inner, seed=seed, **ladder)
    mf = learned.mf_fit
    gamma = fits.peaked_gamma(motifs_from_scores(mf.scores(), S_, D, seed), K, 0.05)
    return {"fixed": fits.soft_mixture_fixed(sim.counts, mf.factors, gamma, max_iters, n_inner, update_F=False), "alternating": learned}


def hard_pair(sim: Simulated, K: int, S_: int, D: int, seed: int, max_iters: int = 20, n_inner: int = 8, **ladder) -> dict[str, MixtureFit]:
    """Motifs and factors frozen after the start, and both updated."""
    learned = fits.hard_mixture(sim.counts, K, S_, D, max_iters, n_inner, seed=seed, **ladder)
    mf = learned.mf_fit
    motifs = motifs_from_scores(mf.scores(), S_, D, seed)
    return {"frozen": fits.hard_mixture_fixed(sim.counts, mf.factors, motifs, max_iters, n_inner), "alternating": learned}


def oracle_hard(sim: Simulated, D: int, max_iters: int = 30, n_inner: int = 8) -> MixtureFit:
    """True factors and true motifs: if this fails, the updates are wrong."""
    motifs = np.array([simulate.pad_support(list(s), D) for s in sim.supports])
    return fits.hard_mixture_fixed(sim.counts, sim.factors, motifs, max_iters, n_inner)


def given_dictionary(sim: Simulated, factors: np.ndarray, S_: int, D: int, seed: int, max_iters: int = 16, n_inner: int = 3, mf_iters: int = 25) -> MixtureFit:
    """Soft motifs over a given dictionary, the true one or one with surplus rows."""
    gamma = fits.peaked_gamma(_init_motifs(sim, factors, S_, D, seed, mf_iters), len(factors), 0.05)
    return fits.soft_mixture_fixed(sim.counts, factors, gamma, max_iters, n_inner)


def summary(fit: MixtureFit, sim: Simulated, name: str) -> DataFrame:
    """One row: recovery, sureness and spread of a mixture fit. Factor metrics are null if the numbers of factors differ."""
    top = S.max_responsibility(fit.responsibilities_df())
    clusters = matching.cluster_accuracy(top.select("i", F.col("z_hat").alias("z")).join(sim.truth, "i"))
    sure = top.agg(F.avg("w")).first()[0]
    cosine, support = None, None
    if len(fit.factors) == len(sim.factors):
        m = matching.match_factors(fit.factors, sim.factors)
        cosine = float(np.mean(m.cosines))
        scores = S.soft_scores(fit.responsibilities_df(), S.motif_scores(fit.beta_df(), fit.motifs_df(), fit.priors_df()))
        labels = S.support_labels(S.map_to_true(scores, m.mapping(fit.spark)), sim.truth)
        support = S.support_accuracy(labels, sim.truth).first()["support_accuracy"]
    u = S.gamma_uncertainty(fit.motifs_df()).first()
    row = (name, fit.n_iter, fit.converged, float(fit.elbo[-1][1]), clusters, support, cosine, sure, *u)
    schema = "fit string, n_iter int, converged boolean, elbo double, cluster_accuracy double, support_accuracy double, mean_factor_cosine double, mean_max_responsibility double, mean_gamma_entropy double, max_gamma_entropy double, mean_top_gamma double, min_top_gamma double"
    return fit.spark.createDataFrame([row], schema)


def compare(pair: dict[str, MixtureFit], sim: Simulated) -> DataFrame:
    out = None
    for name, fit in pair.items():
        row = summary(fit, sim, name)
        out = row if out is None else out.unionByName(row)
    return out


def over_dictionary(spark: SparkSession, seeds: Iterable[int], N: int = 240, M: int = 260, max_iters: int = 16, mf_iters: int = 25) -> DataFrame:
    """seed, max_split, mean_split: how motifs divide between a factor and its copy, over all slots with mass on the pair."""
    rows = []
    for seed in seeds:
        sim, dictionary = simulate.duplicate_dictionary(spark, N, M, 1000 + seed)
        fit = given_dictionary(sim, dictionary, len(sim.supports), 3, seed, max_iters, mf_iters=mf_iters)
        rows.append((seed, *_splits(fit, ((1, 6), (2, 7)), "split")))
    return spark.createDataFrame(rows, "seed int, max_split double, mean_split double")


def correlated_pair(spark: SparkSession, seeds: Iterable[int], N: int = 180, M: int = 260, max_iters: int = 16, mf_iters: int = 25) -> DataFrame:
    """seed, max_targeted, mean_targeted, cluster_accuracy for two factors that nearly agree."""
    rows = []
    for seed in seeds:
        sim = simulate.correlated(spark, N, M, 2000 + seed)
        fit = given_dictionary(sim, sim.factors, len(sim.supports), 2, seed, max_iters, mf_iters=mf_iters)
        z = S.max_responsibility(fit.responsibilities_df()).select("i", F.col("z_hat").alias("z"))
        rows.append((seed, *_splits(fit, ((1, 2),), "targeted"), matching.cluster_accuracy(z.join(sim.truth, "i"))))
    return spark.createDataFrame(rows, "seed int, max_targeted double, mean_targeted double, cluster_accuracy double")


def _splits(fit: MixtureFit, pairs: Sequence[tuple[int, int]], column: str) -> tuple[float, float]:
    values = [r[column] for a, b in pairs for r in S.pair_split(fit.motifs_df(), a, b).collect() if r[column] is not None]
    return float(max(values)), float(np.mean(values))
