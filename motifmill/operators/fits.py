"""The model ladder: Poisson NMF, sum-of-single-effects Poisson factors, hard and soft mixtures of motifs.

Motifs and priors are small and live on the driver, and so do factors of up to DRIVER_BYTES; each sample's state lives next to its counts in written
rows, and an outer iteration is one pass over them. With more features the same updates run by blocks of features (blocked.py).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as C

from ..functions.special import np_gamma_shape
from ..plans.journal import Journal, restore
from ..plans.schedule import Stopper, damping
from ..plans.sweep import Passed, exponential, sweep, unpack
from ..sources.counts import Counts
from ..sources.simulate import EPS as TINY
from ..sources.simulate import normalize_rows
from . import batch as B
from .cluster import motifs_from_scores

EPS = B.EPS
#: Bytes of a vector over all features that the driver and each task may hold.
DRIVER_BYTES = 64 << 20


def _going_on(saved: tuple) -> Passed:
    return Passed(saved[2], saved[3], np.zeros(0))


def too_wide(counts: Counts, rows: int) -> bool:
    """Whether sums of so many values a feature have to stay a table."""
    return counts.n_features() * rows * 8 > DRIVER_BYTES


def _long(spark: SparkSession, x: np.ndarray, names: tuple[str, ...], value: str) -> DataFrame:
    """1-based long form of a small array."""
    at = np.indices(x.shape).reshape(x.ndim, -1) + 1
    rows = [(*map(int, k), float(v)) for k, v in zip(at.T, x.ravel(), strict=True)]
    return spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names) + f", {value} double")


@dataclass
class Fit:
    spark: SparkSession
    factors: np.ndarray
    samples: DataFrame
    width: int
    elbo: list[tuple[int, float]] = field(default_factory=list)
    converged: bool = False
    n_iter: int = 0

    def factors_df(self) -> DataFrame:
        return _long(self.spark, self.factors, ("k", "m"), "f")

    def history_df(self) -> DataFrame:
        return self.spark.createDataFrame([(int(t), float(v)) for t, v in self.elbo], "iter int, elbo double")


# Poisson NMF.


@dataclass
class NMFFit(Fit):
    def loadings_df(self) -> DataFrame:
        K = len(self.factors)

        def cells(ids, L):
            return {"i": np.repeat(ids, K), "k": np.tile(np.arange(1, K + 1, dtype=np.int32), len(ids)), "l": L.ravel()}

        return unpack(self.samples, K, cells, "i long, k int, l double")


def hashed_factors(m: np.ndarray, K: int, shift: int = 0) -> np.ndarray:
    """K x len(m), not normalised: by integer arithmetic from the features' 1-based numbers, which SQL can repeat."""
    return 1.0 + (np.arange(1, K + 1)[:, None] * 7919 + m[None] * 104729 + shift) % 1009


def seeded_factors(m: np.ndarray, K: int, seed: int) -> np.ndarray:
    """K x len(m) draws keyed by (seed, feature)."""
    return exponential(seed + 11, m.astype(np.int64), K).T


def hashed_init(K: int, M: int, shift: int = 0) -> tuple[np.ndarray, Callable]:
    """The integer-arithmetic start that SQL can repeat: factors, and loadings from ids and totals. shift gives others."""
    f = hashed_factors(np.arange(1, M + 1), K, shift)

    def loadings(ids: np.ndarray, total: np.ndarray) -> np.ndarray:
        w = 1.0 + (np.arange(1, K + 1) * 15485863 + ids[:, None] * 32452843) % 1013
        return w / w.sum(1, keepdims=True) * np.maximum(total, EPS)[:, None]

    return f / f.sum(1, keepdims=True), loadings


def seeded_init(K: int, M: int, seed: int) -> tuple[np.ndarray, Callable]:
    f = normalize_rows(seeded_factors(np.arange(1, M + 1), K, seed), EPS)

    def loadings(ids: np.ndarray, total: np.ndarray) -> np.ndarray:
        w = exponential(seed, ids, K)
        return w / w.sum(1, keepdims=True) * np.maximum(total, EPS)[:, None]

    return f, loadings


def poisson_nmf(counts: Counts, K: int, max_iters: int = 200, seed: int | None = None, resume: str | None = None) -> NMFFit:
    """KL-NMF by multiplicative updates from a seeded start, or from the hashed one without a seed. elbo has minus the deviance part of each iteration.

    ``resume``, here and in the other fits: a name under which passes are logged; a fit of that name goes on from its last one.
    """
    if too_wide(counts, K):
        from . import blocked

        return blocked.poisson_nmf(counts, K, max_iters, seed)
    M = counts.n_features()
    F, start = hashed_init(K, M) if seed is None else seeded_init(K, M, seed)
    rows: DataFrame = counts.packed()
    scale = np.ones(K)
    last: Passed | None = None
    history, begun = [], 0
    log = Journal(counts.counts.sparkSession, resume, fit="nmf", K=K, M=M, seed=seed)
    if saved := log.last():
        begun, last = saved[0], _going_on(saved)
        F, scale, history, rows = saved[1]["F"], saved[1]["scale"], restore(Stopper(None, 0, 0), saved[1]), last.samples()
    for it in range(begun + 1, max_iters + 1):

        def step(ids, b, L, F=F, scale=scale):
            L = start(ids, b.total) if L is None else L * scale
            L = B.nmf_loadings(b, L, F)
            A, total, dev = B.nmf_factor_stats(b, L, F)
            return L, np.concatenate([A.ravel(), total, [dev]])

        now = sweep(rows, step, None if last is None else K, K * M + K + 1)
        A, total = now.sums[: K * M].reshape(K, M), now.sums[K * M : -1]
        history.append((it, -now.sums[-1]))
        F = np.maximum(F * A / total[:, None], EPS)
        scale = F.sum(1)
        F = F / scale[:, None]
        log.save(it, now.path, history=history, F=F, scale=scale)
        if last is not None:
            last.drop()
        last, rows = now, now.samples()
    final = sweep(rows, lambda ids, b, L: ((start(ids, b.total) if L is None else L * scale), np.zeros(1)), None if last is None else K, 1)
    if last is not None and not resume:
        last.drop()
    return NMFFit(counts.counts.sparkSession, F, final.samples(), K, history, False, max_iters)


def poisson_nmf_many(counts: Counts, K: int, max_iters: int, starts: list[tuple[np.ndarray, Callable]]) -> list[NMFFit]:
    """One fit for each start (factors, and loadings by ids and totals), all in the passes of a single one: a row's state has the loadings of every fit."""
    M, R = counts.n_features(), len(starts)
    size = K * M + K + 1
    if too_wide(counts, K * R):
        raise ValueError("too many features for fits side by side: run them one by one")
    Fs, scales = [f for f, _ in starts], [np.ones(K)] * R
    rows: DataFrame = counts.packed()
    last: Passed | None = None
    history: list[list[tuple[int, float]]] = [[] for _ in starts]

    def loads(ids, b, state, r, scale):
        return starts[r][1](ids, b.total) if state is None else state[:, r * K : (r + 1) * K] * scale

    for it in range(1, max_iters + 1):

        def step(ids, b, state, Fs=Fs, scales=scales):
            new, sums = [], []
            for r in range(R):
                L = B.nmf_loadings(b, loads(ids, b, state, r, scales[r]), Fs[r])
                A, total, dev = B.nmf_factor_stats(b, L, Fs[r])
                new.append(L)
                sums.append(np.concatenate([A.ravel(), total, [dev]]))
            return np.hstack(new), np.concatenate(sums)

        now = sweep(rows, step, None if last is None else R * K, R * size)
        if last is not None:
            last.drop()
        last, rows = now, now.samples()
        Fs, scales = list(Fs), list(scales)
        for r, sums in enumerate(now.sums.reshape(R, size)):
            history[r].append((it, -sums[-1]))
            raw = np.maximum(Fs[r] * sums[: K * M].reshape(K, M) / sums[K * M : -1][:, None], EPS)
            scales[r] = raw.sum(1)
            Fs[r] = raw / scales[r][:, None]
    final = sweep(rows, lambda ids, b, state: (np.hstack([loads(ids, b, state, r, scales[r]) for r in range(R)]), np.zeros(1)), None if last is None else R * K, 1)
    if last is not None:
        last.drop()
    own = lambda r: final.samples().withColumn("state", C.substring("state", r * K * 8 + 1, K * 8))
    return [NMFFit(counts.counts.sparkSession, Fs[r], own(r), K, history[r], False, max_iters) for r in range(R)]


def poisson_nmf_seeds(counts: Counts, K: int, max_iters: int, seeds: list[int]) -> dict[int, NMFFit]:
    """Each seed's fit is the one that poisson_nmf gives for it."""
    M = counts.n_features()
    return dict(zip(seeds, poisson_nmf_many(counts, K, max_iters, [seeded_init(K, M, s) for s in seeds]), strict=True))


# Sum-of-single-effects.


@dataclass
class EffectsFit(Fit):
    D: int = 0

    def packed(self) -> DataFrame:
        """The counts that the effects were fitted to, as the last pass wrote them."""
        return self.samples.select("i", "mi", "y", "total")

    def effects_df(self) -> DataFrame:
        """i, d, k, p, alpha, lambda."""
        D, K = self.D, len(self.factors)

        def cells(ids, flat):
            e = B.Effects.of(flat, D, K)
            n = len(ids)
            d = np.tile(np.repeat(np.arange(1, D + 1, dtype=np.int32), K), n)
            return {"i": np.repeat(ids, D * K), "d": d, "k": np.tile(np.arange(1, K + 1, dtype=np.int32), n * D), "p": e.gamma.ravel(), "alpha": e.alpha.ravel(), "lambda": e.rate.ravel()}

        return unpack(self.samples, self.width, cells, "i long, d int, k int, p double, alpha double, lambda double")

    def priors_df(self) -> DataFrame:
        D, K = self.D, len(self.factors)

        def cells(ids, flat):
            e = B.Effects.of(flat, D, K)
            return {"i": np.repeat(ids, D), "d": np.tile(np.arange(1, D + 1, dtype=np.int32), len(ids)), "alpha0": e.alpha0.ravel(), "lambda0": e.rate0.ravel()}

        return unpack(self.samples, self.width, cells, "i long, d int, alpha0 double, lambda0 double")

    def scores(self) -> DataFrame:
        """i, scores: loading scores of each sample, packed."""
        D, K = self.D, len(self.factors)

        def cells(ids, flat):
            e = B.Effects.of(flat, D, K)
            s = (e.gamma * e.alpha / e.rate).sum(1)
            return {"i": ids, "scores": pa.ListArray.from_arrays(np.arange(0, s.size + 1, K, dtype=np.int32), s.ravel())}

        return unpack(self.samples, self.width, cells, "i long, scores array<double>")


def random_effects(ids: np.ndarray, D: int, K: int, seed: int, f_sum: np.ndarray, shape: float, rate: float, random_rate: bool = False) -> B.Effects:
    n, w = len(ids), D * K
    draw = exponential(seed, ids, 3 * w)
    g, a, r = (draw[:, k * w : (k + 1) * w].reshape(n, D, K) for k in range(3))
    return B.Effects(g / g.sum(2, keepdims=True), a.copy(), r.copy() if random_rate else np.tile(rate + f_sum, (n, D, 1)), np.full((n, D), shape), np.full((n, D), rate))


def hashed_effects(ids: np.ndarray, D: int, K: int) -> B.Effects:
    """The integer-arithmetic start that SQL can repeat: distributions, shapes and rates from ids, with unit priors."""
    n, i = len(ids), ids[:, None, None]
    d, k = np.arange(1, D + 1)[None, :, None], np.arange(1, K + 1)[None, None]
    g = 1.0 + (i * 11 + d * 19 + k * 37) % 83
    alpha = np.repeat(1 + ((i * 13 + d * 3) % 50) / 10, K, 2)
    rate = np.tile(2.0 + (d % 3) / 4, (n, 1, K))
    return B.Effects(g / g.sum(2, keepdims=True), alpha, rate, np.ones((n, D)), np.ones((n, D)))


def top_loadings(L: np.ndarray, D: int, floor: float) -> np.ndarray:
    """gamma of slot d peaks at the d-th largest loading (lowest index first among equals), wrapping after K."""
    n, K = L.shape
    order = np.argsort(-L, 1, kind="stable")
    g = np.full((n, D, K), floor / K)
    for d in range(D):
        g[np.arange(n), d, order[:, d % K]] = 1 - floor + floor / K
    return g


def _rows_only(samples: DataFrame, width: int | None, F: np.ndarray, D: int, start: Callable, its: int, ramp: tuple[float, int], update_prior: bool, merge: float | None, closest: bool, rate_first: bool) -> tuple[Passed, np.ndarray]:
    """All iterations of a fit with fixed factors in one pass, as samples don't depend on each other. Sums: bound and its KL part by iteration."""
    log_f, f_sum = np.log(F), F.sum(1)

    def step(ids, b, state):
        e = start(ids, b, state)
        sums = np.zeros(2 * its)
        for it in range(1, its + 1):
            B.effects_sweep(b, e, log_f, f_sum, damping(*ramp, it), update_prior, merge, closest, rate_first)
            bound, kl = B.effects_bound(b, e, log_f, f_sum)
            sums[it - 1] += bound.sum()
            sums[its + it - 1] += kl.sum()
        return e.flat(), sums

    done = sweep(samples, step, width, 2 * its)
    return done, done.sums


def poisson_susie(counts: Counts, factors: np.ndarray, D: int, max_iters: int = 100, update_prior: bool = True, break_symmetry: bool = False, tol_dist_sim: float = 1e-4, seed: int = 0, prior_shape: float = 1.0, prior_rate: float = 1.0, given: Callable[[np.ndarray], B.Effects] | None = None) -> EffectsFit:
    """Each sample on its own, given factors (not normalised), always max_iters undamped iterations. The bound includes its KL terms; elbo_without_kl leaves them out.

    ``given``: effects to start from, by ids; else random ones.
    """
    F = np.maximum(factors, TINY)
    K = len(F)
    start = lambda ids, b, _: random_effects(ids, D, K, seed, F.sum(1), prior_shape, prior_rate, random_rate=True) if given is None else given(ids)
    done, sums = _rows_only(counts.packed(), None, F, D, start, max_iters, (1.0, 1), update_prior, tol_dist_sim if break_symmetry else None, True, False)
    fit = EffectsFit(counts.counts.sparkSession, F, done.samples(), B.Effects.width(D, K), list(enumerate(sums[:max_iters], 1)), False, max_iters, D)
    fit.elbo_without_kl = list(enumerate(sums[:max_iters] - sums[max_iters:], 1))  # type: ignore[attr-defined]
    return fit


def mf_susie_fixed(counts: Counts, factors: np.ndarray, D: int, max_iters: int = 100, update_prior: bool = True, break_symmetry: bool = False, tol_dist_sim: float = 1e-4, seed: int = 0, prior_shape: float = 1.0, prior_rate: float = 1.0, gamma_step_init: float = 0.1, gamma_step_ramp: int = 50, elbo_every: int = 1, tol: float | None = None, min_iters: int = 10, patience: int = 3, veb_order: str = "shape_first", given: Callable[[np.ndarray], B.Effects] | None = None) -> EffectsFit:
    """Given factors, rows normalised. One pass runs all iterations; if the stop rule would have ended earlier, a second one runs that many."""
    F = normalize_rows(factors)
    K = len(F)
    start = lambda ids, b, _: random_effects(ids, D, K, seed, F.sum(1), prior_shape, prior_rate) if given is None else given(ids)

    def through(its: int) -> tuple[Passed, np.ndarray]:
        return _rows_only(counts.packed(), None, F, D, start, its, (gamma_step_init, gamma_step_ramp), update_prior, tol_dist_sim if break_symmetry else None, False, veb_order == "lambda_first")

    done, sums = through(max_iters)
    stop, history, n_iter, converged = Stopper(tol, min_iters, patience), [], max_iters, False
    for it in range(1, max_iters + 1):
        if it == 1 or it == max_iters or it % elbo_every == 0:
            history.append((it, sums[it - 1]))
            if stop(it, sums[it - 1]):
                converged, n_iter = True, it
                break
    if n_iter < max_iters:
        done.drop()
        done, _ = through(n_iter)
    return EffectsFit(counts.counts.sparkSession, F, done.samples(), B.Effects.width(D, K), history, converged, n_iter, D)


def mf_susie(counts: Counts, K: int, D: int, max_iters: int = 100, update_prior: bool = True, break_symmetry: bool = False, tol_dist_sim: float = 1e-4, seed: int | None = None, prior_shape: float = 1.0, prior_rate: float = 1.0, init: str = "poisson_nmf", nmf_iters: int = 200, init_gamma_from_nmf: bool = True, gamma_init_floor: float = 1e-4, gamma_step_init: float = 0.1, gamma_step_ramp: int = 50, F_step_init: float = 0.05, F_step_ramp: int = 75, F_pseudocount: float = TINY, elbo_every: int = 1, tol: float | None = None, min_iters: int = 10, patience: int = 3, update_F: bool = True, factors: np.ndarray | None = None, given: Callable[[np.ndarray], B.Effects] | None = None, resume: str | None = None) -> EffectsFit:
    """Factors learned with the effects. ``init``: "poisson_nmf", "random" (which also draws the effects) or "given" (factors, and effects by ids).

    The bound of an iteration needs its new factors, so the next pass computes it before anything else; a fit that stops there
    keeps the rows that pass started from.
    """
    if factors is None and too_wide(counts, K):
        from . import blocked

        options = {k: v for k, v in locals().items() if k not in ("counts", "K", "D", "blocked", "factors", "given", "resume")}
        return blocked.mf_susie(counts, K, D, **options)
    if init not in ("poisson_nmf", "random", "given"):
        raise ValueError("init must be poisson_nmf, random or given")
    if (init == "given") != (factors is not None) or (factors is None) != (given is None):
        raise ValueError("factors and effects are given with init given, and only then")
    M = counts.n_features()
    spark = counts.counts.sparkSession
    s = 0 if seed is None else seed
    width = B.Effects.width(D, K)
    log = Journal(spark, resume, fit="effects", K=K, D=D, M=M, seed=seed, init=init)
    saved = log.last()
    if saved:
        F, rows, before = saved[1]["F"], _going_on(saved).samples(), width
    elif init == "poisson_nmf":
        nmf = poisson_nmf(counts, K, nmf_iters, seed, resume and f"{resume}/nmf")
        F, rows, before = normalize_rows(nmf.factors), nmf.samples, K
    elif init == "given":
        F, rows, before = normalize_rows(factors), counts.packed(), None
    else:
        F, _ = seeded_init(K, M, s)
        F, rows, before = normalize_rows(F), counts.packed(), None
    from_nmf = init == "poisson_nmf" and init_gamma_from_nmf
    last: Passed | None = None
    stop, history = Stopper(tol, min_iters, patience), []
    n_iter, converged = max_iters, False
    evaluated = lambda t: t == 1 or t == max_iters or t % max(elbo_every, 1) == 0
    begun = 0
    if saved:
        begun, last, history = saved[0], _going_on(saved), restore(stop, saved[1])
    for it in range(begun + 1, max_iters + 2):
        log_f, f_sum, rho = np.log(F), F.sum(1), damping(gamma_step_init, gamma_step_ramp, it)
        bound_due, ends = it > 1 and evaluated(it - 1), it > max_iters

        def step(ids, b, state, log_f=log_f, f_sum=f_sum, rho=rho, first=it == 1, bound_due=bound_due, ends=ends):
            if first:
                e = random_effects(ids, D, K, s, f_sum, prior_shape, prior_rate) if given is None else given(ids)
                if from_nmf:
                    e.gamma = top_loadings(state, D, gamma_init_floor)
            else:
                e = B.Effects.of(state, D, K)
            value = B.effects_bound(b, e, log_f, f_sum)[0].sum() if bound_due else 0.0
            A = np.zeros((K, M))
            if not ends:
                B.effects_sweep(b, e, log_f, f_sum, rho, update_prior, tol_dist_sim if break_symmetry else None)
                A = B.effects_factor_stats(b, e, log_f)
            return e.flat(), np.append(A.ravel(), value)

        now = sweep(rows, step, before if it == 1 else width, K * M + 1)
        if bound_due:
            history.append((it - 1, now.sums[-1]))
            if stop(it - 1, now.sums[-1]):
                converged, n_iter = True, it - 1
                now.drop()
                break
        if update_F and not ends:
            rho_f = damping(F_step_init, F_step_ramp, it)
            F = normalize_rows((1 - rho_f) * F + rho_f * normalize_rows(now.sums[:-1].reshape(K, M) + F_pseudocount))
        if not ends:
            log.save(it, now.path, stop, history, F=F)
        if last is not None and not (ends and resume):
            last.drop()
        last, rows = now, now.samples()
    return EffectsFit(spark, F, rows, width, history, converged, n_iter, D)


# Mixtures.


@dataclass
class MixtureFit(Fit):
    S: int = 0
    D: int = 0
    pi: np.ndarray = field(default_factory=lambda: np.zeros(0))
    gamma: np.ndarray = field(default_factory=lambda: np.zeros(0))  # S x D x K
    motifs: np.ndarray | None = None  # S x D, 1-based, of the hard mixture
    alpha0: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rate0: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rate: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    C: np.ndarray = field(default_factory=lambda: np.zeros(0))
    beta_mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    mf_fit: EffectsFit | None = None
    history: list[np.ndarray] = field(default_factory=list)

    def responsibilities_df(self) -> DataFrame:
        """i, s, w, z_hat (the largest, lowest index first)."""
        S, width = self.S, self.width

        def cells(ids, flat):
            w = flat[:, :S]
            z = np.argmax(w, 1).astype(np.int32) + 1
            return {"i": np.repeat(ids, S), "s": np.tile(np.arange(1, S + 1, dtype=np.int32), len(ids)), "w": w.ravel(), "z_hat": np.repeat(z, S)}

        return unpack(self.samples, width, cells, "i long, s int, w double, z_hat int")

    def effects_df(self) -> DataFrame:
        S, D, rate = self.S, self.D, self.rate

        def cells(ids, flat):
            n, a = len(ids), flat[:, S : S + S * D]
            s = np.tile(np.repeat(np.arange(1, S + 1, dtype=np.int32), D), n)
            return {"i": np.repeat(ids, S * D), "s": s, "d": np.tile(np.arange(1, D + 1, dtype=np.int32), n * S), "alpha": a.ravel(), "lambda": np.tile(rate.ravel(), n)}

        return unpack(self.samples, self.width, cells, "i long, s int, d int, alpha double, lambda double")

    def motifs_df(self) -> DataFrame:
        return _long(self.spark, self.gamma, ("s", "d", "k"), "p")

    def hard_motifs_df(self) -> DataFrame:
        rows = [(s + 1, d + 1, int(k)) for (s, d), k in np.ndenumerate(self.motifs)]
        return self.spark.createDataFrame(rows, "s int, d int, k int")

    def beta_df(self) -> DataFrame:
        return _long(self.spark, self.beta_mean, ("s", "d"), "beta_mean")

    def mixture_df(self) -> DataFrame:
        return _long(self.spark, self.pi, ("s",), "pi")

    def priors_df(self) -> DataFrame:
        rows = [(s + 1, d + 1, float(a), float(self.rate0[s, d]), float(self.scale[s, d])) for (s, d), a in np.ndenumerate(self.alpha0)]
        return self.spark.createDataFrame(rows, "s int, d int, alpha0 double, lambda0 double, slot_scale double")


def normalize_gamma(g: np.ndarray) -> np.ndarray:
    g = np.maximum(g, EPS)
    return g / g.sum(2, keepdims=True)


def peaked_gamma(motifs: np.ndarray, K: int, floor: float, surplus: str = "repeat") -> np.ndarray:
    """S x D x K from 1-based motifs; "uniform" leaves slots that repeat an earlier factor of the motif flat."""
    S, D = motifs.shape
    g = np.full((S, D, K), floor / K)
    for s in range(S):
        seen: set[int] = set()
        for d in range(D):
            k = int(motifs[s, d])
            if surplus == "repeat" or k not in seen:
                g[s, d, k - 1] = 1 - floor + floor / K
            seen.add(k)
    return normalize_gamma(g)


def prior_step(stats: dict[str, np.ndarray], alpha0: np.ndarray, rate0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shape and rate from weighted moments; components without weight keep theirs."""
    w = stats["weight"][:, None]
    ok = w > EPS
    safe = np.where(ok, w, 1.0)
    mean, mean_log = stats["mean"] / safe, stats["mean_log"] / safe
    shape = np_gamma_shape(np.where(ok, mean, 1.0), np.where(ok, mean_log, -1.0))
    return np.where(ok, shape, alpha0), np.where(ok, shape / np.maximum(mean, EPS), rate0)


def gamma_step(F: np.ndarray, gamma: np.ndarray, stats: dict[str, np.ndarray], scale: np.ndarray, rho: np.ndarray, step: float) -> np.ndarray:
    return gamma_from(stats["C"] @ np.log(np.maximum(F, EPS)).T, F.sum(1), gamma, stats, scale, rho, step)


def gamma_from(fit: np.ndarray, f_sum: np.ndarray, gamma: np.ndarray, stats: dict[str, np.ndarray], scale: np.ndarray, rho: np.ndarray, step: float) -> np.ndarray:
    """fit: expected counts times log factors, S x D x K."""
    score = fit - (scale * stats["mean"])[:, :, None] * f_sum + np.log(np.maximum(rho, EPS))
    return normalize_gamma((1 - step) * gamma + step * B.softmax(score))


def scale_step(F: np.ndarray, gamma: np.ndarray, stats: dict[str, np.ndarray], scale: np.ndarray, step: float, low: float, high: float) -> np.ndarray:
    return scale_from(stats["C"].sum(2), F.sum(1), gamma, stats, scale, step, low, high)


def scale_from(counts: np.ndarray, f_sum: np.ndarray, gamma: np.ndarray, stats: dict[str, np.ndarray], scale: np.ndarray, step: float, low: float, high: float) -> np.ndarray:
    """counts: expected counts of each slot, S x D."""
    exposure = stats["mean"] * (gamma @ f_sum)
    new = (1 - step) * scale + step * counts / np.maximum(exposure, EPS)
    new = new / np.maximum(new.mean(1, keepdims=True), EPS)
    return np.clip(new, low, high)


def factor_step(F: np.ndarray, A: np.ndarray, step: float, pseudocount: float) -> np.ndarray:
    return normalize_rows((1 - step) * F + step * normalize_rows(A + pseudocount, EPS), EPS)


def gamma_kl(gamma: np.ndarray, rho: np.ndarray) -> float:
    return float((gamma * (np.log(np.maximum(gamma, EPS)) - np.log(np.maximum(rho, EPS)))).sum())


def _sums(stats: dict[str, np.ndarray], log_z: float) -> np.ndarray:
    return np.concatenate([stats["weight"], stats["mean"].ravel(), stats["mean_log"].ravel(), stats["C"].ravel(), [log_z]])


def _stats(sums: np.ndarray, S: int, D: int, M: int) -> tuple[dict[str, np.ndarray], float]:
    at = np.cumsum([S, S * D, S * D, S * D * M])
    w, a, b, c, z = np.split(sums, at)
    return {"weight": w, "mean": a.reshape(S, D), "mean_log": b.reshape(S, D), "C": c.reshape(S, D, M)}, float(z[0])


def _soft_params(F: np.ndarray, gamma: np.ndarray, alpha0: np.ndarray, rate0: np.ndarray, scale: np.ndarray) -> B.Motifs:
    return B.Motifs(gamma @ np.log(np.maximum(F, EPS)), gamma @ F.sum(1), np.log(np.maximum(scale, EPS)), alpha0, rate0, scale)


def _mix(x: np.ndarray) -> np.ndarray:
    x = np.maximum(x, EPS)
    return x / x.sum()


def soft_mixture_fixed(counts: Counts | DataFrame, factors: np.ndarray, gamma: np.ndarray, max_iters: int = 50, n_inner: int = 5, update_prior: bool = True, prior_shape: float = 1.0, prior_rate: float = 1.0, pi_init: np.ndarray | None = None, rho_prior: np.ndarray | None = None, tol: float | None = 1e-5, min_iters: int = 5, patience: int = 3, update_F: bool = False, update_gamma: bool = True, update_slot_scale: bool = False, slot_scale_init: np.ndarray | None = None, slot_scale_step_init: float = 0.2, slot_scale_step_ramp: int = 10, min_slot_scale: float = 1e-3, max_slot_scale: float = 1e3, gamma_step_init: float = 0.5, gamma_step_ramp: int = 10, F_step_init: float = 0.2, F_step_ramp: int = 20, F_pseudocount: float = TINY, omega_init: Callable | None = None, resume: str | None = None) -> MixtureFit:
    """Soft motifs from given factors and gamma (S x D x K). Both component fits of an iteration, before and after the responsibilities, are one pass."""
    samples = counts.packed() if isinstance(counts, Counts) else counts
    F, gamma = normalize_rows(factors, EPS), normalize_gamma(gamma)
    (S, D, K), M = gamma.shape, F.shape[1]
    rho = np.full(gamma.shape, 1 / K) if rho_prior is None else rho_prior
    scale = np.ones((S, D)) if slot_scale_init is None else slot_scale_init
    alpha0, rate0 = np.full((S, D), prior_shape), np.full((S, D), prior_rate)
    pi = np.full(S, 1 / S) if pi_init is None else pi_init / pi_init.sum()
    width, size = S + S * D, S + 2 * S * D + S * D * M + 1

    def one(p: B.Motifs, pi: np.ndarray, first: bool, inner: int, again: bool):
        def step(ids, b, state):
            alpha = p.alpha0 + np.tile((b.total / D)[:, None, None], (1, S, D)) if first else state[:, S:].reshape(b.n, S, D)
            alpha, bound, shares = B.soft_components(b, alpha, p, inner)
            resp = bound + np.log(np.maximum(pi, EPS))
            omega = B.softmax(resp)
            if again:
                alpha, _, shares = B.soft_components(b, alpha, p, 1)
            stats = B.mixture_stats(b, omega, alpha, shares, p, M)
            return np.hstack([omega, alpha.reshape(b.n, -1)]), _sums(stats, B.log_sum_exp(resp).sum())

        return step

    n = samples.count()
    rows, last = samples, None
    stop, history, gammas = Stopper(tol, min_iters, patience), [], []
    n_iter, converged, begun = max_iters, False, 0
    log = Journal(samples.sparkSession, resume, fit="soft", S=S, D=D, K=K, M=M, n=n, n_inner=n_inner)
    if saved := log.last():
        v = saved[1]
        begun, last, history, gammas, converged = saved[0], _going_on(saved), restore(stop, v), list(v["gammas"]), bool(v["converged"])
        F, gamma, alpha0, rate0, scale, pi, rows = v["F"], v["gammas"][-1], v["alpha0"], v["rate0"], v["scale"], v["pi"], last.samples()
        n_iter = begun if converged else max_iters
    for it in range(begun + 1, 0 if converged else max_iters + 1):
        p = _soft_params(F, gamma, alpha0, rate0, scale)
        now = sweep(rows, one(p, pi, it == 1, n_inner, True), None if it == 1 else width, size)
        stats, log_z = _stats(now.sums, S, D, M)
        pi = _mix(stats["weight"] / n)
        if update_prior:
            alpha0, rate0 = prior_step(stats, alpha0, rate0)
        if update_gamma:
            gamma = gamma_step(F, gamma, stats, scale, rho, damping(gamma_step_init, gamma_step_ramp, it))
        if update_slot_scale:
            scale = scale_step(F, gamma, stats, scale, damping(slot_scale_step_init, slot_scale_step_ramp, it), min_slot_scale, max_slot_scale)
        if update_F:
            F = factor_step(F, np.einsum("sdk,sdm->km", gamma, stats["C"]), damping(F_step_init, F_step_ramp, it), F_pseudocount)
        history.append((it, log_z - gamma_kl(gamma, rho)))
        gammas.append(gamma)
        converged = stop(it, history[-1][1])
        log.save(it, now.path, stop, history, F=F, gammas=np.stack(gammas), alpha0=alpha0, rate0=rate0, scale=scale, pi=pi, converged=converged)
        if last is not None:
            last.drop()
        last, rows = now, now.samples()
        if converged:
            n_iter = it
            break
    p = _soft_params(F, gamma, alpha0, rate0, scale)
    final = sweep(rows, one(p, pi, last is None, n_inner, False), None if last is None else width, size)
    if last is not None and not resume:
        last.drop()
    stats, _ = _stats(final.sums, S, D, M)
    spark = samples.sparkSession
    return MixtureFit(spark, F, final.samples(), width, history, converged, n_iter, S, D, _mix(stats["weight"] / n), gamma, None, alpha0, rate0, p.rate, scale, stats["C"], stats["mean"] / np.maximum(stats["weight"], EPS)[:, None], None, gammas)


def soft_mixture(counts: Counts, K: int, S: int, D: int, max_iters: int = 50, n_inner: int = 5, mf_max_iters: int = 60, mf_nmf_iters: int = 100, seed: int | None = None, gamma_init_floor: float = 0.05, motif_min_share: float = 0.10, surplus_slots: str = "repeat", update_F: bool = True, **options) -> MixtureFit:
    """The whole ladder: effects fit, clustered loading scores, peaked motifs, then the soft mixture."""
    from . import blocked

    wide = too_wide(counts, max(K, S * D))
    if surplus_slots not in ("repeat", "uniform"):
        raise ValueError("surplus_slots must be repeat or uniform")
    mf = (blocked.mf_susie if wide else mf_susie)(counts, K, D, mf_max_iters, seed=seed, nmf_iters=mf_nmf_iters, elbo_every=5, tol=5e-4, min_iters=15, patience=2)
    motifs = motifs_from_scores(mf.scores(), S, D, 0 if seed is None else seed, motif_min_share)
    mix, factors = (blocked.soft_mixture_fixed, mf.blocks) if wide else (soft_mixture_fixed, mf.factors)
    fit = mix(counts if wide else mf.packed(), factors, peaked_gamma(motifs, K, gamma_init_floor, surplus_slots), max_iters, n_inner, update_F=update_F, **options)
    fit.mf_fit = mf
    return fit


def _hard_params(F: np.ndarray, motifs: np.ndarray, alpha0: np.ndarray, rate0: np.ndarray) -> B.Motifs:
    ones = np.ones(motifs.shape)
    return B.Motifs(np.log(np.maximum(F, EPS))[motifs - 1], F.sum(1)[motifs - 1], np.zeros(motifs.shape), alpha0, rate0, ones)


def motif_step(F: np.ndarray, motifs: np.ndarray, pooled: np.ndarray, min_share: float = 0.10, iters: int = 50) -> np.ndarray:
    """New motifs from each component's pooled counts (S x M): loadings for fixed factors, the largest shares kept and recycled."""
    (S, D), K = motifs.shape, len(F)
    total = np.maximum(pooled.sum(1), EPS)
    H = np.repeat((total / K)[:, None], K, 1)
    for s in range(S):
        H[s] += total[s] * np.bincount(motifs[s] - 1, minlength=K) / D
    for _ in range(iters):
        H = np.maximum(H * ((pooled / (H @ F + EPS)) @ F.T) / F.sum(1), EPS)
    share = H / np.maximum(H.sum(1, keepdims=True), EPS)
    return np.array([recycled(share[s], D, min_share) for s in range(S)])


def recycled(share: np.ndarray, D: int, min_share: float) -> np.ndarray:
    """1-based ids with at least min_share, largest first (one at least, D at most), repeated up to D."""
    order = np.argsort(-share, kind="stable")
    active = order[share[order] >= min_share][:D]
    if not len(active):
        active = order[:1]
    return np.resize(active, D) + 1


def hard_mixture_fixed(counts: Counts | DataFrame, factors: np.ndarray, motifs: np.ndarray, max_iters: int = 50, n_inner: int = 8, update_prior: bool = True, prior_shape: float = 1.0, prior_rate: float = 1.0, pi_init: np.ndarray | None = None, tol: float | None = 1e-5, min_iters: int = 5, patience: int = 3, update_F: bool = False, update_motifs: bool = False, motif_update_every: int = 1, motif_min_share: float = 0.10, motif_loading_iters: int = 50, F_step_init: float = 1.0, F_step_ramp: int = 1, F_pseudocount: float = TINY, resume: str | None = None) -> MixtureFit:
    """Hard motifs (S x D, 1-based) from given factors. Each iteration starts every sample's effects from the prior."""
    F, motifs = normalize_rows(factors, EPS), np.asarray(motifs)
    (S, D), (K, M) = motifs.shape, F.shape
    alpha0, rate0 = np.full((S, D), prior_shape), np.full((S, D), prior_rate)
    pi = np.full(S, 1 / S) if pi_init is None else pi_init / pi_init.sum()
    width, size = S + S * D, S + 2 * S * D + S * D * M + 1
    rows = counts.packed() if isinstance(counts, Counts) else counts
    n = rows.count()
    spark = rows.sparkSession

    def through(p: B.Motifs, pi: np.ndarray, width_in: int | None, rows: DataFrame) -> Passed:
        def step(ids, b, state):
            alpha, bound, shares = B.hard_components(b, p, n_inner)
            resp = bound + np.log(np.maximum(pi, EPS))
            omega = B.softmax(resp)
            stats = B.mixture_stats(b, omega, alpha, shares, p, M)
            return np.hstack([omega, alpha.reshape(b.n, -1)]), _sums(stats, B.log_sum_exp(resp).sum())

        return sweep(rows, step, width_in, size)

    last: Passed | None = None
    stop, history, seen = Stopper(tol, min_iters, patience), [], []
    n_iter, converged, begun = max_iters, False, 0
    log = Journal(spark, resume, fit="hard", S=S, D=D, K=K, M=M, n=n, n_inner=n_inner)
    if saved := log.last():
        v = saved[1]
        begun, last, history, seen, converged = saved[0], _going_on(saved), restore(stop, v), list(v["seen"]), bool(v["converged"])
        F, motifs, alpha0, rate0, pi, rows = v["F"], v["seen"][-1], v["alpha0"], v["rate0"], v["pi"], last.samples()
        n_iter = begun if converged else max_iters
    for it in range(begun + 1, 0 if converged else max_iters + 1):
        now = through(_hard_params(F, motifs, alpha0, rate0), pi, None if last is None else width, rows)
        stats, log_z = _stats(now.sums, S, D, M)
        pi = _mix(stats["weight"] / n)
        if update_prior:
            alpha0, rate0 = prior_step(stats, alpha0, rate0)
        history.append((it, log_z))
        if update_F:
            A = np.zeros((K, M))
            np.add.at(A, motifs.ravel() - 1, stats["C"].reshape(S * D, M))
            F = factor_step(F, A, damping(F_step_init, F_step_ramp, it), F_pseudocount)
        if update_motifs and it % motif_update_every == 0:
            motifs = motif_step(F, motifs, stats["C"].sum(1), motif_min_share, motif_loading_iters)
        seen.append(motifs)
        converged = stop(it, log_z)
        log.save(it, now.path, stop, history, F=F, seen=np.stack(seen), alpha0=alpha0, rate0=rate0, pi=pi, converged=converged)
        if last is not None:
            last.drop()
        last, rows = now, now.samples()
        if converged:
            n_iter = it
            break
    p = _hard_params(F, motifs, alpha0, rate0)
    final = through(p, pi, None if last is None else width, rows)
    if last is not None and not resume:
        last.drop()
    stats, _ = _stats(final.sums, S, D, M)
    hard = np.zeros((S, D, K))
    hard[np.arange(S)[:, None], np.arange(D)[None], motifs - 1] = 1.0
    return MixtureFit(spark, F, final.samples(), width, history, converged, n_iter, S, D, _mix(stats["weight"] / n), hard, motifs, alpha0, rate0, p.rate, p.scale, stats["C"], stats["mean"] / np.maximum(stats["weight"], EPS)[:, None], None, seen)


def hard_mixture(counts: Counts, K: int, S: int, D: int, max_iters: int = 50, n_inner: int = 8, mf_max_iters: int = 60, mf_nmf_iters: int = 100, seed: int | None = None, motif_min_share: float = 0.10, update_F: bool = True, update_motifs: bool = True, F_step_init: float = 0.2, F_step_ramp: int = 20, **options) -> MixtureFit:
    from . import blocked

    wide = too_wide(counts, max(K, S * D))
    mf = (blocked.mf_susie if wide else mf_susie)(counts, K, D, mf_max_iters, seed=seed, nmf_iters=mf_nmf_iters, elbo_every=5, tol=5e-4, min_iters=15, patience=2)
    motifs = motifs_from_scores(mf.scores(), S, D, 0 if seed is None else seed, motif_min_share)
    mix, factors = (blocked.hard_mixture_fixed, mf.blocks) if wide else (hard_mixture_fixed, mf.factors)
    fit = mix(counts if wide else mf.packed(), factors, motifs, max_iters, n_inner, update_F=update_F, update_motifs=update_motifs, motif_min_share=motif_min_share, F_step_init=F_step_init, F_step_ramp=F_step_ramp, **options)
    fit.mf_fit = mf
    return fit
