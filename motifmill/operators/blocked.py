"""The fits of fits.py for any number of features: factors are a table by blocks, samples' sums are added up over blocks.

Same updates, same results; each round over the cells is a pass that joins pieces with their block. Used when a sum over all features would not
fit the driver (fits.DRIVER_BYTES), or directly.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from ..plans.blocks import FEATURES, PIECES, Blocks, Factors, Table, by_block, cut, factors_by, factors_from, first_state, normalised, totals
from ..plans.schedule import Stopper, damping
from ..plans.sweep import exponential
from ..sources.counts import Counts
from ..sources.simulate import EPS as TINY
from . import batch as B
from . import fits

EPS = B.EPS


@dataclass
class BlockFit:
    """factors has no columns here; the factors are in blocks."""

    blocks: Factors | None = None

    def factors_df(self) -> DataFrame:
        return self.blocks.frame()


@dataclass
class BlockNMF(BlockFit, fits.NMFFit):
    blocks: Factors | None = None


@dataclass
class BlockEffects(BlockFit, fits.EffectsFit):
    blocks: Factors | None = None


@dataclass
class BlockMixture(BlockFit, fits.MixtureFit):
    blocks: Factors | None = None
    C_table: DataFrame | None = field(default=None)  # blk, v: S x D x width expected counts


def _floats(values: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(values)).reshape(-1, width)


def _moved(f: Factors, sums: DataFrame, new: Callable[[np.ndarray, np.ndarray], np.ndarray], columns: int) -> Factors:
    """Factors from new(f, sums of the block: columns x width), normalised; blocks without cells have sums of 0."""
    joined, block = f.rows.join(sums, "blk", "left"), f.block

    def run(blk: int, values: list) -> np.ndarray:
        old = block(values[0])
        got = np.zeros((columns, old.shape[1])) if values[1] is None else np.frombuffer(values[1])[: columns * old.shape[1]].reshape(columns, -1)
        return new(old, got)

    return normalised(by_block(joined, run, "f", "v"), f.K, f.size)


def _step_towards(f: Factors, sums: DataFrame, counts: Callable[[np.ndarray], np.ndarray], columns: int, step: float, least: float) -> Factors:
    """Damped move to the normalised counts(sums), K x width."""
    to = _moved(f, sums, lambda _, got: np.maximum(counts(got), least), columns)
    joined = f.rows.join(to.rows.withColumnRenamed("f", "g"), "blk")
    old, new = f.block, to.block
    return normalised(by_block(joined, lambda _, v: np.maximum((1 - step) * old(v[0]) + step * new(v[1]), least), "f", "g"), f.K, f.size)


def poisson_nmf(counts: Counts, K: int, max_iters: int = 200, seed: int | None = None, size: int = FEATURES, pieces: int = PIECES) -> BlockNMF:
    """As fits.poisson_nmf."""
    b = cut(counts, size, pieces)
    return _nmf(b, K, max_iters, seed)


def _nmf(b: Blocks, K: int, max_iters: int, seed: int | None) -> BlockNMF:
    spark = b.pieces.sparkSession
    f = factors_by(spark, b.M, K, b.size, (lambda m: fits.hashed_factors(m, K)) if seed is None else (lambda m: np.maximum(fits.seeded_factors(m, K, seed), EPS)))

    def start(ids: np.ndarray, total: np.ndarray) -> np.ndarray:
        w = 1.0 + (np.arange(1, K + 1) * 15485863 + ids[:, None] * 32452843) % 1013 if seed is None else exponential(seed, ids, K)
        return w / w.sum(1, keepdims=True) * np.maximum(total, EPS)[:, None]

    state = Table.of(first_state(b.samples, start), "state")
    scale, history = np.ones(K), []
    for it in range(1, max_iters + 1):

        def up(c: B.Batch, L: np.ndarray, f: np.ndarray, scale=scale) -> tuple:
            at = f[:, c.m].T
            ratio = c.y / (((L * scale)[c.row] * at).sum(1) + EPS)
            return c.by_row(ratio[:, None] * at), None

        def loads(ids, total, L, got, scale=scale) -> np.ndarray:
            return np.maximum(L * scale * got, EPS)  # factors sum to 1

        def stats(c: B.Batch, L: np.ndarray, f: np.ndarray) -> tuple:
            at = f[:, c.m].T
            rate = (L[c.row] * at).sum(1) + EPS
            return None, np.append(c.by_feature(L[c.row] * (c.y / rate)[:, None], f.shape[1]).ravel(), (c.y * np.log(c.y / rate) - c.y).sum())

        state = state.then(b.update(state.rows, K, b.meet(state.rows, K, f, up), K, loads), "state")
        A = Table.of(b.block_sums(b.meet(state.rows, K, f, stats)), "block-sums")
        level = totals(state.rows, lambda s: _floats(s, K).sum(0), K, "state")
        deviance = totals(A.rows, lambda vs: np.array([sum(np.frombuffer(v)[-1] for v in vs)]), 1, "v")[0] + level.sum()
        history.append((it, -deviance))
        f = _moved(f, A.rows, lambda old, got, level=level: np.maximum(old * got / level[:, None], EPS), K)
        scale = f.scale
    final = b.update(state.rows, K, b.meet(state.rows, K, f, lambda c, L, f: (None, None)), K, lambda ids, total, L, got: L * scale)
    return BlockNMF(spark, np.empty((K, 0)), Table.of(final, "state").rows, K, history, False, max_iters, blocks=f)


def mf_susie(counts: Counts, K: int, D: int, max_iters: int = 100, update_prior: bool = True, break_symmetry: bool = False, tol_dist_sim: float = 1e-4, seed: int | None = None, prior_shape: float = 1.0, prior_rate: float = 1.0, init: str = "poisson_nmf", nmf_iters: int = 200, init_gamma_from_nmf: bool = True, gamma_init_floor: float = 1e-4, gamma_step_init: float = 0.1, gamma_step_ramp: int = 50, F_step_init: float = 0.05, F_step_ramp: int = 75, F_pseudocount: float = TINY, elbo_every: int = 1, tol: float | None = None, min_iters: int = 10, patience: int = 3, update_F: bool = True, factors: Factors | None = None, given: Callable[[np.ndarray], B.Effects] | None = None, size: int = FEATURES, pieces: int = PIECES) -> BlockEffects:
    """As fits.mf_susie; with init given, factors are a table by blocks."""
    if init not in ("poisson_nmf", "random", "given") or (init == "given") != (factors is not None) or (factors is None) != (given is None):
        raise ValueError("init must be poisson_nmf, random or given (with factors and effects)")
    b = cut(counts, size, pieces)
    s, width, ones = 0 if seed is None else seed, B.Effects.width(D, K), np.ones(K)
    fresh = lambda ids: fits.random_effects(ids, D, K, s, ones, prior_shape, prior_rate) if given is None else given(ids)
    if init == "poisson_nmf":
        nmf = _nmf(b, K, nmf_iters, seed)
        f = nmf.blocks

        def from_loadings(ids, total, L, got) -> np.ndarray:
            e = fresh(ids)
            if init_gamma_from_nmf:
                e.gamma = fits.top_loadings(L, D, gamma_init_floor)
            return e.flat()

        nothing = b.meet(nmf.samples, K, f, lambda c, L, f: (None, None))
        state = Table.of(b.update(nmf.samples, K, nothing, 1, from_loadings), "state")
    else:
        f = factors if factors is not None else factors_by(b.pieces.sparkSession, b.M, K, size, lambda m: np.maximum(fits.seeded_factors(m, K, s), EPS))
        state = Table.of(first_state(b.samples, lambda ids, total: fresh(ids).flat()), "state")
    stop, history, n_iter, converged = Stopper(tol, min_iters, patience), [], max_iters, False
    merge = break_symmetry and D > 1
    for it in range(1, max_iters + 1):
        rho = damping(gamma_step_init, gamma_step_ramp, it)
        for d in range(D):

            def effects(flat: np.ndarray, first=d == 0) -> B.Effects:
                e = B.Effects.of(flat, D, K)
                if merge and first:
                    e.gamma = B.merge_equal(e.gamma, tol_dist_sim)
                return e

            def shares(c, flat, f, d=d, effects=effects) -> tuple:
                return B.effect_counts(c, effects(flat), np.log(f), d), None

            def moved(ids, total, flat, got, d=d, effects=effects, rho=rho) -> np.ndarray:
                e = effects(flat)
                B.effect_update(e, d, got, ones, rho, update_prior)
                return e.flat()

            state = state.then(b.update(state.rows, width, b.meet(state.rows, width, f, shares), 1 + K, moved), "state")
        if update_F:
            A = b.block_sums(b.meet(state.rows, width, f, lambda c, flat, f: (None, B.effects_factor_stats(c, B.Effects.of(flat, D, K), np.log(f)).ravel())))
            f = _step_towards(f, Table.of(A, "block-sums").rows, lambda got: got + F_pseudocount, K, damping(F_step_init, F_step_ramp, it), TINY)
        if it == 1 or it == max_iters or it % max(elbo_every, 1) == 0:
            met = b.meet(state.rows, width, f, lambda c, flat, f: (B.effects_cells(c, B.Effects.of(flat, D, K), np.log(f))[:, None], None))
            bounds = b.update(state.rows, width, met, 1, lambda ids, total, flat, got: B.effects_bound_of(got[:, 0], B.Effects.of(flat, D, K), ones)[0][:, None])
            history.append((it, totals(bounds, lambda v: np.array([_floats(v, 1).sum()]), 1, "state")[0]))
            if stop(it, history[-1][1]):
                converged, n_iter = True, it
                break
    return BlockEffects(b.pieces.sparkSession, np.empty((K, 0)), state.rows, width, history, converged, n_iter, D, blocks=f)


# Mixtures. The state is responsibilities, effects, the effects before them (hard motifs), and the sample's part of the bound.


@dataclass
class _Mixture:
    """What one pass needs of the global state."""

    p: B.Motifs  # without log_g
    pi: np.ndarray
    log_g: Callable[[np.ndarray], np.ndarray]  # block of factors -> S x D x width

    def at(self, f: np.ndarray) -> B.Motifs:
        return B.Motifs(self.log_g(f), self.p.exposure, self.p.log_scale, self.p.alpha0, self.p.rate0, self.p.scale)


def _alpha(state: np.ndarray, S: int, D: int, nth: int = 0) -> np.ndarray:
    lo = S + nth * S * D
    return state[:, lo : lo + S * D].reshape(-1, S, D)


def _at(S: int, D: int, nth: int = 0) -> tuple[int, int]:
    """Columns of the effects in a state, for Blocks.meet to take."""
    return S + nth * S * D, S + (nth + 1) * S * D


def _put(state: np.ndarray, S: int, D: int, alpha: np.ndarray | None = None, omega: np.ndarray | None = None, before: np.ndarray | None = None, log_z: np.ndarray | None = None) -> np.ndarray:
    out = state.copy()
    n = len(out)
    if omega is not None:
        out[:, :S] = omega
    if alpha is not None:
        out[:, S : S + S * D] = alpha.reshape(n, -1)
    if before is not None:
        out[:, S + S * D : S + 2 * S * D] = before.reshape(n, -1)
    if log_z is not None:
        out[:, -1] = log_z
    return out


def _round(b: Blocks, state: Table, width: int, f: Factors, m: _Mixture) -> Table:
    """Effects from the counts that their shares give, in all components; the ones before are kept beside them."""
    S, D = m.p.alpha0.shape

    def shares(c, st, f) -> tuple:
        p, alpha = m.at(f), st.reshape(-1, S, D)
        return np.hstack([B.slot_counts(c, alpha[:, s], p, s) for s in range(S)]), None

    def moved(ids, total, st, got) -> np.ndarray:
        return _put(st, S, D, alpha=m.p.alpha0 + got.reshape(-1, S, D), before=_alpha(st, S, D))

    return state.then(b.update(state.rows, width, b.meet(state.rows, width, f, shares, [_at(S, D)]), S * D, moved), "state")


def _respond(b: Blocks, state: Table, width: int, f: Factors, m: _Mixture, hard: bool) -> Table:
    """Responsibilities. Hard motifs share by the effects before the last round, and the bound takes those that follow."""
    S, D = m.p.alpha0.shape

    def cells(c, st, f) -> tuple:
        p, alpha, out = m.at(f), st.reshape(-1, S, D), []
        for s in range(S):
            xi, elf, _ = B.slot_shares(c, alpha[:, s], p, s)
            out += [B.slot_cells(c, xi, elf)[:, None], c.by_row(xi * c.y[:, None])]
        return np.hstack(out), None

    def moved(ids, total, st, got) -> np.ndarray:
        alpha, parts = _alpha(st, S, D), got.reshape(len(got), S, 1 + D)
        p = m.p
        resp = np.column_stack([B.slot_bound_of(parts[:, s, 0], parts[:, s, 1:], alpha[:, s], p, s) for s in range(S)]) + np.log(np.maximum(m.pi, EPS))
        return _put(st, S, D, omega=B.softmax(resp), log_z=B.log_sum_exp(resp))

    return state.then(b.update(state.rows, width, b.meet(state.rows, width, f, cells, [_at(S, D, int(hard))]), S * (1 + D), moved), "state")


def _expected(b: Blocks, state: Table, width: int, f: Factors, m: _Mixture, hard: bool) -> tuple[dict[str, np.ndarray], float, Table]:
    """Moments of the effects, the bound's sum, and the expected counts by block (a table)."""
    S, D = m.p.alpha0.shape

    def block(c, st, f) -> tuple:
        p, omega, alpha = m.at(f), st[:, :S], _alpha(st, S, D)
        C = [c.by_feature(B.slot_shares(c, alpha[:, s], p, s)[0] * (c.y * omega[c.row, s])[:, None], f.shape[1]) for s in range(S)]
        return None, np.stack(C).ravel()

    C = Table.of(b.block_sums(b.meet(state.rows, width, f, block, [(0, S), _at(S, D, int(hard))])), "expected-counts")
    rate = m.p.rate

    def moments(states: list[bytes]) -> np.ndarray:
        st = _floats(states, width)
        w, alpha = st[:, :S, None], _alpha(st, S, D)
        mean_log = (w * (B.np_digamma(alpha) - np.log(rate))).sum(0)
        return np.concatenate([st[:, :S].sum(0), (w * alpha / rate).sum(0).ravel(), mean_log.ravel(), [st[:, -1].sum()]])

    sums = totals(state.rows, moments, S + 2 * S * D + 1, "state")
    w, mean, mean_log, z = np.split(sums, np.cumsum([S, S * D, S * D]))
    return {"weight": w, "mean": mean.reshape(S, D), "mean_log": mean_log.reshape(S, D)}, float(z[0]), C


def _start(b: Blocks, S: int, D: int, alpha: Callable[[np.ndarray], np.ndarray]) -> tuple[Table, int]:
    width = S + 2 * S * D + 1

    def first(ids: np.ndarray, total: np.ndarray) -> np.ndarray:
        return _put(np.zeros((len(ids), width)), S, D, alpha=alpha(total))

    return Table.of(first_state(b.samples, first), "state"), width


def soft_mixture_fixed(counts: Counts, factors: DataFrame | Factors, gamma: np.ndarray, max_iters: int = 50, n_inner: int = 5, update_prior: bool = True, prior_shape: float = 1.0, prior_rate: float = 1.0, pi_init: np.ndarray | None = None, rho_prior: np.ndarray | None = None, tol: float | None = 1e-5, min_iters: int = 5, patience: int = 3, update_F: bool = False, update_gamma: bool = True, update_slot_scale: bool = False, slot_scale_init: np.ndarray | None = None, slot_scale_step_init: float = 0.2, slot_scale_step_ramp: int = 10, min_slot_scale: float = 1e-3, max_slot_scale: float = 1e3, gamma_step_init: float = 0.5, gamma_step_ramp: int = 10, F_step_init: float = 0.2, F_step_ramp: int = 20, F_pseudocount: float = TINY, size: int = FEATURES, pieces: int = PIECES) -> BlockMixture:
    """As fits.soft_mixture_fixed; factors are a table (k, m, f) or already in blocks."""
    gamma = fits.normalize_gamma(gamma)
    S, D, K = gamma.shape
    b = cut(counts, size, pieces)
    f = factors if isinstance(factors, Factors) else factors_from(factors, K, size, EPS)
    rho = np.full(gamma.shape, 1 / K) if rho_prior is None else rho_prior
    scale = np.ones((S, D)) if slot_scale_init is None else slot_scale_init
    alpha0, rate0 = np.full((S, D), prior_shape), np.full((S, D), prior_rate)
    pi = np.full(S, 1 / S) if pi_init is None else pi_init / pi_init.sum()
    ones, n = np.ones(K), b.samples.count()
    state, width = _start(b, S, D, lambda total: prior_shape + np.tile((total / D)[:, None, None], (1, S, D)))

    def mixture() -> _Mixture:
        g = gamma
        return _Mixture(B.Motifs(np.zeros(0), g @ ones, np.log(np.maximum(scale, EPS)), alpha0, rate0, scale), pi, lambda block: g @ np.log(np.maximum(block, EPS)))

    def through(again: bool) -> tuple[_Mixture, dict, float, Table]:
        nonlocal state
        m = mixture()
        for _ in range(n_inner + 1):
            state = _round(b, state, width, f, m)
        state = _respond(b, state, width, f, m, False)
        for _ in range(2 if again else 0):
            state = _round(b, state, width, f, m)
        return m, *_expected(b, state, width, f, m, False)

    stop, history, gammas, n_iter, converged = Stopper(tol, min_iters, patience), [], [], max_iters, False
    for it in range(1, max_iters + 1):
        _, stats, log_z, C = through(True)
        pi = fits._mix(stats["weight"] / n)
        if update_prior:
            alpha0, rate0 = fits.prior_step(stats, alpha0, rate0)
        both = C.rows.join(f.rows, "blk")
        block = f.block

        def by_factor(vs: list[bytes], fs: list[bytes], block=block) -> np.ndarray:
            out = np.zeros(S * D * (K + 1))
            for v, raw in zip(vs, fs, strict=True):
                c = np.frombuffer(v).reshape(S, D, -1)
                out += np.concatenate([(c @ np.log(np.maximum(block(raw), EPS)).T).ravel(), c.sum(2).ravel()])
            return out

        sums = totals(both, by_factor, S * D * (K + 1), "v", "f")
        if update_gamma:
            gamma = fits.gamma_from(sums[: S * D * K].reshape(S, D, K), ones, gamma, stats, scale, rho, damping(gamma_step_init, gamma_step_ramp, it))
        if update_slot_scale:
            scale = fits.scale_from(sums[S * D * K :].reshape(S, D), ones, gamma, stats, scale, damping(slot_scale_step_init, slot_scale_step_ramp, it), min_slot_scale, max_slot_scale)
        if update_F:
            g = gamma.reshape(S * D, K).T
            f = _step_towards(f, C.rows, lambda got, g=g: g @ got + F_pseudocount, S * D, damping(F_step_init, F_step_ramp, it), EPS)
        history.append((it, log_z - fits.gamma_kl(gamma, rho)))
        gammas.append(gamma)
        if stop(it, history[-1][1]):
            converged, n_iter = True, it
            break
    m, stats, _, C = through(False)
    beta = stats["mean"] / np.maximum(stats["weight"], EPS)[:, None]
    return BlockMixture(b.pieces.sparkSession, np.empty((K, 0)), state.rows, width, history, converged, n_iter, S, D, fits._mix(stats["weight"] / n), gamma, None, alpha0, rate0, m.p.rate, scale, np.zeros(0), beta, None, gammas, blocks=f, C_table=C.rows)


def hard_mixture_fixed(counts: Counts, factors: DataFrame | Factors, motifs: np.ndarray, max_iters: int = 50, n_inner: int = 8, update_prior: bool = True, prior_shape: float = 1.0, prior_rate: float = 1.0, pi_init: np.ndarray | None = None, tol: float | None = 1e-5, min_iters: int = 5, patience: int = 3, update_F: bool = False, update_motifs: bool = False, motif_update_every: int = 1, motif_min_share: float = 0.10, motif_loading_iters: int = 50, F_step_init: float = 1.0, F_step_ramp: int = 1, F_pseudocount: float = TINY, K: int | None = None, size: int = FEATURES, pieces: int = PIECES) -> BlockMixture:
    """As fits.hard_mixture_fixed; factors are a table (k, m, f), with K, or already in blocks."""
    motifs = np.asarray(motifs)
    S, D = motifs.shape
    b = cut(counts, size, pieces)
    f = factors if isinstance(factors, Factors) else factors_from(factors, K, size, EPS)
    K = f.K
    alpha0, rate0 = np.full((S, D), prior_shape), np.full((S, D), prior_rate)
    pi = np.full(S, 1 / S) if pi_init is None else pi_init / pi_init.sum()
    n = b.samples.count()
    state, width = _start(b, S, D, lambda total: np.zeros((len(total), S, D)))

    def through() -> tuple[_Mixture, dict, float, Table]:
        nonlocal state
        at, prior = motifs - 1, alpha0
        m = _Mixture(B.Motifs(np.zeros(0), np.ones((S, D)), np.zeros((S, D)), alpha0, rate0, np.ones((S, D))), pi, lambda block: np.log(np.maximum(block, EPS))[at])
        # Every fit starts from the prior.
        state = state.then(first_state(state.rows, lambda ids, total: _put(np.zeros((len(ids), width)), S, D, alpha=np.tile(prior, (len(ids), 1, 1)))), "state")
        for _ in range(n_inner):
            state = _round(b, state, width, f, m)
        state = _respond(b, state, width, f, m, True)
        return m, *_expected(b, state, width, f, m, True)

    stop, history, seen, n_iter, converged = Stopper(tol, min_iters, patience), [], [], max_iters, False
    for it in range(1, max_iters + 1):
        _, stats, log_z, C = through()
        pi = fits._mix(stats["weight"] / n)
        if update_prior:
            alpha0, rate0 = fits.prior_step(stats, alpha0, rate0)
        history.append((it, log_z))
        if update_F:
            to = np.zeros((K, S * D))
            to[motifs.ravel() - 1, np.arange(S * D)] = 1.0
            f = _step_towards(f, C.rows, lambda got, to=to: to @ got + F_pseudocount, S * D, damping(F_step_init, F_step_ramp, it), EPS)
        if update_motifs and it % motif_update_every == 0:
            motifs = _motif_step(f, motifs, C.rows, motif_min_share, motif_loading_iters)
        seen.append(motifs)
        if stop(it, log_z):
            converged, n_iter = True, it
            break
    m, stats, _, C = through()
    gamma = np.zeros((S, D, K))
    gamma[np.arange(S)[:, None], np.arange(D)[None], motifs - 1] = 1.0
    beta = stats["mean"] / np.maximum(stats["weight"], EPS)[:, None]
    return BlockMixture(b.pieces.sparkSession, np.empty((K, 0)), state.rows, width, history, converged, n_iter, S, D, fits._mix(stats["weight"] / n), gamma, motifs, alpha0, rate0, m.p.rate, m.p.scale, np.zeros(0), beta, None, seen, blocks=f, C_table=C.rows)


def _motif_step(f: Factors, motifs: np.ndarray, C: DataFrame, min_share: float, iters: int) -> np.ndarray:
    """As fits.motif_step: loadings of each component's pooled counts by passes over the blocks."""
    (S, D), K = motifs.shape, f.K
    pooled = f.rows.join(C, "blk")
    block = f.block
    ys = lambda v: np.frombuffer(v).reshape(S, D, -1).sum(1)
    total = np.maximum(totals(C, lambda vs: sum(ys(v).sum(1) for v in vs), S, "v"), EPS)
    H = np.repeat((total / K)[:, None], K, 1)
    for s in range(S):
        H[s] += total[s] * np.bincount(motifs[s] - 1, minlength=K) / D
    for _ in range(iters):

        def up(fs: list[bytes], vs: list[bytes], H=H) -> np.ndarray:
            return sum(((ys(v) / (H @ block(raw) + EPS)) @ block(raw).T).ravel() for raw, v in zip(fs, vs, strict=True))

        H = np.maximum(H * totals(pooled, up, S * K, "f", "v").reshape(S, K), EPS)
    share = H / np.maximum(H.sum(1, keepdims=True), EPS)
    return np.array([fits.recycled(share[s], D, min_share) for s in range(S)])
