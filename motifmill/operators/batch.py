"""Vectorised updates over a batch of samples in compressed sparse rows. Cells without counts contribute nothing but factor sums.

Cell matrices (a row a cell) lie column by column in memory: they have few columns, and numpy is slow along short rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..functions.special import np_digamma, np_inv_digamma, np_lgamma

EPS = 1e-12


@dataclass
class Batch:
    """n samples; row, m (0-based) and y of each positive cell, in row order; total of each row."""

    n: int
    row: np.ndarray
    m: np.ndarray
    y: np.ndarray
    total: np.ndarray

    def by_row(self, v: np.ndarray) -> np.ndarray:
        """Sums of a cell vector (or of each column of a cell matrix) by row."""
        if v.ndim == 1:
            return np.bincount(self.row, v, self.n)
        return np.column_stack([np.bincount(self.row, v[:, k], self.n) for k in range(v.shape[1])]).reshape(self.n, v.shape[1])

    def by_feature(self, v: np.ndarray, M: int) -> np.ndarray:
        """Columns of a cell matrix summed by feature: (columns, M)."""
        return np.stack([np.bincount(self.m, v[:, k], M) for k in range(v.shape[1])])


def softmax(x: np.ndarray, eps: float = 0.0) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / np.maximum(e.sum(-1, keepdims=True), eps)


def log_sum_exp(x: np.ndarray) -> np.ndarray:
    top = x.max(-1)
    return top + np.log(np.exp(x - top[..., None]).sum(-1))


def xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.where(x > 0, x, 1.0)), 0.0)


def gamma_kl(a: np.ndarray, l: np.ndarray, a0: np.ndarray, l0: np.ndarray) -> np.ndarray:  # noqa: E741
    """KL divergence of Gamma(a, rate l) from Gamma(a0, rate l0)."""
    return (a - a0) * np_digamma(a) + a0 * (np.log(l) - np.log(l0)) - np_lgamma(a) + np_lgamma(a0) - (l - l0) * a / l


# Poisson NMF by multiplicative updates.


def nmf_loadings(b: Batch, L: np.ndarray, F: np.ndarray) -> np.ndarray:
    at = F.take(b.m, 1).T
    ratio = b.y / ((L.T.take(b.row, 1).T * at).sum(1) + EPS)
    return np.maximum(L * b.by_row(ratio[:, None] * at) / F.sum(1), EPS)


def nmf_factor_stats(b: Batch, L: np.ndarray, F: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """K x M numerator and K sums for the factor update; the deviance part Σ (y ln(y/rate) - y + rate) at the current state."""
    own = L.T.take(b.row, 1).T
    rate = (own * F.take(b.m, 1).T).sum(1) + EPS
    A = b.by_feature(own * (b.y / rate)[:, None], F.shape[1])
    deviance = float((b.y * np.log(b.y / rate) - b.y).sum() + (L @ F.sum(1)).sum())
    return A, L.sum(0), deviance


# Sum-of-single-effects Poisson factors, all effects of all samples.


@dataclass
class Effects:
    """gamma, alpha, rate: n x D x K; alpha0, rate0: n x D."""

    gamma: np.ndarray
    alpha: np.ndarray
    rate: np.ndarray
    alpha0: np.ndarray
    rate0: np.ndarray

    @staticmethod
    def width(D: int, K: int) -> int:
        return 3 * D * K + 2 * D

    def flat(self) -> np.ndarray:
        n = len(self.gamma)
        return np.hstack([x.reshape(n, -1) for x in (self.gamma, self.alpha, self.rate, self.alpha0, self.rate0)])

    @classmethod
    def of(cls, flat: np.ndarray, D: int, K: int) -> Effects:
        n, w = len(flat), D * K
        g, a, r = (flat[:, k * w : (k + 1) * w].reshape(n, D, K).copy() for k in range(3))
        return cls(g, a, r, flat[:, 3 * w : 3 * w + D].copy(), flat[:, 3 * w + D :].copy())

    def expected_log(self) -> np.ndarray:
        return (self.gamma * (np_digamma(self.alpha) - np.log(self.rate))).sum(2)


def effect_logs(b: Batch, e: Effects, log_f: np.ndarray, effects: slice = slice(None)) -> np.ndarray:
    """The expected log factor of the effects at each cell, a row an effect."""
    gamma = e.gamma[:, effects]
    out = np.zeros((gamma.shape[1], len(b.y)))
    for k, at in enumerate(log_f.take(b.m, 1)):
        for d in range(len(out)):
            out[d] += gamma[:, d, k].take(b.row) * at
    return out


def effect_shares(b: Batch, e: Effects, log_f: np.ndarray, logs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """xi (cells x D) and the expected log factor of each effect at each cell (logs: as known from effect_logs)."""
    elf = effect_logs(b, e, log_f) if logs is None else logs
    return softmax((elf + e.expected_log().T.take(b.row, 1)).T), elf.T


def merge_equal(gamma: np.ndarray, tol: float, closest: bool = False) -> np.ndarray:
    """Effects of a sample with (nearly) the same distribution become one and a uniform one, again and again.

    Pairs go in the order of their slots, or the closest first.
    """
    n, D, K = gamma.shape
    g = gamma.copy()
    active = np.sqrt(((g - 1 / K) ** 2).sum(2)) > tol
    while True:
        merged = False
        if closest:
            d = np.sqrt(((g[:, :, None] - g[:, None]) ** 2).sum(3))
            usable = active[:, :, None] & active[:, None] & ~np.eye(D, dtype=bool)
            d = np.where(usable, d, np.inf).reshape(n, -1)
            # Column-major order of the distance matrix decides between equal pairs.
            order = np.arange(D * D).reshape(D, D).T.ravel()
            first = order[np.argmin(d[:, order], 1)]
            rows = np.flatnonzero(d[np.arange(n), first] < tol)
            if len(rows):
                d1, d2 = first[rows] // D, first[rows] % D
                g[rows, d1] = (g[rows, d1] + g[rows, d2]) / 2
                g[rows, d2] = 1 / K
                active[rows, d2] = False
                merged = True
        else:
            for d1 in range(D - 1):
                for d2 in range(d1 + 1, D):
                    near = np.sqrt(((g[:, d1] - g[:, d2]) ** 2).sum(1)) < tol
                    rows = np.flatnonzero(near & active[:, d1] & active[:, d2])
                    if len(rows):
                        g[rows, d1] = (g[rows, d1] + g[rows, d2]) / 2
                        g[rows, d2] = 1 / K
                        active[rows, d2] = False
                        merged = True
        if not merged:
            return g


def effect_counts(b: Batch, e: Effects, log_f: np.ndarray, d: int, logs: np.ndarray | None = None) -> np.ndarray:
    """What effect d gets from each sample's cells, n x (1 + K): its counts, and the same times each factor's log. Adds up over parts of the features."""
    got = effect_shares(b, e, log_f, logs)[0][:, d] * b.y
    return np.column_stack([b.by_row(got), b.by_row((got * log_f.take(b.m, 1)).T)])


def effect_update(e: Effects, d: int, counts: np.ndarray, f_sum: np.ndarray, rho: float, update_prior: bool, rate_first: bool = False) -> None:
    """Effect d of all samples in place, from effect_counts of all features."""
    a = counts[:, 0] + e.alpha0[:, d]
    e.alpha[:, d] = a[:, None]
    e.rate[:, d] = e.rate0[:, d, None] + f_sum
    score = counts[:, 1:] - a[:, None] * np.log(e.rate[:, d])
    e.gamma[:, d] = (1 - rho) * e.gamma[:, d] + rho * softmax(score)
    if update_prior:
        mean = (e.gamma[:, d] * e.alpha[:, d] / e.rate[:, d]).sum(1)
        mean_log = (e.gamma[:, d] * (np_digamma(e.alpha[:, d]) - np.log(e.rate[:, d]))).sum(1)
        if rate_first:
            e.rate0[:, d] = e.alpha0[:, d] / mean
        e.alpha0[:, d] = np_inv_digamma(mean_log + np.log(e.rate0[:, d]))
        if not rate_first:
            e.rate0[:, d] = e.alpha0[:, d] / mean


def effects_sweep(b: Batch, e: Effects, log_f: np.ndarray, f_sum: np.ndarray, rho: float, update_prior: bool, merge_tol: float | None = None, closest: bool = False, rate_first: bool = False) -> None:
    """One pass over the effects in place, each with freshly shared counts."""
    D = e.gamma.shape[1]
    if merge_tol is not None and D > 1:
        e.gamma = merge_equal(e.gamma, merge_tol, closest)
    logs = effect_logs(b, e, log_f)
    for d in range(D):
        effect_update(e, d, effect_counts(b, e, log_f, d, logs), f_sum, rho, update_prior, rate_first)
        logs[d] = effect_logs(b, e, log_f, slice(d, d + 1))[0]


def effects_factor_stats(b: Batch, e: Effects, log_f: np.ndarray) -> np.ndarray:
    """K x M expected counts of each factor."""
    xi, _ = effect_shares(b, e, log_f)
    got = xi.T * b.y
    weight = [sum(got[d] * e.gamma[:, d, k].take(b.row) for d in range(len(got))) for k in range(len(log_f))]
    return b.by_feature(np.array(weight).T, log_f.shape[1])


def effects_cells(b: Batch, e: Effects, log_f: np.ndarray) -> np.ndarray:
    """The bound's part that comes from each sample's cells; adds up over parts of the features."""
    xi, elf = effect_shares(b, e, log_f)
    got = xi * b.y[:, None]
    return b.by_row((got * (elf + e.expected_log().T.take(b.row, 1).T)).sum(1) - (xlogx(xi) * b.y[:, None]).sum(1))


def effects_bound_of(cells: np.ndarray, e: Effects, f_sum: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Evidence bound of each sample from effects_cells of all features, and the part of it that is minus the KL terms."""
    K = e.gamma.shape[2]
    fit = cells - (e.gamma * e.alpha / e.rate * f_sum).sum((1, 2))
    kl = xlogx(e.gamma).sum((1, 2)) + e.gamma.shape[1] * np.log(K)
    kl = kl + (e.gamma * gamma_kl(e.alpha, e.rate, e.alpha0[:, :, None], e.rate0[:, :, None])).sum((1, 2))
    return fit - kl, -kl


def effects_bound(b: Batch, e: Effects, log_f: np.ndarray, f_sum: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return effects_bound_of(effects_cells(b, e, log_f), e, f_sum)


# Mixtures of motifs. A component's factors are log_g (S x D x M), its exposure f (S x D).


@dataclass
class Motifs:
    log_g: np.ndarray
    exposure: np.ndarray  # expected factor sum of each slot
    log_scale: np.ndarray
    alpha0: np.ndarray
    rate0: np.ndarray
    scale: np.ndarray

    @property
    def rate(self) -> np.ndarray:
        return self.rate0 + self.scale * self.exposure


def slot_logs(b: Batch, p: Motifs, s: int) -> np.ndarray:
    """The expected log factor of component s at each cell (cells x D)."""
    return p.log_g[s].take(b.m, 1).T


def slot_shares(b: Batch, alpha: np.ndarray, p: Motifs, s: int, elf: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """xi (cells x D), the expected log factor at each cell (elf, if known), the expected log loading of each sample."""
    elf = slot_logs(b, p, s) if elf is None else elf
    mean_log = np_digamma(alpha) - np.log(p.rate[s])
    return softmax(elf + mean_log.T.take(b.row, 1).T + p.log_scale[s], EPS), elf, mean_log


def slot_counts(b: Batch, alpha: np.ndarray, p: Motifs, s: int, elf: np.ndarray | None = None) -> np.ndarray:
    return b.by_row(slot_shares(b, alpha, p, s, elf)[0] * b.y[:, None])


def slot_cells(b: Batch, xi: np.ndarray, elf: np.ndarray) -> np.ndarray:
    """The bound's part that comes from each sample's cells, but for the expected log loadings; adds up over parts of the features."""
    return b.by_row((xi * b.y[:, None] * elf).sum(1) - (b.y[:, None] * xi * np.log(np.maximum(xi, EPS))).sum(1))


def slot_bound_of(cells: np.ndarray, got: np.ndarray, alpha: np.ndarray, p: Motifs, s: int) -> np.ndarray:
    """Bound of each sample under component s from its cells' part and its counts by slot, of all features."""
    rate = p.rate[s]
    out = cells + ((np_digamma(alpha) - np.log(rate)) * got).sum(1)
    return out - (alpha / rate * p.scale[s] * p.exposure[s]).sum(1) - gamma_kl(alpha, rate, p.alpha0[s], p.rate0[s]).sum(1)


def slot_bound(b: Batch, xi: np.ndarray, elf: np.ndarray, alpha: np.ndarray, p: Motifs, s: int) -> np.ndarray:
    return slot_bound_of(slot_cells(b, xi, elf), b.by_row(xi * b.y[:, None]), alpha, p, s)


def soft_components(b: Batch, alpha: np.ndarray, p: Motifs, inner: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """alpha (n x S x D) after inner + 1 rounds from the given one, each component's bound, and its shares."""
    S = len(p.alpha0)
    bound, shares = np.zeros((b.n, S)), []
    alpha = alpha.copy()
    for s in range(S):
        elf = slot_logs(b, p, s)
        for _ in range(inner + 1):
            alpha[:, s] = p.alpha0[s] + slot_counts(b, alpha[:, s], p, s, elf)
        xi, _, _ = slot_shares(b, alpha[:, s], p, s, elf)
        bound[:, s] = slot_bound(b, xi, elf, alpha[:, s], p, s)
        shares.append(xi)
    return alpha, bound, shares


def hard_components(b: Batch, p: Motifs, inner: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The same from the prior with exactly inner rounds; bounds use the last shares with the alpha that follows from them."""
    S, D = p.alpha0.shape
    bound, shares = np.zeros((b.n, S)), []
    alpha = np.zeros((b.n, S, D))
    for s in range(S):
        a = np.tile(p.alpha0[s], (b.n, 1))
        xi = np.full((D, len(b.y)), 1 / D).T
        elf = slot_logs(b, p, s)
        for _ in range(inner):
            xi, _, _ = slot_shares(b, a, p, s, elf)
            a = p.alpha0[s] + b.by_row(xi * b.y[:, None])
        alpha[:, s] = a
        bound[:, s] = slot_bound(b, xi, elf, a, p, s)
        shares.append(xi)
    return alpha, bound, shares


def mixture_stats(b: Batch, omega: np.ndarray, alpha: np.ndarray, shares: list[np.ndarray], p: Motifs, M: int) -> dict[str, np.ndarray]:
    """Weighted sums that the global updates need."""
    S = omega.shape[1]
    w = omega[:, :, None]
    C = np.stack([b.by_feature(shares[s] * (b.y * omega[:, s].take(b.row))[:, None], M) for s in range(S)])
    return {"weight": omega.sum(0), "mean": (w * alpha / p.rate).sum(0), "mean_log": (w * (np_digamma(alpha) - np.log(p.rate))).sum(0), "C": C}
