"""Sparse kernels against dense re-derivations from the formulas."""

import numpy as np
import pytest

from motifmill.functions.special import np_digamma, np_lgamma
from motifmill.operators import batch as B


def dense(n, M, seed, rate=0.7):
    rng = np.random.default_rng(seed)
    Y = rng.poisson(rate, (n, M)).astype(float)
    Y[0] = 0  # a sample without counts
    Y[:, 1] = 0  # and a feature
    row, m = np.nonzero(Y)
    return Y, B.Batch(n, row, m, Y[row, m], Y.sum(1))


def factors(K, M, seed):
    f = np.random.default_rng(seed).gamma(0.5, 1, (K, M)) + 1e-9
    return f / f.sum(1, keepdims=True)


def test_nmf_step():
    Y, b = dense(9, 12, 1)
    F = factors(3, 12, 2)
    L = np.random.default_rng(3).gamma(1, 1, (9, 3))
    R = L @ F + B.EPS
    want = np.maximum(L * ((Y / R) @ F.T) / F.sum(1), B.EPS)
    got = B.nmf_loadings(b, L, F)
    assert np.allclose(got, want, rtol=1e-9)
    A, total, dev = B.nmf_factor_stats(b, got, F)
    R = got @ F + B.EPS
    assert np.allclose(A, got.T @ (Y / R), rtol=1e-9) and np.allclose(total, got.sum(0))
    ok = Y > 0
    assert dev == pytest.approx((Y[ok] * np.log(Y[ok] / R[ok])).sum() - Y.sum() + (got @ F).sum())


def effects(n, D, K, seed):
    rng = np.random.default_rng(seed)
    g = rng.gamma(1, 1, (n, D, K))
    return B.Effects(g / g.sum(2, keepdims=True), rng.gamma(2, 1, (n, D, K)), rng.gamma(2, 1, (n, D, K)) + 0.5, np.ones((n, D)), np.ones((n, D)))


def dense_xi(e, F, n, M):
    g = e.gamma @ np.log(F) + (e.gamma * (np_digamma(e.alpha) - np.log(e.rate))).sum(2)[:, :, None]
    x = np.exp(g - g.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


@pytest.mark.parametrize("D,K", [(1, 3), (3, 3), (4, 2), (2, 1)])
def test_effects_bound_and_factor_sums(D, K):
    n, M = 7, 10
    Y, b = dense(n, M, 4)
    F, e = factors(K, M, 5), effects(n, D, K, 6)
    xi = dense_xi(e, F, n, M)
    fit = (xi * Y[:, None]).sum(2) * (e.gamma * (np_digamma(e.alpha) - np.log(e.rate))).sum(2)
    fit = fit.sum(1) + (xi * Y[:, None] * (e.gamma @ np.log(F))).sum((1, 2)) - (e.gamma * e.alpha / e.rate * F.sum(1)).sum((1, 2)) - (Y[:, None] * xi * np.log(xi)).sum((1, 2))
    kl = (e.gamma * np.log(e.gamma)).sum((1, 2)) + D * np.log(K)
    a, l, a0, l0 = e.alpha, e.rate, 1.0, 1.0  # noqa: E741
    kl += (e.gamma * ((a - a0) * np_digamma(a) + a0 * (np.log(l) - np.log(l0)) - np_lgamma(a) + np_lgamma(np.array(a0)) - (l - l0) * a / l)).sum((1, 2))
    bound, minus_kl = B.effects_bound(b, e, np.log(F), F.sum(1))
    assert np.allclose(bound, fit - kl, rtol=1e-8) and np.allclose(minus_kl, -kl, rtol=1e-8)
    assert np.allclose(B.effects_factor_stats(b, e, np.log(F)), np.einsum("ndk,ndm,nm->km", e.gamma, xi, Y), rtol=1e-8)


def test_sweep_raises_the_bound():
    Y, b = dense(12, 15, 7, 3.0)
    F, e = factors(3, 15, 8), effects(12, 2, 3, 9)
    e.rate = np.tile(1 + F.sum(1), (12, 2, 1))
    last = -np.inf
    for _ in range(15):
        B.effects_sweep(b, e, np.log(F), F.sum(1), 1.0, False)
        now = B.effects_bound(b, e, np.log(F), F.sum(1))[0].sum()
        assert now >= last - 1e-8
        last = now


def test_merge_in_order_and_closest_first():
    g = np.array([[[0.8, 0.1, 0.1], [0.8, 0.1, 0.1], [0.1, 0.8, 0.1]]])
    # The closest pair is found in column-major order, so there the later slot takes over.
    for closest, stays, goes in ((False, 0, 1), (True, 1, 0)):
        out = B.merge_equal(g, 1e-4, closest)
        assert np.allclose(out[0, stays], [0.8, 0.1, 0.1]) and np.allclose(out[0, goes], 1 / 3) and np.allclose(out[0, 2], g[0, 2])


def motifs(S, D, M, seed):
    rng = np.random.default_rng(seed)
    F = factors(4, M, seed)
    g = rng.gamma(1, 1, (S, D, 4))
    g /= g.sum(2, keepdims=True)
    scale = rng.uniform(0.5, 2, (S, D))
    return B.Motifs(g @ np.log(F), g @ F.sum(1), np.log(scale), rng.uniform(0.5, 2, (S, D)), rng.uniform(0.5, 2, (S, D)), scale)


def test_soft_components_against_dense():
    n, M, S, D = 6, 9, 3, 2
    Y, b = dense(n, M, 11)
    p = motifs(S, D, M, 12)
    alpha = np.random.default_rng(13).gamma(2, 1, (n, S, D))

    def shares(a, s):
        z = p.log_scale[s][:, None] + (np_digamma(a) - np.log(p.rate[s]))[:, :, None] + p.log_g[s]
        x = np.exp(z - z.max(1, keepdims=True))
        return x / x.sum(1, keepdims=True)

    got, bound, _ = B.soft_components(b, alpha, p, 1)
    for s in range(S):
        a = alpha[:, s]
        for _ in range(2):
            a = p.alpha0[s] + (shares(a, s) * Y[:, None]).sum(2)
        assert np.allclose(got[:, s], a, rtol=1e-9)
        x = shares(a, s)
        ml = np_digamma(a) - np.log(p.rate[s])
        want = ((x * Y[:, None]).sum(2) * ml).sum(1) + (x * Y[:, None] * p.log_g[s]).sum((1, 2)) - (Y[:, None] * x * np.log(x)).sum((1, 2)) - (a / p.rate[s] * p.scale[s] * p.exposure[s]).sum(1)
        want -= B.gamma_kl(a, p.rate[s], p.alpha0[s], p.rate0[s]).sum(1)
        assert np.allclose(bound[:, s], want, rtol=1e-8)


def test_sums_are_conserved():
    n, M, S, D = 8, 11, 2, 3
    Y, b = dense(n, M, 14)
    p = motifs(S, D, M, 15)
    alpha, _, shares = B.soft_components(b, np.ones((n, S, D)), p, 2)
    for s in range(S):
        assert np.allclose((B.slot_counts(b, alpha[:, s], p, s)).sum(1), Y.sum(1))
    omega = B.softmax(np.random.default_rng(16).normal(size=(n, S)))
    assert B.mixture_stats(b, omega, alpha, shares, p, M)["C"].sum() == pytest.approx(Y.sum())


def test_equal_slots_stay_equal():
    Y, b = dense(6, 8, 17)
    F = factors(3, 8, 18)
    log_g = np.log(F)[np.array([[0, 0, 2]])]
    p = B.Motifs(log_g, np.ones((1, 3)), np.zeros((1, 3)), np.ones((1, 3)), np.ones((1, 3)), np.ones((1, 3)))
    alpha, _, _ = B.soft_components(b, np.ones((6, 1, 3)), p, 4)
    assert np.allclose(alpha[:, 0, 0], alpha[:, 0, 1])
