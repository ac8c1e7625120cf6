import numpy as np
import pytest
from pyspark.sql import functions as F

from motifmill.operators import batch as B
from motifmill.operators import fits
from motifmill.operators import longform as L
from motifmill.plans.journal import Journal
from motifmill.sources import counts as C

K, S, D, M = 3, 2, 2, 9


class Killed(Exception):
    pass


@pytest.fixture(scope="module")
def counts(spark):
    rng = np.random.default_rng(3)
    rows = [(i, f"f{m}", float(v)) for i in range(30) for m, v in enumerate(rng.poisson(2, M)) if v]
    return C.counts_from(spark.createDataFrame(rows, "i long, name string, y double"), "i", "name", "y")


GAMMA = np.random.default_rng(2).dirichlet(np.ones(K), (S, D))
START = fits.hashed_init(K, M)[0]
FITS = {
    "nmf": lambda c, **kw: fits.poisson_nmf(c, K, 3, 1, **kw),
    "effects": lambda c, **kw: fits.mf_susie(c, K, D, 3, seed=1, nmf_iters=1, **kw),
    "soft": lambda c, **kw: fits.soft_mixture_fixed(c, START, GAMMA, 3, 1, update_F=True, **kw),
    "hard": lambda c, **kw: fits.hard_mixture_fixed(c, START, np.array([[1, 2], [3, 1]]), 3, 1, update_F=True, update_motifs=True, **kw),
}


@pytest.mark.parametrize("name", FITS)
def test_a_killed_fit_goes_on(spark, counts, monkeypatch, name):
    """Killed between two passes, begun again by name: the same factors, history and samples, and the passes before are not run again."""
    whole, passes = FITS[name](counts), []
    sweep = fits.sweep

    def until(n):
        def run(*args):
            if len(passes) == n:
                raise Killed
            passes.append(1)
            return sweep(*args)

        return run

    alive = 4 if name == "effects" else 2  # the effects' start takes two passes
    monkeypatch.setattr(fits, "sweep", until(alive))
    with pytest.raises(Killed):
        FITS[name](counts, resume=f"test-{name}")
    passes.clear()
    monkeypatch.setattr(fits, "sweep", until(99))
    again = FITS[name](counts, resume=f"test-{name}")
    assert len(passes) == 2  # the pass that was lost, and the last one
    assert np.array_equal(again.factors, whole.factors) and again.elbo == whole.elbo
    assert sorted(map(tuple, again.samples.select("i", "state").collect())) == sorted(map(tuple, whole.samples.select("i", "state").collect()))
    # Once more after the end: only what comes after the logged passes.
    passes.clear()
    assert np.array_equal(FITS[name](counts, resume=f"test-{name}").factors, whole.factors) and len(passes) == 1
    log = Journal(spark, f"test-{name}")
    log.forget()
    assert log.last() is None


def test_a_name_belongs_to_one_fit(spark, counts):
    fits.poisson_nmf(counts, 2, 1, 1, resume="test-mine")
    with pytest.raises(ValueError, match="other data or options"):
        fits.poisson_nmf(counts, 3, 1, 1, resume="test-mine")
    Journal(spark, "test-mine").forget()


@pytest.mark.parametrize("closest", [False, True])
@pytest.mark.parametrize("slots", [2, 4, 5])
def test_merged_effects_equal_the_kernel(spark, closest, slots):
    rng = np.random.default_rng([slots, closest])
    g = rng.dirichlet(np.ones(K) * 3, (60, 1)) + rng.normal(0, 0.05, (60, slots, K))
    g = np.abs(g) / np.abs(g).sum(2, keepdims=True)
    g[::7, 0] = 1 / K  # not active
    g[1::7, 1] = g[1::7, 0]
    rows = [(i, d + 1, k + 1, float(p)) for (i, d, k), p in np.ndenumerate(g)]
    df = spark.createDataFrame(rows, "i long, d int, k int, p double").repartition(3)
    got = L.merged(df, K, slots, 0.12, closest).toPandas().sort_values(["i", "d", "k"]).p.to_numpy().reshape(g.shape)
    want = B.merge_equal(g, 0.12, closest)
    assert np.allclose(got, want) and not np.allclose(want, g)
    assert df.where(F.lit(False)).count() == 0 and L.merged(df.limit(0), K, slots, 0.12, closest).count() == 0


def test_seeds_side_by_side_equal_single_runs(counts, monkeypatch):
    """Three fits in as many passes as one."""
    passes, sweep = [], fits.sweep
    monkeypatch.setattr(fits, "sweep", lambda *a: passes.append(1) or sweep(*a))
    seeds = [1, 2, 5]
    together = fits.poisson_nmf_seeds(counts, K, 3, seeds)
    assert len(passes) == 4
    for s in seeds:
        one = fits.poisson_nmf(counts, K, 3, s)
        assert np.allclose(together[s].factors, one.factors, rtol=1e-12) and np.allclose([v for _, v in together[s].elbo], [v for _, v in one.elbo])
        key = ["i", "k"]
        a, b = (x.loadings_df().toPandas().sort_values(key).l.to_numpy() for x in (together[s], one))
        assert np.allclose(a, b, rtol=1e-9)
