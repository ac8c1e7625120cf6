"""Fits by blocks of features give what the fits with all factors on the driver give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifmill.operators import blocked, fits
from motifmill.plans import blocks
from motifmill.sources import counts as C

K, S, D, M, N = 3, 2, 2, 23, 40
CUT = {"size": 5, "pieces": 7}


@pytest.fixture(scope="module")
def counts(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), f"f{m:02d}", float(v)) for i in range(N) for m, v in enumerate(rng.poisson(rng.gamma(0.3, 3, M))) if v]
    df = spark.createDataFrame(rows, "i long, name string, y double")
    names = spark.createDataFrame([(f"f{m:02d}",) for m in range(M + 2)], "name string")  # two without counts
    ids = spark.range(N + 3).select(F.col("id").alias("i"))  # three without counts
    return C.counts_from(df, "i", "name", "y", features=names, samples=ids)


def table(df):
    x = df.toPandas().sort_values(["k", "m"])
    return x.f.to_numpy().reshape(K, -1)


def frame(spark, f):
    return fits._long(spark, f, ("k", "m"), "f")


def cells(df, *keys):
    return df.toPandas().sort_values(list(keys)).drop(columns=[]).to_numpy(float)


@pytest.mark.parametrize("seed", [None, 4])
def test_nmf(counts, seed):
    a, b = fits.poisson_nmf(counts, K, 3, seed), blocked.poisson_nmf(counts, K, 3, seed, **CUT)
    assert table(b.factors_df()) == pytest.approx(a.factors, rel=1e-9)
    assert cells(b.loadings_df(), "i", "k") == pytest.approx(cells(a.loadings_df(), "i", "k"), rel=1e-9)
    assert [v for _, v in b.elbo] == pytest.approx([v for _, v in a.elbo], rel=1e-9)


def test_effects(spark, counts):
    start = fits.hashed_init(K, counts.n_features())[0]
    options = {"max_iters": 2, "init": "given", "given": lambda ids: fits.hashed_effects(ids, D, K), "gamma_step_init": 0.5, "F_step_init": 0.3, "break_symmetry": True}
    a = fits.mf_susie(counts, K, D, factors=start, **options)
    b = blocked.mf_susie(counts, K, D, factors=blocks.factors_from(frame(spark, start), K, CUT["size"], 1e-12), **options, **CUT)
    assert table(b.factors_df()) == pytest.approx(a.factors, rel=1e-8)
    assert cells(b.effects_df(), "i", "d", "k") == pytest.approx(cells(a.effects_df(), "i", "d", "k"), rel=1e-7)
    assert [v for _, v in b.elbo] == pytest.approx([v for _, v in a.elbo], rel=1e-9)


def test_effects_from_nmf(counts):
    a, b = (fit(counts, K, D, 1, seed=2, nmf_iters=2, **more) for fit, more in ((fits.mf_susie, {}), (blocked.mf_susie, CUT)))
    assert table(b.factors_df()) == pytest.approx(a.factors, rel=1e-8)


def test_soft_mixture(spark, counts):
    start = fits.hashed_init(K, counts.n_features())[0]
    gamma = np.random.default_rng(1).dirichlet(np.ones(K), (S, D))
    options = {"max_iters": 2, "n_inner": 1, "update_F": True, "update_slot_scale": True}
    a = fits.soft_mixture_fixed(counts, start, gamma, **options)
    b = blocked.soft_mixture_fixed(counts, frame(spark, start), gamma, **options, **CUT)
    assert table(b.factors_df()) == pytest.approx(a.factors, rel=1e-8)
    for x, y in ((b.gamma, a.gamma), (b.pi, a.pi), (b.alpha0, a.alpha0), (b.rate0, a.rate0), (b.scale, a.scale), (b.beta_mean, a.beta_mean)):
        assert x == pytest.approx(y, rel=1e-7)
    assert [v for _, v in b.elbo] == pytest.approx([v for _, v in a.elbo], rel=1e-9)
    assert cells(b.responsibilities_df(), "i", "s") == pytest.approx(cells(a.responsibilities_df(), "i", "s"), rel=1e-6, abs=1e-9)


def test_hard_mixture(spark, counts):
    start = fits.hashed_init(K, counts.n_features())[0]
    motifs = np.array([[1, 2], [3, 1]])
    options = {"max_iters": 2, "n_inner": 2, "update_F": True, "update_motifs": True, "motif_loading_iters": 2, "F_step_init": 0.2, "F_step_ramp": 20}
    a = fits.hard_mixture_fixed(counts, start, motifs, **options)
    b = blocked.hard_mixture_fixed(counts, frame(spark, start), motifs, K=K, **options, **CUT)
    assert table(b.factors_df()) == pytest.approx(a.factors, rel=1e-8)
    assert (b.motifs == a.motifs).all() and b.pi == pytest.approx(a.pi, rel=1e-8) and b.alpha0 == pytest.approx(a.alpha0, rel=1e-7)
    assert [v for _, v in b.elbo] == pytest.approx([v for _, v in a.elbo], rel=1e-9)


def test_pieces_and_slices(counts):
    b = blocks.cut(counts, 5, 7)
    assert b.M == M + 2 and b.pieces.select(F.max(F.size("mi"))).first()[0] <= 5
    n = {r.blk: r["count"] for r in b.pieces.groupBy("blk").count().collect()}
    assert {r.blk: r.n for r in b.slices.collect()} == {blk: -(-c // 7) for blk, c in n.items()}


def test_pieces_carry_only_what_the_kernel_takes(spark):
    """The kernel gets the columns taken; a sample's parts are added up over any number of batches, samples without parts stay."""
    cells = [(i, m, float(i + m)) for i in (1, 2, 3) for m in range(1, 13)]
    c = C.counts_from(spark.createDataFrame(cells, "i long, m int, y double"), "i", "m", "y", samples=spark.createDataFrame([(4,), (1,)], "i long"))
    b = blocks.cut(c, 2, 2)
    state = blocks.first_state(b.samples.union(spark.createDataFrame([(4, 0.0)], "i long, total double")).dropDuplicates(["i"]), lambda ids, total: np.arange(5.0) + 10 * ids[:, None])
    f = blocks.factors_by(spark, b.M, 1, 2, lambda m: np.ones((1, len(m))))
    met = b.meet(state, 5, f, lambda c, st, f: (np.hstack([st, c.by_row(c.y[:, None])]), None), [(0, 1), (3, 5)])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for rows in ("2", "3", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            out = b.update(state, 5, met, 4, lambda ids, total, st, got: np.hstack([st, got])).toPandas().set_index("i")
            for i, raw in out.state.items():
                n = 6 if i in (1, 2, 3) and i in {x[0] for x in cells} and out.total[i] > 0 else 0
                want = [10 * i + k for k in range(5)] + [n * (10 * i + k) for k in (0, 3, 4)] + [sum(y for j, _, y in cells if j == i) if n else 0]
                assert np.frombuffer(raw).tolist() == pytest.approx(want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
