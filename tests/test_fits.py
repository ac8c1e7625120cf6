import numpy as np
import pytest
from pyspark.sql import functions as F

from motifmill.operators import fits, matching
from motifmill.operators import summaries as S
from motifmill.operators.cluster import kmeans, motifs_from_scores
from motifmill.plans import benchmark
from motifmill.sources import counts as C
from motifmill.sources import simulate
from motifmill.streaming import scoring


@pytest.fixture(scope="module")
def block(spark):
    sim = simulate.block(spark, 160, 120, 101)
    for df in (sim.counts.counts, sim.truth):
        df.cache().count()
    return sim


def small(spark, rows, M, samples=None):
    """Counts from (i, m, y), with samples and features that may be empty."""
    counts = spark.createDataFrame(rows, "i long, m int, y double")
    features = spark.createDataFrame([(m, f"f{m}") for m in range(1, M + 1)], "m int, name string")
    ids = spark.createDataFrame([(i,) for i in samples or sorted({r[0] for r in rows})], "i long")
    totals = ids.join(counts.groupBy("i").agg(F.sum("y").alias("total")), "i", "left").fillna(0.0)
    return C.Counts(counts, features, totals)


def test_nmf_deviance_falls_and_rows_sum_to_one(block):
    fit = fits.poisson_nmf(block.counts, 5, 12, seed=2)
    gains = np.diff([v for _, v in fit.elbo])
    assert (gains >= -1e-6).all()
    assert np.allclose(fit.factors.sum(1), 1)
    rate = fit.loadings_df().agg(F.sum("l")).first()[0]
    assert rate == pytest.approx(block.counts.counts.agg(F.sum("y")).first()[0], rel=1e-6)


def test_same_result_under_any_partitioning(spark, block):
    other = C.Counts(block.counts.counts.repartition(7), block.counts.features, block.counts.samples.repartition(3))
    a, b = (fits.poisson_nmf(c, 4, 3, seed=5) for c in (block.counts, other))
    assert np.allclose(a.factors, b.factors, rtol=1e-9)
    x, y = (fits.soft_mixture_fixed(c, a.factors, fits.peaked_gamma(np.array([[1, 2], [3, 4]]), 4, 0.05), 2, 1, update_F=True) for c in (block.counts, other))
    assert np.allclose(x.gamma, y.gamma, rtol=1e-8) and np.allclose(x.factors, y.factors, rtol=1e-8)


def test_effects_with_true_factors_recover_supports(block):
    fit = fits.mf_susie_fixed(block.counts, block.factors, 3, 40, seed=1)
    labels = S.support_labels(S.loading_scores(fit.effects_df()), block.truth)
    assert S.support_accuracy(labels, block.truth).first()["support_accuracy"] > 0.85
    assert [t for t, _ in fit.elbo] == list(range(1, 41))


def test_stop_rule_reruns_fewer_iterations(block):
    fit = fits.mf_susie_fixed(block.counts, block.factors, 3, 60, seed=1, gamma_step_init=1.0, gamma_step_ramp=1, update_prior=False, tol=1e-3, min_iters=5, patience=2)
    assert fit.converged and fit.n_iter < 60 and fit.elbo[-1][0] == fit.n_iter
    same = fits.mf_susie_fixed(block.counts, block.factors, 3, fit.n_iter, seed=1, gamma_step_init=1.0, gamma_step_ramp=1, update_prior=False)
    a, b = (f.effects_df().orderBy("i", "d", "k").toPandas().p.to_numpy() for f in (fit, same))
    assert np.allclose(a, b)


def test_learned_effects(block):
    fit = fits.mf_susie(block.counts, 5, 3, 6, seed=1, nmf_iters=15)
    assert len(fit.elbo) == 6 and fit.elbo[-1][1] > fit.elbo[0][1]
    e = fit.effects_df().groupBy("i", "d").agg(F.sum("p").alias("p"))
    assert e.agg(F.max(F.abs(F.col("p") - 1))).first()[0] < 1e-9
    assert np.mean(matching.match_factors(fit.factors, block.factors).cosines) > 0.8
    assert fits.mf_susie(block.counts, 5, 2, 2, seed=1, init="random").factors.shape == (5, 120)


def test_effects_stop_keeps_the_state_it_stopped_at(block):
    fit = fits.mf_susie(block.counts, 5, 2, 30, seed=1, nmf_iters=10, tol=0.5, min_iters=3, patience=1)
    assert fit.converged and fit.n_iter == 3 and fit.elbo[-1][0] == 3
    same = fits.mf_susie(block.counts, 5, 2, 3, seed=1, nmf_iters=10)
    assert np.allclose(fit.factors, same.factors)
    a, b = (f.effects_df().orderBy("i", "d", "k").toPandas().p.to_numpy() for f in (fit, same))
    assert np.allclose(a, b)


def test_soft_mixture_recovers_planted_groups(block):
    motifs = np.array([(list(s) * 3)[:3] for s in block.supports])
    fit = fits.soft_mixture_fixed(block.counts, block.factors, fits.peaked_gamma(motifs, 5, 0.05), 8, 3)
    z = S.max_responsibility(fit.responsibilities_df()).select("i", F.col("z_hat").alias("z"))
    assert matching.cluster_accuracy(z.join(block.truth, "i")) > 0.7
    assert fit.pi.sum() == pytest.approx(1) and np.allclose(fit.gamma.sum(2), 1)
    assert fit.C.sum() == pytest.approx(block.counts.counts.agg(F.sum("y")).first()[0])
    activity = S.slot_activity(fit.beta_df(), fit.motifs_df(), fit.priors_df())
    assert activity.count() == 24 and S.dimension_selection(S.flagged_slots(activity)).count() == 8


def test_slot_scale_and_whole_ladder(block):
    fit = fits.soft_mixture(block.counts, 5, 8, 3, 3, 2, 4, 8, seed=1, update_slot_scale=True, surplus_slots="uniform")
    assert fit.scale.min() >= 1e-3 and fit.mf_fit is not None and len(fit.history) == fit.n_iter
    with pytest.raises(ValueError):
        fits.soft_mixture(block.counts, 5, 8, 3, surplus_slots="other")


def test_hard_mixture_with_true_motifs(block):
    motifs = np.array([(list(s) * 3)[:3] for s in block.supports])
    fit = fits.hard_mixture_fixed(block.counts, block.factors, motifs, 6, 6)
    z = S.max_responsibility(fit.responsibilities_df()).select("i", F.col("z_hat").alias("z"))
    assert matching.cluster_accuracy(z.join(block.truth, "i")) > 0.7
    assert fit.elbo[-1][1] >= fit.elbo[0][1]
    learned = fits.hard_mixture(block.counts, 5, 8, 3, 3, 3, 3, 8, seed=1)
    assert learned.motifs.shape == (8, 3) and learned.hard_motifs_df().count() == 24


def test_single_vector_splits_over_duplicate_factors(spark):
    sim = simulate.duplicate_vector(spark, 400)
    fit = fits.poisson_susie(sim.counts, sim.factors, 5, 60, seed=3)
    e = fit.effects_df().toPandas()
    tied = e.pivot(index="d", columns="k", values="p")
    assert np.allclose(tied[1], tied[11])
    assert (tied[1] + tied[11]).max() > 0.9
    assert fit.elbo_without_kl[-1][1] > fit.elbo[-1][1]


@pytest.mark.parametrize("D,K", [(1, 2), (3, 2), (2, 1)])
def test_edges(spark, D, K):
    """A sample and a feature without counts, one slot, more slots than factors, one factor."""
    c = small(spark, [(1, 1, 3.0), (1, 3, 1.0), (2, 3, 4.0), (2, 4, 2.0)], 5, [1, 2, 3])
    nmf = fits.poisson_nmf(c, K, 3, 1)
    assert nmf.loadings_df().count() == 3 * K and (nmf.factors > 0).all()
    mf = fits.mf_susie(c, K, D, 2, seed=1, nmf_iters=2, break_symmetry=True)
    assert mf.effects_df().count() == 3 * D * K and np.isfinite(mf.factors).all()
    soft = fits.soft_mixture(c, K, 2, D, 2, 1, 2, 2, seed=1)
    assert soft.responsibilities_df().count() == 6 and np.isfinite(soft.gamma).all()
    hard = fits.hard_mixture(c, K, 2, D, 2, 1, 2, 2, seed=1)
    assert hard.responsibilities_df().where("w is null or isnan(w)").count() == 0
    one = fits.poisson_susie(small(spark, [(1, 1, 2.0)], 3), np.ones((K, 3)) / 3, D, 3)
    assert one.effects_df().count() == D * K


def test_kmeans_and_motifs(spark):
    rows = [(i, [1.0, 0.0, 0.0] if i % 2 else [0.0, 3.0, 1.0]) for i in range(1, 21)]
    df = spark.createDataFrame(rows, "i long, scores array<double>")
    centers, z = kmeans(df, 2, 1)
    assert len({r.z for r in z.where("i % 2 = 1").collect()}) == 1 and z.select("z").distinct().count() == 2
    m = {tuple(r) for r in motifs_from_scores(df, 2, 3, 1).tolist()}
    assert m == {(1, 1, 1), (2, 3, 2)}
    assert kmeans(df, 4, 1)[0].shape == (4, 3)  # more centres than distinct rows


def test_kmeans_has_every_row_at_any_size(spark):
    """One far row of 60,000; the result does not depend on partitions."""
    noise = "0.001 * (i % 7)"
    df = spark.range(60_000).selectExpr("id as i").selectExpr("i", f"if(i % 2 = 0, array(1D, {noise}, 0D), array({noise}, 1D, 0D)) as scores")
    far = df.selectExpr("max_by(i, pmod(xxhash64(i), 1 << 30))").first()[0]
    df = df.selectExpr("i", f"if(i = {far}, array(0D, 0D, 1D), transform(scores, x -> double(x))) as scores")
    centers, z = kmeans(df, 3, 1)
    alone = z.where(f"i = {far}").first().z
    assert z.where(f"z = {alone}").count() == 1 and np.allclose(centers[alone - 1], [0, 0, 1], atol=1e-9)
    few = df.where("i % 100 < 3").withColumn("scores", F.expr("transform(scores, (x, k) -> x + pmod(xxhash64(i, k), 1000) / 1500)"))
    assert np.allclose(kmeans(few, 4, 2)[0], kmeans(few.repartition(7), 4, 2)[0], atol=1e-9)


def test_kmeans_is_no_worse_than_plain_restarts(spark):
    from motifmill.operators import cluster

    rng = np.random.default_rng(8)
    x = np.concatenate([rng.dirichlet(a * 20 + 0.3, 60) for a in np.vstack([np.eye(4), np.full((1, 4), 0.25), [[0.5, 0.5, 0, 0]]])])
    df = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "i long, scores array<double>")
    best = np.inf
    for r in range(40):
        c = x[np.random.default_rng(r).choice(len(x), 6, replace=False)]
        for _ in range(50):
            z = cluster.assign(x, c)[0]
            c = np.stack([x[z == k].mean(0) if (z == k).any() else c[k] for k in range(6)])
        best = min(best, cluster.assign(x, c)[1].sum())
    centers, z = kmeans(df, 6, 3)
    assert cluster.assign(x, centers)[1].sum() <= best * (1 + 1e-9)
    got = z.toPandas().sort_values("i").z.to_numpy() - 1
    assert (got == ((x[:, None] - centers[None]) ** 2).sum(2).argmin(1)).all()


def test_streamed_scores_equal_batch(spark, block, tmp_path):
    fit = fits.soft_mixture_fixed(block.counts, block.factors, fits.peaked_gamma(np.array([[1, 2], [3, 4]]), 5, 0.05), 2, 2)
    packed = block.counts.packed()
    packed.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(scoring.PACKED).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = scoring.score_mixture(stream, fit).writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    q.awaitTermination()
    a = spark.table("scored").orderBy("i", "s").toPandas()
    b = scoring.score_mixture(packed, fit).orderBy("i", "s").toPandas()
    assert len(a) == 320 and np.allclose(a.w, b.w)
    effects = fits.mf_susie_fixed(block.counts, block.factors, 2, 3)
    assert scoring.score_effects(packed, effects, 2).count() == 160 * 5


def test_benchmark_rows(spark, block):
    rows = benchmark.run_seeds("block", lambda seed: block, (1, 2), 5, 8, 3, nmf_iters=5, mf_max_iters=2, mf_nmf_iters=5, mos_max_iters=2, mos_n_inner=1)
    out = {r.method: r for r in S.benchmark_summary(rows).collect()}
    assert set(out) == {"NMF and k-means", "effects and k-means", "soft motifs"}
    assert out["NMF and k-means"].mean_gamma_entropy_mean is None and out["soft motifs"].n_seed == 2
    one = S.benchmark_summary(rows.where("seed = 1")).first()
    assert one.cluster_accuracy_sd is None


def test_given_start_needs_factors_and_effects(spark):
    sim = simulate.block(spark, 16, 12, 3)
    with pytest.raises(ValueError):
        fits.mf_susie(sim.counts, 5, 2, 1, init="given")
    with pytest.raises(ValueError):
        fits.mf_susie(sim.counts, 5, 2, 1, factors=sim.factors)


def test_counts_are_read_once_and_numbered_by_ranges(spark, monkeypatch):
    """The plan of packed counts has no join or aggregate of the source; many names are put in order by ranges."""
    from motifmill.sources import counts as C

    df = spark.createDataFrame([(i, f"f{m}") for i in range(5) for m in range(7)], "i long, f string")
    c = C.counts_from(df, "i", "f")
    assert "Scan ExistingRDD" not in c.packed()._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(C, "ONE_TASK", 6)
    many = C.counts_from(df, "i", "f")
    assert sorted(map(tuple, many.features.collect())) == sorted(map(tuple, c.features.collect())) == [(m + 1, f"f{m}") for m in range(7)]
    assert many.features.dtypes == c.features.dtypes


def test_wide_counts_go_by_blocks(spark, monkeypatch):
    """The same fits, whatever the way."""
    sim = simulate.block(spark, 24, 12, 3)
    narrow = [fits.soft_mixture(sim.counts, 3, 2, 2, 1, 1, mf_max_iters=1, mf_nmf_iters=1, seed=1), fits.hard_mixture(sim.counts, 3, 2, 2, 1, 1, mf_max_iters=1, mf_nmf_iters=1, seed=1)]
    monkeypatch.setattr(fits, "DRIVER_BYTES", 1)
    wide = [fits.soft_mixture(sim.counts, 3, 2, 2, 1, 1, mf_max_iters=1, mf_nmf_iters=1, seed=1), fits.hard_mixture(sim.counts, 3, 2, 2, 1, 1, mf_max_iters=1, mf_nmf_iters=1, seed=1)]
    for a, b in zip(narrow, wide, strict=True):
        assert type(b).__name__ == "BlockMixture" and b.gamma == pytest.approx(a.gamma, rel=1e-6) and b.pi == pytest.approx(a.pi, rel=1e-6)
        f = b.factors_df().toPandas().sort_values(["k", "m"]).f.to_numpy().reshape(3, -1)
        assert f == pytest.approx(a.factors, rel=1e-6)
