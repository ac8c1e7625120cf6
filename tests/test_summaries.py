import pytest

from motifmill.operators import longform as L
from motifmill.operators import summaries as S
from motifmill.sources import counts as C
from motifmill.sources import simulate


def test_no_extra_mass_when_the_support_is_full(spark):
    sizes = spark.createDataFrame([(1, 1, 2.0), (1, 2, 1.0)], "i long, d int, size double")
    truth = lambda n: spark.createDataFrame([(1, 1, n)], "i long, grp int, true_support_size int")
    assert S.extra_mass(sizes, truth(2)).first().extra == 0
    assert S.extra_mass(sizes, truth(1)).first().extra == pytest.approx(1 / 3)


def test_ties_go_to_the_lowest_index(spark):
    scores = spark.createDataFrame([(1, 3, 1.0), (1, 1, 1.0), (1, 2, 1.0)], "i long, k int, score double")
    sizes = spark.createDataFrame([(1, 2)], "i long, true_support_size int")
    assert S.support_labels(scores, sizes).first().label == "1,2"
    omega = spark.createDataFrame([(1, 2, 0.5), (1, 1, 0.5)], "i long, s int, w double")
    assert S.max_responsibility(omega).first().z_hat == 1


def test_entropy_of_one_factor_is_null_and_of_certainty_zero(spark):
    assert S.motif_entropy(spark.createDataFrame([(1, 1, 1, 1.0)], "s int, d int, k int, p double")).first().gamma_entropy is None
    sure = spark.createDataFrame([(1, 1, 1, 1.0), (1, 1, 2, 0.0)], "s int, d int, k int, p double")
    assert S.motif_entropy(sure).first().gamma_entropy == 0
    assert S.inclusion_probability(spark.createDataFrame([(1, 1, 1, 1.0), (1, 2, 1, 0.5)], "i long, d int, k int, p double")).first().pip == 1


def test_one_value_has_no_sd(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 3.0)], "g string, v double")
    out = {r.g: r.sd for r in S.summarize_values(df, "v", "g").collect()}
    assert out["a"] is None and out["b"] == pytest.approx(2**0.5)


def test_null_mappings_drop_out(spark):
    scores = spark.createDataFrame([(1, 1, 2.0), (1, 2, 3.0)], "i long, k int, score double")
    mapping = spark.createDataFrame([(1, 4), (2, None)], "k int, true_k int")
    assert [tuple(r) for r in S.map_to_true(scores, mapping).collect()] == [(1, 4, 2.0)]


def test_components_without_weight_keep_their_priors(spark):
    alpha = spark.createDataFrame([(1, 1, 1, 2.0)], "i long, s int, d int, a double")
    omega = spark.createDataFrame([(1, 1, 0.0)], "i long, s int, w double")
    rates = spark.createDataFrame([(1, 1, 1.0)], "s int, d int, rate double")
    assert L.prior_moments(alpha, omega, rates).count() == 0


def test_counts_keep_empty_dimensions(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (None, "b")], "s long, f string")
    features = spark.createDataFrame([("a",), ("b",)], "name string")
    samples = spark.createDataFrame([(1,), (2,)], "i long")
    c = C.counts_from(df, "s", "f", features=features, samples=samples)
    assert [tuple(r) for r in c.counts.collect()] == [(1, 1, 2.0)]
    assert sorted((r.i, r.total) for r in c.samples.collect()) == [(1, 2.0), (2, 0.0)]
    assert {r.name: r.total for r in C.column_totals(c.counts, c.features).collect()} == {"a": 2.0, "b": 0.0}
    packed = {r.i: r.mi for r in c.packed().collect()}
    assert packed == {1: [1], 2: []}
    assert C.sparsity_profile(c).first().density == pytest.approx(0.25)


def test_simulators_are_keyed_by_seed_and_row(spark):
    a, b = (simulate.block(spark, 80, 40, 7).counts.counts.repartition(n).orderBy("i", "m").collect() for n in (1, 5))
    assert a == b
    sim = simulate.tree(spark, 60, 50, 3)
    assert sim.truth.select("grp").distinct().count() == 6
    assert {r.true_support_label for r in sim.truth.collect()} == {simulate.support_label(s) for s in simulate.TREE_SUPPORTS}
    with pytest.raises(ValueError):
        simulate.block(spark, 81, 40)
    _, dictionary = simulate.duplicate_dictionary(spark, 80, 40)
    assert dictionary.shape == (7, 40) and dictionary.sum(1) == pytest.approx([1.0] * 7)
    assert simulate.pad_support([1, 2], 5) == [1, 2, 1, 2, 1]
