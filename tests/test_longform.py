import pytest

from motifmill import catalogue as Q
from motifmill.operators import longform as L

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def p(spark):
    return Q.posterior(spark, SF)


def shuffled(df):
    """Depths in the plan of what unfolds a sample's slots and of the shuffles by sample."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    return [depth(x) for x in lines if "Generate inline(" in x], [depth(x) for x in lines if "Exchange hashpartitioning(i#" in x]


@pytest.mark.parametrize("name", ["slots", "effects"])
def test_shares_are_not_shuffled(p, name):
    """Cells are shuffled by sample before they unfold; shares by slot are summed where they are."""
    if name == "slots":
        df = L.expected_counts(Q._shares(p, p.omega))
    else:
        df = L.effect_shares(p.counts.counts, p.effects, p.f0)
    unfolds, shuffles = shuffled(df)
    assert unfolds and all(d > min(unfolds) for d in shuffles)


def test_shares_sum_to_one_and_weights_go_along(p):
    shares = Q._shares(p, p.omega)
    rows = shares.toPandas()
    assert rows.groupby(["i", "s", "m"]).xi.sum().sub(1).abs().max() < 1e-12
    want = p.omega.toPandas().set_index(["i", "s"]).w
    assert len(rows) == len(p.counts.counts.toPandas()) * Q.S_ * Q.D
    assert (rows.set_index(["i", "s"]).w.sub(want.reindex(rows.set_index(["i", "s"]).index)).abs() < 1e-12).all()
    a, b = (x.toPandas().set_index(["s", "d", "m"]).c.sort_index() for x in (L.expected_counts(shares), L.expected_counts(Q._shares(p), p.omega)))
    assert (a - b).abs().max() < 1e-9
