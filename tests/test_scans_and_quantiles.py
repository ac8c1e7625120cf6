import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifmill.operators import figures
from motifmill.operators import quantiles as Q
from motifmill.plans import scan


def test_row_numbers(spark):
    rng = random.Random(1)
    rows = [(k, rng.randrange(1000)) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, v long").repartition(5)
    got = {(r.v, r.id): r.n for r in scan.row_numbers(df, "v", "id", parts=7).collect()}
    assert got == {(v, i): n for n, (v, i) in enumerate(sorted((v, i) for i, v in rows), 1)}
    assert scan.row_numbers(df.limit(0), "v", "id").count() == 0


@pytest.mark.parametrize("segments,values,parts", [(1, 2, 6), (1, 1, 6), (3, 3, 5), (40, 2, 4), (2, 9, 1)])
def test_run_boundaries_by_walking_along(spark, segments, values, parts):
    rng = random.Random(segments * values)
    rows = sorted((rng.randrange(segments), k, rng.choice([None, *range(values)][-values:] if values > 1 else [5])) for k in range(300))
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = sorted(tuple(r) for r in figures.run_boundaries(spark.createDataFrame(rows, "seg long, at long, v long").repartition(3), "at", "v", "seg").select("seg", "run", "v", "first", "last", "n").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    want = []
    for seg, inside in itertools.groupby(rows, key=lambda r: r[0]):
        for run, (v, group) in enumerate(itertools.groupby(inside, key=lambda r: r[2]), 1):
            at = [r[1] for r in group]
            want.append((seg, run, v, at[0], at[-1], len(at)))
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_runs_with_null_segments_and_values(spark):
    rows = [(None, 1, None), (None, 2, None), (None, 3, 1), (1, 1, None), (1, 2, 1)]
    got = figures.run_boundaries(spark.createDataFrame(rows, "seg long, at long, v long"), "at", "v", "seg").collect()
    assert sorted((repr(r.seg), r.run, repr(r.v), r.n) for r in got) == [("1", 1, "None", 1), ("1", 2, "1", 1), ("None", 1, "None", 2), ("None", 2, "1", 1)]


PROBS = {"q0": 0.0, "q25": 0.25, "median": 0.5, "q90": 0.9, "q1": 1.0}


def expected(values):
    return [float(np.quantile(values, p)) for p in PROBS.values()]


@pytest.mark.parametrize("most,cuts", [(10_000, 256), (60, 16)])
def test_quantiles_equal_sorting(spark, most, cuts):
    """However often the brackets are cut again."""
    rng = np.random.default_rng(most)
    groups = {
        "wide": rng.normal(size=700) * np.exp(rng.normal(size=700) * 20),
        "ties": rng.integers(0, 4, 600).astype(float),
        "equal": np.full(500, -2.5),
        "hot": np.concatenate([np.full(400, 7.0), rng.uniform(0, 14, 200)]),
        "one": np.array([3.0]),
        "two": np.array([1.0, 2.0]),
        None: rng.uniform(-1e300, 1e300, 50),
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("one", None), ("one", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "grp string, v double").repartition(5)
    got = {r.grp: [r[n] for n in PROBS] for r in Q.quantiles(df, "v", PROBS, ["grp"], cuts, most).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g] == pytest.approx(expected(vs), rel=1e-12), g
    everything = np.concatenate([*groups.values()])
    assert list(Q.quantiles(df, "v", PROBS, None, cuts, most).first()) == pytest.approx(expected(everything), rel=1e-12)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([("a", None)], "grp string, v double")
    assert Q.quantiles(df, "v", PROBS, ["grp"]).count() == 0 and Q.quantiles(df, "v", PROBS).count() == 0
    assert Q.with_quantiles(df.groupBy("grp").agg(F.count("v").alias("n")), df, "v", {"m": 0.5}, ["grp"]).first().m is None
