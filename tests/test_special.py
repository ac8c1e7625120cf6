import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifmill.functions import arrays as A
from motifmill.functions import special as X

POINTS = [1e-6, 1e-3, 0.3, 1.0, 2.5, 7.7, 30.0, 1e3, 1e5]


def test_lgamma_against_math():
    assert np.allclose(X.np_lgamma(np.array(POINTS)), [math.lgamma(x) for x in POINTS], rtol=1e-11, atol=1e-11)


def test_known_values():
    assert X.np_digamma(1.0) == pytest.approx(X.DIGAMMA_1, abs=1e-12)
    assert X.np_trigamma(1.0) == pytest.approx(math.pi**2 / 6, abs=1e-12)


def test_recurrences():
    x = np.array(POINTS)
    assert np.allclose(X.np_digamma(x + 1) - X.np_digamma(x), 1 / x, rtol=1e-9)
    assert np.allclose(X.np_trigamma(x) - X.np_trigamma(x + 1), 1 / x**2, rtol=1e-6)


def test_inverse_digamma():
    x = np.array([0.05, 0.3, 1.0, 2.5, 30.0, 1e3])
    assert np.allclose(X.np_inv_digamma(X.np_digamma(x)), x, rtol=1e-6)


def test_gamma_shape_is_a_fixed_point():
    a = np.array([0.2, 0.8, 1.5])
    got = X.np_gamma_shape(a / 2.0, X.np_digamma(a) - math.log(2.0))
    assert np.allclose(got, a, rtol=1e-6)


def test_columns_equal_numpy(spark):
    df = spark.createDataFrame([(x,) for x in POINTS], "x double")
    got = df.select(X.digamma(F.col("x")), X.trigamma(F.col("x")), X.lgamma(F.col("x"))).toPandas().to_numpy()
    x = np.array(POINTS)
    assert np.allclose(got, np.column_stack([X.np_digamma(x), X.np_trigamma(x), X.np_lgamma(x)]), rtol=1e-12)


def test_array_functions(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([0.0, 0.0, 5.0],)], "v array<double>")
    r = df.select(A.argmax(F.col("v")), A.log_sum_exp(F.col("v")), A.entropy(A.normalize(F.col("v"))), A.top_label(F.col("v"), F.lit(2)), A.softmax(F.col("v"))).collect()
    assert [x[0] for x in r] == [2, 3]
    assert r[0][1] == pytest.approx(math.log(math.exp(1) + 2 * math.exp(3)))
    assert [x[3] for x in r] == ["2,3", "1,3"]
    assert sum(r[0][4]) == pytest.approx(1)
    assert 0 <= r[1][2] < 1e-6


def test_labels_sort_numbers(spark):
    df = spark.createDataFrame([([10, 2, 2],)], "v array<int>")
    assert df.select(A.support_label(F.col("v"))).first()[0] == "2,10"
    assert df.select(A.recycle(F.col("v"), 5)).first()[0] == [10, 2, 2, 10, 2]
