import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fitgrain.functions.quantiles import exact_quantiles, order_statistics

QS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.mark.parametrize("limit", [10, 1_000_000])
def test_quantiles_equal_numpy_with_and_without_narrowing(spark, limit):
    rng = np.random.default_rng(1)
    a = np.round(rng.lognormal(3, 2, 5000), 3)
    b = np.where(np.arange(5000) % 3 == 0, 7.0, rng.normal(size=5000))  # one value holds a third
    b[::11] = np.nan
    df = spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a double, b double").repartition(5)
    got = exact_quantiles(df, {"a": QS, "b": QS}, inside_limit=limit)
    assert got["a"] == pytest.approx(np.quantile(a, QS).tolist(), rel=1e-12)
    assert got["b"] == pytest.approx(np.nanquantile(b, QS).tolist(), rel=1e-12)


def test_rank_between_two_heavy_ties_is_narrowed(spark):
    """Few values lie between two that hold nearly all rows; the ties must not be ranked with them."""
    from fitgrain.functions import quantiles

    values = [0] * 3000 + list(range(1, 41)) + [100] * 3000
    df = spark.createDataFrame([(v,) for v in values], "x long")
    counts = {}
    picked = quantiles._pick
    quantiles._pick = lambda d, v, b: counts.update({t: x.inside for t, x in b.items() if x.low != x.high}) or picked(d, v, b)
    try:
        got = order_statistics(df, {"x": F.col("x")}, {"x": [10, 3020, 6000]}, {"x": len(values)}, inside_limit=50)
    finally:
        quantiles._pick = picked
    assert got["x"] == {10: 0, 3020: values[3020], 6000: 100}
    assert counts and max(counts.values()) <= 50


def test_empty_and_all_null_columns_give_none(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert exact_quantiles(df, {"x": [0.5]}) == {"x": [None]}
    assert exact_quantiles(df.limit(0), {"x": [0.1, 0.9]}) == {"x": [None, None]}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=40), st.integers(1, 6))
def test_ranks_of_small_lists(spark, values, limit):
    df = spark.createDataFrame([(v,) for v in values], "x long")
    ranks = list(range(len(values)))
    got = order_statistics(df, {"x": F.col("x")}, {"x": ranks}, {"x": len(values)}, inside_limit=limit)
    assert [got["x"][r] for r in ranks] == sorted(values)


def test_large_integers_keep_all_digits(spark):
    values = [2**61 + i for i in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    got = order_statistics(df, {"x": F.col("x")}, {"x": [0, 137, 299]}, {"x": 300}, inside_limit=20)
    assert got["x"] == {0: values[0], 137: values[137], 299: values[299]}
    assert not math.isnan(float(got["x"][0]))
