"""Mergeable quantile sketches against exact ranks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fitgrain.functions import sketches as sk
from fitgrain.functions.quantiles import exact_quantiles
from fitgrain.operators.numeric import fit_caps, fit_medians
from fitgrain.session import scratch_path, written

SHARES = [0.01, 0.25, 0.5, 0.9, 0.99]


def off(values, value, share):
    """By how much the value's rank misses the share."""
    low, high = np.mean(values < value), np.mean(values <= value)
    return max(0.0, low - share, share - high)


@pytest.fixture(scope="module")
def numbers(spark):
    draw = np.random.default_rng(4)
    n = 40_000
    x = np.round(draw.lognormal(3, 1.5, n), 2)
    rows = spark.createDataFrame(__import__("pandas").DataFrame({"id": np.arange(n), "x": x, "tie": draw.integers(0, 3, n).astype(float)}))
    rows = rows.withColumn("x", F.when(F.col("id") % 10 > 0, F.col("x"))).withColumn("tie", F.when(F.col("id") % 7 == 0, float("nan")).otherwise(F.col("tie")))
    return written(rows.withColumn("day", (F.col("id") % 9).cast("int")).withColumn("none", F.lit(None).cast("double")).repartition(6), "numbers")


def test_sketches_merge_within_their_error(spark, numbers):
    path = scratch_path(spark, "sketches")
    with pytest.raises(FileNotFoundError):
        sk.stored_sketches(spark, path)
    columns = ("x", "tie", "none")
    sk.add_sketches(sk.sketches(numbers.filter("day < 5"), columns, ("day",)), path)
    sk.add_sketches(sk.sketches(numbers.filter("day >= 5"), columns, ("day",)), path)
    parts = sk.stored_sketches(spark, path)
    assert parts.count() == 2 * 9  # a column without values has no sketch
    found = sk.approx_quantiles(parts, {c: SHARES for c in columns})
    table = numbers.toPandas()
    for c in ("x", "tie"):
        values = table[c].dropna().to_numpy()
        assert all(off(values, v, q) <= sk.rank_error() for v, q in zip(found[c], SHARES))
    assert found["none"] == [None] * 5
    some = sk.approx_quantiles(parts.filter("day in (1, 8)"), {"x": [0.5]})["x"][0]
    assert off(table[table.day.isin([1, 8])].x.dropna().to_numpy(), some, 0.5) <= sk.rank_error()
    assert sk.merged(parts).agg(F.sum("n")).first()[0] == table.x.count() + table.tie.count()


def test_approximate_caps_and_medians(numbers):
    exact = exact_quantiles(numbers, {"x": [0.5, 0.99]})["x"]
    values = numbers.select("x").toPandas().x.dropna().to_numpy()
    assert fit_medians(numbers, ["x", "absent"])["x"] == exact[0] and fit_caps(numbers, ["x"])["x"] == exact[1]
    assert off(values, fit_medians(numbers, ["x"], approx=True)["x"], 0.5) <= sk.rank_error()
    assert off(values, fit_caps(numbers, ["x", "none"], approx=True)["x"], 0.99) <= sk.rank_error()
    assert fit_caps(numbers, ["none"], approx=True) == {"none": None} and fit_caps(numbers, [], approx=True) == {}
