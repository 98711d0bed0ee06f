import numpy as np
import pytest
from pyspark.sql import functions as F

from fitgrain.operators import evaluate as ev
from fitgrain.operators.split import stratified_folds, stratified_split


@pytest.mark.parametrize("limit", [50, 1_000_000])
def test_split_is_exact_per_class(spark, limit):
    rows = spark.range(1003).select(F.col("id").alias("ID"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    out = stratified_split(rows, inside_limit=limit)
    got = {(r["label"], r["is_validation"]): r["count"] for r in out.groupBy("label", "is_validation").count().collect()}
    assert got == {(1, True): 20, (1, False): 81, (0, True): 180, (0, False): 722}
    again = {r["ID"] for r in stratified_split(rows.repartition(9)).filter("is_validation").collect()}
    assert again == {r["ID"] for r in out.filter("is_validation").collect()}


def test_folds_differ_by_at_most_one_row(spark):
    rows = spark.range(997).select(F.concat(F.lit("id-"), "id").alias("ID"), (F.col("id") % 3).alias("label"))
    counts = stratified_folds(rows).groupBy("label", "fold").count().collect()
    assert len(counts) == 15
    for label in range(3):
        sizes = [r["count"] for r in counts if r["label"] == label]
        assert max(sizes) - min(sizes) <= 1 and len(sizes) == 5


def scores(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    s = np.round(rng.random(n) + 0.3 * y, 2)  # many ties
    return y, s, spark.createDataFrame(list(zip(y.tolist(), s.tolist())), "label int, score double").repartition(6)


def python_curve(y, s):
    points = [(0.0, 0.0)]
    for t in sorted(set(s), reverse=True):
        points.append((np.mean(s[y == 0] >= t), np.mean(s[y == 1] >= t)))
    return np.array(points)


def test_auc_equals_pair_counting(spark):
    y, s, df = scores(spark)
    pos, neg = s[y == 1][:, None], s[y == 0][None, :]
    expected = np.mean((pos > neg) + 0.5 * (pos == neg))
    assert ev.auc(df).first()["auc"] == pytest.approx(expected, abs=1e-12)


def test_auc_of_a_single_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.7)], "label int, score double")
    assert ev.auc(df).first()["auc"] is None


def test_curve_and_interpolation_equal_numpy(spark):
    y, s, df = scores(spark)
    steps = ev.score_steps(df.withColumn("fold", F.lit(0)), by=["fold"])
    expected = python_curve(y, s)
    full = ev.roc_curve(steps, ["fold"], drop_intermediate=False).orderBy(F.desc("threshold")).collect()
    assert np.allclose([(r["fpr"], r["tpr"]) for r in full], expected)
    bent = ev.roc_curve(steps, ["fold"]).orderBy(F.desc("threshold")).collect()
    assert len(bent) <= len(full)
    grid = np.linspace(0, 1, 100)
    lines = np.interp(grid, expected[:, 0], expected[:, 1])
    thin = np.interp(grid, [r["fpr"] for r in bent], [r["tpr"] for r in bent])
    assert np.allclose(lines, thin)
    lines[0] = 0.0
    got = (
        ev.mean_roc(ev.interpolated_roc(steps, ["fold"]), []).orderBy("grid_point").collect()
    )
    lines[-1] = 1.0
    assert np.allclose([r["mean_tpr"] for r in got], lines)


def test_metrics_are_zero_where_undefined(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "label int, Prediction int")
    assert ev.metrics(df).first().asDict() == {"accuracy": 0.5, "precision": 0.0, "recall": 0.0, "f1": 0.0}
    matrix = {r["actual"]: (r["predicted_0"], r["predicted_1"]) for r in ev.confusion_matrix(df).collect()}
    assert matrix == {0: (1, 0), 1: (1, 0)}
    empty = {r["actual"]: (r["predicted_0"], r["predicted_1"]) for r in ev.confusion_matrix(df.limit(0)).collect()}
    assert empty == {0: (0, 0), 1: (0, 0)}


def test_split_of_many_classes(spark, monkeypatch):
    from fitgrain.operators import split

    df = spark.range(12_000).selectExpr("id AS ID", "IF(id % 3 = 0, NULL, id % 4000) AS label")
    ranked = split.stratified_split(df), split.stratified_folds(df)
    monkeypatch.setattr(split, "FEW_CLASSES", 10_000)
    few = df.where("label < 30 OR label IS NULL AND ID < 300")
    plain = split.stratified_split(few), split.stratified_folds(few)
    monkeypatch.setattr(split, "FEW_CLASSES", 0)
    again = split.stratified_split(few), split.stratified_folds(few)
    for a, b in zip(plain, again):
        assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)
    for label, n, marked in ranked[0].selectExpr("label", "int(is_validation) AS v").groupBy("label").agg({"*": "count", "v": "sum"}).collect():
        assert {n, marked} == {n, int(0.2 * n + 0.5)} or {n, marked} == {marked, int(0.2 * marked + 0.5)}
    assert ranked[1].groupBy("label", "fold").count().where("label IS NULL AND count <> 800").isEmpty()
