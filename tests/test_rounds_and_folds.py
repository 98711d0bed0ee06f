"""Training that stops by itself, and maps of all folds from one scan."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from fitgrain.operators import fold_maps as fm
from fitgrain.operators.keyed_maps import MapSpec, encoded, fit_means, fit_modes
from fitgrain.operators.split import stratified_folds
from fitgrain.plans import stopping
from fitgrain.session import written
from fitgrain.sources.applications import train_rows


def rings(spark, n, seed=1, noise=0.0):
    draw = np.random.default_rng(seed)
    angle, label = draw.uniform(0, 2 * np.pi, n), draw.integers(0, 2, n)
    x = (1 + 2 * label + draw.normal(size=n) * 0.2)[:, None] * np.stack([np.cos(angle), np.sin(angle)], axis=1)
    label = np.where(draw.random(n) < noise, 1 - label, label)
    return spark.createDataFrame([(i, Vectors.dense(v), float(y)) for i, (v, y) in enumerate(zip(x, label))], ["ID", "features", "y"])


def test_training_stops_by_itself(spark):
    rows = written(rings(spark, 1500, noise=0.1), "rings")
    network = stopping.StoppedNetwork([2, 8, 2], 1000, 42)
    model = network.fit(rows)
    done, losses, best = zip(*network.curve)
    assert done == tuple(range(stopping.ROUND, stopping.ROUND * len(done) + 1, stopping.ROUND)) and done[-1] < 1000
    assert model.curve == network.curve and best[int(np.argmin(losses))]
    assert min(losses) < 0.45 < losses[0]  # noise of a tenth alone costs 0.33
    at = int(np.argmin(losses))
    assert all(x >= losses[at] - stopping.TOLERANCE for x in losses[at:]) and len(losses) <= at + 1 + 2 * stopping.PATIENCE
    right = model.transform(rings(spark, 400, seed=2)).filter("prediction = y").count()
    assert right > 380
    again = stopping.StoppedNetwork([2, 8, 2], 1000, 42)
    assert np.allclose(again.fit(rows).weights.toArray(), model.weights.toArray()) and [b for _, _, b in again.curve] == list(best)


def test_few_rows_and_few_iterations(spark):
    network = stopping.StoppedNetwork([2, 3, 2], 7, 1)
    network.fit(rings(spark, 5))
    assert [done for done, _, _ in network.curve][-1] <= 7
    no_id = rings(spark, 300).drop("ID")
    assert stopping.StoppedNetwork([2, 3, 2], 5, 1).fit(no_id).transform(no_id).count() == 300


def test_network_multiplies_packed_blocks(spark, monkeypatch):
    """Rows are packed once; Spark's own network only carries weights and never sees them."""
    seen, fit = [], stopping.MultilayerPerceptronClassifier._fit
    monkeypatch.setattr(stopping.MultilayerPerceptronClassifier, "_fit", lambda self, df: seen.append(df.count()) or fit(self, df))
    rows = written(rings(spark, 3000, noise=0.1), "rings")
    model = stopping.StoppedNetwork([2, 8, 2], 1000, 42).fit(rows)
    assert max(seen) == 1
    train, held = stopping.both_parts(stopping.packed(stopping.held_marked(rows, "features", "y", "ID"), "features", "y"))
    assert train.count() + held.count() < 60
    loss = held.sparkSession.createDataFrame(model.curve, "n long, loss double, best boolean").agg(F.min("loss")).first()[0]
    assert np.isclose(stopping.summed_loss(held, [2, 8, 2], model.weights.toArray(), slope=False)[0], loss)
    # The blocks' loss is what Spark's model gives on the rows themselves.
    scored = model.transform(rows).select(F.col("probability").cast("string"), "y", stopping.vector_to_array("probability")[1].alias("p"))
    plain = scored.agg(-F.avg(F.when(F.col("y") == 1, F.log("p")).otherwise(F.log(1 - F.col("p"))))).first()[0]
    both = stopping.summed_loss(train.unionByName(held), [2, 8, 2], model.weights.toArray(), slope=False)[0]
    assert np.isclose(both, plain, rtol=1e-4)


def test_gradient_is_the_slope_of_the_loss():
    draw = np.random.default_rng(3)
    layers = [3, 5, 4, 2]
    weights = draw.normal(size=sum((a + 1) * b for a, b in zip(layers, layers[1:])))
    x, y = draw.normal(size=(40, 3)), draw.integers(0, 2, 40)
    _, gradient = stopping.network_loss(weights, layers, x, y)
    for k in range(0, len(weights), 7):
        step = np.zeros(len(weights))
        step[k] = 1e-5
        up, down = (stopping.network_loss(weights + s, layers, x, y)[0] for s in (step, -step))
        assert np.isclose((up - down) / 2e-5, gradient[k], rtol=1e-4, atol=1e-6)


def test_labels_of_the_network_are_checked(spark):
    rows = rings(spark, 50).withColumn("y", F.when(F.col("ID") != 7, F.col("y")))
    with pytest.raises(Exception, match="labels 0 or 1"):
        stopping.StoppedNetwork([2, 3, 2], 5, 1).fit(rows)


def test_penalty_spares_biases():
    weights = np.arange(1.0, 3 * 4 + 5 * 2 + 1)
    small = stopping.shrunk(weights, [2, 4, 2], 0.5)
    at_bias = [*range(8, 12), *range(20, 22)]
    assert all(small[i] == weights[i] * (1 if i in at_bias else 0.5) for i in range(22))



def as_numbers(maps):
    near = lambda v: None if v is None else round(float(v), 6)
    return {n: ([(k, near(v), c) for k, v, c in sorted(m.rows)], near(m.fallback)) for n, m in maps.items()}


@pytest.fixture(scope="module")
def folded(spark, apps):
    rows = train_rows(apps).withColumn("rare", F.when(F.col("ID") % 97 == 1, F.col("ID").cast("string")))
    return written(stratified_folds(rows), "folds")


def test_fold_modes_equal_separate_fits(folded):
    specs = [MapSpec("tract", "county", "census_tract_number"), MapSpec("lien", "loan_type", "lien_status"), MapSpec("rare", "rare", "agency"), MapSpec("agency", None, "agency"), MapSpec("gone", "none", "nothing")]
    found = fm.fit_fold_modes(folded, specs)
    assert len(found) == 5
    for fold, maps in enumerate(found):
        alone = fit_modes(folded.filter(F.col("fold") != fold), specs)
        assert {n: (sorted(m.rows), m.fallback) for n, m in maps.items()} == {n: (sorted(m.rows), m.fallback) for n, m in alone.items()}
    assert any(sorted(found[0]["rare"].rows) != sorted(maps["rare"].rows) for maps in found)


@pytest.mark.parametrize("of", (None, "label"))
def test_fold_means_equal_separate_fits(folded, of):
    specs = [MapSpec("county", None, "county"), MapSpec("rare", None, "rare")] if of else [MapSpec("income", "county", "tract_to_msamd_income"), MapSpec("amount", "rare", "loan_amount")]
    for fold, maps in enumerate(fm.fit_fold_means(folded, specs, of=of)):
        alone = fit_means(folded.filter(F.col("fold") != fold), specs, of=of)
        assert as_numbers(maps) == as_numbers(alone)
        if of:
            held = folded.filter(F.col("fold") == fold)
            key = lambda df: sorted((r["ID"], round(r["county"], 9), round(r["rare"], 9)) for r in df.collect())
            assert key(encoded(held, list(maps.values()))) == key(encoded(held, list(alone.values())))


def test_all_folds_are_learned_in_one_scan(folded, monkeypatch):
    plans = []
    monkeypatch.setattr(fm, "_gathered", lambda rows, specs, limit: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or {})
    fm.fit_fold_means(folded, [MapSpec("county", None, "county")], of="label")
    fm.fit_fold_modes(folded, [MapSpec("lien", "loan_type", "lien_status")])
    assert [p.count("FileScan") for p in plans] == [1, 1]


def test_no_rows_have_no_maps(folded):
    none = folded.filter("false")
    assert all(m["county"].rows == [] for m in fm.fit_fold_means(none, [MapSpec("county", None, "county")], of="label"))
    assert fm.fit_fold_modes(folded, []) == [{}] * 5


def test_kernel_margin_separates_rings(spark):
    from pyspark.ml.classification import LinearSVC

    from fitgrain.operators.evaluate import auc
    from fitgrain.plans.kernel import KernelMargin
    from fitgrain.plans.training import scores_of

    rows, unseen = written(rings(spark, 1200), "rings"), written(rings(spark, 400, seed=2), "rings")
    model = KernelMargin().fit(rows)
    linear = LinearSVC(featuresCol="features", labelCol="y").fit(rows)
    area = lambda m: auc(scores_of(m, unseen, "ID", "y").withColumnRenamed("y", "label"), score="score").first()["auc"]
    assert area(model) > 0.97 and area(linear) < 0.65
    scored = sorted((r["margin"], r["probability"][1], r["prediction"]) for r in model.transform(unseen).collect())
    assert all(a[1] <= b[1] for a, b in zip(scored, scored[1:])) and 0 <= scored[0][1] < 0.1 < 0.9 < scored[-1][1] <= 1
    assert all(p == (q >= 0.5) for _, q, p in scored)
    assert {"ID", "features", "y", "probability", "prediction", "margin"} == set(model.transform(unseen).columns)
    assert model.transform(unseen.filter("false")).count() == 0


def test_kernel_features_approximate_the_kernel():
    from fitgrain.plans.kernel import waves

    x = np.random.default_rng(5).normal(size=(60, 4))
    frequencies, phases = waves(4, 4096, 0.25, 1)
    z = np.sqrt(2 / 4096) * np.cos(x @ frequencies + phases)
    exact = np.exp(-0.25 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - exact).max() < 0.08
