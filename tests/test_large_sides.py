"""Sides that outgrow a task: what is joined by shuffle, and what is computed once a document."""

from pyspark.sql import functions as F

from fitgrain.catalog import QUERIES
from fitgrain.operators import keyed_maps as km
from fitgrain.plans import training as tr
from fitgrain.sources.applications import train_rows


def test_large_map_is_not_broadcast(spark):
    rows = spark.range(6000).select(F.col("id").alias("ID"), (F.col("id") % 2000).alias("k"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    learned = km.fit_means(rows, [km.MapSpec("k", None, "k")], limit=0, of="y")
    out = km.encoded(rows.select("ID", F.col("k").alias("key"), "k"), list(learned.values()))
    plan = out._jdf.queryExecution().optimizedPlan().toString() + out._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan
    means = rows.groupBy(F.col("k").alias("key")).agg(F.avg("y").alias("mean"))
    assert out.join(means, "key").where(F.abs(F.col("k") - F.col("mean")) > 1e-12).count() == 0


def test_context_is_made_once_a_document(spark, sf_dir):
    plan = QUERIES["r8_prompt"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("split(")


def test_maps_are_applied_once_before_the_fit(spark, apps, monkeypatch):
    seen = []
    monkeypatch.setattr(tr, "fit_classifier", lambda train, *more: seen.append(train))
    tr.train_model(train_rows(apps))
    assert seen[0].inputFiles() and all("/features-" in f for f in seen[0].inputFiles())
