"""Scoring: predictions, decisions, rule baseline, approval rate, full training run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitgrain import schema
from fitgrain.operators.evaluate import auc, metrics
from fitgrain.operators.split import TEST_SHARE, stratified_split
from fitgrain.plans.cleaning import fit_cleaning
from fitgrain.plans.features import fit_features
from fitgrain.plans.training import THRESHOLD, TrainedModel, fit_classifier, train_model
from fitgrain.sources.tables import append_log

# The baseline rule and its two scores.
INCOME_SHARE = 0.2
RULE_HIGH = 0.82
RULE_LOW = 0.45


def predicted(probability: Column, threshold: float = THRESHOLD) -> Column:
    return (probability >= F.lit(threshold)).cast("int")


def predictions(model: TrainedModel, df: DataFrame) -> DataFrame:
    """``(ID, Prediction)``; the id travels with its row."""
    return model.probabilities(df).select(schema.ID, predicted(F.col("probability")).alias("Prediction"))


def approval_rate(scored: DataFrame, prediction: str = "Prediction") -> DataFrame:
    return scored.agg(F.avg(prediction).alias("approval_rate"))


def with_decision(df: DataFrame, probability: str = "probability") -> DataFrame:
    """Decision at one half and the rounded probability; batch or stream."""
    p = F.col(probability)
    return df.withColumn("decision", F.when(p >= THRESHOLD, "approved").otherwise("denied")).withColumn(
        "confidence", F.round(p, 3)
    )


def rule_score(income: Column, amount: Column) -> Column:
    """The baseline rule: high where income exceeds a fifth of the amount."""
    return F.when(income > amount * INCOME_SHARE, F.lit(RULE_HIGH)).otherwise(F.lit(RULE_LOW))


def with_rule_score(df: DataFrame, into: str = "probability") -> DataFrame:
    return df.withColumn(into, rule_score(F.col("applicant_income"), F.col("loan_amount")))


def training_run(train: DataFrame, classifier, model_path: str, log_path: str, compat: bool = False, **options):
    """Split, fit, evaluate on the held-out rows, save the model and log the run.

    The split comes first, so held-out labels never enter a learned map;
    ``compat`` learns the maps from all rows, as the published figures do.
    """
    spark = train.sparkSession
    marked = stratified_split(train, share=TEST_SHARE)
    kept, held = marked.filter("not is_validation").drop("is_validation"), marked.filter("is_validation").drop("is_validation")
    if compat:
        cleaning = fit_cleaning(train, compat=True)
        features = fit_features(cleaning.transform(train, True), **options)
        ready = features.transform(cleaning.transform(kept, True))
        model = TrainedModel(cleaning, features, fit_classifier(ready, features.features, classifier(len(features.features))))
    else:
        model = train_model(kept, classifier, **options)
    scored = model.probabilities(held).select(schema.ID, schema.TARGET, "probability")
    scored = scored.withColumn("Prediction", predicted(F.col("probability")))
    figures = metrics(scored).first().asDict()
    figures["roc_auc"] = auc(scored, score="probability").first()["auc"]
    model.save(spark, model_path)
    sizes = marked.groupBy("is_validation").count().collect()
    counts = {r["is_validation"]: r["count"] for r in sizes}
    append_log(spark, log_path, counts.get(False, 0), counts.get(True, 0), model.features.features, figures, model_path)
    return model, figures
