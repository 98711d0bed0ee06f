"""Scoring of a stream of applications with frozen maps.

Cleaning, features and classifier are projections and lookups of static maps,
so the same transform serves batch and stream. Nothing is kept between
batches, hence no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from fitgrain import schema
from fitgrain.plans.scoring import with_decision, with_rule_score
from fitgrain.plans.training import TrainedModel


def scored_stream(stream: DataFrame, model: TrainedModel | None = None) -> DataFrame:
    """``(ID, decision, confidence)`` per arriving row.

    Without a model the rows are scored by the explicit baseline rule.
    """
    scored = with_rule_score(stream) if model is None else model.probabilities(stream)
    return with_decision(scored).select(schema.ID, "decision", "confidence")


def write_stream(scored: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append scored rows to a Parquet table, each exactly once."""
    writer = scored.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


def stream_decisions(spark, stream: DataFrame, path: str, model: TrainedModel | None = None) -> DataFrame:
    """Score all rows available now and read the table back."""
    query = write_stream(scored_stream(stream, model), f"{path}/rows", f"{path}/state")
    query.awaitTermination()
    return spark.read.schema(scored_stream(stream, model).schema).parquet(f"{path}/rows")
