"""The feature plan: caps, logs, median fills and target-mean encodings."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from fitgrain import schema
from fitgrain.functions.quantiles import exact_quantiles
from fitgrain.operators.keyed_maps import KeyedMap, MapSpec, encoded, filled, fit_means, fit_modes, restored, stored
from fitgrain.operators.numeric import capped_log, filled_log, present
from fitgrain.sources.tables import read_json_document, write_json_document

CAP_SHARE = 0.99
MODAL_AGENCY = MapSpec("modal_agency", None, "agency")


def text_columns(df: DataFrame, target: str = schema.TARGET) -> list[str]:
    """String columns that may be encoded."""
    kept_out = {target, schema.ID, schema.SPLIT, *schema.EXCLUDED}
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in kept_out]


def feature_columns(
    df: DataFrame,
    exclude_protected: bool = True,
    protected: Sequence[str] = schema.PROTECTED,
    target: str = schema.TARGET,
) -> list[str]:
    """Non-text columns in table order, without roles and excluded columns.

    Protected attributes stay in the table for auditing but enter the feature
    list only with ``exclude_protected=False``.
    """
    kept_out = {target, schema.ID, schema.SPLIT, *schema.EXCLUDED}
    if exclude_protected:
        kept_out |= set(protected)
    return [f.name for f in df.schema.fields if f.name not in kept_out and isinstance(f.dataType, T.NumericType)]


def missing_features(wanted: Sequence[str], df: DataFrame) -> list[str]:
    """Learned features that ``df`` does not have."""
    return [c for c in wanted if c not in df.columns]


def require_features(wanted: Sequence[str], df: DataFrame) -> None:
    absent = missing_features(wanted, df)
    if absent:
        raise ValueError(f"features missing from the table: {', '.join(absent)}")


@dataclass
class FeatureModel:
    """Caps, medians, the modal agency, encodings and the frozen feature list."""

    caps: dict[str, float | None] = field(default_factory=dict)
    medians: dict[str, float | None] = field(default_factory=dict)
    modes: dict[str, KeyedMap] = field(default_factory=dict)
    encodings: dict[str, KeyedMap] = field(default_factory=dict)
    features: list[str] = field(default_factory=list)

    def numeric(self, df: DataFrame) -> DataFrame:
        return filled_log(capped_log(df, self.caps), self.medians)

    def fill_agency(self, df: DataFrame) -> DataFrame:
        modal = self.modes.get(MODAL_AGENCY.name)
        return filled(df, modal) if modal is not None and "agency" in df.columns else df

    def transform(self, df: DataFrame) -> DataFrame:
        return encoded(self.fill_agency(self.numeric(df)), list(self.encodings.values()))

    def save(self, spark: SparkSession, path: str) -> None:
        stored(self.modes, spark).write.mode("overwrite").parquet(f"{path}/modes")
        stored(self.encodings, spark).write.mode("overwrite").parquet(f"{path}/encodings")
        facts = {
            "caps": self.caps,
            "medians": self.medians,
            "features": self.features,
            "modes": list(self.modes),
            "encodings": list(self.encodings),
        }
        write_json_document(spark, f"{path}/facts", json.dumps(facts))

    @staticmethod
    def load(spark: SparkSession, path: str) -> FeatureModel:
        facts = json.loads(read_json_document(spark, f"{path}/facts"))
        modes = [MODAL_AGENCY] if MODAL_AGENCY.name in facts["modes"] else []
        codes = [MapSpec(c, None, c) for c in facts["encodings"]]
        return FeatureModel(
            facts["caps"],
            facts["medians"],
            restored(spark.read.parquet(f"{path}/modes"), modes),
            restored(spark.read.parquet(f"{path}/encodings"), codes),
            facts["features"],
        )


def encoding_specs(df: DataFrame) -> list[MapSpec]:
    """The named encodings first, then every remaining text column."""
    named = present(df, schema.ENCODED)
    rest = [c for c in text_columns(df) if c not in named]
    return [MapSpec(c, None, c) for c in named + rest]


def fit_features(train: DataFrame, exclude_protected: bool = True, target: str = schema.TARGET, encode: bool = True) -> FeatureModel:
    """Learn every feature map from the cleaned ``train``; without ``encode`` only what no label enters."""
    model = FeatureModel()
    caps = present(train, schema.CAPPED)
    medians = present(train, schema.MEDIAN_FILLED)
    wanted = {**{c: [CAP_SHARE] for c in caps}, **{c: [0.5] for c in medians}}
    with ThreadPool(1) as pool:  # quantiles and encodings do not depend on each other
        quantiles = pool.apply_async(exact_quantiles, (train, wanted))
        model.modes = fit_modes(train, [MODAL_AGENCY])
        if encode:
            model.encodings = fit_means(model.fill_agency(train), encoding_specs(train), of=target)
        learned = quantiles.get()
    model.caps = {c: learned[c][0] for c in caps}
    model.medians = {c: learned[c][0] for c in medians}
    model.features = feature_columns(model.transform(train), exclude_protected, target=target)
    return model
