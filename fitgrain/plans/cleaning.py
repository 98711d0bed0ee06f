"""The cleaning plan: ordered steps, learned on train, applied anywhere.

Fitting runs in four levels, one per dependency between learned maps:

0. missing shares, occupancy modes (rows are filtered by their result)
1. ethnicity by race, tract by county, lien by loan type, donor buckets
2. county by (filled) tract
3. msamd by (filled) county, income means by tract and by county

Each level is one scan and one shuffle for all its maps. ``transform`` then is
a projection with broadcast lookups; it shuffles nothing while maps are small.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitgrain import schema
from fitgrain.functions import text as tx
from fitgrain.operators.hotdeck import HotDeck, fit_hotdeck
from fitgrain.operators.keyed_maps import KeyedMap, MapSpec, filled, fit_means, fit_modes, restored, stored
from fitgrain.operators.numeric import replaced
from fitgrain.operators.profile import MISSING_THRESHOLD, high_missing_columns
from fitgrain.sources.tables import read_json_document, write_json_document

OCCUPANCY = MapSpec("occupancy", "property_type", "owner_occupancy")
ETHNICITY = MapSpec("ethnicity", "applicant_race_name_1", "applicant_ethnicity")
TRACT = MapSpec("tract", "county", "census_tract_number")
COUNTY = MapSpec("county", "census_tract_number", "county")
MSAMD = MapSpec("msamd", "county", "msamd")
INCOME_BY_TRACT = MapSpec("income_by_tract", "census_tract_number", "tract_to_msamd_income")
INCOME_BY_COUNTY = MapSpec("income_by_county", "county", "tract_to_msamd_income")
LIEN = MapSpec("lien", "loan_type", "lien_status")
SPECS = (OCCUPANCY, ETHNICITY, TRACT, COUNTY, MSAMD, INCOME_BY_TRACT, INCOME_BY_COUNTY, LIEN)

TRACT_SENTINEL = "-1"


def legal_occupancy(df: DataFrame) -> DataFrame:
    """Rows whose occupancy is one of the legal labels."""
    return df.filter(F.col("owner_occupancy").isin(*schema.OCCUPANCY_LABELS))


def normalised_ethnicity(df: DataFrame) -> DataFrame:
    """Lower-case ethnicity with missing markers as nulls."""
    if "applicant_ethnicity" not in df.columns:
        return df
    text = tx.normalised_or_null(F.col("applicant_ethnicity").cast("string"))
    return replaced(df, {"applicant_ethnicity": text})


@dataclass
class CleaningModel:
    """Everything learned by :func:`fit_cleaning`."""

    dropped: list[str] = field(default_factory=list)
    maps: dict[str, KeyedMap] = field(default_factory=dict)
    hotdeck: HotDeck | None = None
    compat: bool = False

    def _fill(self, df: DataFrame, *names: str, sentinel: str | None = None) -> DataFrame:
        maps = [self.maps[n] for n in names if n in self.maps]
        if not maps or maps[0].value not in df.columns:
            return df
        return filled(df, *maps, sentinel=sentinel)

    def occupancy(self, df: DataFrame, training: bool) -> DataFrame:
        df = df.drop(*self.dropped)
        df = self._fill(df, OCCUPANCY.name)
        if training and "owner_occupancy" in df.columns:
            df = legal_occupancy(df)
        return normalised_ethnicity(df)

    def labels(self, df: DataFrame) -> DataFrame:
        """The label expressions, after ethnicity has been filled by raw race."""
        out = {
            "preapproval": lambda c: tx.request_flag(c, self.compat),
            "applicant_ethnicity": lambda c: tx.coded(c, tx.ETHNICITY_CODES, tx.APPLICANT_DEFAULT_CODE, clean=True),
            "applicant_race_name_1": lambda c: tx.consolidated(c, compat=self.compat),
            "co_applicant_ethnicity": lambda c: tx.coded(c, tx.ETHNICITY_CODES, tx.CO_APPLICANT_DEFAULT_CODE),
            "co_applicant_race_name_1": lambda c: tx.consolidated(c, missing="No co-applicant", compat=self.compat),
            "applicant_sex": tx.classified,
            "co_applicant_sex": tx.classified,
        }
        return replaced(df, {c: f(F.col(c).cast("string")) for c, f in out.items() if c in df.columns})

    def transform(self, df: DataFrame, training: bool = False) -> DataFrame:
        """Clean ``df``. Only training rows are filtered by occupancy."""
        df = self.occupancy(df, training)
        df = self._fill(df, ETHNICITY.name)
        df = self.labels(df)
        df = self._fill(df, TRACT.name, sentinel=TRACT_SENTINEL)
        df = self._fill(df, COUNTY.name)
        df = self._fill(df, MSAMD.name)
        df = self._fill(df, INCOME_BY_TRACT.name, INCOME_BY_COUNTY.name)
        df = self._fill(df, LIEN.name)
        return self.hotdeck.transform(df) if self.hotdeck else df

    def save(self, spark: SparkSession, path: str) -> None:
        stored(self.maps, spark).write.mode("overwrite").parquet(f"{path}/maps")
        deck = self.hotdeck
        facts = {"dropped": self.dropped, "compat": self.compat, "specs": list(self.maps), "deck": None}
        if deck is not None and deck.columns:
            deck.donors.write.mode("overwrite").parquet(f"{path}/donors")
            facts["deck"] = {
                "columns": deck.columns,
                "buckets": deck.buckets,
                "medians": dict(deck.medians),
                "small": deck.small,
                "id_col": deck.id_col,
            }
        write_json_document(spark, f"{path}/facts", json.dumps(facts))

    @staticmethod
    def load(spark: SparkSession, path: str) -> CleaningModel:
        facts = json.loads(read_json_document(spark, f"{path}/facts"))
        wanted = [s for s in SPECS if s.name in facts["specs"]]
        maps = restored(spark.read.parquet(f"{path}/maps"), wanted)
        deck = facts["deck"] and HotDeck(donors=spark.read.parquet(f"{path}/donors"), **facts["deck"])
        return CleaningModel(facts["dropped"], maps, deck, facts["compat"])


def fit_cleaning(train: DataFrame, threshold: float = MISSING_THRESHOLD, compat: bool = False) -> CleaningModel:
    """Learn every cleaning map from ``train``."""
    model = CleaningModel(compat=compat)
    model.dropped = [c for c in high_missing_columns(train, threshold) if c not in (schema.ID, schema.TARGET)]
    model.maps.update(fit_modes(train.drop(*model.dropped), [OCCUPANCY]))

    legal = model.occupancy(train, training=True)
    with ThreadPool(2) as pool:  # the donors depend on no map, so they are gathered alongside
        deck = pool.apply_async(fit_hotdeck, (legal,)) if schema.ID in legal.columns else None
        model.maps.update(fit_modes(legal, [ETHNICITY, TRACT, LIEN]))

        kept = model._fill(legal, TRACT.name, sentinel=TRACT_SENTINEL)
        model.maps.update(fit_modes(kept, [COUNTY]))

        kept = model._fill(kept, COUNTY.name)
        means = pool.apply_async(fit_means, (kept, [INCOME_BY_TRACT, INCOME_BY_COUNTY]))
        model.maps.update(fit_modes(kept, [MSAMD]))
        model.maps.update(means.get())
        model.hotdeck = deck.get() if deck else None
    return model
