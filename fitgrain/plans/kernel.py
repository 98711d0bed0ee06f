"""A margin classifier with a radial kernel, approximated by random Fourier features, and a probability."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.base import Estimator, Model
from pyspark.ml.classification import LinearSVC, LinearSVCModel, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitgrain.plans.stopping import held_parts

# Tasks get the functions of this module by value, so workers need not import the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

COMPONENTS = 256
PENALTY = 1e-4


def waves(width: int, components: int, gamma: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeded frequencies and phases whose cosines' products approximate ``exp(-gamma * distance ** 2)``."""
    draw = np.random.default_rng(seed)
    return draw.normal(0, np.sqrt(2 * gamma), (width, components)), draw.uniform(0, 2 * np.pi, components)


def mapped(features: Column, frequencies: np.ndarray, phases: np.ndarray) -> Column:
    """The Fourier features of a vector column, a batch at a time."""

    @F.pandas_udf("array<double>")
    def cosines(rows: pd.Series) -> pd.Series:
        if not len(rows):
            return rows
        return pd.Series(list(np.sqrt(2 / len(phases)) * np.cos(np.stack(rows.to_numpy()) @ frequencies + phases)))

    return array_to_vector(cosines(vector_to_array(features)))


class KernelMargin(Estimator):
    """A linear margin in the space of random Fourier features, and a sigmoid of it fitted on rows it was not trained on.

    ``gamma`` is one over the number of features, which suits scaled ones. A
    tenth of the rows, by a scramble of their ids, fits the sigmoid.
    """

    def __init__(self, components: int = COMPONENTS, gamma: float | None = None, penalty: float = PENALTY, seed: int = 42, id_col: str = "ID", label: str = "y", features: str = "features") -> None:
        super().__init__()
        self.components, self.gamma, self.penalty, self.seed, self.id_col, self.label, self.features = components, gamma, penalty, seed, id_col, label, features

    def _fit(self, dataset: DataFrame) -> KernelMarginModel:
        train, held = held_parts(dataset, self.features, self.label, self.id_col)
        width = train.select(F.size(vector_to_array(self.features))).first()[0]
        frequencies, phases = waves(width, self.components, self.gamma or 1 / width, self.seed)
        space = lambda df: df.withColumn("__waves", mapped(F.col(self.features), frequencies, phases))
        svc = LinearSVC(featuresCol="__waves", labelCol=self.label, rawPredictionCol="__margins", predictionCol="__side", regParam=self.penalty, standardization=False)
        svc = svc.fit(space(train))
        margins = svc.transform(space(held)).select(self.label, vector_to_array("__margins")[1].alias("margin"))
        margins = VectorAssembler(inputCols=["margin"], outputCol="margins").transform(margins)
        sigmoid = LogisticRegression(featuresCol="margins", labelCol=self.label).fit(margins)
        # A held-out part of one class has no slope of its own; the margin itself is taken then.
        slope = float(sigmoid.coefficients[0]) if sigmoid.numClasses == 2 and sigmoid.coefficients[0] > 0 else 1.0
        return KernelMarginModel(svc, frequencies, phases, slope, float(sigmoid.intercept) if slope != 1.0 else 0.0, self.features)


class KernelMarginModel(Model):
    """Margin, probability and prediction of each row."""

    def __init__(self, svc: LinearSVCModel, frequencies: np.ndarray, phases: np.ndarray, slope: float, intercept: float, features: str) -> None:
        super().__init__()
        self.svc, self.frequencies, self.phases, self.slope, self.intercept, self.features = svc, frequencies, phases, slope, intercept, features

    def _transform(self, dataset: DataFrame) -> DataFrame:
        placed = dataset.withColumn("__waves", mapped(F.col(self.features), self.frequencies, self.phases))
        margin = vector_to_array("__margins")[1]
        p = 1 / (1 + F.exp(-(margin * self.slope + self.intercept)))
        scored = self.svc.transform(placed).withColumn("margin", margin).withColumn("__p", p)
        out = scored.withColumn("probability", array_to_vector(F.array(1 - F.col("__p"), F.col("__p")))).withColumn("prediction", (F.col("__p") >= 0.5).cast("double"))
        return out.drop("__waves", "__margins", "__side", "__p")
