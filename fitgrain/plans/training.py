"""Classifiers, training on a held-out split, and the cross-validation sweep."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    LinearSVC,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitgrain import schema
from fitgrain.operators.numeric import replaced
from fitgrain.operators.retrieve import neighbour_votes, top_k
from fitgrain.plans.cleaning import CleaningModel, fit_cleaning
from fitgrain.plans.features import FeatureModel, fit_features, require_features
from fitgrain.plans.kernel import KernelMargin
from fitgrain.plans.stopping import StoppedNetwork
from fitgrain.session import scratch_path, written
from fitgrain.sources.tables import path_exists

# Hyperparameters of the production model and the candidates.
HIDDEN_LAYERS = (100, 50)
MAX_ITER = 1000
TREES = 100
NEIGHBOURS = 5
SEED = 42
THRESHOLD = 0.5


def network(inputs: int, max_iter: int = MAX_ITER, seed: int = SEED) -> StoppedNetwork:
    """Two hidden layers of sigmoid units, trained by L-BFGS until held-out rows stop gaining."""
    return StoppedNetwork([inputs, *HIDDEN_LAYERS, 2], max_iter, seed)


def candidates(inputs: int, seed: int = SEED) -> dict[str, object]:
    """The compared classifiers. The nearest-neighbour one is handled apart."""
    return {
        "LogisticRegression": LogisticRegression(featuresCol="features", labelCol="y", maxIter=1000, regParam=0.0),
        "KNeighbors": NEIGHBOURS,
        "SVC": KernelMargin(seed=seed),
        "RandomForest": RandomForestClassifier(featuresCol="features", labelCol="y", numTrees=TREES, seed=seed),
        "MLP": network(inputs, seed=seed),
    }


def linear_margin() -> LinearSVC:
    """The margin classifier without a kernel, for tables where the radial one costs too much."""
    return LinearSVC(featuresCol="features", labelCol="y", regParam=0.01)


def _numeric(df: DataFrame, features: Sequence[str]) -> DataFrame:
    require_features(features, df)
    return replaced(df, {c: F.col(c).cast("double") for c in features})


def preparation_stages(features: Sequence[str]) -> list:
    """Mean fill, assembly and scaling of the feature columns."""
    filled = [f"__{c}" for c in features]
    return [
        Imputer(strategy="mean", inputCols=list(features), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
    ]


def fit_classifier(train: DataFrame, features: Sequence[str], classifier, target: str = schema.TARGET) -> PipelineModel:
    """Preparation and classifier fitted as one pipeline."""
    ready = _numeric(train, features).withColumn("y", F.col(target).cast("double"))
    return Pipeline(stages=[*preparation_stages(features), classifier]).fit(ready)


def neighbour_scores(
    train: DataFrame, rows: DataFrame, k: int, target: str = "y", id_col: str = schema.ID, vec: str = "features"
) -> DataFrame:
    """``(id, score)``: the share of class 1 among the ``k`` nearest training vectors."""
    store = train.select(F.col(id_col).alias("near"), vector_to_array(vec, "float32").alias("vec"), target)
    asked = rows.select(id_col, vector_to_array(vec, "float32").alias("vec"))
    hits = top_k(asked, store, k, "l2", id_col, "vec", "near", "vec")
    return neighbour_votes(hits, store, target, id_col, "near")


def scores_of(model, rows: DataFrame, *keep: str) -> DataFrame:
    """The probability of class 1 as ``score``, or the margin of a margin classifier."""
    out = model.transform(rows)
    of = "probability" if "probability" in out.columns else "rawPrediction"
    return out.select(*keep, vector_to_array(of)[1].alias("score"))


@dataclass
class TrainedModel:
    """Cleaning, features and classifier, saved and loaded as one."""

    cleaning: CleaningModel
    features: FeatureModel
    classifier: PipelineModel

    def prepared(self, df: DataFrame, training: bool = False) -> DataFrame:
        return self.features.transform(self.cleaning.transform(df, training))

    def probabilities(self, df: DataFrame) -> DataFrame:
        """``df`` as it came, with the probability of class 1; a column of that name is replaced.

        Copies of the columns travel along, so no join by id is needed and
        repeated ids stay apart. What the caller does not read is pruned.
        """
        kept = {c: f"__in_{c}" for c in df.columns if c != "probability"}
        ready = self.prepared(df.withColumns({into: F.col(f"`{c}`") for c, into in kept.items()}))
        require_features(self.features.features, ready)
        carried = [F.col(f"`{into}`") for into in kept.values()]
        out = self.classifier.transform(_numeric(ready.select(*carried, *self.features.features), self.features.features))
        as_came = [F.col(f"`{into}`").alias(c) for c, into in kept.items()]
        return out.select(*as_came, vector_to_array("probability")[1].alias("probability"))

    def save(self, spark: SparkSession, path: str) -> None:
        self.cleaning.save(spark, f"{path}/cleaning")
        self.features.save(spark, f"{path}/features")
        self.classifier.write().overwrite().save(f"{path}/classifier")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TrainedModel:
        if not path_exists(spark, f"{path}/classifier"):
            raise FileNotFoundError(f"no saved model at '{path}': train and save one first")
        return TrainedModel(
            CleaningModel.load(spark, f"{path}/cleaning"),
            FeatureModel.load(spark, f"{path}/features"),
            PipelineModel.load(f"{path}/classifier"),
        )


def train_model(
    train: DataFrame,
    classifier: Callable[[int], object] = network,
    exclude_protected: bool = True,
    target: str = schema.TARGET,
    compat: bool = False,
) -> TrainedModel:
    """Fit cleaning, features and classifier on the same training rows."""
    cleaning = fit_cleaning(train, compat=compat)
    clean = written(cleaning.transform(train, training=True), "clean")
    features = fit_features(clean, exclude_protected, target)
    # Mean fill, scaling and classifier each read it: the maps are applied once.
    ready = written(features.transform(clean).select(schema.ID, target, *features.features), "features")
    fitted = fit_classifier(ready, features.features, classifier(len(features.features)), target)
    return TrainedModel(cleaning, features, fitted)


Prepare = Callable[[DataFrame], Callable[[DataFrame, bool], DataFrame]]


def cross_validate(
    df: DataFrame,
    features: Sequence[str],
    models: Mapping[str, object],
    fold: str = "fold",
    folds: int = 5,
    target: str = schema.TARGET,
    id_col: str = schema.ID,
    prepare: Prepare | None = None,
    by_fold: Callable[[DataFrame, int], DataFrame] | None = None,
    parallelism: int = 4,
) -> DataFrame:
    """Scored validation rows ``(model, fold, id, label, score)`` of the whole sweep.

    ``prepare`` learns preprocessing from the training rows of a fold and
    returns its transform, so no fold sees its own labels; ``by_fold`` applies
    what was learned for a held-out fold before, for all folds at once. The scores are
    written once; AUC, curves and ranking are queries over that table.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "sweep")

    def ready(number: int) -> tuple[DataFrame, DataFrame]:
        """Training and validation vectors of a fold, written once for all models."""
        train, held = df.filter(F.col(fold) != number), df.filter(F.col(fold) == number)
        if prepare is not None:
            apply = prepare(train)
            train, held = apply(train, True), apply(held, False)
        if by_fold is not None:
            train, held = by_fold(train, number), by_fold(held, number)
        stages = Pipeline(stages=preparation_stages(features)).fit(_numeric(train, features))
        y = F.col(target).cast("double").alias("y")
        return tuple(
            written(stages.transform(_numeric(side, features)).select(id_col, y, "features"), f"fold{number}")
            for side in (train, held)
        )

    def run(job: tuple[int, str]) -> None:
        number, name = job
        train, held = sides[number]
        if isinstance(models[name], int):
            scored = neighbour_scores(train, held, models[name], id_col=id_col)
            scored = held.select(id_col, "y").join(scored, id_col)
        else:
            scored = scores_of(models[name].fit(train), held, id_col, "y")
        rows = scored.select(F.col(id_col).alias("id"), F.col("y").cast("int").alias("label"), "score")
        rows.write.parquet(f"{path}/model={name}/fold={number}")

    with ThreadPool(parallelism) as pool:  # a few Spark jobs at a time, as CrossValidator does
        sides = dict(enumerate(pool.map(ready, range(folds), chunksize=1)))
        pool.map(run, [(number, name) for name in models for number in range(folds)], chunksize=1)
    layout = f"id {df.schema[id_col].dataType.simpleString()}, label int, score double, model string, fold int"
    return spark.read.schema(layout).parquet(path)
