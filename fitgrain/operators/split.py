"""Exact stratified splits without moving the table.

Rows of a class are ordered by a scramble of their id. The id scramble at each
wanted rank is found once; the split itself is then a comparison per row.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fitgrain import schema
from fitgrain.functions.mixing import with_scramble
from fitgrain.functions.quantiles import INSIDE_LIMIT, order_statistics
from fitgrain.session import written

TEST_SHARE = 0.2
FOLDS = 5
SEED = 42
#: Up to so many classes the wanted ranks are found without moving the table; beyond it rows are ranked in place.
FEW_CLASSES = 100


def _few_classes(df: DataFrame, strata: str) -> list | None:
    classes = df.groupBy(strata).count().take(FEW_CLASSES + 1)
    return classes if len(classes) <= FEW_CLASSES else None


def _cuts(df, classes, strata, id_col, seed, cuts_of, inside_limit) -> tuple[DataFrame, dict]:
    """Rows with their scramble, and per class the scrambles at the wanted ranks."""
    mixed = with_scramble(df, id_col, seed, "__place")
    place = F.col("__place")
    values, ranks, counts = {}, {}, {}
    for i, (label, n) in enumerate(classes):
        same = F.col(strata).isNull() if label is None else F.col(strata) == F.lit(label)
        values[i] = F.when(same, place)
        ranks[i] = sorted({r for r in cuts_of(n) if 0 <= r < n})
        counts[i] = n
    at = order_statistics(mixed.select(strata, "__place"), values, ranks, counts, inside_limit)
    return mixed, {label: [at[i][r] for r in cuts_of(n) if 0 <= r < n] for i, (label, n) in enumerate(classes)}


def _ranked(df: DataFrame, strata: str, id_col: str, seed: int) -> DataFrame:
    """Rows with ``__rank`` in their class and its size ``__n``, for any number of classes of any size.

    Rows are range-partitioned by class and scramble, so a large class fills
    several partitions; its running totals over them are added to the ranks inside.
    """
    placed = with_scramble(df, id_col, seed, "__place").repartitionByRange(strata, "__place")
    placed = written(placed.withColumn("__part", F.spark_partition_id()), "split")
    sizes = placed.groupBy(F.col(strata).alias("__class"), F.col("__part").alias("__in")).agg(F.count("*").alias("__size"))
    parts = Window.partitionBy("__class").orderBy("__in")
    starts = sizes.select(
        "__class",
        "__in",
        (F.sum("__size").over(parts) - F.col("__size")).alias("__start"),
        F.sum("__size").over(Window.partitionBy("__class")).alias("__n"),
    )
    inside = F.row_number().over(Window.partitionBy("__part", strata).orderBy("__place")) - 1
    same = (F.col("__part") == F.col("__in")) & F.col(strata).eqNullSafe(F.col("__class"))
    return (
        placed.withColumn("__inside", inside)
        .join(starts, same)
        .withColumn("__rank", F.col("__start") + F.col("__inside"))
        .drop("__class", "__in", "__start", "__inside", "__part", "__place")
    )


def stratified_split(
    df: DataFrame,
    strata: str = schema.TARGET,
    share: float = TEST_SHARE,
    seed: int = SEED,
    id_col: str = schema.ID,
    into: str = "is_validation",
    inside_limit: int = INSIDE_LIMIT,
) -> DataFrame:
    """``df`` with a flag that marks exactly round(share * n) rows of every class."""
    classes = _few_classes(df, strata)
    if classes is None:
        ranked = _ranked(df, strata, id_col, seed)
        return ranked.withColumn(into, F.col("__rank") < F.floor(F.lit(share) * F.col("__n") + 0.5)).drop("__rank", "__n")
    mixed, cuts = _cuts(df, classes, strata, id_col, seed, lambda n: [math.floor(share * n + 0.5) - 1], inside_limit)
    flag = F.lit(False)
    for label, at in cuts.items():
        same = F.col(strata).isNull() if label is None else F.col(strata) == F.lit(label)
        if at:
            flag = F.when(same, F.col("__place") <= F.lit(at[0])).otherwise(flag)
    return mixed.withColumn(into, flag).drop("__place")


def stratified_folds(
    df: DataFrame,
    strata: str = schema.TARGET,
    folds: int = FOLDS,
    seed: int = SEED,
    id_col: str = schema.ID,
    into: str = "fold",
    inside_limit: int = INSIDE_LIMIT,
) -> DataFrame:
    """``df`` with a fold number; each class's fold sizes differ by at most one."""
    classes = _few_classes(df, strata)
    if classes is None:
        ranked = _ranked(df, strata, id_col, seed)
        return ranked.withColumn(into, F.expr(f"cast(__rank * {folds} div __n as int)")).drop("__rank", "__n")
    # Rank r of n belongs to fold floor(r * folds / n); these are the first ranks of folds 1, 2, ...
    starts = lambda n: [-(-i * n // folds) for i in range(1, folds)]
    mixed, cuts = _cuts(df, classes, strata, id_col, seed, starts, inside_limit)
    fold = F.lit(0)
    for label, at in cuts.items():
        same = F.col(strata).isNull() if label is None else F.col(strata) == F.lit(label)
        own = F.lit(0)
        for first in at:
            own = own + F.when(F.col("__place") >= F.lit(first), 1).otherwise(0)
        fold = F.when(same, own).otherwise(fold)
    return mixed.withColumn(into, fold.cast("int")).drop("__place")
