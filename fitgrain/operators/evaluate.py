"""Evaluation of binary scores: confusion, metrics, ROC, AUC, ranking.

Score order is global, but no window runs over the whole table: rows are first
combined per distinct score, range-partitioned by score, and summed per
partition; the running totals of the few partitions are then added to the
running sums inside each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fitgrain import schema
from fitgrain.session import written

CLASS_NAMES = ("Rejected", "Approved")
GRID = 100


def _cells(label: str, prediction: str) -> list[Column]:
    y, p = F.col(label), F.col(prediction)
    return [
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
    ]


def _ratio(a: Column, b: Column) -> Column:
    """a / b, zero where b is zero."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _f1(hits: Column, false_pos: Column, false_neg: Column) -> Column:
    return _ratio(2 * hits, 2 * hits + false_pos + false_neg)


def confusion_matrix(df: DataFrame, label: str = schema.TARGET, prediction: str = "Prediction") -> DataFrame:
    """Both rows of the matrix, also for a class that never occurs."""
    rows = F.array(
        F.struct(F.lit(0).alias("actual"), F.col("tn").alias("predicted_0"), F.col("fp").alias("predicted_1")),
        F.struct(F.lit(1).alias("actual"), F.col("fn").alias("predicted_0"), F.col("tp").alias("predicted_1")),
    )
    return df.agg(*_cells(label, prediction)).select(F.inline(rows))


def metrics(df: DataFrame, label: str = schema.TARGET, prediction: str = "Prediction", by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1, zero where undefined."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return df.groupBy(*by).agg(*_cells(label, prediction)).select(
        *by,
        _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _f1(tp, fp, fn).alias("f1"),
    )


def class_report(df: DataFrame, label: str = schema.TARGET, prediction: str = "Prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and weighted means."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    rejected = (_ratio(tn, tn + fn), _ratio(tn, tn + fp), _f1(tn, fn, fp))
    approved = (_ratio(tp, tp + fp), _ratio(tp, tp + fn), _f1(tp, fp, fn))
    n0, n1 = tn + fp, tp + fn
    macro = [(a + b) / 2 for a, b in zip(rejected, approved)]
    weighted = [_ratio(a * n0 + b * n1, n0 + n1) for a, b in zip(rejected, approved)]
    accuracy = [_ratio(tp + tn, n0 + n1)] * 3
    lines = [
        (CLASS_NAMES[0], rejected, n0),
        (CLASS_NAMES[1], approved, n1),
        ("accuracy", accuracy, n0 + n1),
        ("macro avg", macro, n0 + n1),
        ("weighted avg", weighted, n0 + n1),
    ]
    rows = [
        F.struct(
            F.lit(name).alias("class"),
            *[v.alias(f) for v, f in zip(values, ("precision", "recall", "f1"))],
            support.alias("support"),
        )
        for name, values, support in lines
    ]
    return df.agg(*_cells(label, prediction)).select(F.inline(F.array(*rows)))


def score_steps(
    df: DataFrame, label: str = schema.TARGET, score: str = "score", by: Sequence[str] = ()
) -> DataFrame:
    """One row per distinct score, best first, with the counts above it.

    Columns: ``by``, ``score``, ``pos``, ``neg`` (at this score), ``tp0``,
    ``fp0`` (strictly above), ``positives``, ``negatives`` (all), and the
    counts ``next_pos``, ``next_neg`` at the next lower score.
    """
    by = list(by)
    combined = (
        df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(*by, F.col(score).cast("double").alias("score"))
        .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    )
    # The partition number is part of the result, so it is written, not recomputed.
    placed = written(
        combined.repartitionByRange(*[F.col(c) for c in by], F.col("score").desc()).withColumn(
            "bucket", F.spark_partition_id()
        ),
        "scores",
    )
    top = F.struct(F.col("pos"), F.col("neg"))
    totals = placed.groupBy(*by, "bucket").agg(
        F.sum("pos").alias("bpos"), F.sum("neg").alias("bneg"), F.max_by(top, "score").alias("head")
    )
    # At most one row per partition and group.
    across = Window.partitionBy(*(by or [F.lit(0)])).orderBy("bucket")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*(by or [F.lit(0)]))
    offsets = totals.select(
        *by,
        "bucket",
        F.coalesce(F.sum("bpos").over(before), F.lit(0)).alias("tp_off"),
        F.coalesce(F.sum("bneg").over(before), F.lit(0)).alias("fp_off"),
        F.sum("bpos").over(whole).alias("positives"),
        F.sum("bneg").over(whole).alias("negatives"),
        F.lead("head").over(across).alias("next_head"),
    )
    if not by:
        offsets = F.broadcast(offsets)  # one row per partition
    inside = Window.partitionBy(*by, "bucket").orderBy(F.desc("score"))
    above = inside.rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(offsets, [*by, "bucket"]).select(
        *by,
        "score",
        "pos",
        "neg",
        (F.col("tp_off") + F.coalesce(F.sum("pos").over(above), F.lit(0))).alias("tp0"),
        (F.col("fp_off") + F.coalesce(F.sum("neg").over(above), F.lit(0))).alias("fp0"),
        "positives",
        "negatives",
        F.coalesce(F.lead("pos").over(inside), F.col("next_head.pos")).alias("next_pos"),
        F.coalesce(F.lead("neg").over(inside), F.col("next_head.neg")).alias("next_neg"),
    )


def auc(df: DataFrame, label: str = schema.TARGET, score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve; tied scores count one half. Null for one class only."""
    return auc_of_steps(score_steps(df, label, score, by), by)


def auc_of_steps(steps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area from the rows of :func:`score_steps`."""
    lost = F.col("negatives") - F.col("fp0") - F.col("neg") / F.lit(2.0)
    area = F.sum(F.col("pos") * lost)
    pairs = F.first("positives").cast("double") * F.first("negatives").cast("double")
    return steps.groupBy(*by).agg(F.try_divide(area, pairs).alias("auc"))


def roc_curve(steps: DataFrame, by: Sequence[str] = (), drop_intermediate: bool = True) -> DataFrame:
    """``(threshold, fpr, tpr)`` from :func:`score_steps`, with the start at (0, 0).

    ``drop_intermediate`` leaves out points between two equal steps, which lie
    on a straight line; the last point always stays.
    """
    tp, fp = F.col("tp0") + F.col("pos"), F.col("fp0") + F.col("neg")
    points = steps
    if drop_intermediate:
        first = (F.col("tp0") == 0) & (F.col("fp0") == 0)
        last = F.col("next_pos").isNull()
        bend = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
        points = steps.filter(first | last | bend)
    curve = points.select(
        *by,
        F.col("score").alias("threshold"),
        F.try_divide(fp, F.col("negatives")).alias("fpr"),
        F.try_divide(tp, F.col("positives")).alias("tpr"),
    )
    start = (
        steps.filter("tp0 = 0 and fp0 = 0")
        .select(*by, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    )
    return start.unionByName(curve)


def interpolated_roc(steps: DataFrame, by: Sequence[str], grid: int = GRID) -> DataFrame:
    """``(by, grid_point, fpr, tpr)``: every curve read on an even grid of rates.

    A step that adds negatives covers the grid points between its two rates, so
    each row computes its own points and nothing is joined.
    """
    last = grid - 1
    n, fp0, neg = F.col("negatives"), F.col("fp0"), F.col("neg")
    low = F.expr(f"(fp0 * {last} + negatives - 1) div negatives")
    high = F.expr(f"((fp0 + neg) * {last} - 1) div negatives")
    covered = steps.filter("neg > 0 and negatives > 0").withColumn("low", low).withColumn("high", high)
    points = covered.filter("low <= high").select(
        *by, "pos", "tp0", "fp0", "neg", "positives", "negatives", F.explode(F.sequence("low", "high")).alias("grid_point")
    )
    share = (F.col("grid_point") * n / F.lit(float(last)) - fp0) / neg
    value = F.try_divide(F.col("tp0") + share * F.col("pos"), F.col("positives"))
    inner = points.filter("grid_point > 0").select(*by, F.col("grid_point").cast("int"), value.alias("tpr"))
    ends = steps.filter("tp0 = 0 and fp0 = 0").select(
        *by,
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("grid_point"), F.lit(0.0).alias("tpr")),
                F.struct(F.lit(last).alias("grid_point"), F.lit(1.0).alias("tpr")),
            )
        ),
    )
    return inner.unionByName(ends).withColumn("fpr", F.col("grid_point") / F.lit(float(last)))


def mean_roc(curves: DataFrame, by: Sequence[str] = (), grid: int = GRID) -> DataFrame:
    """Mean curve over folds, ending at 1."""
    mean = F.when(F.col("grid_point") == grid - 1, 1.0).otherwise(F.col("mean"))
    return (
        curves.groupBy(*by, "grid_point", "fpr").agg(F.avg("tpr").alias("mean")).select(*by, "grid_point", "fpr", mean.alias("mean_tpr"))
    )


def model_ranking(fold_auc: DataFrame, model: str = "model", value: str = "auc") -> DataFrame:
    """Models by mean AUC over folds with population deviation, the winner first."""
    # One row per model.
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("mean_auc"), model)
    return (
        fold_auc.groupBy(model)
        .agg(F.avg(value).alias("mean_auc"), F.stddev_pop(value).alias("std_auc"))
        .withColumn("place", F.row_number().over(order))
        .withColumn("winner", F.col("place") == 1)
    )
