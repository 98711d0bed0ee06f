"""Evaluation queries over a deterministic score of the application table."""

from __future__ import annotations

from pyspark.sql import functions as F

from fitgrain.catalog.registry import query, rounded, with_apps
from fitgrain.operators import evaluate as ev
from fitgrain.sources.applications import applications

SCORED = ("scored", "SELECT ID, label, (ID * 7919 % 10007) / 10007.0E0 AS score, CAST((ID * 7919 % 10007) / 10007.0E0 >= 0.5 AS INT) AS pred FROM apps")
SWEEP = (
    "sweep",
    "SELECT ID, label, 'm' || m AS model, CAST(ID % 5 AS INT) AS fold, "
    "floor(((ID + m * 31) * (7919 + m * 4) % 10007) / 10.0E0) / 1001.0E0 AS score FROM apps, generate_series(0, 2) t(m)",
)
CELLS = (
    "cells",
    "SELECT count(*) FILTER (WHERE label = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp, "
    "count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp FROM scored",
)


def scored(spark, sf_dir):
    score = (F.col("ID") * 7919 % 10007) / F.lit(10007.0)
    return applications(spark, sf_dir).select("ID", "label", score.alias("score"), (score >= 0.5).cast("int").alias("Prediction"))


def sweep(spark, sf_dir):
    """Three scores and five folds of every row, with many ties."""
    m = F.col("m")
    raw = (F.col("ID") + m * 31) * (7919 + m * 4) % 10007
    return (
        applications(spark, sf_dir)
        .select("ID", "label", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("m"))
        .select(
            "ID",
            "label",
            F.concat(F.lit("m"), m).alias("model"),
            (F.col("ID") % 5).cast("int").alias("fold"),
            (F.floor(raw / F.lit(10.0)) / F.lit(1001.0)).alias("score"),
        )
    )


@query(
    "v1_confusion_matrix",
    with_apps(
        "SELECT 0 AS actual, tn AS predicted_0, fp AS predicted_1 FROM cells UNION ALL SELECT 1, fn, tp FROM cells",
        SCORED,
        CELLS,
    ),
)
def v1(spark, sf_dir):
    return ev.confusion_matrix(scored(spark, sf_dir))


@query(
    "v2_metrics",
    with_apps(
        "SELECT round((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, "
        "round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1 FROM cells",
        SCORED,
        CELLS,
    ),
)
def v2(spark, sf_dir):
    return rounded(ev.metrics(scored(spark, sf_dir)))


@query(
    "v3_class_report",
    with_apps(
        """
        SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM (
        SELECT 'Rejected' AS class, p0 AS precision, r0 AS recall, g0 AS f1, n0 AS support FROM parts
        UNION ALL SELECT 'Approved', p1, r1, g1, n1 FROM parts
        UNION ALL SELECT 'accuracy', hit, hit, hit, n0 + n1 FROM parts
        UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (g0 + g1) / 2, n0 + n1 FROM parts
        UNION ALL SELECT 'weighted avg', (p0 * n0 + p1 * n1) / (n0 + n1), (r0 * n0 + r1 * n1) / (n0 + n1), (g0 * n0 + g1 * n1) / (n0 + n1), n0 + n1 FROM parts)
        """,
        SCORED,
        CELLS,
        (
            "parts",
            "SELECT tn + fp AS n0, tp + fn AS n1, (tp + tn) / (tp + tn + fp + fn)::DOUBLE AS hit, tn / (tn + fn)::DOUBLE AS p0, tn / (tn + fp)::DOUBLE AS r0, "
            "2 * tn / (2 * tn + fn + fp)::DOUBLE AS g0, tp / (tp + fp)::DOUBLE AS p1, tp / (tp + fn)::DOUBLE AS r1, 2 * tp / (2 * tp + fp + fn)::DOUBLE AS g1 FROM cells",
        ),
    ),
)
def v3(spark, sf_dir):
    return rounded(ev.class_report(scored(spark, sf_dir)))


@query(
    "v4_auc",
    with_apps(
        "SELECT round(sum(pos * (below + neg / 2.0E0)) / (sum(pos) * sum(neg)::DOUBLE), 6) AS auc FROM "
        "(SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM "
        "(SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY score))",
        SCORED,
    ),
)
def v4(spark, sf_dir):
    return rounded(ev.auc(scored(spark, sf_dir)))


@query(
    "v4_auc_by_model_fold",
    with_apps(
        "SELECT model, fold, round(sum(pos * (below + neg / 2.0E0)) / (sum(pos) * sum(neg)::DOUBLE), 6) AS auc FROM "
        "(SELECT model, fold, pos, neg, coalesce(sum(neg) OVER (PARTITION BY model, fold ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM "
        "(SELECT model, fold, score, sum(label) AS pos, sum(1 - label) AS neg FROM sweep GROUP BY ALL)) GROUP BY model, fold",
        SWEEP,
    ),
)
def v4_by(spark, sf_dir):
    return rounded(ev.auc(sweep(spark, sf_dir), by=["model", "fold"]))


CURVE = (
    "curve",
    "SELECT score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n, "
    "lead(pos) OVER w AS np, lead(neg) OVER w AS nn, row_number() OVER w AS rn FROM "
    "(SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY score) WINDOW w AS (ORDER BY score DESC)",
)
ROC = (
    "SELECT round(threshold, 6) AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM ("
    "SELECT score AS threshold, fp / n::DOUBLE AS fpr, tp / p::DOUBLE AS tpr FROM curve {where} "
    "UNION ALL SELECT 'Infinity'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE)"
)


@query("v5_roc_curve", with_apps(ROC.format(where="WHERE rn = 1 OR np IS NULL OR np <> pos OR nn <> neg"), SCORED, CURVE))
def v5(spark, sf_dir):
    return rounded(ev.roc_curve(ev.score_steps(scored(spark, sf_dir))))


@query("v5_roc_curve_all_points", with_apps(ROC.format(where=""), SCORED, CURVE))
def v5_all(spark, sf_dir):
    return rounded(ev.roc_curve(ev.score_steps(scored(spark, sf_dir)), drop_intermediate=False))


@query(
    "v6_mean_roc",
    with_apps(
        """
        SELECT model, g AS grid_point, round(g / 99.0E0, 6) AS fpr,
          round(CASE WHEN g = 99 THEN 1.0E0 ELSE avg(y) END, 6) AS mean_tpr
        FROM (
          SELECT model, fold, g, CASE WHEN g = 0 THEN 0.0E0 ELSE
            max_tp / p + (g * n / 99.0E0 - fp) / (next_fp - fp) * (next_min - max_tp) / p END AS y
          FROM ends, (SELECT CAST(unnest(generate_series(0, 98)) AS INT) AS g)
          WHERE g * n >= fp * 99 AND g * n < next_fp * 99
          UNION ALL SELECT DISTINCT model, fold, 99, 1.0E0 FROM ends)
        GROUP BY model, g
        """,
        SWEEP,
        (
            "points",
            "SELECT model, fold, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM (SELECT model, fold, score, sum(label) AS pos, sum(1 - label) AS neg "
            "FROM sweep GROUP BY ALL) WINDOW w AS (PARTITION BY model, fold ORDER BY score DESC) UNION ALL SELECT DISTINCT model, fold, 0, 0 FROM sweep",
        ),
        (
            "ends",
            "SELECT model, fold, fp, max(tp) AS max_tp, lead(fp) OVER w AS next_fp, lead(min(tp)) OVER w AS next_min, "
            "max(max(tp)) OVER (PARTITION BY model, fold) AS p, max(fp) OVER (PARTITION BY model, fold) AS n "
            "FROM points GROUP BY model, fold, fp WINDOW w AS (PARTITION BY model, fold ORDER BY fp)",
        ),
    ),
)
def v6(spark, sf_dir):
    steps = ev.score_steps(sweep(spark, sf_dir), by=["model", "fold"])
    return rounded(ev.mean_roc(ev.interpolated_roc(steps, ["model", "fold"]), ["model"]))


@query(
    "v7_model_ranking",
    with_apps(
        "SELECT model, round(avg(auc), 6) AS mean_auc, round(stddev_pop(auc), 6) AS std_auc, "
        "CAST(row_number() OVER (ORDER BY avg(auc) DESC, model) AS INT) AS place, row_number() OVER (ORDER BY avg(auc) DESC, model) = 1 AS winner FROM ("
        "SELECT model, fold, sum(pos * (below + neg / 2.0E0)) / (sum(pos) * sum(neg)::DOUBLE) AS auc FROM "
        "(SELECT model, fold, pos, neg, coalesce(sum(neg) OVER (PARTITION BY model, fold ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM "
        "(SELECT model, fold, score, sum(label) AS pos, sum(1 - label) AS neg FROM sweep GROUP BY ALL)) GROUP BY model, fold) GROUP BY model",
        SWEEP,
    ),
)
def v7(spark, sf_dir):
    return rounded(ev.model_ranking(ev.auc(sweep(spark, sf_dir), by=["model", "fold"])))
