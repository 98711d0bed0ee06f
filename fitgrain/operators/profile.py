"""Profiling and exploration: missing shares, counts, bins, rates, correlation."""

from __future__ import annotations

from collections.abc import Sequence
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fitgrain import schema
from fitgrain.functions.mixing import with_scramble
from fitgrain.functions.quantiles import exact_quantiles, number
from fitgrain.operators.numeric import present, value_of

IMBALANCE_ADVICE = 3.0
MISSING_THRESHOLD = 0.5


def is_missing(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return F.col(name).isNull() | F.isnan(name)
    return F.col(name).isNull()


def _named_rows(pairs: Sequence[tuple[Column, ...]], fields: Sequence[str]) -> Column:
    """An array of structs to be exploded, one per described column."""
    return F.array(*[F.struct(*[v.alias(f) for v, f in zip(p, fields)]) for p in pairs])


def _seen(df: DataFrame, name: str) -> Column:
    """The column with NaN as null, for counting."""
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return F.nanvl(F.col(name), F.lit(None))
    return F.col(f"`{name}`")


def _counts(df: DataFrame) -> DataFrame:
    """Present values per column as ``c0, c1, ...`` and all rows as ``n``."""
    counts = [F.count(_seen(df, c)).alias(f"c{i}") for i, c in enumerate(df.columns)]
    return df.agg(F.count("*").alias("n"), *counts)


def missing_percent(df: DataFrame) -> DataFrame:
    """``(column_name, missing_pct)`` for every column, from one aggregate."""
    pairs = [
        (F.lit(c), F.try_divide((F.col("n") - F.col(f"c{i}")) * 100.0, F.col("n"))) for i, c in enumerate(df.columns)
    ]
    return _counts(df).select(F.inline(_named_rows(pairs, ("column_name", "missing_pct"))))


def missing_report(df: DataFrame, candidate_over: float = 50.0) -> DataFrame:
    """Columns with gaps, worst first, with a flag for removal candidates."""
    return (
        missing_percent(df)
        .filter("missing_pct > 0")
        .withColumn("drop_candidate", F.col("missing_pct") > candidate_over)
        .orderBy(F.desc("missing_pct"), "column_name")
    )


def high_missing_columns(df: DataFrame, threshold: float = MISSING_THRESHOLD) -> list[str]:
    """Columns whose missing share is above ``threshold``; one row reaches the driver."""
    row = _counts(df).first()
    return [c for i, c in enumerate(df.columns) if row["n"] - row[f"c{i}"] > threshold * row["n"]]


def overview(df: DataFrame) -> DataFrame:
    """One row per column with its type, the column count and the row count."""
    fields = [(F.lit(i), F.lit(f.name), F.lit(f.dataType.simpleString())) for i, f in enumerate(df.schema.fields)]
    counted = df.agg(F.count("*").alias("n_rows"))
    return counted.select(
        F.inline(_named_rows(fields, ("position", "column_name", "data_type"))),
        "n_rows",
        F.lit(len(df.columns)).alias("n_columns"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Count and percent of each non-null value."""
    counts = df.filter(~is_missing(df, column)).groupBy(column).agg(F.count("*").alias("n"))
    # The total is a scalar over the combined counts, not a window over them.
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(column, "n", F.round(F.col("n") * 100.0 / total, 2).alias("pct"))


def imbalance(df: DataFrame, column: str = schema.TARGET) -> DataFrame:
    """Largest class over smallest class, and whether weighting is advised."""
    counts = df.filter(~is_missing(df, column)).groupBy(column).agg(F.count("*").alias("n"))
    ratio = F.max("n") / F.min("n")
    return counts.agg(ratio.alias("ratio"), (ratio > IMBALANCE_ADVICE).alias("weighting_advised"))


def row_sample(df: DataFrame, n: int, seed: int = 42, id_col: str = schema.ID) -> DataFrame:
    """``n`` rows in scrambled id order: the same sample on every run and cluster."""
    return with_scramble(df, id_col, seed, "__place").orderBy("__place", id_col).limit(n).drop("__place")


def null_mask(df: DataFrame) -> DataFrame:
    """Every column replaced by whether it is missing."""
    return df.select(*[is_missing(df, c).alias(c) for c in df.columns])


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 50) -> DataFrame:
    """Equal-width bins between each column's extremes, the last one closed.

    ``(column_name, bin, bin_low, bin_high, n)``; empty bins are not listed.
    """
    names = present(df, columns)
    ends = df.agg(
        *[f(value_of(df, c)).alias(f"{t}{i}") for i, c in enumerate(names) for t, f in (("lo", F.min), ("hi", F.max))]
    ).first()
    spans = {}
    for i, c in enumerate(names):
        low, high = ends[f"lo{i}"], ends[f"hi{i}"]
        if low is not None:
            # A constant column gets the unit interval around its value.
            spans[c] = (low - 0.5, high + 0.5) if low == high else (low, high)
    entries = []
    for c, (low, high) in spans.items():
        v = value_of(df, c)
        place = F.least(F.floor((v - F.lit(low)) * F.lit(float(bins)) / F.lit(high - low)), F.lit(bins - 1)) + 1
        width = (high - low) / bins
        entries.append(
            F.when(
                v.isNotNull(),
                F.struct(F.lit(c).alias("column_name"), place.cast("int").alias("bin"), F.lit(low).alias("low"), F.lit(width).alias("width")),
            )
        )
    if not entries:
        return df.sparkSession.createDataFrame([], "column_name string, bin int, bin_low double, bin_high double, n long")
    return (
        df.select(F.explode(F.array(*entries)).alias("e"))
        .filter("e is not null")
        .groupBy("e.column_name", "e.bin", "e.low", "e.width")
        .agg(F.count("*").alias("n"))
        .select(
            "column_name",
            "bin",
            (F.col("low") + (F.col("bin") - 1) * F.col("width")).alias("bin_low"),
            (F.col("low") + F.col("bin") * F.col("width")).alias("bin_high"),
            "n",
        )
    )


def describe(df: DataFrame, columns: Sequence[str] = schema.NUMERIC) -> DataFrame:
    """Mean, sample deviation, bias-corrected skew, maximum, 99th percentile, log advice."""
    names = present(df, columns)
    q99 = exact_quantiles(df, {c: [0.99] for c in names})
    # Stacked values keep the aggregate small enough to be compiled well.
    entries = [
        F.struct(F.lit(c).alias("column_name"), value_of(df, c).alias("v"), F.lit(q99[c][0]).cast("double").alias("q99"))
        for c in names
    ]
    n = F.count("v")
    skew = F.when(n > 2, F.skewness("v") * F.sqrt(n * (n - 1.0)) / (n - 2.0))
    return (
        df.select(F.explode(F.array(*entries)).alias("e"))
        .select("e.*")
        .groupBy("column_name", "q99")
        .agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), skew.alias("skew"), F.max("v").alias("max"))
        .withColumn("log_recommended", F.abs("skew") > 1)
        .select("column_name", "mean", "std", "skew", "max", "q99", "log_recommended")
    )


def rate_by_category(
    df: DataFrame, columns: Sequence[str], target: str = schema.TARGET, top: int = 15
) -> DataFrame:
    """Mean target per category, the ``top`` highest of each column, with the overall mean.

    All columns share one scan and one shuffle of combined counts.
    """
    names = present(df, columns)
    entries = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("category")) for c in names]
    stats = (
        df.select(F.explode(F.array(*entries)).alias("e"), F.col(target).cast("double").alias("y"))
        .groupBy("e.column_name", "e.category")
        .agg(F.sum("y").alias("s"), F.count("y").alias("ny"), F.count("*").alias("n"))
    )
    # Rows with a missing category count in the overall mean but are not listed.
    overall = df.agg(F.avg(F.col(target).cast("double"))).scalar()
    order = Window.partitionBy("column_name").orderBy(F.desc("rate"), "category")
    return (
        stats.filter("category is not null and ny > 0")
        .withColumn("rate", F.col("s") / F.col("ny"))
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= top)
        .select("column_name", "place", "category", "rate", "n", overall.alias("overall_rate"))
    )


def top_rates(
    df: DataFrame, column: str, min_count: int, top: int = 20, target: str = schema.TARGET
) -> DataFrame:
    """Categories with at least ``min_count`` rows, highest mean target first."""
    return (
        df.filter(~is_missing(df, column))
        .groupBy(column)
        .agg(F.avg(target).alias("rate"), F.count(target).alias("n"))
        .filter(F.col("n") >= min_count)
        .orderBy(F.desc("rate"), column)
        .limit(top)
    )


def quantile_edges(df: DataFrame, column: str, q: int) -> list[float]:
    """Distinct quantile edges, as many as ``q + 1``."""
    edges = exact_quantiles(df, {column: [i / q for i in range(q + 1)]})[column]
    return sorted({e for e in edges if e is not None})


def quantile_bin(df: DataFrame, column: str, edges: Sequence[float]) -> Column:
    """1-based bin with right-closed edges, the first bin closed on both sides."""
    v = number(column, df.schema[column].dataType)
    chain = F.when(v.isNull() | (v < edges[0]) | (v > edges[-1]), F.lit(None).cast("int"))
    for i, high in enumerate(edges[1:], start=1):
        chain = chain.when(v <= F.lit(high), F.lit(i))
    return chain


def with_quantile_bin(df: DataFrame, column: str, q: int, into: str) -> DataFrame:
    edges = quantile_edges(df, column, q)
    if len(edges) < 2:
        return df.withColumn(into, F.lit(None).cast("int"))
    return df.withColumn(into, quantile_bin(df, column, edges))


def bin_by_target(df: DataFrame, column: str, target: str = schema.TARGET) -> DataFrame:
    """Rows per category and class, absent pairs as zero."""
    return (
        df.filter(~is_missing(df, column))
        .groupBy(column)
        .agg(
            F.count_if(F.col(target) == 0).alias("rejected"),
            F.count_if(F.col(target) == 1).alias("approved"),
        )
    )


def quartile_rates(df: DataFrame, column: str, target: str = schema.TARGET, q: int = 4) -> DataFrame:
    """Mean target per quantile bin, labelled Q1, Q2, ..."""
    binned = with_quantile_bin(df, column, q, "__bin").filter("__bin is not null")
    return binned.groupBy(F.concat(F.lit("Q"), F.col("__bin")).alias("quartile")).agg(
        F.avg(target).alias("rate"), F.count(target).alias("n")
    )


def correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair, over rows where both are present.

    An aggregate with one ``corr`` per pair is too large for the JVM to
    compile, so each task sums the products of its own rows as matrices and
    hands on one row; the sums of the tasks are then added by Spark.
    """
    names = present(df, columns)
    k = len(names)
    numbers = df.select(*[value_of(df, c).alias(c) for c in names])
    centre = [v or 0.0 for v in numbers.agg(*[F.avg(c) for c in names]).first()]

    def sums(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros((4, k, k))
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]
            x = np.column_stack(columns) - np.array(centre)
            seen = ~np.isnan(x)
            x = np.where(seen, x, 0.0)
            seen = seen.astype(float)
            total += np.stack([seen.T @ seen, x.T @ seen, (x * x).T @ seen, x.T @ x])
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()])], names=["sums"])

    parts = numbers.mapInArrow(sums, "sums array<double>")
    cells = parts.select(F.posexplode("sums").alias("cell", "v")).groupBy("cell").agg(F.sum("v").alias("v"))
    # Four sums per pair: rows, values of a, squares of a, products.
    pair = (F.col("cell") % (k * k)).alias("pair")
    which = F.floor(F.col("cell") / (k * k))
    by_pair = cells.groupBy(pair).agg(
        *[F.sum(F.when(which == i, F.col("v"))).alias(c) for i, c in enumerate(("n", "sa", "qa", "p"))]
    )
    a, b = F.floor(F.col("pair") / k), F.col("pair") % k
    mirror = by_pair.select(
        (b * k + a).alias("pair"), F.col("sa").alias("sb"), F.col("qa").alias("qb")
    )  # one row per pair
    n = F.col("n")
    spread = lambda s, q: F.col(q) - F.col(s) * F.col(s) / n
    shared = F.col("p") - F.col("sa") * F.col("sb") / n
    scale = F.sqrt(F.greatest(spread("sa", "qa"), F.lit(0.0))) * F.sqrt(F.greatest(spread("sb", "qb"), F.lit(0.0)))
    name_at = lambda i: F.get(F.array(*[F.lit(c) for c in names]), i.cast("int"))
    return by_pair.join(mirror, "pair").select(
        name_at(a).alias("column_a"),
        name_at(b).alias("column_b"),
        F.when(n > 0, F.try_divide(shared, scale)).alias("r"),
    )
