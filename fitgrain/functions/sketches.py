"""Approximate quantiles from mergeable KLL sketches that are stored beside the data.

A sketch of a column is a few KB whatever the rows. Sketches of parts (days,
files, batches) are kept as a table; those of all parts, or of any choice of
them, merge without reading the rows again, and new data only adds its own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitgrain.functions.quantiles import number
from fitgrain.sources.tables import path_exists

#: Size of a sketch: the normalised rank error is about 2.3 / k ** 0.9, with probability 0.99.
ACCURACY = 400


def rank_error(k: int = ACCURACY) -> float:
    """How far a quantile's rank may be off, as a share of the rows, with probability 0.99."""
    return 2.446 / k**0.9433


def sketches(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), k: int = ACCURACY) -> DataFrame:
    """``(*by, column, n, sketch)``: one sketch a column of each part, in one pass; NaN is missing, a column without values has none.

    Rows are sketched in their tasks, so a large part costs one sketch a task.
    """
    values = {c: number(c, df.schema[c].dataType) for c in columns}
    rows = df.select(*by, *[v.alias(f"v{i}") for i, v in enumerate(values.values())])
    aggs = [a for i in range(len(values)) for a in (F.count(f"v{i}").alias(f"n{i}"), F.kll_sketch_agg_double(F.col(f"v{i}"), F.lit(k)).alias(f"s{i}"))]
    wide = rows.groupBy(*by).agg(*aggs)
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.col(f"s{i}").alias("sketch")) for i, c in enumerate(values)])).alias("e")
    return wide.select(*by, long).select(*by, "e.*").filter("n > 0")


def add_sketches(new: DataFrame, path: str) -> None:
    """Append the sketches of new parts to the table at ``path``."""
    new.write.mode("append").parquet(path)


def stored_sketches(spark: SparkSession, path: str) -> DataFrame:
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no sketches at '{path}'")
    return spark.read.parquet(path)


def merged(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, column, n, sketch)`` of many sketches; without ``by`` of all of them."""
    return parts.groupBy(*by, "column").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def quantile(share: float) -> Column:
    """The value at a share of the rows of ``sketch``."""
    return F.kll_sketch_get_quantile_double("sketch", F.lit(float(share)))


def approx_quantiles(parts: DataFrame, wanted: Mapping[str, Sequence[float]]) -> dict[str, list[float | None]]:
    """Quantiles of several columns, as ``exact_quantiles`` returns them, from stored sketches alone."""
    shares = sorted({q for qs in wanted.values() for q in qs})
    rows = merged(parts.filter(F.col("column").isin(*wanted))).select("column", *[quantile(q).alias(f"q{i}") for i, q in enumerate(shares)]).collect()
    found = {r["column"]: [r[f"q{i}"] for i in range(len(shares))] for r in rows}
    return {c: [found[c][shares.index(q)] if c in found else None for q in qs] for c, qs in wanted.items()}
