"""Numeric transforms: quantile caps, logs, fills and scaling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitgrain.functions.quantiles import exact_quantiles, number
from fitgrain.functions.sketches import approx_quantiles, sketches


def replaced(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """``df`` with some columns replaced in place."""
    return df.withColumns(dict(columns)) if columns else df


def value_of(df: DataFrame, name: str) -> Column:
    return number(name, df.schema[name].dataType)


def present(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [c for c in names if c in df.columns]


def capped_log(df: DataFrame, caps: Mapping[str, float | None]) -> DataFrame:
    """log(1 + min(value, cap)); missing stays missing."""
    out = {}
    for c, cap in caps.items():
        if c in df.columns:
            v = value_of(df, c)
            low = v if cap is None else F.least(v, F.lit(float(cap)))
            out[c] = F.when(v.isNotNull(), F.log1p(low))
    return replaced(df, out)


def constant_fill(df: DataFrame, values: Mapping[str, float | None]) -> DataFrame:
    """Missing numbers replaced by one constant per column."""
    out = {
        c: F.coalesce(value_of(df, c), F.lit(v).cast("double")) for c, v in values.items() if c in df.columns
    }
    return replaced(df, out)


def filled_log(df: DataFrame, values: Mapping[str, float | None]) -> DataFrame:
    """log(1 + value) with missing values filled first."""
    out = {
        c: F.log1p(F.coalesce(value_of(df, c), F.lit(v).cast("double")))
        for c, v in values.items()
        if c in df.columns
    }
    return replaced(df, out)


def fit_caps(df: DataFrame, columns: Sequence[str], q: float = 0.99, approx: bool = False) -> dict[str, float | None]:
    """The quantile of each column; ``approx`` takes it from one pass of sketches."""
    wanted = {c: [q] for c in present(df, columns)}
    found = approx_quantiles(sketches(df, list(wanted)), wanted) if approx and wanted else exact_quantiles(df, wanted)
    return {c: v[0] for c, v in found.items()}


def fit_medians(df: DataFrame, columns: Sequence[str], approx: bool = False) -> dict[str, float | None]:
    return fit_caps(df, columns, 0.5, approx)


def fit_column_means(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    names = present(df, columns)
    row = df.agg(*[F.avg(value_of(df, c)).alias(c) for c in names]).first()
    return row.asDict()


def fit_scales(
    df: DataFrame, columns: Sequence[str], population: bool = True
) -> dict[str, tuple[float | None, float | None]]:
    """Mean and standard deviation per column, in one pass."""
    names = present(df, columns)
    spread = F.stddev_pop if population else F.stddev_samp
    aggs = [f(value_of(df, c)).alias(f"{t}{i}") for i, c in enumerate(names) for t, f in (("m", F.avg), ("s", spread))]
    row = df.agg(*aggs).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(names)}


def scaled(df: DataFrame, scales: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """Zero mean and unit spread; a constant column is only centred."""
    out = {}
    for c, (mean, spread) in scales.items():
        if c in df.columns:
            centred = value_of(df, c) - F.lit(mean).cast("double")
            out[c] = centred / F.lit(float(spread)) if spread else centred
    return replaced(df, out)
