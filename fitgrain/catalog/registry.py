"""Registration of queries, and SQL fragments shared by the checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitgrain.sources.applications import applications_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is the equivalent statement for DuckDB."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query '{name}' is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded, so that both engines show the same digits."""
    shown = [
        F.round(f"`{f.name}`", digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ]
    return df.select(*shown)


def with_apps(body: str, *steps: tuple[str, str]) -> str:
    """A statement over ``apps``, ``train`` and ``test``, after further named steps."""
    named = [
        ("apps", applications_sql()),
        ("train", "SELECT * EXCLUDE (split) FROM apps WHERE split = 'train'"),
        ("test", "SELECT * EXCLUDE (split) FROM apps WHERE split = 'test'"),
        *steps,
    ]
    return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in named) + f"\n{body}"


def mode_map_sql(source: str, key: str, value: str) -> str:
    return (
        f"SELECT k, v FROM (SELECT {key} AS k, {value} AS v, row_number() OVER (PARTITION BY {key} "
        f"ORDER BY count(*) DESC, {value}) AS rn FROM {source} WHERE {key} IS NOT NULL AND {value} IS NOT NULL "
        f"GROUP BY {key}, {value}) WHERE rn = 1"
    )


def mode_sql(source: str, value: str) -> str:
    return (
        f"(SELECT {value} FROM {source} WHERE {value} IS NOT NULL GROUP BY {value} "
        f"ORDER BY count(*) DESC, {value} LIMIT 1)"
    )


def scramble_sql(id_expr: str, seed: int) -> str:
    """The id scramble, written out."""
    h, p = 2147483648, 2147483647
    hi, lo = f"({id_expr} // {h})", f"({id_expr} % {h})"
    l1 = f"(({lo} + ({hi} * 742938285 + {seed}) % {p}) % {h})"
    h1 = f"(({hi} + ({l1} * 950706376 + {seed}) % {p}) % {h})"
    l2 = f"(({l1} + ({h1} * 1226874159 + {seed}) % {p}) % {h})"
    return f"({l2} * {h} + {h1})"


def union_sql(parts: Sequence[str]) -> str:
    return "\nUNION ALL\n".join(parts)
