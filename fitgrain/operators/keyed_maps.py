"""Maps learned per key (group mode, group mean, target mean) and their use.

Every learned map is a table ``(key, value, n)`` plus a fallback; ``n`` counts
all rows of the key, with or without a value. All maps of
one dependency level are learned together: one scan, one shuffle of rows that
are already combined per (map, key, value).

A map of a few keys becomes a literal in the projection. One that fits the
driver is kept as rows and joined by broadcast. A larger one is written to the shared folder. Its heavy keys, at most ``HOT_SHARE`` of
them by counting, are still joined by broadcast; the rest join by shuffle, with
the rows of heavy and missing keys spread over salts so that no task gets them
all.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitgrain import schema
from fitgrain.functions.quantiles import number
from fitgrain.session import written

LITERAL_KEYS = 64
SMALL_MAP_ROWS = 200_000
SMALL_MAP_CHARS = 20_000_000
#: Rows of small maps that one job brings to the driver.
HEAD_ROWS = 50_000
HOT_SHARE = 1000
SALTS = 1024
#: Copies of each cold key of a large map, so that a key unseen in training spreads over as many tasks.
COLD_COPIES = 8

_MAP = "map string, is_global boolean, key string, value string, n long"
_names = count()


@dataclass(frozen=True)
class MapSpec:
    """What to learn: ``value`` per ``key``. ``key=None`` learns the fallback only."""

    name: str
    key: str | None
    value: str


@dataclass
class KeyedMap:
    """A learned map with its fallback, both held as text and cast on use."""

    name: str
    key: str | None
    value: str
    fallback: str | None = None
    rows: list[tuple[str, str, int]] | None = field(default_factory=list)
    table: DataFrame | None = None
    total: int | None = None

    def as_table(self, spark: SparkSession) -> DataFrame:
        """The map as ``(key, value, n)``."""
        if self.table is not None:
            return self.table
        columns = list(zip(*self.rows)) if self.rows else [[], [], []]
        types = (pa.string(), pa.string(), pa.int64())
        arrow = pa.table(
            {c: pa.array(v, t) for c, v, t in zip(("key", "value", "n"), columns, types)}
        )
        return spark.createDataFrame(arrow)

    def as_column(self, key: str, dtype: T.DataType) -> Column:
        """The mapped value as an expression, for a map of a few keys."""
        if not self.rows:
            return F.lit(None).cast(dtype)
        kind = dtype.simpleString()
        entries = ", ".join(f"{_quoted(k)}, CAST({_quoted(v)} AS {kind})" for k, v, _ in self.rows)
        return F.try_element_at(F.expr(f"map({entries})"), F.col(key).cast("string"))

    def look_up(self, df: DataFrame, key: str | None, dtype: T.DataType) -> tuple[DataFrame, Column]:
        """``df``, joined to the map where it is not a literal, and the mapped value."""
        if key not in df.columns:
            return df, F.lit(None).cast(dtype)
        if self.table is None and len(self.rows) <= LITERAL_KEYS:
            return df, self.as_column(key, dtype)
        into = f"__mapped{next(_names)}"
        table = self.as_table(df.sparkSession).withColumn("value", F.col("value").cast(dtype))
        if self.table is None:
            return _left(df, F.col(key), F.broadcast(table), into), F.col(into)
        if self.total is None:
            self.total = self.table.agg(F.sum("n")).first()[0] or 0
        return _left_split(df, key, table, self.total, into), F.col(into)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _left(df: DataFrame, key: Column, table: DataFrame, into: str) -> DataFrame:
    on = f"__key{next(_names)}"
    side = table.select(F.col("key").alias(on), F.col("value").alias(into))
    return df.join(side, key.cast("string") == F.col(on), "left").drop(on)


def _left_split(df: DataFrame, key: str, table: DataFrame, total: int, into: str) -> DataFrame:
    # Fewer than HOT_SHARE keys can each hold more than 1/HOT_SHARE of the rows, with or without a value.
    heavy = F.col("n") * HOT_SHARE > F.lit(total)
    tag = next(_names)
    hot, on_hot, is_hot = f"__hot{tag}", f"__onhot{tag}", f"__ishot{tag}"
    on, salt, row_salt = f"__on{tag}", f"__salt{tag}", f"__rowsalt{tag}"
    spread = F.col(schema.ID) if schema.ID in df.columns else F.struct(*df.columns)
    few = table.filter(heavy).select(F.col("key").alias(on_hot), F.col("value").alias(hot), F.lit(True).alias(is_hot))
    df = df.join(F.broadcast(few), F.col(key).cast("string") == F.col(on_hot), "left")
    done = F.col(key).isNull() | F.col(is_hot).isNotNull()
    # A key that training never saw may hold any share of the rows: each cold key stands COLD_COPIES times.
    cold_salt = F.pmod(F.xxhash64(spread), F.lit(COLD_COPIES))
    done_salt = COLD_COPIES + F.pmod(F.xxhash64(spread), F.lit(SALTS))
    df = df.withColumn(row_salt, F.when(done, done_salt).otherwise(cold_salt))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(COLD_COPIES - 1).cast("long"))).alias(salt)
    cold = table.filter(~heavy).select(F.col("key").alias(on), F.col("value").alias(into), copies)
    met = (F.col(key).cast("string") == F.col(on)) & (F.col(row_salt) == F.col(salt))
    # By the size of its file alone a table of many short keys would be broadcast, and every task hold all its copies.
    return (
        df.join(cold.hint("merge"), met, "left")
        .withColumn(into, F.coalesce(F.col(hot), F.col(into)))
        .drop(hot, on_hot, is_hot, on, salt, row_salt)
    )


def _usable(df: DataFrame, specs: Sequence[MapSpec]) -> list[MapSpec]:
    """Specs whose value column exists; a missing key column leaves the fallback."""
    return [
        s if s.key is None or s.key in df.columns else MapSpec(s.name, None, s.value)
        for s in specs
        if s.value in df.columns
    ]


def _stacked(df: DataFrame, specs: Sequence[MapSpec], *extra: str) -> DataFrame:
    """One row per (row, map): ``map, key, text, num`` and the extra columns."""
    entries = []
    for s in specs:
        dtype = df.schema[s.value].dataType
        num = number(s.value, dtype) if isinstance(dtype, T.NumericType) else F.lit(None).cast("double")
        key = F.col(s.key).cast("string") if s.key else F.lit(None).cast("string")
        entries.append(
            F.struct(
                F.lit(s.name).alias("map"),
                key.alias("key"),
                F.col(s.value).cast("string").alias("text"),
                num.alias("num"),
            )
        )
    return df.select(F.explode(F.array(*entries)).alias("e"), *extra).select("e.*", *extra)


def _gathered(rows: DataFrame, specs: Sequence[MapSpec], limit: int) -> dict[str, KeyedMap]:
    """The maps: in one job if all of them together are small, else from a written table.

    Large maps are computed twice: up to the bound, and then into the table.
    """
    bound = min(limit, HEAD_ROWS) + len(specs)
    head = rows.limit(bound + 1).collect()
    chars = sum(len(r["key"] or "") + len(r["value"] or "") for r in head)
    if len(head) > bound or chars > SMALL_MAP_CHARS or sum(not r["is_global"] for r in head) > limit:
        return _held(written(rows, "maps"), specs, limit)
    maps = {s.name: KeyedMap(s.name, s.key, s.value) for s in specs}
    for r in head:
        if r["is_global"]:
            maps[r["map"]].fallback = r["value"]
        elif r["value"] is not None:
            maps[r["map"]].rows.append((r["key"], r["value"], r["n"]))
    return maps


def _held(table: DataFrame, specs: Sequence[MapSpec], limit: int) -> dict[str, KeyedMap]:
    """Each map of a written table by its own size: as rows while the smaller ones fit the driver together, else a table."""
    maps = {s.name: KeyedMap(s.name, s.key, s.value) for s in specs}
    chars = F.coalesce(F.char_length("key"), F.lit(0)) + F.coalesce(F.char_length("value"), F.lit(0))
    sizes = table.filter("not is_global").groupBy("map").agg(F.count("*").alias("n"), F.sum(chars).alias("chars")).collect()
    left, chars_left, large = limit, SMALL_MAP_CHARS, []
    for r in sorted(sizes, key=lambda r: (r["n"], r["map"])):
        if r["n"] <= left and r["chars"] <= chars_left:
            left, chars_left = left - r["n"], chars_left - r["chars"]
        else:
            large.append(r["map"])
    for r in table.filter(F.col("is_global") | ~F.col("map").isin(large)).collect():
        if r["is_global"]:
            maps[r["map"]].fallback = r["value"]
        elif r["value"] is not None:
            maps[r["map"]].rows.append((r["key"], r["value"], r["n"]))
    for name in large:
        maps[name].rows = None
        maps[name].table = table.filter((F.col("map") == name) & ~F.col("is_global")).select("key", "value", "n")
    return maps


def fit_modes(df: DataFrame, specs: Sequence[MapSpec], limit: int = SMALL_MAP_ROWS) -> dict[str, KeyedMap]:
    """Most frequent non-null value per key and overall; ties take the smallest."""
    specs = _usable(df, specs)
    if not specs:
        return {}
    counts = _stacked(df, specs).groupBy("map", "key", "text", "num").agg(F.count("*").alias("n"))
    ranked = F.when(F.col("text").isNotNull(), F.struct((-F.col("n")).alias("rank"), "num", "text"))
    first = F.min(ranked)["text"].alias("value")
    modes = (
        _with_totals(counts)
        .groupBy("map", "is_global", "key", "text", "num")
        .agg(F.sum("n").alias("n"))
        .groupBy("map", "is_global", "key")
        .agg(first, F.sum("n").alias("n"))
    )
    return _gathered(modes.select("map", "is_global", "key", "value", "n"), specs, limit)


def _with_totals(combined: DataFrame) -> DataFrame:
    """Combined rows once for their key and once for the whole map.

    One pass serves both: a union of two aggregates would scan the table twice.
    """
    own = F.struct(F.lit(False).alias("is_global"), F.col("key").alias("key"))
    whole = F.struct(F.lit(True).alias("is_global"), F.lit(None).cast("string").alias("key"))
    rest = [c for c in combined.columns if c != "key"]
    twice = combined.select(*rest, F.explode(F.array(own, whole)).alias("of"))
    return twice.select(*rest, "of.*").filter("is_global or key is not null")


def fit_means(
    df: DataFrame, specs: Sequence[MapSpec], limit: int = SMALL_MAP_ROWS, of: str | None = None
) -> dict[str, KeyedMap]:
    """Mean of the value per key and overall, over non-null values.

    With ``of`` the mean of that column is taken per *value* of each spec
    (target-mean encoding), and the overall mean is that of all rows.
    """
    specs = _usable(df, specs)
    if not specs:
        return {}
    if of is None:
        long = _stacked(df, specs).select("map", "key", "num")
    else:
        long = _stacked(df, specs, of).select(
            "map", F.col("text").alias("key"), number(of, df.schema[of].dataType).alias("num")
        )
    sums = long.groupBy("map", "key").agg(F.sum("num").alias("total"), F.count("num").alias("filled"), F.count("*").alias("n"))
    mean = F.try_divide(F.col("total"), F.col("filled")).cast("string").alias("value")
    means = (
        _with_totals(sums)
        .groupBy("map", "is_global", "key")
        .agg(F.sum("total").alias("total"), F.sum("filled").alias("filled"), F.sum("n").alias("n"))
        .select("map", "is_global", "key", mean, "n")
    )
    return _gathered(means, specs, limit)


def stored(maps: dict[str, KeyedMap], spark: SparkSession) -> DataFrame:
    """All maps as one long table, for saving."""
    heads = [(m.name, True, None, m.fallback, 0) for m in maps.values()]
    small = [(m.name, False, *r) for m in maps.values() if m.rows is not None for r in m.rows]
    names = ("map", "is_global", "key", "value", "n")
    types = (pa.string(), pa.bool_(), pa.string(), pa.string(), pa.int64())
    columns = list(zip(*(heads + small))) or [[]] * 5
    table = spark.createDataFrame(
        pa.table({c: pa.array(v, t) for c, v, t in zip(names, columns, types)})
    )
    for m in maps.values():
        if m.table is not None:
            table = table.unionByName(m.table.select(F.lit(m.name).alias("map"), F.lit(False).alias("is_global"), "key", "value", "n"))
    return table


def restored(table: DataFrame, specs: Sequence[MapSpec], limit: int = SMALL_MAP_ROWS) -> dict[str, KeyedMap]:
    """Maps read back from ``stored``, by the same sizes as when they were learned."""
    return _held(table, specs, limit)


def filled(df: DataFrame, *maps: KeyedMap, sentinel: str | None = None, key: str | None = None) -> DataFrame:
    """Missing values of the maps' value column from each map in turn, then the fallback.

    ``sentinel`` replaces the learned fallback.
    """
    target = maps[0].value
    dtype = df.schema[target].dataType
    current = F.col(target)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        current = F.nanvl(current, F.lit(None))
    layout = df.columns
    offers = []
    for m in maps:
        df, found = m.look_up(df, key or m.key, dtype)
        offers.append(found)
    last = sentinel if sentinel is not None else maps[-1].fallback
    value = F.coalesce(current, *offers, F.lit(last).cast(dtype))
    return _without_joined(df.withColumn(target, value), layout)


def _without_joined(df: DataFrame, layout: Sequence[str]) -> DataFrame:
    joined = [c for c in df.columns if c not in layout]
    return df.drop(*joined) if joined else df


def encoded(df: DataFrame, maps: Sequence[KeyedMap]) -> DataFrame:
    """Each map's value column replaced by the learned mean, unseen by the overall mean."""
    layout = df.columns
    means = {}
    for m in maps:
        if m.value not in layout:
            continue
        df, found = m.look_up(df, m.value, T.DoubleType())
        means[m.value] = F.coalesce(found, F.lit(m.fallback).cast("double"))
    return _without_joined(df.withColumns(means), layout) if means else df
