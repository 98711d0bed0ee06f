"""Exact order statistics and quantiles of whole columns.

``percentile`` and ``mode`` keep every distinct value of a group in one task.
Here a bounded sketch first brackets each wanted rank, an exact count confirms
the bracket, and only the values inside it are grouped and ranked.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

INSIDE_LIMIT = 1_000_000
SKETCH_ACCURACY = 10_000


@dataclass
class _Bracket:
    low: float | int | None = None
    high: float | int | None = None
    below: int = 0
    inside: int = 0
    settled: bool = False
    #: Whether the ends themselves are outside.
    above_low: bool = False
    under_high: bool = False

    def holds(self, value: Column) -> Column:
        test = value.isNotNull()
        if self.low is not None:
            test = test & (value > F.lit(self.low) if self.above_low else value >= F.lit(self.low))
        if self.high is not None:
            test = test & (value < F.lit(self.high) if self.under_high else value <= F.lit(self.high))
        return test


def order_statistics(
    df: DataFrame,
    values: Mapping[str, Column],
    ranks: Mapping[str, Sequence[int]],
    counts: Mapping[str, int],
    inside_limit: int = INSIDE_LIMIT,
) -> dict[str, dict[int, float | int]]:
    """The values at the given 0-based ranks of each named expression.

    ``counts`` are the numbers of non-null values. All expressions must have
    one type. The result is exact; the number of passes grows with the
    logarithm of the row count.
    """
    brackets = {
        (name, rank): _Bracket(inside=counts[name])
        for name in values
        for rank in ranks[name]
        if counts[name] > 0
    }
    while True:
        wide = [t for t, b in brackets.items() if not b.settled and b.inside > inside_limit]
        if not wide:
            break
        _narrow(df, values, brackets, wide)
    return _pick(df, values, brackets)


def _narrow(df, values, brackets, targets) -> None:
    """One sketch pass and one counting pass over the wide brackets."""
    margin = 2.0 / SKETCH_ACCURACY
    sketches = []
    for i, (name, rank) in enumerate(targets):
        b = brackets[name, rank]
        share = (rank - b.below) / max(b.inside - 1, 1)
        ends = F.array(F.lit(max(0.0, share - margin)), F.lit(min(1.0, share + margin)))
        inside = F.when(b.holds(values[name]), values[name])
        sketches.append(F.percentile_approx(inside, ends, SKETCH_ACCURACY).alias(f"s{i}"))
    sketch = df.agg(*sketches).first()

    tests = []
    for i, (name, rank) in enumerate(targets):
        low, high = sketch[i]
        ends = (values[name] < F.lit(low), values[name] <= F.lit(low), values[name] < F.lit(high), values[name] <= F.lit(high))
        tests += [F.count_if(test).alias(f"t{i}_{k}") for k, test in enumerate(ends)]
    seen = df.agg(*tests).first()

    for i, target in enumerate(targets):
        low, high = sketch[i]
        b, rank = brackets[target], target[1]
        under_low, to_low, under_high, to_high = seen[4 * i : 4 * i + 4]
        if rank < under_low:
            new = replace(b, high=low, under_high=True, inside=under_low - b.below)
        elif rank < to_low:
            new = _Bracket(low, low, under_low, to_low - under_low, settled=True)
        elif rank < under_high:  # between the ends, without what they hold
            new = _Bracket(low, high, to_low, under_high - to_low, above_low=True, under_high=True)
        elif rank < to_high:
            new = _Bracket(high, high, under_high, to_high - under_high, settled=True)
        else:
            new = replace(b, low=high, above_low=True, below=to_high, inside=b.below + b.inside - to_high)
        # A sketch of large integers is rounded and may not help: then what the bracket holds is ranked.
        brackets[target] = new if new.settled or new.inside < b.inside else replace(b, settled=True)


def _pick(df, values, brackets) -> dict[str, dict[int, float | int]]:
    found: dict[str, dict[int, float | int]] = {name: {} for name in values}
    slots: dict[tuple, list[int]] = {}
    for (name, rank), b in brackets.items():
        if b.low is not None and b.low == b.high:
            found[name][rank] = b.low
        else:
            slots.setdefault((name, b.low, b.high, b.below, b.above_low, b.under_high), []).append(rank)
    if not slots:
        return found
    keys = list(slots)
    offered = [
        F.when(
            _Bracket(low, high, above_low=above_low, under_high=under_high).holds(values[name]),
            F.struct(F.lit(i).alias("slot"), values[name].alias("value")),
        )
        for i, (name, low, high, _, above_low, under_high) in enumerate(keys)
    ]
    counted = (
        df.select(F.explode(F.array(*offered)).alias("e"))
        .filter("e is not null")
        .groupBy(F.col("e.slot").alias("slot"), F.col("e.value").alias("value"))
        .count()
    )
    running = F.sum("count").over(Window.partitionBy("slot").orderBy("value"))
    wanted = sorted({rank - key[3] for key, rs in slots.items() for rank in rs})
    picked = (
        counted.withColumn("upto", running)
        .groupBy("slot")
        .agg(*[F.min(F.when(F.col("upto") > r, F.col("value"))).alias(f"r{r}") for r in wanted])
        .collect()
    )
    for row in picked:
        name, _, _, below, *_ = keys[row["slot"]]
        for rank in slots[keys[row["slot"]]]:
            found[name][rank] = row[f"r{rank - below}"]
    return found


def number(name: str, dtype: T.DataType) -> Column:
    """A double with NaN read as missing."""
    col = F.col(name).cast("double")
    return F.nanvl(col, F.lit(None)) if isinstance(dtype, (T.FloatType, T.DoubleType)) else col


def exact_quantiles(
    df: DataFrame, wanted: Mapping[str, Sequence[float]], inside_limit: int = INSIDE_LIMIT
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of several columns in shared passes."""
    if not wanted:
        return {}
    values = {c: number(c, df.schema[c].dataType) for c in wanted}
    df = df.select(*wanted)
    counted = df.agg(*[F.count(values[c]).alias(c) for c in wanted]).first()
    counts = {c: counted[c] for c in wanted}
    places = {c: [q * (counts[c] - 1) for q in qs] for c, qs in wanted.items()}
    ranks = {
        c: sorted({r for p in ps for r in (math.floor(p), math.ceil(p))}) if counts[c] else []
        for c, ps in places.items()
    }
    at = order_statistics(df, values, ranks, counts, inside_limit)
    result: dict[str, list[float | None]] = {}
    for c, ps in places.items():
        if not counts[c]:
            result[c] = [None] * len(ps)
            continue
        low = [at[c][math.floor(p)] for p in ps]
        high = [at[c][math.ceil(p)] for p in ps]
        result[c] = [a + (b - a) * (p - math.floor(p)) for a, b, p in zip(low, high, ps)]
    return result
