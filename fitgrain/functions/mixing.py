"""Deterministic shuffling of row ids by integer arithmetic.

Draws, splits and samples must give the same rows on every run, on every
cluster size and after a lost executor, so no random generator is used: a row's
place is a fixed scramble of its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The prime 2**31 - 1, and multipliers for it from the published
# tables of good multiplicative generators.
PRIME = 2147483647
HALF = 2147483648
MULTIPLIERS = (742938285, 950706376, 1226874159)


def as_long_id(col: Column, dtype: T.DataType) -> Column:
    """A non-negative 62-bit integer from an id of any type."""
    whole = col.cast("long") if isinstance(dtype, T.IntegralType) else F.xxhash64(col)
    return F.pmod(whole, F.lit(HALF * HALF))


def with_scramble(df: DataFrame, id_col: str, seed: int, into: str) -> DataFrame:
    """``df`` with a one-to-one scramble of the id, different for every seed.

    Three rounds over the two 31-bit halves of the id. No two ids below 2**62
    share a value, so an order by it has no ties. Each round is a column of
    its own, so that Spark computes it once.
    """
    half = F.lit(HALF)

    def stir(part: str, other: str, multiplier: int) -> Column:
        return (F.col(part) + (F.col(other) * F.lit(multiplier) + F.lit(seed)) % F.lit(PRIME)) % half

    own, high, low = f"{into}_id", f"{into}_high", f"{into}_low"
    whole = as_long_id(F.col(id_col), df.schema[id_col].dataType)
    layout = [c for c in df.columns if c != into]
    df = df.withColumn(own, whole).withColumn(high, F.shiftright(own, 31)).withColumn(low, F.col(own) % half)
    df = df.withColumn(low, stir(low, high, MULTIPLIERS[0]))
    df = df.withColumn(high, stir(high, low, MULTIPLIERS[1]))
    df = df.withColumn(low, stir(low, high, MULTIPLIERS[2]))
    return df.select(*layout, (F.col(low) * half + F.col(high)).alias(into))
