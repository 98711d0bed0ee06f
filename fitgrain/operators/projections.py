"""Approximate nearest-neighbour join by random projections, with exact scores and a measured recall.

Each table cuts the space by a few seeded hyperplanes; vectors on the same side
of all of them share a bucket. Queries also look into the buckets behind the
planes they are closest to. What shares a bucket is scored exactly. How many
tables there are is settled by the neighbours that a sample of the queries
really has.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fitgrain.operators.cells import sliced, unit, unpacked
from fitgrain.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RECALL = 0.9
#: What the sample's recall must exceed the wanted one by.
MARGIN = 0.03
SAMPLE = 256
MAX_TABLES = 32
PROBES = 3
#: Store rows to a bucket, on average.
BUCKET_ROWS = 64
#: Rows of either side that meet in one task.
TASK_ROWS = 20_000
SEED = 42


@dataclass
class Projections:
    """Seeded hyperplanes through the store's mean: ``bits`` for each of ``tables``."""

    mean: np.ndarray
    planes: np.ndarray
    bits: int
    tables: int
    probes: int
    metric: str
    recall: float = 0.0

    def sides(self, rows: np.ndarray) -> np.ndarray:
        """Signed distances to the planes: (row, table, bit)."""
        return ((unit(rows, self.metric) - self.mean) @ self.planes).reshape(len(rows), -1, self.bits)

    def buckets(self, sides: np.ndarray) -> np.ndarray:
        return ((sides > 0) << np.arange(self.bits)).sum(axis=2)

    def probed(self, sides: np.ndarray) -> np.ndarray:
        """The own bucket and those behind the nearest planes: (row, table, probe)."""
        own = self.buckets(sides)[:, :, None]
        near = np.argsort(np.abs(sides), axis=2, kind="stable")[:, :, : self.probes]
        return np.concatenate([own, own ^ (1 << near)], axis=2)


def fit_projections(queries: DataFrame, store: DataFrame, exact: Callable[[DataFrame, DataFrame, int], DataFrame], k: int, metric: str, recall: float = RECALL, sample: int = SAMPLE, seed: int = SEED) -> Projections:
    """Planes for the ``(s, vec)`` of a store, as many tables as the true neighbours of a sample of the queries need.

    ``exact`` finds them; vectors equal to the query, which always meet it, do
    not count. If the most tables do not reach the recall, buckets are made
    wider until they do; one bucket holds everything.
    """
    n = store.count()
    drawn = queries.orderBy(F.xxhash64("q", F.lit(seed)), "q").limit(sample)
    drawn = written(drawn.select(F.monotonically_increasing_id().alias("q"), "vec"), "sampled-queries")
    hits = exact(drawn, store, k + 1).select("q", "s")
    pairs = hits.join(drawn.withColumnRenamed("vec", "a"), "q").join(store.select("s", F.col("vec").alias("b")), "s").filter("a <> b").select("a", "b").toArrow()
    width = store.select(F.size("vec")).first()[0]
    mean = np.zeros(width)
    if metric == "l2":
        means = store.select(F.posexplode("vec").alias("at", "x")).groupBy("at").agg(F.avg("x").alias("x")).orderBy("at").toArrow()
        mean = means.column("x").to_numpy()
    bits = max(1, min(20, round(math.log2(max(2, n / BUCKET_ROWS)))))
    a, b = (unpacked(pairs, c) for c in ("a", "b"))
    while True:
        planes = np.random.default_rng(seed).normal(size=(width, MAX_TABLES * bits))
        made = Projections(mean, planes, bits, MAX_TABLES, min(PROBES, bits), metric)
        if not len(a):
            made.tables, made.planes, made.recall = 1, planes[:, :bits], 1.0
            return made
        met = (made.probed(made.sides(a)) == made.buckets(made.sides(b))[:, :, None]).any(axis=2)
        reached = np.logical_or.accumulate(met, axis=1).mean(axis=0)
        enough = np.flatnonzero(reached >= min(1.0, recall + MARGIN))
        if len(enough) or bits == 1:
            made.tables = int(enough[0]) + 1 if len(enough) else MAX_TABLES
            made.recall = float(reached[made.tables - 1])
            made.planes = planes[:, : made.tables * bits]
            return made
        bits -= 1


def approx_top_k(queries: DataFrame, store: DataFrame, k: int, made: Projections, searcher, layout: T.StructType, task_rows: int = TASK_ROWS) -> DataFrame:
    """``(q, s, score, place)``: the ``k`` best of what shares a bucket with each ``(q, vec)``, scored exactly.

    A bucket with many rows is cut into blocks by a hash of the ids, and every
    pair of blocks meets in a task of its own.
    """

    def bucketed(name: str, asks: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                sides = made.sides(unpacked(batch))
                found = made.probed(sides) if asks else made.buckets(sides)[:, :, None]
                for table in range(made.tables):
                    places = found[:, table, :]
                    row = np.repeat(np.arange(len(places)), places.shape[1])
                    sent = pa.array(row)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(sent), batch.column(1).take(sent), pa.array(np.full(len(row), table, np.int32)), pa.array(places.ravel().astype(np.int32))], [name, "vec", "table", "bucket"])

        return run

    def dealt(df: DataFrame, name: str, asks: bool) -> DataFrame:
        shape = T.StructType([df.schema[name], df.schema["vec"], T.StructField("table", T.IntegerType()), T.StructField("bucket", T.IntegerType())])
        return df.select(name, "vec").mapInArrow(bucketed(name, asks), shape)

    def blocks(df: DataFrame, into: str) -> DataFrame:
        size = F.greatest(F.lit(1), F.ceil(F.count("*") / task_rows)).cast("int")
        return df.groupBy("table", "bucket").agg(size.alias(into))

    asked, held = written(dealt(queries, "q", True), "asked-buckets"), written(dealt(store, "s", False), "held-buckets")
    shape = written(blocks(asked, "lefts").join(blocks(held, "rights"), ["table", "bucket"]), "bucket-blocks")
    again = shape.select(*[F.col(c).alias(c) for c in shape.columns])
    mine = asked.join(shape, ["table", "bucket"]).select("q", "vec", "table", "bucket", F.pmod(F.xxhash64("q"), F.col("lefts")).cast("int").alias("lb"), F.explode(F.sequence(F.lit(0), F.col("rights") - 1)).alias("rb"))
    theirs = held.join(again, ["table", "bucket"]).select("s", "vec", "table", "bucket", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("lb"), F.pmod(F.xxhash64("s"), F.col("rights")).cast("int").alias("rb"))
    names = layout.names

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        types = pa.schema([(names[0], left.schema.field("q").type), (names[1], right.schema.field("s").type), (names[2], pa.float64())])
        if not left.num_rows or not right.num_rows:
            return types.empty_table()
        ids = right.column("s").to_numpy()
        order = np.argsort(ids, kind="stable")
        at, found, values = searcher(unpacked(left), ids[order], unpacked(right)[order])
        return pa.table([left.column("q").take(pa.array(at)), pa.array(found, types.types[1]), pa.array(values)], schema=types)

    keys = ("table", "bucket", "lb", "rb")
    hits = mine.groupBy(*keys).cogroup(theirs.groupBy(*keys)).applyInArrow(run, layout).distinct()
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "s"))
    return hits.withColumn("place", place).filter(F.col("place") <= k)
