"""Nearest-neighbour search between two large tables over cells of the store.

Exact: each stored vector belongs to its nearest centre, and a cell knows its
radius. A query first searches one cell; by the triangle inequality no cell
whose centre is farther than its radius plus the k-th distance found can hold
anything nearer, so it is skipped. Cells are gathered into groups of bounded
size, and a query travels once to each group with a cell it needs.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitgrain.session import written

# Tasks get the functions of this module by value, so workers need not import the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Cells at most; centres and radii are the only part of the store on the driver.
MAX_CELLS = 4096
#: Cells to a group of the size that one task holds.
CELLS_A_GROUP = 8
#: Numbers of the vectors that one task holds of either side, at most and, of large stores, at least: pairs of smaller groups move each row too often.
GROUP_FLOATS = 4_000_000
#: Groups, at least, that a store of many cells is dealt to.
LEAST_GROUPS = 8
#: Numbers of a vector, at most, for which rows near each other are told apart from the rest; rows to such a block, and rows dealt to blocks at once.
NARROW, BLOCK_ROWS, BLOCKED_ROWS = 8, 64, 50_000
#: Digits of a score.
SCORE_DIGITS = 9
#: What rounding may take from a bound.
SLACK = 1e-5
#: The same for lifted vectors, of the longest one's length: their last number is a rounded root.
LIFTED_SLACK = 1e-3


def unpacked(table, vec: str = "vec") -> np.ndarray:
    """The matrix of an Arrow column of vectors of one length."""
    column = table.column(vec)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def unit(rows: np.ndarray, metric: str) -> np.ndarray:
    """Rows as they are compared: for the cosine, of length 1."""
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300) if metric == "cosine" else rows


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gaps = (a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1)[None, :]
    return np.sqrt(np.maximum(gaps, 0))


def differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of narrow vectors, each the same whatever rows stand beside it."""
    total = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        gap = a[:, i, None] - b[None, :, i]
        total += gap * gap
    return np.sqrt(total)


def blocks(rows: np.ndarray) -> list[np.ndarray]:
    """The numbers of rows that lie near each other: halves by their widest place, until few are left."""
    waiting, out = [np.arange(len(rows))] if len(rows) else [], []
    while waiting:
        which = waiting.pop()
        if len(which) <= BLOCK_ROWS:
            out.append(which)
            continue
        halves = np.argpartition(rows[which, np.ptp(rows[which], axis=0).argmax()], len(which) // 2)
        waiting += [which[halves[: len(which) // 2]], which[halves[len(which) // 2 :]]]
    return out


def ball(rows: np.ndarray) -> tuple[np.ndarray, float]:
    """A point amid some rows and how far the farthest of them is."""
    middle = rows.mean(axis=0, keepdims=True)
    return middle, float(differences(rows, middle).max())


def in_reach(far: np.ndarray, most: np.ndarray | float) -> np.ndarray:
    """The places of what is not farther than ``most``, with room for rounding."""
    return np.flatnonzero(far <= most * (1 + SLACK) + SLACK)


def nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, of equally near ones the first, and how far it is.

    Narrow rows near each other are compared only with the centres that the
    triangle inequality leaves them.
    """
    at, gap = np.zeros(len(rows), np.int64), np.zeros(len(rows))
    if centres.shape[1] > NARROW:
        for lo in range(0, len(rows), 1000):
            gaps = distances(rows[lo : lo + 1000], centres)
            first = np.argmin(gaps, axis=1)
            at[lo : lo + 1000], gap[lo : lo + 1000] = first, gaps[np.arange(len(first)), first]
        return at, gap
    for which in blocks(rows):
        middle, radius = ball(rows[which])
        far = differences(middle, centres)[0]
        near = in_reach(far, far.min() + 2 * radius)
        gaps = differences(rows[which], centres[near])
        first = np.argmin(gaps, axis=1)
        at[which], gap[which] = near[first], gaps[np.arange(len(which)), first]
    return at, gap


def narrow_searcher(k: int, otherwise, digits: int):
    """A function as ``otherwise``, for the distance: ``(queries, ids, vectors) -> (row, id, value)``, ``ids`` ascending.

    Narrow queries near each other meet only the stored rows that can be among
    their k nearest: some rows near both bound how far these are.
    """

    def search(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not len(queries) or len(ids) <= max(k, 4 * BLOCK_ROWS) or vectors.shape[1] > NARROW:
            return otherwise(queries, ids, vectors)
        held = blocks(vectors)
        balls = [ball(vectors[which]) for which in held]
        middles, radii, sizes = np.concatenate([m for m, _ in balls]), np.array([r for _, r in balls]), np.array([len(which) for which in held])
        found, values = np.zeros((len(queries), k), ids.dtype), np.zeros((len(queries), k))
        for which in blocks(queries):
            middle, radius = ball(queries[which])
            far = differences(middle, middles)[0]
            by_end = np.argsort(far + radii)
            some = np.concatenate([held[b] for b in by_end[: np.searchsorted(np.cumsum(sizes[by_end]), k) + 1]])
            last = np.partition(differences(queries[which], vectors[some]), k - 1, axis=1)[:, k - 1].max()
            met = np.sort(np.concatenate([held[b] for b in in_reach(far - radii, last + radius)]))
            scores = np.round(-differences(queries[which], vectors[met]), digits)
            least = np.partition(scores, len(met) - k, axis=1)[:, len(met) - k]
            row, place = np.nonzero(scores >= least[:, None])  # by row, ids ascending
            order = np.lexsort((place, -scores[row, place], row))
            nth = np.arange(len(row)) - np.searchsorted(row, row, side="left")
            row, place = row[order][nth < k], place[order][nth < k]
            found[which], values[which] = ids[met[place]].reshape(-1, k), scores[row, place].reshape(-1, k)
        return np.repeat(np.arange(len(queries)), k), found.ravel(), values.ravel()

    return search


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches small enough to hold a distance to every centre for each row."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def gathered(batches: Iterator[pa.RecordBatch], rows: int = BLOCKED_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of about as many rows, made of smaller ones."""
    held = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _best(at: np.ndarray, found: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    """The places of the k best (row, id, value) entries of each row; equal values rank by id."""
    order = np.lexsort((np.unique(found, return_inverse=True)[1], -values, at))
    place = np.arange(len(at)) - np.searchsorted(at[order], at[order], side="left")
    return order[place < k]


def squared_length(vec: str) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))


def lifted(store: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """Both sides with one number more, by which nearest is what has the largest inner product, and the largest squared length.

    All stored vectors get the length of the longest; queries get 0.
    """
    most = store.agg(F.max(squared_length("vec"))).first()[0]
    rest = F.sqrt(F.greatest(F.lit(0.0), F.lit(most) - squared_length("vec"))).cast("float")
    zero = F.lit(0.0).cast("float")
    return store.withColumn("vec", F.concat("vec", F.array(rest))), queries.withColumn("vec", F.concat("vec", F.array(zero))), float(most)


@dataclass
class Cells:
    """The part of an index that tasks need: per cell its centre, radius, size and group.

    ``lift`` is the largest squared length of a lifted store, else 0.
    """

    centres: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray
    groups: np.ndarray
    metric: str
    lift: float = 0.0

    def needed(self, batch: pa.RecordBatch, bounds: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the cells each query of a batch needs, in order: the first one to search, or all others that its bound does not rule out."""
        rows, used = unit(unpacked(batch), self.metric), np.flatnonzero(self.sizes)
        centres, radii = self.centres[used], self.radii[used]
        first, _ = nearest(rows, centres)
        if bounds is None:
            return np.arange(len(first)), used[first]
        slack = SLACK + LIFTED_SLACK * np.sqrt(self.lift)
        ends = bounds * (1 + SLACK) + slack
        found = []
        narrow = centres.shape[1] <= NARROW
        for which in blocks(rows) if narrow else np.split(np.arange(len(rows)), range(1000, len(rows), 1000)):
            if narrow:
                middle, radius = ball(rows[which])
                near = in_reach(differences(middle, centres)[0] - radii, ends[which].max() + radius)
                gaps = differences(rows[which], centres[near])
            else:
                near, gaps = np.arange(len(used)), distances(rows[which], centres)
            row, cell = np.nonzero((gaps - radii[None, near] <= ends[which, None]) & (near[None, :] != first[which, None]))
            found.append((which[row], used[near[cell]]))
        row, cell = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))
        order = np.lexsort((cell, row))
        return row[order], cell[order]

    def batches(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """As many rows at a time as are compared with the cells: the more narrow ones, the nearer they lie to each other."""
        return gathered(batches) if self.centres.shape[1] <= NARROW else sliced(batches)


@dataclass
class CellIndex:
    """A store dealt out to cells: ``(s, vec, cell)``."""

    rows: DataFrame
    cells: Cells
    group_rows: int

    def _visits(self, queries: DataFrame, bounded: bool) -> DataFrame:
        """``(q, vec, group, cells)``: each group that a query goes to and the cells it needs there."""
        layout = T.StructType([queries.schema["q"], queries.schema["vec"], T.StructField("group", T.LongType()), T.StructField("cells", T.ArrayType(T.IntegerType()))])
        cells, groups = self.cells, self.cells.groups

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in cells.batches(batches):
                row, cell = cells.needed(batch, np.asarray(batch.column(2)) if bounded else None)
                if not len(row):
                    continue
                new = np.concatenate([[True], (row[1:] != row[:-1]) | (groups[cell[1:]] != groups[cell[:-1]])])
                starts = np.flatnonzero(new)
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)).astype(np.int32)), pa.array(cell.astype(np.int32)))
                sent = pa.array(row[starts])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(sent), batch.column(1).take(sent), pa.array(groups[cell[starts]]), lists], layout.names)

        return queries.mapInArrow(run, layout)

    def _met(self, visits: DataFrame, k: int, searcher, layout: T.StructType) -> DataFrame:
        """The k best of each query in each group it goes to. A group's queries are dealt to several tasks if they are many."""
        if self.cells.metric == "l2":
            searcher = narrow_searcher(k, searcher, SCORE_DIGITS)
        visits = written(visits, "visits")
        counts = visits.groupBy("group").agg(F.count("*").alias("n"))
        tasks = F.greatest(F.lit(1), F.ceil(F.col("n") / self.group_rows)).cast("int").alias("tasks")
        spread = written(counts.select("group", tasks), "visit-tasks")
        again = spread.select(F.col("group").alias("group"), F.col("tasks").alias("tasks"))
        mine = visits.join(F.broadcast(spread), "group").select("q", "vec", "cells", "group", F.pmod(F.xxhash64("q"), F.col("tasks")).cast("int").alias("task"))
        theirs = self._numbered().join(F.broadcast(again), "group").select("s", "vec", "cell", "group", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"))
        names = layout.names

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            types = pa.schema([(names[0], left.schema.field("q").type), (names[1], right.schema.field("s").type), (names[2], pa.float64())])
            if not left.num_rows or not right.num_rows:
                return types.empty_table()
            order = np.lexsort((np.unique(right.column("s").to_numpy(), return_inverse=True)[1], right.column("cell").to_numpy()))
            right = right.take(pa.array(order))
            ids, cells, rows = right.column("s").to_numpy(), right.column("cell").to_numpy(), unpacked(right)
            queries, wanted = unpacked(left), left.column("cells").combine_chunks()
            asked = np.repeat(np.arange(left.num_rows), np.diff(wanted.offsets.to_numpy()))
            wanted = wanted.flatten().to_numpy()
            parts = []
            for cell in np.unique(wanted):
                lo, hi = np.searchsorted(cells, [cell, cell + 1])
                which = asked[wanted == cell]
                at, found, values = searcher(queries[which], ids[lo:hi], rows[lo:hi])
                parts.append((which[at], found, values))
            at, found, values = (np.concatenate(x) for x in zip(*parts))
            kept = _best(at, found, values, k)
            return pa.table([left.column("q").take(pa.array(at[kept])), pa.array(found[kept], types.types[1]), pa.array(values[kept])], schema=types)

        return mine.groupBy("group", "task").cogroup(theirs.groupBy("group", "task")).applyInArrow(run, layout)

    def _numbered(self) -> DataFrame:
        groups = self.rows.sparkSession.createDataFrame(pa.table({"cell": pa.array(np.arange(len(self.cells.sizes), dtype=np.int32)), "group": pa.array(self.cells.groups)}))
        return self.rows.join(F.broadcast(groups), "cell")

    def search(self, queries: DataFrame, k: int, searcher, layout: T.StructType) -> DataFrame:
        """``(q, s, score)``: for each query at least its k best, from the cells it needs."""
        first = written(self.first_hits(queries, k, searcher, layout), "first-hits")
        bounded = self.bounded(queries, first, k)
        return first.unionByName(self._met(self._visits(bounded, True), k, searcher, layout))

    def first_hits(self, queries: DataFrame, k: int, searcher, layout: T.StructType) -> DataFrame:
        """The k best of each query in its nearest cell."""
        return self._met(self._visits(queries, False), k, searcher, layout)

    def bounded(self, queries: DataFrame, first: DataFrame, k: int) -> DataFrame:
        """``(q, vec, bound)``: how far from each query its k-th best can be, by what it found first."""
        last = first.groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        if self.cells.metric == "l2":
            away = -F.col("least")
        elif self.cells.metric == "dot":  # the squared distance of a query to a lifted vector
            away = F.sqrt(F.greatest(F.lit(0.0), squared_length("vec") + self.cells.lift - 2 * F.col("least")))
        else:
            away = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("least")))
        far = F.when(F.col("n") >= k, away).otherwise(F.lit(float("inf")))
        return written(queries.join(last, "q").select("q", "vec", far.alias("bound")), "bounded-queries")

    def compared(self, bounded: DataFrame) -> DataFrame:
        """``(q, compared)``: how many stored vectors each query meets, of all there are."""
        layout = T.StructType([bounded.schema["q"], T.StructField("compared", T.LongType())])
        cells = self.cells

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in cells.batches(batches):
                met = np.zeros(batch.num_rows, np.int64)
                for row, cell in (cells.needed(batch, None), cells.needed(batch, np.asarray(batch.column(2)))):
                    met += np.bincount(row, cells.sizes[cell], batch.num_rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(met)], layout.names)

        return bounded.mapInArrow(run, layout)


def group_size(group_rows: int, n_store: int, width: int) -> int:
    """Rows of either side that meet in one task.

    Each row is moved once for every group of the other side, so what is
    shuffled falls with the size; what a task holds stays bounded.
    """
    most = max(1, GROUP_FLOATS // max(1, width))
    return min(most, max(1, group_rows, n_store // LEAST_GROUPS))


def fit_cells(store: DataFrame, n_store: int, metric: str, group_rows: int, cells: int | None = None, lift: float = 0.0) -> CellIndex:
    """Deal the ``(s, vec)`` of a store, lifted for inner products, to the cells of centres drawn from it and moved once to their cells' means."""
    wanted = cells or min(MAX_CELLS, max(2, CELLS_A_GROUP * -(-n_store // group_rows)), max(2, group_rows))
    drawn = store.orderBy(F.xxhash64("s"), "s").limit(wanted).select("vec").toArrow()
    centres = unit(unpacked(drawn), metric)

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, sizes = np.zeros(centres.shape), np.zeros(len(centres), np.int64)
        for batch in gathered(batches) if centres.shape[1] <= NARROW else sliced(batches):
            rows = unit(unpacked(batch), metric)
            cell, _ = nearest(rows, centres)
            np.add.at(sums, cell, rows)
            sizes += np.bincount(cell, minlength=len(centres))
        used = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(sizes[used]), pa.array(list(sums[used]), pa.list_(pa.float64()))], ["cell", "n", "sum"])

    parts = store.select("vec").mapInArrow(means, "cell int, n long, sum array<double>")
    sums = parts.select("cell", "n", F.posexplode("sum").alias("at", "x")).groupBy("cell", "at").agg((F.sum("x") / F.sum("n")).alias("x"))
    moved = sums.orderBy("cell", "at").toArrow()
    centres = moved.column("x").to_numpy().reshape(-1, centres.shape[1])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches) if centres.shape[1] <= NARROW else sliced(batches):
            cell, gap = nearest(unit(unpacked(batch), metric), centres)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(gap)], ["s", "vec", "cell", "gap"])

    layout = T.StructType([store.schema["s"], store.schema["vec"], T.StructField("cell", T.IntegerType()), T.StructField("gap", T.DoubleType())])
    rows = written(store.select("s", "vec").mapInArrow(dealt, layout), "cells")
    facts = rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("radius")).toArrow()
    radii, sizes = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    at = facts.column("cell").to_numpy()
    radii[at], sizes[at] = facts.column("radius").to_numpy(), facts.column("n").to_numpy()
    held = group_size(group_rows, n_store, centres.shape[1])
    groups = np.concatenate([[0], (np.cumsum(sizes) // held)[:-1]]).astype(np.int64)
    return CellIndex(rows.drop("gap"), Cells(centres, radii, sizes, groups, metric, lift), held)
