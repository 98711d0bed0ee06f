"""SimHash near-dedup: generalised pigeonhole search over correlated bit groups with thresholds allocated by cost."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitgrain.llm.common import raw, release_worker, texts
from fitgrain.llm.components import components
from fitgrain.session import written

SHINGLE = 3
DISTANCE = 3
SEED = 42
BITS = 64
#: Parts by the number of distinct fingerprints: fewer and wider ones keep their buckets small.
PARTS = ((4_000_000, 4), (500_000_000, 3), (float("inf"), 2))
#: Bits of a part whose values are counted to estimate candidates: 65,536 counts a part at most.
COUNTED_BITS = 16
#: What a probe costs, in candidates compared.
PROBE_COST = 4.0
#: Fingerprints from which the correlation of bits is measured: it only shapes the partitions, never the result.
SAMPLE = 20_000
#: Fingerprints that share a part's value are compared with each other up to this count;
#: beyond it they meet at neighbouring fingerprints, whose number does not grow with the group.
BUCKET = 4096

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BIT_BYTES = 4096


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of one UTF-8 text; 0 without words."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    n = max(len(words) - shingle + 1, 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, n, _BIT_BYTES):
        ones += np.unpackbits(hashes[k : k + _BIT_BYTES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, row_col: str | None = None) -> DataFrame:
    """``(doc_id, fp)`` of each row, the 64 bits as a signed integer, and the long ``row_col`` if one is named."""
    more = [row_col] if row_col else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker()
        for batch in batches:
            found = np.fromiter((fingerprint(t, shingle) for t in raw(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found.view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *more])

    return texts(documents, id_col, text_col, *more).mapInArrow(run, ", ".join(["doc_id long, fp long", *(f"`{c}` long" for c in more)]))


def bit_groups(sample: np.ndarray, parts: int = 4) -> list[list[int]]:
    """Bits in groups of equal size, correlated bits together: each group grows by the bit that goes best with it."""
    sample = sample if len(sample) else np.zeros(1, np.uint64)
    bits = (sample[:, None] >> np.arange(BITS, dtype=np.uint64) & np.uint64(1)).astype(float)
    spread = bits.std(axis=0)
    centred = (bits - bits.mean(axis=0)) / np.where(spread > 0, spread, 1)
    likeness = np.abs(centred.T @ centred) / max(len(sample), 1)
    left, groups = set(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        first = min(left, key=lambda b: (-likeness[b, list(left)].sum(), b))
        group = [first]
        left.remove(first)
        while len(group) < size:
            best = min(left, key=lambda b: (-likeness[b, group].sum(), b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def value_of(fp: str, bits: list[int]) -> str:
    """SQL for the bits of a group, packed."""
    return " | ".join(f"shiftleft(shiftright({fp}, {b}) & 1L, {k})" for k, b in enumerate(bits))


def counted(bits: list[int]) -> list[int]:
    """The bits of a part that its counts go by: all of a narrow one."""
    return bits[:: -(-len(bits) // COUNTED_BITS)][:COUNTED_BITS]


def estimates(counts: np.ndarray, width: int, most: int) -> np.ndarray:
    """Cost of each counted value at thresholds -1, 0, … ``most``: probes and the candidates they bring."""
    narrow = len(counts).bit_length() - 1
    near = [counts.astype(float)]
    places = np.arange(len(counts))
    for radius in range(1, most + 1):
        near.append(sum((counts[places ^ sum(1 << f for f in flips)] for flips in combinations(range(narrow), radius)), np.zeros(len(counts))) if radius <= 2 else np.full(len(counts), counts.sum(), float))
    out = [np.zeros(len(counts))]
    for t in range(most + 1):
        share = 0.5 ** (width - narrow)
        candidates = sum(near[r] * comb(width, r) / comb(narrow, r) * share for r in range(t + 1))
        out.append(candidates + PROBE_COST * sum(comb(width, r) for r in range(t + 1)))
    return np.stack(out)


def allocate(costs: list[np.ndarray], distance: int = DISTANCE) -> np.ndarray:
    """For each row the thresholds of least cost, one a part; ``costs[k][t + 1]`` are the rows' costs of threshold t in part k.

    Dynamic programming over the parts; the state is the sum of thresholds so
    far. They must add up to ``distance - parts + 1``: by the generalised
    pigeonhole principle the least sum that loses no pair. -1 skips a part.
    """
    parts, rows = len(costs), costs[0].shape[1]
    target = distance - parts + 1
    best = {0: (np.zeros(rows), np.zeros((rows, 0), np.int8))}
    for k, own in enumerate(costs):
        step: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for total, (cost, chosen) in best.items():
            for t in range(-1, len(own) - 1):
                if total + t - (parts - k - 1) > target:
                    continue
                new = cost + own[t + 1]
                path = np.column_stack([chosen, np.full(rows, t, np.int8)])
                if total + t in step:
                    old, old_path = step[total + t]
                    better = new < old
                    step[total + t] = np.where(better, new, old), np.where(better[:, None], path, old_path)
                else:
                    step[total + t] = new, path
        best = step
    return best[target][1]


def packed(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.int64)
    for k, b in enumerate(bits):
        out |= (fps >> np.uint64(b) & np.uint64(1)).astype(np.int64) << k
    return out


def packed_sql(fp: str, bits: list[int]) -> str:
    return " | ".join(f"shiftleft(shiftright({fp}, {b}) & 1L, {k})" for k, b in enumerate(bits))


def parted(distinct: DataFrame, groups: list[list[int]]) -> DataFrame:
    """``(part, value, fp)``: the value of each part of each fingerprint."""
    parts = ", ".join(f"struct({k} AS part, {packed_sql('fp', bits)} AS value)" for k, bits in enumerate(groups))
    return distinct.select("fp", F.explode(F.expr(f"array({parts})")).alias("p")).select("p.part", "p.value", "fp")


def probes(distinct: DataFrame, groups: list[list[int]], costs: list[np.ndarray], distance: int) -> DataFrame:
    """``(part, value, fp)``: all values within the threshold that each fingerprint's parts are allocated."""
    sent = distinct.sparkSession.sparkContext.broadcast(costs)
    flips = [{t: np.array([sum(1 << f for f in c) for r in range(t + 1) for c in combinations(range(len(bits)), r)], np.int64) for t in range(distance + 1)} for bits in groups]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = np.asarray(batch.column(0))
            for lo in range(0, len(signed), 5000):
                some = signed[lo : lo + 5000]
                fps = some.view(np.uint64)
                chosen = allocate([c[:, packed(fps, counted(bits))] for c, bits in zip(sent.value, groups)], distance)
                for k, bits in enumerate(groups):
                    values = packed(fps, bits)
                    for t in np.unique(chosen[:, k]):
                        if t >= 0:
                            rows = np.flatnonzero(chosen[:, k] == t)
                            near = values[rows][:, None] ^ flips[k][int(t)][None, :]
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(near.size, k, np.int32)), pa.array(near.ravel()), pa.array(np.repeat(some[rows], near.shape[1]))], ["part", "value", "fp"])

    return distinct.mapInArrow(run, "part int, value long, fp long")


def masks(distance: int) -> list[int]:
    """All changes of up to ``distance`` bits, as signed integers."""
    found = [sum(1 << b for b in c) for r in range(distance + 1) for c in combinations(range(BITS), r)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in found]


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``(a, b)`` fingerprints ``distance`` bits apart or less, enough of them to connect all that such links connect.

    Small buckets give each link of theirs. In a bucket of more than ``BUCKET``
    fingerprints all that lie around one middle (one bit off on the indexed
    side, the rest on the probing side) link to the smallest of them: a number
    that grows with the bucket, not with its square.
    """
    n = distinct.count()
    parts = next(p for most, p in PARTS if n <= most)
    sample = distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toArrow()["fp"].to_numpy().astype(np.int64).view(np.uint64)
    groups = bit_groups(sample, parts)
    histogram = parted(distinct, [counted(bits) for bits in groups]).groupBy("part", "value").count().toArrow()
    part, value, count = (histogram[c].to_numpy().astype(np.int64) for c in ("part", "value", "count"))
    costs = []
    for k, bits in enumerate(groups):
        counts = np.zeros(1 << len(counted(bits)), np.int64)
        counts[value[part == k]] = count[part == k]
        costs.append(estimates(counts, len(bits), distance))
    index = parted(distinct, groups)
    asked = written(probes(distinct, groups, costs, distance), "probes")
    full = written(index.groupBy("part", "value").count().where(F.col("count") > BUCKET).select("part", "value"), "full-buckets")
    near = F.expr(f"bit_count(x.fp ^ y.fp) <= {distance} AND x.fp <> y.fp")
    if full.isEmpty():
        return asked.alias("x").join(index.alias("y"), (F.col("x.part") == F.col("y.part")) & (F.col("x.value") == F.col("y.value")) & near).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    small = index.join(full, ["part", "value"], "left_anti")
    found = asked.alias("x").join(small.alias("y"), (F.col("x.part") == F.col("y.part")) & (F.col("x.value") == F.col("y.value")) & near).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))

    def around(df: DataFrame, bits: int) -> DataFrame:
        changes = F.array(*[F.lit(m).cast("long") for m in masks(bits)])
        return df.select("fp", F.explode(F.transform(changes, lambda m: F.col("fp").bitwiseXOR(m))).alias("middle"))

    held = around(index.join(full, ["part", "value"], "left_semi").select("fp").distinct(), 1)
    centres = written(held.groupBy("middle").agg(F.min("fp").alias("b")), "middles")
    looking = asked.join(full, ["part", "value"], "left_semi").select("fp").distinct()
    ends = held.unionByName(around(looking, distance - 1)).join(centres, "middle").select(F.col("fp").alias("a"), "b").distinct()
    return found.unionByName(ends.where(F.col("a") != F.col("b")))


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, row_col: str | None = None) -> DataFrame:
    """``(doc_id, fp, component_id)``, and ``row_col`` if one is named: each row's fingerprint and the smallest id it reaches over links.

    Words are runs without white space, A-Z lower-cased; fewer words than a
    shingle are one shingle; null, empty and blank texts have fingerprint 0 and link to each
    other and to what is near 0. Equal fingerprints, repeated rows among them, are
    one node. A row without an id gets the smallest id of its component, which
    is null if none has one. An empty table gives no rows.
    """
    docs = written(fingerprints(documents, id_col, text_col, shingle, row_col), "fingerprints")
    nodes = written(docs.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = components(links(nodes.select("fp"), distance))
    linked = nodes.join(roots, F.col("fp") == F.col("node")).select("fp", "first", "root")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    named = linked.join(least, "root").select("fp", "least")
    firsts = written(nodes.join(named, "fp", "left").select("fp", F.when(F.col("least").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id")), "firsts")
    return docs.join(firsts, "fp").select("doc_id", "fp", "component_id", *([row_col] if row_col else []))
