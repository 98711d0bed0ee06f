"""Suffix-array dedup: bytes covered by a string of a given length that also starts elsewhere.

Sampled suffixes are ordered by Spark's external sort, all others are induced
from them: the order of the suffix one byte further left follows from that
byte and from the order before it, and its common prefix with its neighbour is
one more than the least common prefix between the two in the order before.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fitgrain.llm.common import raw, texts
from fitgrain.session import written

WIDTH = 200
#: Bytes of the grams that sample the suffixes. Equal strings of WIDTH bytes are sampled at the same place.
GRAM = 32
#: Grams that one in 64 documents shows so often are hot: their rows are dealt out. Only the plan depends on it.
HOT_SAMPLE = 16
HOT_GRAMS = 10_000
SALTS = 64
#: Different contexts of one gram that are sorted in one group. Beyond it the
#: contexts are dealt out by runs of STRIDE windows and the bytes these share, and
#: what is still that large (windows that differ in a few bytes only) is counted by hash.
GROUP = 1000
STRIDE = 8
#: Sorted suffixes that are induced together: whole groups.
BLOCK = 20_000
_PIECE = (1 << 20) - 4096


def samples(text: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """``(gram, at, first, last)``: each window of ``width`` bytes is sampled at the leftmost of its least gram hashes.

    The windows that start in ``first`` … ``last`` are sampled at ``at``.
    """
    grams = width - GRAM + 1
    h = (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    size, factor = 1, 0xBF58476D1CE4E5B9
    while size < GRAM:
        h = h[:-size] * np.uint64(factor) + h[size:]
        factor = (factor * factor + 2) & (1 << 64) - 1
        size *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    least = (h >> np.uint64(20) << np.uint64(20)) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size * 2 <= grams:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < grams:
        least = np.minimum(least[: len(least) - (grams - size)], least[grams - size :])
    at = (least & np.uint64((1 << 20) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    return h[at[first]].view(np.int64), at[first], first, last


_SAMPLED = [("gram", pa.int64()), ("context", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int32()), ("shape", pa.int32())]


def sampled_suffixes(docs: DataFrame) -> DataFrame:
    """``(gram, context, doc_id, first, shape)``: all sampled suffixes, a hash of the bytes their windows cover, the first window, and in ``shape`` where the gram and the last window lie after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            columns: list[list[np.ndarray]] = [[] for _ in _SAMPLED]
            for doc_id, text in zip(batch.column(0).to_pylist(), raw(batch.column(1))):
                data = np.frombuffer(text, np.uint8)
                for lo in range(0, len(text) - WIDTH + 1, _PIECE):
                    gram, at, first, last = samples(data[lo : lo + _PIECE + WIDTH - 1])
                    shape = (at - first) << 8 | (last - first)
                    starts, stops = (first + lo).tolist(), (last + lo + WIDTH).tolist()
                    context = np.fromiter((digest(text[a:b], s) for a, b, s in zip(starts, stops, shape.tolist())), np.uint64, len(starts))
                    for column, value in zip(columns, (gram, context.view(np.int64), np.full(len(gram), doc_id, np.int64), first + lo, shape)):
                        column.append(value)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(t.to_pandas_dtype())) for c, (_, t) in zip(columns, _SAMPLED)], [n for n, _ in _SAMPLED])

    return docs.where(F.col("doc_id").isNotNull()).mapInArrow(run, "gram long, context long, doc_id long, first int, shape int")


def candidates(docs: DataFrame) -> DataFrame:
    """The sampled suffixes whose gram is sampled twice or more: all others are of windows found once."""
    few = sampled_suffixes(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(64)) == 0)).groupBy("gram").count()
    hot = written(few.where(F.col("count") >= HOT_SAMPLE).orderBy(F.desc("count"), "gram").limit(HOT_GRAMS).select("gram", F.lit(True).alias("hot")), "hot-grams")
    marked = sampled_suffixes(docs).join(F.broadcast(hot), "gram", "left")
    salted = marked.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "first"), F.lit(SALTS))).otherwise(0))
    counted = salted.withColumn("n", F.count("*").over(Window.partitionBy("gram", "salt")))
    return counted.where((F.col("n") > 1) | F.col("hot")).select(*[n for n, _ in _SAMPLED])


def contexts(found: DataFrame) -> DataFrame:
    """Each different context of a gram, one place of it, how often it is there, and how many the gram has."""
    own = found.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "first", "shape")).alias("at"))
    own = written(own.select("gram", "context", "n", "at.*"), "contexts")
    return own.join(own.groupBy("gram").agg(F.count("*").alias("kinds")), "gram")


def induce(group: np.ndarray, right: list[bytes], left: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Which windows of sorted sampled suffixes are also there in another of their group.

    ``right`` holds the bytes from the sample on, in ascending order inside each
    group, ``left`` those before it, from right to left. Row i, column j of the
    result: the window that starts j bytes left of sample i.
    """
    n = len(right)
    lengths = np.fromiter(map(len, right), np.int64, n)
    reach = np.fromiter(map(len, left), np.int64, n)
    after = _matrix(right, lengths)
    before = _matrix(left, reach)
    same = (after[1:] == after[:-1]) & (np.arange(after.shape[1]) < np.minimum(lengths[1:], lengths[:-1])[:, None])
    common = np.concatenate([[-1], np.where(group[1:] == group[:-1], np.where(same.all(axis=1), after.shape[1], same.argmin(axis=1)), -1)])
    found = np.zeros((n, before.shape[1] + 1), bool)
    order = np.arange(n)
    for j in range(before.shape[1] + 1):
        if j:
            high = np.maximum(common, np.concatenate([common[1:], [-1]]))
            alive = np.flatnonzero((reach[order] >= j) & (high + reach[order] - j + 1 >= width))
            if len(alive) < 2:
                break
            key = group[order[alive]] << 8 | before[order[alive], j - 1]
            by = np.argsort(key, kind="stable")
            key, alive = key[by], alive[by]
            pairs = np.flatnonzero(key[1:] == key[:-1])
            least = np.full(len(alive), -1)
            if len(pairs):
                ends = np.column_stack([alive[pairs] + 1, alive[pairs + 1] + 1]).ravel()
                least[pairs + 1] = 1 + np.minimum.reduceat(np.concatenate([common, [-1]]), ends)[::2]
            order, common = order[alive], least
        hit = np.flatnonzero(common >= width)
        found[order[hit], j] = True
        found[order[hit - 1], j] = True
    return found


def _matrix(rows: list[bytes], lengths: np.ndarray) -> np.ndarray:
    """Rows of bytes, filled up with zeros."""
    widest = int(lengths.max(initial=0))
    out = np.zeros((len(rows), widest), np.uint8)
    out[np.arange(widest) < lengths[:, None]] = np.frombuffer(b"".join(rows), np.uint8)
    return out


_WINDOWS = "doc_id long, first int, last int"


def _runs(found: np.ndarray, doc_ids: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Runs of marked windows as rows of first and last start."""
    edges = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, low = np.nonzero(edges == 1)
    high = np.nonzero(edges == -1)[1] - 1
    columns = (doc_ids[row], (at[row] - high).astype(np.int32), (at[row] - low).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "first", "last"])


def induced_windows(pieces: DataFrame) -> DataFrame:
    """Windows of single contexts that another context of the gram holds too: external sort, then induction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if len(rows) >= BLOCK and row[0] != rows[-1][0]:
                    yield block(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield block(rows)

    def block(rows: list[tuple]) -> pa.RecordBatch:
        gram, right, left, doc_id, first, n = zip(*rows)
        gram = np.array(gram)
        group = np.concatenate([[0], np.cumsum(gram[1:] != gram[:-1])])
        found = induce(group, right, left)
        own = np.array(n) == 1
        at = np.array(first, np.int64) + np.fromiter(map(len, left), np.int64, len(left))
        return _runs(found[own], np.array(doc_id, np.int64)[own], at[own])

    queue = pieces.repartition("gram").sortWithinPartitions("gram", "right")
    return queue.select("gram", "right", "left", "doc_id", "first", "n").mapInArrow(run, _WINDOWS)


_PIECES = [("gram", pa.int64()), ("right", pa.binary()), ("left", pa.binary()), ("doc_id", pa.int64()), ("first", pa.int32()), ("n", pa.int64())]


def finer(pieces: DataFrame) -> DataFrame:
    """Each piece as runs of at most ``STRIDE`` windows, sampled anew where the bytes that these share start.

    Runs are cut and sampled at fixed distances from the old sample, so equal
    windows fall into equal runs at equal places, even where one document
    leaves the first windows of a run out. ``gram`` is a hash of the shared
    bytes, ``context`` one of all bytes of the run.
    """
    schema = pa.schema([*_PIECES, ("context", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for gram, right, left, doc_id, first, n in zip(*(batch.column(c).to_pylist() for c, _ in _PIECES)):
                rows = []
                least, most = WIDTH - len(right), len(left)
                at = first + most
                for low in range(least - least % STRIDE, most + 1, STRIDE):
                    lo, hi = max(low, least), min(low + STRIDE - 1, most)
                    shared = left[:low][::-1] + b"|" + right[: WIDTH - low - STRIDE + 1]
                    new_right, new_left = left[:low][::-1] + right[: WIDTH - lo], left[low:hi]
                    shape = (lo - low) << 8 | (hi - low)
                    rows.append((digest(shared, gram + low & (1 << 64) - 1), new_right, new_left, doc_id, at - hi, n, digest(new_left + b"|" + new_right, shape)))
                signed = [tuple(v - (1 << 64) if k in (0, 6) and v >> 63 else v for k, v in enumerate(row)) for row in rows]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*signed), schema)], schema=schema)

    return pieces.select(*[c for c, _ in _PIECES]).mapInArrow(run, "gram long, right binary, left binary, doc_id long, first int, n long, context long")


def large_windows(large: DataFrame) -> DataFrame:
    """Windows of single contexts that another context holds too, for grams of very many contexts."""
    dealt = written(finer(large), "finer")
    own = dealt.groupBy("gram", "context").agg((F.sum("n") + F.count("*") - 1).alias("n"), F.min(F.struct("doc_id", "first", "right", "left")).alias("at"))
    own = written(own.select("gram", "context", "n", "at.*"), "finer-contexts")
    sized = own.join(own.groupBy("gram").agg(F.count("*").alias("kinds")).where(F.col("kinds") > 1), "gram")
    copied = dealt.where(F.col("n") == 1).join(own.where(F.col("n") > 1).select("gram", "context"), ["gram", "context"], "left_semi")
    copied = copied.select("doc_id", "first", (F.col("first") + F.octet_length("left") + F.octet_length("right") - WIDTH).cast("int").alias("last"))
    sorted_ = induced_windows(sized.where(F.col("kinds") <= GROUP))
    return copied.unionByName(sorted_).unionByName(counted_windows(sized.where(F.col("kinds") > GROUP)))


def counted_windows(pieces: DataFrame) -> DataFrame:
    """The same by 128-bit hashes of single windows, combined before they are dealt out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for right, left, doc_id, first, n in zip(*(batch.column(c).to_pylist() for c in ("right", "left", "doc_id", "first", "n"))):
                text = left[::-1] + right
                digests = [xxhash.xxh3_128_digest(text[k : k + WIDTH]) for k in range(len(text) - WIDTH + 1)]
                halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                size = len(halves)
                columns = (halves[:, 0], halves[:, 1], np.full(size, doc_id, np.int64), np.arange(first, first + size, dtype=np.int32), np.full(size, n == 1))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h1", "h2", "doc_id", "first", "single"])

    windows = written(pieces.mapInArrow(run, "h1 long, h2 long, doc_id long, first int, single boolean"), "windows")
    twice = windows.groupBy("h1", "h2").count().where(F.col("count") > 1).select("h1", "h2")
    return windows.where("single").join(twice, ["h1", "h2"], "left_semi").select("doc_id", "first", F.col("first").alias("last"))


def pieces(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes around each wanted place: ``right`` from the sample on, ``left`` before it from right to left."""
    places = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("gram", "first", "shape", "n")).alias("places"))
    joined = docs.join(places.withColumnRenamed("doc_id", "__id"), F.col("doc_id") == F.col("__id"), "left").select("doc_id", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                places = batch.column(2)[k].as_py()
                if places:
                    text = (batch.column(1)[k].as_py() or "").encode()
                    for p in places:
                        first, at = p["first"], p["first"] + (p["shape"] >> 8)
                        rows.append((p["gram"], text[at : first + (p["shape"] & 255) + WIDTH], text[first:at][::-1], doc_id, first, p["n"]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _PIECES)], [n for n, _ in _PIECES])

    return joined.mapInArrow(run, "gram long, right binary, left binary, doc_id long, first int, n long")


def marked(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text, marks)`` of each row: ranges of starts of strings of ``WIDTH`` bytes that also start elsewhere."""
    docs = texts(documents, id_col, text_col)
    found = written(candidates(docs), "candidates")
    kinds = written(contexts(found), "kinds")
    copied = found.join(kinds.where(F.col("n") > 1).select("gram", "context"), ["gram", "context"], "left_semi")
    copied = copied.select("doc_id", "first", (F.col("first") + F.col("shape").bitwiseAND(255)).alias("last"))
    wanted = kinds.where(F.col("kinds") > 1)
    windows = copied.unionByName(induced_windows(pieces(docs, wanted.where(F.col("kinds") <= GROUP))))
    large = wanted.where(F.col("kinds") > GROUP)
    if not large.isEmpty():
        windows = windows.unionByName(large_windows(pieces(docs, large)))
    marks = windows.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("marks"))
    return docs.join(marks.withColumnRenamed("doc_id", "__id"), F.col("doc_id") == F.col("__id"), "left").select("doc_id", "text", "marks")


def spans_of(marks: pa.Array) -> list[list[dict[str, int]]]:
    return [merged([(m["first"], m["last"] + WIDTH) for m in own.as_py() or ()]) for own in marks]


def repeated_spans(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text, spans)`` of each row: the byte ranges that a string of ``WIDTH`` bytes covers which also starts elsewhere.

    Strings are judged on the whole input; overlapping ones count, matches do
    not cross documents, ``spans`` are the longest runs in order, ends
    excluded. Null and short texts have none. Repeated rows repeat each
    other's strings. A row without an id is left as it is and not compared. An
    empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = pa.array(spans_of(batch.column(2)), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), spans], ["doc_id", "text", "spans"])

    return marked(documents, id_col, text_col).mapInArrow(run, "doc_id long, text string, spans array<struct<start:long,stop:long>>")


def merged(ranges: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[list[int]] = []
    for start, stop in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [{"start": a, "stop": b} for a, b in out]


def cut(text: bytes, spans: list[dict[str, int]]) -> bytes:
    """The bytes outside the spans."""
    at, kept = 0, []
    for s in spans:
        kept.append(text[at : s["start"]])
        at = s["stop"]
    return b"".join([*kept, text[at:]])


def cut_digests(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of each row, its spans cut out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, spans in enumerate(spans_of(batch.column(2))):
                whole = (batch.column(1)[k].as_py() or "").encode()
                kept = cut(whole, spans)
                rows.append((len(whole), len(whole) - len(kept), len(spans), sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c) for c in zip(*rows))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return marked(documents, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
