"""MinHash near-dedup on HyperMinHash sketches: banded compressed registers, corrected estimates, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitgrain.llm.common import raw, texts
from fitgrain.llm.components import components
from fitgrain.session import written, written_by

SHINGLE = 4
#: Documents link if 100 times the intersection is at least so many times the union.
PERCENT = 80
BANDS = 96
ROWS = 3
#: Bits of a register: leading zeros take what is left of 16.
MANTISSA = 10
HASH_BITS = 52
EMPTY = 0xFFFF
#: Of a document's band values one in so many, the most frequent, is not searched: linked
#: documents share far more. At similarity 0.8 a band is shared with probability 0.512, so of
#: 96 fewer than 20 with 1e-9; sets too small to fill the bands share more, as d different
#: shingles touch d bands at most.
UNSEARCHED = 5
#: Standard errors by which an estimate may lie below the limit before it rules a pair out.
ERRORS = 6.0
#: Rounds in which each class is compared with one other.
ROUNDS = 1
#: Classes of a band value whose pairs are compared directly.
FEW = 32
#: Low bits that go with a class, and in how many linked sets differ, at most: a tenth, and six standard errors.
BITS = 256
MOST_APART = round(BITS * 0.1 + ERRORS * (BITS * 0.1 * 0.9) ** 0.5)
#: Bits by which the bound of small sets, whose counts have longer tails, lies higher.
TAIL = 4

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _K2
    return x ^ x >> np.uint64(29)


class Shingles:
    """Sets of shingle hashes; words of one batch are hashed once."""

    def __init__(self, shingle: int = SHINGLE) -> None:
        self.shingle, self.known = shingle, {}

    def of(self, text: bytes) -> np.ndarray:
        """The distinct 64-bit hashes, sorted; none without words."""
        words = text.translate(_LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        known, digest = self.known, xxhash.xxh3_64_intdigest
        for word in set(words):
            if word not in known:
                known[word] = digest(word)
        hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        size = min(self.shingle, len(words))
        n = len(words) - size + 1
        out = np.full(n, size, np.uint64)
        for k in range(size):
            out = _mixed(out * _K1 + hashes[k : k + n])
        return np.unique(out)


def sketch(hashes: np.ndarray, registers: int = BANDS * ROWS) -> np.ndarray:
    """Of sorted hashes, one register a bucket: the leading zeros and the first mantissa bits of the bucket's least hash, or ``EMPTY``."""
    out = np.full(registers, EMPTY, np.uint16)
    if not len(hashes):
        return out
    bucket = (hashes >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)
    value = _mixed(hashes * _K1 + np.uint64(1)) >> np.uint64(64 - HASH_BITS)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))  # buckets rise with the hashes
    fraction, exponent = np.frexp(np.minimum.reduceat(value, first).astype(np.float64))
    mantissa = np.maximum((fraction * 2 - 1) * (1 << MANTISSA), 0).astype(np.uint16)
    out[bucket[first].astype(np.int64)] = (HASH_BITS - exponent).astype(np.uint16) << np.uint16(MANTISSA) | mantissa
    return out


def low_bits(registers: np.ndarray) -> np.ndarray:
    """The last mantissa bit of each of the first ``BITS`` registers of a row, as 64-bit numbers; empty registers are 0."""
    first = registers[:BITS]
    return np.packbits(first & 1 & (first != EMPTY), bitorder="little").view(np.int64)


def band_values(registers: np.ndarray) -> np.ndarray:
    """A number of each band of a row of registers that tells band and registers; -1 for an empty band."""
    parts = registers.reshape(len(registers), BANDS, ROWS)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.int64), parts.shape[:2]).copy()
    for k in range(ROWS):
        out = out << 16 | parts[:, :, k].astype(np.int64)
    out[(parts == EMPTY).all(axis=2)] = -1
    return out


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of sketch rows, and their standard error at the limit.

    Equal registers of different shingles are expected to number about 0.17 a
    bucket and a mantissa value, less for sets of unequal size; they are taken off.
    """
    used = ((a != EMPTY) | (b != EMPTY)).sum(axis=1)
    equal = ((a == b) & (a != EMPTY)).sum(axis=1)
    ratio = np.maximum(n, m) / np.maximum(np.minimum(n, m), 1)
    chance = 0.1699 * used / (1 << MANTISSA) * 4 * ratio / (1 + ratio) ** 2
    return np.clip((equal - chance) / np.maximum(used - chance, 1), 0, 1), np.sqrt(PERCENT * (100 - PERCENT) / 1e4 / np.maximum(used, 1))


def _texts(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, text, t1, t2)``: two hashes of the text tell rows of one id apart when the texts are read again."""
    docs = texts(documents, id_col, text_col)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("second"), "text").alias("t2"))


def sketched(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, t1, t2, n, held, digest, sketch, bits)`` of each row: the size of its set, its bands that hold anything, a 128-bit digest of the set, the registers and a bit of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                some, sets = batch.slice(lo, 500), Shingles(shingle)
                rows = []
                for text in raw(some.column(1)):
                    found = sets.of(text)
                    registers = sketch(found)
                    held = int((registers.reshape(BANDS, ROWS) != EMPTY).any(axis=1).sum())
                    rows.append((len(found), held, xxhash.xxh3_128_digest(found.tobytes()), registers.tobytes(), low_bits(registers)))
                n, held, digest, registers, bits = zip(*rows)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), some.column(3), pa.array(n, pa.int64()), pa.array(held, pa.int32()), pa.array(digest, pa.binary()), pa.array(registers, pa.binary()), pa.array(bits, pa.list_(pa.int64()))], ["doc_id", "t1", "t2", "n", "held", "digest", "sketch", "bits"])

    return docs.mapInArrow(run, "doc_id long, t1 long, t2 long, n long, held int, digest binary, sketch binary, bits array<long>")


def hash_sets(docs: DataFrame, classes: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(rep, hashes)`` of the classes, from the text of each one's first document; again for each repeated row of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                some, sets = batch.slice(lo, 500), Shingles(shingle)
                found = [sets.of(t).view(np.int64) for t in raw(some.column(1))]
                offsets = np.concatenate([[0], np.cumsum([len(h) for h in found])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found)))], ["rep", "hashes"])

    keys = classes.select("rep", F.col("doc_id").alias("of"), "t1", "t2")
    read = docs.join(keys, ["t1", "t2"]).where(F.col("doc_id").eqNullSafe(F.col("of"))).select("rep", "text")
    return read.mapInArrow(run, "rep long, hashes array<long>")


def searched_bands(classes: DataFrame) -> DataFrame:
    """``(band, rep, n, weight, bits)``: the band values to search each class by, of those that another class has too.

    The most frequent of a class's values are left out, by one order for all
    classes: the rarest value that two of them share is still searched in both
    if they share more than either leaves out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                some = batch.slice(lo, 1000)
                values = band_values(np.frombuffer(b"".join(some.column(1).to_pylist()), np.uint16).reshape(some.num_rows, -1))
                held = values >= 0
                yield pa.RecordBatch.from_arrays([pa.array(values[held]), some.column(0).take(pa.array(np.repeat(np.arange(len(held)), held.sum(axis=1))))], ["band", "rep"])

    bands = classes.select("rep", "sketch").mapInArrow(run, "band long, rep long")
    counts = bands.groupBy("band").agg(F.count("*").alias("others")).where("others > 1")
    shared = bands.join(counts, "band").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("others", "band"))).alias("found"), F.sum("others").alias("weight"))
    kept = F.size("found") - F.floor(F.col("held") / UNSEARCHED).cast("int")
    sized = shared.join(classes.select("rep", "n", "held", "bits"), "rep").where(kept > 0)
    return sized.select("rep", "n", "weight", "bits", F.explode(F.slice("found", F.lit(1), kept)).alias("f")).select("f.band", "rep", "n", "weight", "bits")


def _estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for k in (2, 3))
        n, m = np.asarray(batch.column(4)), np.asarray(batch.column(5))
        found, error = estimate(a, b, n, m)
        possible = 100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)
        yield batch.select([0, 1]).filter(pa.array(possible & (found >= PERCENT / 100 - ERRORS * error)))


def verified(pairs: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``(a, b)`` that link: first by their sketches, then by their full sets."""
    def side(name: str) -> DataFrame:
        return classes.select(F.col("rep").alias(name), F.col("sketch").alias(f"sketch_{name}"), F.col("n").alias(f"n_{name}"))

    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sketch_a", "sketch_b", "n_a", "n_b")
    likely = written(rows.mapInArrow(_estimated, "a long, b long"), "likely-pairs")
    full = likely.join(sets.select(F.col("rep").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("rep").alias("b"), F.col("hashes").alias("y")), "b")
    both = full.select("a", "b", F.size(F.array_intersect("x", "y")).alias("both"), (F.size("x") + F.size("y")).alias("sum"))
    return written(both.where(100 * F.col("both") >= PERCENT * (F.col("sum") - F.col("both"))).select("a", "b"), "links")


def _alike(n: str, m: str) -> Column:
    """Whether sets of these sizes can link."""
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def _bits_alike(x: str, y: str, n: str, m: str) -> Column:
    """Whether the low bits of sets of these sizes agree as those of linked sets do.

    Linked sets differ in a ninth of both sizes' sum at most, and a shingle that
    only one of them has changes one register; sets of few shingles fill few
    registers, and a fifth of what the larger of two linked sets fill differ.
    """
    total = F.col(n) + F.col(m)
    filled = 1 - F.exp(-total * (100.0 / (100 + PERCENT) / (BANDS * ROWS)))
    mean = BITS * (100 - PERCENT) / 200 * filled
    most = F.least(F.lit(float(MOST_APART)), total * ((100 - PERCENT) / (100 + PERCENT)), mean + ERRORS * F.sqrt(mean) + TAIL)
    apart = sum(F.bit_count(F.col(x)[k].bitwiseXOR(F.col(y)[k])) for k in range(BITS // 64))
    return apart <= most + 1e-6


def _rooted(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``rows`` with the root of their ``rep``, itself without a link."""
    if roots is None:
        return rows.withColumn("root", F.col("rep"))
    return rows.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))


def _by_pivots(rows: DataFrame, turn: int) -> DataFrame:
    """``(a, b)``: of each class that is not linked to all it shares a band value with, and the possible pivot that most of these values hold up to it.

    A value's pivot is its class of most weight at first, later any.
    """
    place = F.struct((-F.col("weight") if turn == 0 else F.xxhash64("rep", F.lit(turn))).alias("p"), F.col("rep").alias("pivot"), F.col("root").alias("pivot_root"), F.col("n").alias("pivot_n"), F.col("bits").alias("pivot_bits"))
    open_bands = rows.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min(place).alias("first")).where("low <> high").select("band", "first.pivot", "first.pivot_root", "first.pivot_n", "first.pivot_bits")
    possible = (F.col("root") != F.col("pivot_root")) & _alike("n", "pivot_n") & _bits_alike("bits", "pivot_bits", "n", "pivot_n")
    met = rows.select("band", "rep", "n", "root", "bits").join(open_bands, "band").where(possible)
    counted = met.groupBy("rep", "pivot").agg(F.count("*").alias("times"))
    best = counted.groupBy("rep").agg(F.max(F.struct("times", "pivot"))["pivot"].alias("pivot"))
    return best.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()


def _in_small_bands(rows: DataFrame, small: DataFrame) -> DataFrame:
    """``(a, b)``: the pairs not yet linked of each of these bands whose low bits agree as often as those of linked sets do."""
    own = rows.join(small.select("band"), "band").select("band", "rep", "n", "root", "bits")
    unlinked = (F.col("x.rep") < F.col("y.rep")) & (F.col("x.root") != F.col("y.root")) & _alike("x.n", "y.n")
    possible = _bits_alike("x.bits", "y.bits", "x.n", "y.n")
    met = own.alias("x").join(own.alias("y"), (F.col("x.band") == F.col("y.band")) & unlinked & possible)
    return met.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))


def _by_rare_shingles(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``(a, b)``: of these ``(rep, root, n, bits)`` all pairs not yet linked that may link, by their shingles exactly and by their low bits.

    A class's shingles are ordered by how many of the classes have them. Two
    that link share one of the first fifth and one more of each, and what
    follows the first one shared is long enough in both. Many texts around one
    passage do not meet in it unless it is nearly all of them.
    """
    held = members.join(sets, "rep")
    often = held.select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("often"))
    shown = held.select("rep", F.explode("hashes").alias("h")).join(often.where("often > 1"), "h")
    order = shown.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("often", "h"))).alias("order"))
    alone = F.col("n") - F.size("order")  # shingles of this class only stand first
    first = F.col("n") - F.floor((PERCENT * F.col("n") + 99) / 100) + 1
    heads = members.join(order, "rep").where(first > alone)
    heads = heads.select("rep", "root", "n", "bits", alone.alias("alone"), F.posexplode(F.slice("order", F.lit(1), (first - alone).cast("int"))).alias("k", "o"))
    heads = heads.select("rep", "root", "n", "bits", F.col("o.h").alias("h"), (F.col("n") - F.col("alone") - F.col("k")).alias("rest"))
    meeting = heads.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("h")
    heads = written(heads.join(meeting, "h"), "rare-shingles")
    unlinked = (F.col("x.rep") < F.col("y.rep")) & (F.col("x.root") != F.col("y.root")) & _alike("x.n", "y.n")
    enough = (100 + PERCENT) * F.least("x.rest", "y.rest") >= PERCENT * (F.col("x.n") + F.col("y.n"))
    possible = enough & _bits_alike("x.bits", "y.bits", "x.n", "y.n")
    return heads.alias("x").join(heads.alias("y"), (F.col("x.h") == F.col("y.h")) & unlinked & possible).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))


def _likeliest(pairs: DataFrame) -> DataFrame:
    """``(a, b)``: of each class the pair that met most often."""
    ends = pairs.select("*", F.explode(F.array("a", "b")).alias("rep"))
    best = ends.groupBy("rep").agg(F.max(F.struct("times", "a", "b")).alias("best"))
    return best.select("best.a", "best.b").distinct()


def _unlinked(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose classes have different roots."""
    for name in ("a", "b"):
        own = roots.select(F.col("node").alias(name), F.col("root").alias(f"root_{name}"))
        pairs = pairs.join(own, name, "left").withColumn(f"root_{name}", F.coalesce(f"root_{name}", name))
    return pairs.where("root_a <> root_b").drop("root_a", "root_b")


def linked_roots(classes: DataFrame, docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(node, root)`` of the classes with a link.

    First each class is compared with one other a round, so that groups of near
    copies, whatever their size, cost a row a member. Then the pairs not yet
    linked of band values with few classes are found; the classes of others
    meet by their rare shingles. Of these pairs each class tries the likeliest
    first, again while half of what is tried links: a group in several parts is
    joined without comparing all members of its parts. The rest are all compared.
    """
    bands = written(searched_bands(classes), "bands")
    some = written_by(classes, "candidates", "rep", lambda dealt: dealt.join(bands.select("rep").distinct(), "rep", "left_semi"))
    sets = written_by(hash_sets(docs, some, shingle), "candidate-sets", "rep", lambda dealt: dealt.dropDuplicates(["rep"]))
    links, roots = None, None

    def learn(pairs: DataFrame) -> DataFrame:
        nonlocal links, roots
        new = verified(pairs, some, sets)
        links = new if links is None else links.unionByName(new)
        roots = components(links)
        return new

    for turn in range(ROUNDS):
        learn(_by_pivots(written(_rooted(bands, roots), "rooted-bands") if roots is not None else _rooted(bands, None), turn))
    rows = written(_rooted(bands.drop("weight"), roots), "rooted-bands")
    open_bands = rows.groupBy("band").agg(F.count("*").alias("members"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    open_bands = written(open_bands.select("band", "members"), "open-bands")
    few = _in_small_bands(rows, open_bands.where(F.col("members") <= FEW))
    members = written(rows.join(open_bands.where(F.col("members") > FEW).select("band"), "band").select("rep", "root", "n", "bits").distinct(), "members")
    met = few.unionByName(_by_rare_shingles(members, sets)).groupBy("a", "b").agg(F.count("*").alias("times"))
    pairs = written(met, "open-pairs")
    while not pairs.isEmpty():
        likeliest = written(_likeliest(pairs), "likeliest-pairs")
        found = learn(likeliest)
        pairs = written(_unlinked(pairs.join(likeliest, ["a", "b"], "left_anti"), roots), "open-pairs")
        if 2 * found.count() < likeliest.count():
            learn(pairs.select("a", "b"))
            break
    return roots


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of each row: the size of its set of word shingles and the smallest id it reaches over links.

    Words are runs without white space, A-Z lower-cased; fewer words than a
    shingle are one shingle. Rows with equal sets, repeated rows among them,
    are one class. Null, empty and blank texts have an empty set, link with
    nothing and stay. A row without an id gets the smallest id of its
    component, null if none has one, and is kept only then. An empty table
    gives no rows.
    """
    docs = _texts(documents, id_col, text_col)
    rows = written(sketched(docs, shingle), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")).alias("first")
    classes = rows.where("n > 0").groupBy("digest").agg(first, F.first("n").alias("n"), F.first("held").alias("held"), F.first("sketch").alias("sketch"), F.first("bits").alias("bits"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("rep"), "digest", "first.doc_id", "first.t1", "first.t2", "n", "held", "sketch", "bits"), "classes")
    roots = linked_roots(classes.drop("digest"), docs, shingle)
    linked = _rooted(classes.select("rep", "digest", "doc_id"), roots)
    least = linked.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = linked.join(least, "root").select("digest", "component_id")
    named = written(named, "class-components")
    whole = rows.where("n > 0").join(named, "digest").select("doc_id", "n", "component_id")
    alone = rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return whole.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
