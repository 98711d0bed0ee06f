"""Token files: directly addressable codes of 8-bit chunks, written in document order and read back."""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator
from string import punctuation
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fitgrain.llm.common import Recent, kept_in_worker, texts
from fitgrain.session import scratch_path

MAGIC = b"FGDAC1\0\0"
#: A file is closed after the document that fills it to so many ids.
FILE_IDS = 1_000_000
#: Bits of a continuation bitmap to an entry of its rank directory.
RANK_BITS = 512
#: Bytes of a worker's word cache.
CACHE_BYTES = 96_000_000
#: Kept runs of punctuation.
MARKS = 10_000
#: Texts of together so many bytes are encoded at once.
BATCH_BYTES = 3_000_000


def _byte_signs() -> dict[int, int]:
    """The sign that byte-level tokenizers show for each byte: itself if it prints, else the next one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}


BYTE_SIGNS = _byte_signs()


def pack(ids: np.ndarray) -> bytes:
    """Levels of 8-bit chunks, lowest first. Level k holds chunk k of the ids that have one.

    Each level: its length, its chunks, a bitmap that says which ids go on in
    the next level, and before each block of ``RANK_BITS`` bits how many ones
    came before it. The last level has no ones.
    """
    ids = np.asarray(ids, np.uint32)
    out = []
    while True:
        more = ids > 0xFF
        bits = np.packbits(more, bitorder="little")
        blocks = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
        ranks = np.concatenate([[0], np.cumsum(blocks)[:-1]]).astype("<u8") if len(blocks) else blocks.astype("<u8")
        out += [struct.pack("<Q", len(ids)), (ids & 0xFF).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()]
        ids = ids[more] >> 8
        if not len(ids):
            return struct.pack("<B", len(out) // 4) + b"".join(out)


class Codes:
    """Ids of packed bytes: one by position, or a whole run."""

    def __init__(self, data: bytes) -> None:
        self.levels = []
        at = 1
        for _ in range(data[0]):
            (n,) = struct.unpack_from("<Q", data, at)
            at += 8
            chunks = np.frombuffer(data, np.uint8, n, at)
            bits = np.frombuffer(data, np.uint8, -(-n // 8), at + n)
            at += n + len(bits)
            ranks = np.frombuffer(data, "<u8", -(-n // RANK_BITS), at)
            at += 8 * len(ranks)
            self.levels.append((chunks, bits, ranks))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def rank(self, level: int, i: int) -> int:
        """How many of the first ``i`` bits are ones: a directory entry and one block at most."""
        _, bits, ranks = self.levels[level]
        block = min(i // RANK_BITS, len(ranks) - 1)
        inside = np.unpackbits(bits[block * RANK_BITS // 8 : -(-i // 8)], bitorder="little")[: i - block * RANK_BITS]
        return int(ranks[block]) + int(inside.sum())

    def __getitem__(self, i: int) -> int:
        value = 0
        for k, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * k
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            i = self.rank(k, i)
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        return self._slice(0, start, stop)

    def _slice(self, level: int, start: int, stop: int) -> np.ndarray:
        chunks, bits, _ = self.levels[level]
        out = chunks[start:stop].astype(np.uint32)
        more = np.unpackbits(bits[start // 8 : -(-stop // 8)], bitorder="little")[start % 8 :][: stop - start].astype(bool)
        if more.any():
            first = self.rank(level, start)
            out[more] |= self._slice(level + 1, first, first + int(more.sum())) << np.uint32(8)
        return out


def token_file(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """A file: documents with their first positions, then the codes of all ids."""
    starts = np.cumsum([0, *map(len, ids)]).astype("<u8")
    named = np.array([d is not None for d in doc_ids], np.uint8)
    keys = np.array([d or 0 for d in doc_ids], "<i8")
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    return MAGIC + struct.pack("<Q", len(doc_ids)) + named.tobytes() + keys.tobytes() + starts.tobytes() + pack(flat)


class TokenFile:
    """One file, read: documents and any of their ids, without decoding others."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        (n,) = struct.unpack_from("<Q", data, 8)
        named = np.frombuffer(data, np.uint8, n, 16)
        keys = np.frombuffer(data, "<i8", n, 16 + n)
        self.doc_ids = [int(k) if has else None for k, has in zip(keys, named)]
        self.starts = np.frombuffer(data, "<u8", n + 1, 16 + 9 * n).astype(np.int64)
        self.codes = Codes(data[16 + 9 * n + 8 * (n + 1) :])

    def ids(self, k: int) -> np.ndarray:
        """All ids of the ``k``-th document."""
        return self.codes.slice(int(self.starts[k]), int(self.starts[k + 1]))


class WordTokens:
    """Ids of whole texts by a tokenizer that drops white space and never joins across it.

    Texts are cut at spaces and line feeds. Each different word of a batch is
    encoded once, and often kept; the texts' ids are gathered by the numbers
    of their words. ASCII punctuation at a word's end is a pre-token of its
    own.
    """

    def __init__(self, tokenizer: Tokenizer) -> None:
        self.tokenizer, self.model, self.known, self.marks = tokenizer, tokenizer.model, Recent(CACHE_BYTES), {}

    def _shown(self, word: str) -> str | None:
        """A word of letters only as the model sees it, past the normalizer, whose work on it is plain; else None."""
        if word.isascii():
            return word.lower() if word.isalpha() else None
        if word.isalpha() and is_normalized("NFC", word) and "Σ" not in word and "İ" not in word:
            return word.lower().encode().decode("latin-1").translate(BYTE_SIGNS)
        return None

    def _made(self, words: list[str]) -> list[bytes]:
        """The ids of each word."""
        tokenize, shown = self.model.tokenize, self._shown
        flat, ends, hard = array("I"), [], []
        for word in words:
            stem = word.rstrip(punctuation)
            letters = shown(stem) if stem else None
            if letters is not None and (stem == word or stem[-1].lower().isalpha()):
                flat.extend([t.id for t in tokenize(letters)])
                if stem != word:
                    flat.extend(self._mark(word[len(stem) :]))
            else:
                hard.append((len(ends), word))
            ends.append(len(flat))
        data = flat.tobytes()
        made = [data[4 * a : 4 * b] for a, b in zip([0, *ends], ends)]
        for (at, _), found in zip(hard, self.tokenizer.encode_batch([w for _, w in hard], add_special_tokens=False)):
            made[at] = array("I", found.ids).tobytes()
        return made

    def _mark(self, mark: str) -> list[int]:
        """The ids of ASCII punctuation at a word's end, which is a pre-token."""
        ids = self.marks.get(mark)
        if ids is None:
            ids = self.tokenizer.encode(mark, add_special_tokens=False).ids
            if len(self.marks) == MARKS:
                self.marks.clear()
            if len(mark) < 8:
                self.marks[mark] = ids
        return ids

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a column; null is empty."""
        column = pc.fill_null(column, "")
        ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < len(column):
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + BATCH_BYTES, side="right")))
            yield from self._encode(column.slice(lo, hi - lo))
            lo = hi

    def _encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        cut = pc.split_pattern(pc.replace_substring(column, "\n", " "), " ")
        offsets = cut.offsets.to_numpy()
        coded = cut.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self.known.ready(words, self._made)
        found = [known[w] for w in words]
        self.known.forget_long()
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(found), np.uint32)
        which = coded.indices.to_numpy()
        own = sizes[which]
        ends = np.cumsum(own)
        ids = flat[np.repeat(starts[which] - (ends - own), own) + np.arange(ends[-1] if len(ends) else 0)]
        at = np.concatenate([[0], ends])[offsets - offsets[0]]
        return (ids[a:b] for a, b in zip(at[:-1], at[1:]))


def _words(table: Broadcast) -> WordTokens:
    """One a worker process, so that its cache lives on from task to task."""
    return kept_in_worker(("words", zlib.crc32(table.value)), lambda: WordTokens(Tokenizer.from_str(table.value.decode())))


def write_token_files(documents: DataFrame, tokenizer_file: str, end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode each whole text, append ``end_id`` and write token files to ``path`` in ascending id order.

    The table at ``path`` has a row for each file: ``part`` and ``file`` give
    its place, ``n_ids`` its size, ``data`` its bytes. Rows without an id come
    first; null and empty texts hold the end id only. Rows of one id stand in
    the order of a hash of their texts, then of the texts, so that only equal
    rows tie, and no id's rows need to be in one task. An empty table gives no
    files.
    """
    df = texts(documents, id_col, text_col)
    with open(tokenizer_file, "rb") as f:
        table = df.sparkSession.sparkContext.broadcast(f.read())
    end = np.array([end_id], np.uint32)
    schema = pa.schema([("file", pa.int32()), ("n_ids", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _words(table)
        doc_ids, ids, size, number = [], [], 0, 0
        for batch in batches:
            for doc_id, found in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1))):
                doc_ids.append(doc_id)
                ids.append(np.concatenate([found, end]))
                size += len(ids[-1])
                if size >= FILE_IDS:
                    yield pa.RecordBatch.from_pylist([{"file": number, "n_ids": size, "data": token_file(doc_ids, ids)}], schema=schema)
                    doc_ids, ids, size, number = [], [], 0, number + 1
        if doc_ids:
            yield pa.RecordBatch.from_pylist([{"file": number, "n_ids": size, "data": token_file(doc_ids, ids)}], schema=schema)

    keyed = df.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_hash"), F.coalesce("text", F.lit(""))]
    ordered = keyed.repartitionByRange(*order[:2]).sortWithinPartitions(*order).select("doc_id", "text")
    files = ordered.mapInArrow(run, "file int, n_ids long, data binary")
    files.select(F.spark_partition_id().alias("part"), "*").write.parquet(path)


def read_token_files(spark, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of each document in the files below ``path``."""
    files = spark.read.schema("part int, file int, n_ids long, data binary").parquet(path)
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    places = files.select("part", "file", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("file_start")).join(F.broadcast(parts), "part")
    schema = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, number, data = (batch.column(k)[row].as_py() for k in range(3))
                read = TokenFile(data)
                ids = [read.ids(k) for k in range(len(read.doc_ids))]
                columns = [[part] * len(ids), [number] * len(ids), read.doc_ids, read.starts[:-1], [len(x) for x in ids], [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]]
                yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(columns, schema)], schema=schema)

    found = files.select("part", "file", "data").mapInArrow(run, "part int, file int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return found.join(places, ["part", "file"]).select("doc_id", (F.col("part_start") + F.col("file_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_table(documents: DataFrame, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write token files to the shared folder and read them back."""
    spark = documents.sparkSession
    path = scratch_path(spark, "token-files")
    write_token_files(documents, tokenizer_file, end_id, path, id_col, text_col)
    return read_token_files(spark, path)
