"""Byte-level BPE: a rank queue on a hierarchical bitmap merges pre-tokens; ids decode to bytes."""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from fitgrain.llm.common import Recent, kept_in_worker, texts

#: Bytes of each of a worker's three caches: pieces, words at a text's start, and words after a space.
PIECE_BYTES, FIRST_BYTES, WORD_BYTES = 60_000_000, 4_000_000, 100_000_000
#: Texts of together so many characters are encoded at once; one queue merges pieces of so many bytes.
BATCH_CHARS = 2_000_000
QUEUE_BYTES = 10_000


def read_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    """The merge ranks of a rank file: a base64 token and its id on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class RankQueue:
    """Positions by rank: the lowest rank next, with all positions queued for it.

    Bit sets of 64 say which ranks have positions: a bit of a level is set if
    the word below it is not zero, so one find-first-set step for each level
    gives the next rank, however many there are.
    """

    def __init__(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        found, starts = np.unique(ranks[order], return_index=True)
        self.buckets = dict(zip(found.tolist(), (x.tolist() for x in np.split(positions[order], starts[1:]))))
        self.low: dict[int, int] = {}
        self.mid: dict[int, int] = {}
        self.top = 0
        for rank in self.buckets:
            self._mark(rank)

    def _mark(self, rank: int) -> None:
        word, block = rank >> 6, rank >> 12
        self.low[word] = self.low.get(word, 0) | 1 << (rank & 63)
        self.mid[block] = self.mid.get(block, 0) | 1 << (word & 63)
        self.top |= 1 << block

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        self._mark(rank)

    def pop(self) -> tuple[int, list[int]]:
        """The next rank and its positions from left to right; the queue must not be empty."""
        block = (self.top & -self.top).bit_length() - 1
        mid = self.mid[block]
        word = block << 6 | (mid & -mid).bit_length() - 1
        low = self.low[word]
        rank = word << 6 | (low & -low).bit_length() - 1
        low &= low - 1
        self.low[word] = low
        if not low:
            mid &= mid - 1
            self.mid[block] = mid
            if not mid:
                self.top &= self.top - 1
        positions = self.buckets.pop(rank)
        positions.sort()
        return rank, positions


def byte_pair_ranks(ranks: dict[bytes, int]) -> np.ndarray:
    """The rank of each pair of bytes, -1 without one."""
    table = np.full(1 << 16, -1)
    for token, rank in ranks.items():
        if len(token) == 2:
            table[token[0] << 8 | token[1]] = rank
    return table


def merge(pieces: list[bytes], ranks: dict[bytes, int], pair_ranks: np.ndarray) -> list[list[int]]:
    """The ids of each pre-token; one queue serves them all.

    The pieces lie end to end in one linked list of part starts (``after``,
    ``before``) and no pair reaches over a piece's end. A queued position is
    stale if its part is gone or its pair now has another rank. Inside a piece
    the lowest rank goes first and its leftmost position: if a merge makes a
    pair of the same or a lower rank, the piece's other positions of this rank
    go back into the queue.
    """
    text = b"".join(pieces)
    n = len(text)
    if not n:
        return [[] for _ in pieces]
    rank_of = ranks.get
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.cumsum(sizes)
    whole = np.fromiter((p in ranks for p in pieces), bool, len(pieces))
    starts = ends - sizes
    data = np.frombuffer(text, np.uint8)
    links = np.arange(1, n + 2)
    links[starts[whole]] = ends[whole]
    after = links.tolist()
    links = np.arange(-1, n)
    links[starts[sizes > 0]] = -1
    before = links.tolist()
    pairs = np.full(n + 1, -1)
    pairs[: n - 1] = pair_ranks[data[:-1].astype(np.int64) << 8 | data[1:]]
    pairs[ends[sizes > 0] - 1] = -1
    pairs[:n][np.repeat(whole, sizes)] = -1
    pair = pairs.tolist()
    end_of = np.repeat(ends, sizes).tolist()
    queued = np.flatnonzero(pairs >= 0)
    queue = RankQueue(pairs[queued], queued)
    push = queue.push
    while queue.top:
        rank, positions = queue.pop()
        held = -1
        for i in positions:
            if pair[i] != rank:
                continue
            if i < held:
                push(rank, i)
                continue
            end = end_of[i]
            gone = after[i]
            right = after[gone]
            after[i] = right
            pair[gone] = -1
            new = None
            if right < end:
                before[right] = i
                new = rank_of(text[i : after[right]])
            if new is None:
                pair[i] = -1
            else:
                pair[i] = new
                push(new, i)
                if new <= rank:
                    held = end
            left = before[i]
            if left >= 0:
                new = rank_of(text[left:right])
                if new is None:
                    pair[left] = -1
                elif new != pair[left]:
                    pair[left] = new
                    push(new, left)
                    if new <= rank:
                        held = end
    out = []
    start = 0
    for piece in pieces:
        end = start + len(piece)
        ids = []
        while start < end:
            stop = after[start]
            ids.append(ranks[text[start:stop]])
            start = stop
        out.append(ids)
    return out


class ByteBpe:
    """Encoder and decoder of one rank table.

    A text is cut at each space that begins a word. The pattern never matches
    across such a cut unless white space surrounds it; such a text is matched
    at once.
    """

    _straddles = re.compile(r"\s \s|\s \Z")

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.pair_ranks = byte_pair_ranks(ranks)
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.pieces_of = regex.compile(pattern).findall
        self.pieces, self.words, self.spaced = Recent(PIECE_BYTES), Recent(FIRST_BYTES), Recent(WORD_BYTES)

    def _merged(self, pieces: list[str]) -> list[bytes]:
        out: list[bytes] = []
        queue, size = [], 0
        for piece in pieces:
            queue.append(piece.encode())
            size += len(queue[-1])
            if size >= QUEUE_BYTES:
                out += [array("I", ids).tobytes() for ids in merge(queue, self.ranks, self.pair_ranks)]
                queue, size = [], 0
        return out + [array("I", ids).tobytes() for ids in merge(queue, self.ranks, self.pair_ranks)]

    def _whole(self, texts: list[str]) -> list[bytes]:
        cut = [self.pieces_of(t) for t in texts]
        pieces = self.pieces.ready({p for c in cut for p in c}, self._merged)
        done = [b"".join([pieces[p] for p in c]) for c in cut]
        self.pieces.forget_long()
        return done

    def _encode(self, texts: list[str]) -> list[bytes]:
        cut = [None if self._straddles.search(t) else t.split(" ") for t in texts]
        words = self.words.ready({c[0] for c in cut if c}, self._whole)
        spaced = self.spaced.ready({w for c in cut if c for w in c[1:]}, lambda new: self._whole([" " + w for w in new]))
        whole = iter(self._whole([t for t, c in zip(texts, cut) if c is None]))
        done = [next(whole) if c is None else words[c[0]] + b"".join([spaced[w] for w in c[1:]]) for c in cut]
        self.words.forget_long()
        self.spaced.forget_long()
        return done

    def encode(self, texts: Iterable[str]) -> Iterable[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        batch, size = [], 0
        for text in texts:
            batch.append(text)
            size += len(text)
            if size >= BATCH_CHARS:
                yield from self._encode(batch)
                batch, size = [], 0
        yield from self._encode(batch)

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in memoryview(ids).cast("I")])


TOKENS = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())]
)
DIGESTS = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
)

def _coder(table: Broadcast, pattern: str) -> ByteBpe:
    """One coder a worker process, so that its caches live on from task to task."""
    key = sha256(table.value + pattern.encode()).digest()
    return kept_in_worker(key, lambda: ByteBpe(read_ranks(table.value.splitlines()), pattern))


def _encoded(batches: Iterator[pa.RecordBatch], table: Broadcast, pattern: str) -> Iterator[tuple[object, bytes, bytes]]:
    coder = _coder(table, pattern)
    for batch in batches:
        whole = (t.as_py() or "" for t in batch.column(1))
        for doc_id, ids in zip(batch.column(0).to_pylist(), coder.encode(whole)):
            yield doc_id, ids, coder.decode(ids)


def _rows(found: Iterator[list], schema: pa.Schema, rows: int) -> Iterator[pa.RecordBatch]:
    while chunk := list(islice(found, rows)):
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row)) for row in chunk], schema=schema)


def rank_table(spark: SparkSession, rank_file: str) -> Broadcast:
    """A rank file, read on the driver and sent once; vocabularies are a few MB."""
    with open(rank_file, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def bpe_tokens(documents: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded)`` of each row: ids as little-endian 32-bit integers and the bytes they decode to.

    Null and empty texts have no ids. Each row is encoded by itself, so
    repeated rows, rows without an id and an empty table need no rule.
    """
    df = texts(documents, id_col, text_col)
    table = rank_table(df.sparkSession, rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _rows(([d, len(i) // 4, i, b] for d, i, b in _encoded(batches, table, pattern)), TOKENS, 200)

    return df.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def bpe_digests(documents: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``bpe_tokens``, with SHA-256 digests of ids and decoded bytes in place of both."""
    df = texts(documents, id_col, text_col)
    table = rank_table(df.sparkSession, rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = ([d, len(i) // 4, sha256(i).hexdigest(), sha256(b).hexdigest()] for d, i, b in _encoded(batches, table, pattern))
        return _rows(digests, DIGESTS, 5000)

    return df.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
