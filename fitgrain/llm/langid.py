"""Language ID: the average of hashed subword embeddings through a linear softmax, with calibrated rejection."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitgrain.llm.common import raw, release_worker, shipped

#: Labelled rows to learn from, at most, dealt evenly to the languages.
TRAIN_ROWS = 6000
#: Buckets of the subwords of each length; lengths in bytes.
BUCKETS = 1 << 15
LENGTHS = (2, 3, 4)
DIMENSIONS = 16
EPOCHS = 4
RATE = 4.0
#: Every fourth learned row is kept for the temperature and the rejection threshold.
CALIBRATION = 4
#: Every eighth learned row also teaches what is no language: its letters in a random order.
MIXED_UP = 8
#: Share of rightly named calibration rows that may be rejected.
REJECTED_SHARE = 0.001
#: The class of mixed-up rows, and what rejected texts are called.
UNKNOWN = "und"
#: What rounding may take from the odds.
ROUNDING = 1e-3
_PIECE = 1 << 20
_SIGNS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def subwords(text: bytes) -> Iterator[np.ndarray]:
    """Buckets of all subwords of a UTF-8 text, a piece of it at a time. Other signs than letters are one space."""
    longest = max(LENGTHS)
    shown = text.translate(_SIGNS)
    for lo in range(0, max(len(shown), 1), _PIECE):
        own = np.frombuffer(shown[lo : lo + _PIECE + longest - 1], np.uint8)
        space = own == 32
        space[1:] &= space[:-1].copy()
        space[:1] = False
        own = own[~space]
        gram = own.astype(np.uint32)
        for length in range(2, longest + 1):
            if len(own) < length:
                break
            gram = gram[:-1] * np.uint32(257) + own[length - 1 :]
            if length in LENGTHS:
                at = LENGTHS.index(length) * BUCKETS
                yield (gram * np.uint32(2654435761) >> np.uint32(17)).astype(np.int64) + at


@dataclass(frozen=True)
class Model:
    """Each bucket's share of the logits: the product of embeddings and softmax weights.

    The last class is that of mixed-up texts.
    """

    languages: tuple[str, ...]
    shares: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, text: bytes) -> np.ndarray:
        total, n = np.zeros(len(self.bias)), 0
        for buckets in subwords(text):
            total += self.shares[buckets].sum(axis=0, dtype=np.float64)
            n += len(buckets)
        return total / max(n, 1) + self.bias

    def predict(self, text: bytes) -> tuple[str, float, bool]:
        """The likeliest language, its probability, and whether the text is like one at all."""
        p = softmax(self.logits(text) / self.temperature)
        best = int(p[:-1].argmax())
        return self.languages[best], float(p[best]), bool(language_odds(p) >= self.threshold)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def language_odds(p: np.ndarray) -> np.ndarray:
    """The logarithm of the odds that a text is of a language, not mixed up."""
    known = np.clip(1 - p[..., -1], 1e-12, 1 - 1e-12)
    return np.log(known / (1 - known))


def mixed_up(text: bytes, seed: int) -> bytes:
    """The text with its letters in a random order; other signs stay where they are."""
    signs = np.frombuffer(text.translate(_SIGNS), np.uint8).copy()
    letters = signs != 32
    signs[letters] = np.random.default_rng(seed).permutation(signs[letters])
    return signs.tobytes()


def packed_counts(text: bytes) -> bytes:
    counted = np.zeros(BUCKETS * len(LENGTHS), np.int32)
    for buckets in subwords(text):
        counted += np.bincount(buckets, minlength=len(counted)).astype(np.int32)
    return pack(counted)


def pack(counted: np.ndarray) -> bytes:
    """The buckets that a text has, and how often: the numbers' high bytes, mostly zero, stand together."""
    found = np.flatnonzero(counted)
    both = np.concatenate([np.diff(found, prepend=0), counted[found]]).astype(np.int32)
    return zlib.compress(both.view(np.uint8).reshape(-1, 4).T.tobytes(), 6)


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """``(buckets, counts)`` of ``pack``."""
    both = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1).T.copy().view(np.int32).reshape(2, -1)
    return np.cumsum(both[0], dtype=np.int32), both[1].astype(np.float32)


def fit(rows: list[tuple[str, bytes]]) -> Model:
    """Learn from ``(language, packed counts)`` rows by stochastic gradient descent, one row a step; rows stay packed.

    Rows without a language are mixed up. The threshold on the odds of a
    language is that by which the least likely rightly named calibration rows
    are rejected, or halfway from there to the likeliest mixed-up ones if
    these lie lower.
    """
    languages = tuple(sorted({r[0] for r in rows if r[0] is not None}))
    classes = [len(languages) if r[0] is None else languages.index(r[0]) for r in rows]
    held = [k for k in range(len(rows)) if k % CALIBRATION == 0]
    learned = [k for k in range(len(rows)) if k % CALIBRATION]
    random = np.random.default_rng(7)
    embeddings = random.normal(0, 0.1, (BUCKETS * len(LENGTHS), DIMENSIONS)).astype(np.float32)
    weights = random.normal(0, 0.1, (DIMENSIONS, len(languages) + 1)).astype(np.float32)
    bias = np.zeros(len(languages) + 1, np.float32)
    steps = EPOCHS * len(learned)
    for step in range(steps):
        if step % max(len(learned), 1) == 0:
            order = random.permutation(learned)
        k = order[step % len(learned)]
        buckets, counts = unpack(rows[k][1])
        share = counts / counts.sum()
        mean = share @ embeddings[buckets]
        error = softmax(mean @ weights + bias)
        error[classes[k]] -= 1
        rate = np.float32(RATE * (1 - step / steps))
        back = weights @ error
        weights -= rate / 10 * np.outer(mean, error)
        bias -= rate / 100 * error
        embeddings[buckets] -= rate * share[:, None] * len(share) ** 0.5 * back[None, :]
    table = embeddings @ weights
    model = Model(languages, table, bias, 1.0, -np.inf)
    if not held:
        return model
    logits = np.stack([counts / counts.sum() @ table[buckets] + bias for buckets, counts in (unpack(rows[k][1]) for k in held)])
    right = np.array([classes[k] for k in held])
    temperature = min((2.0**e for e in np.arange(-4, 4.25, 0.25)), key=lambda t: -np.log(softmax(logits / t)[np.arange(len(held)), right] + 1e-12).sum())
    p = softmax(logits / temperature)
    odds, named = language_odds(p), p[:, :-1].argmax(axis=1) == right
    sure, mixed = np.sort(odds[named]), np.sort(odds[right == len(languages)])
    threshold = float(sure[int(len(sure) * REJECTED_SHARE)]) if len(sure) else -np.inf
    if len(sure) and len(mixed):
        threshold = min(threshold, (threshold + float(mixed[int(len(mixed) * (1 - REJECTED_SHARE))])) / 2)
    # A text is summed in another order than its calibration row.
    return Model(languages, table, bias, float(temperature), threshold - ROUNDING)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_rows(documents: DataFrame, rows: int = TRAIN_ROWS) -> list[tuple[str | None, bytes]]:
    """At most ``rows`` labelled rows that are not held out, as packed bucket counts, evenly over the languages by a hash of their ids; and some of them mixed up, without a language."""
    labelled = documents.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    counts = labelled.groupBy("lang").count().collect()
    if not counts:
        return []
    each = max(rows // len(counts), 1)
    share = F.create_map(*[F.lit(x) for r in counts for x in (r[0], min(1.0, each / r[1]))])
    place = F.xxhash64(F.lit("langid"), "doc_id")
    drawn = labelled.where((F.pmod(place, F.lit(1 << 30)) / (1 << 30)) < share[F.col("lang")]).select(place.alias("place"), "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker()
        for batch in batches:
            for row, text in enumerate(raw(batch.column(2))):
                place = batch.column(0)[row].as_py()
                made = [packed_counts(text)]
                if place % MIXED_UP == 0:
                    made.append(packed_counts(mixed_up(text, place % (1 << 32))))
                n = len(made)
                yield pa.RecordBatch.from_arrays([pa.array([place] * n), pa.array([batch.column(1)[row].as_py()] * n, pa.string()), pa.array([False, True][:n]), pa.array(made)], ["place", "lang", "mixed", "packed"])

    packed = drawn.mapInArrow(run, "place long, lang string, mixed boolean, packed binary").orderBy("mixed", "place", "packed").limit(rows + rows // MIXED_UP)
    nothing = pack(np.zeros(0, np.int32))
    found = packed.select("lang", "mixed", "packed").toLocalIterator()
    return [(None if mixed else lang, bytes(own)) for lang, mixed, own in found if bytes(own) != nothing]


def fit_languages(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> Model | None:
    """A model of the labelled rows whose id's CRC-32 is not 2 modulo 4; None if there are none."""
    shipped(documents.sparkSession)
    named = documents.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    learned = training_rows(named, rows)
    random = np.random.default_rng(1)
    return fit([learned[k] for k in random.permutation(len(learned))]) if learned else None


def languages(documents: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, accepted)`` of each row, from its whole text alone.

    A text that is null or has no letter is ``und`` with score 0 and rejected;
    so is every text without a model. Another text is rejected if the odds
    that it is of any language lie under the model's threshold. Rows are judged one by
    one: repeated rows are equal, a null id is not held out, an empty table
    gives no rows.
    """
    judged = _judged(documents, model, text_col, F.col(f"`{id_col}`").cast("long").alias("doc_id"))
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")


def accepted_rows(documents: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``documents`` in an accepted language, as they came; a row's verdict travels with it, so none is joined back."""
    judged = _judged(documents, model, text_col, F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    return judged.where("accepted").select("row.*")


def _judged(documents: DataFrame, model: Model | None, text_col: str, carried: Column) -> DataFrame:
    """The carried column, ``lang_pred``, ``score`` and ``accepted`` of each row."""
    spark = shipped(documents.sparkSession)
    text = F.col(f"`{text_col}`")
    rows = documents.select(carried, text.alias("__text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("__letters"))
    sent = spark.sparkContext.broadcast(model)
    name = rows.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker()
        model = sent.value
        for batch in batches:
            found = [model.predict(t) if model and has.as_py() else (UNKNOWN, 0.0, False) for t, has in zip(raw(batch.column(1)), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())], [name, "lang_pred", "score", "accepted"])

    layout = T.StructType([rows.schema[name], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])
    return rows.mapInArrow(run, layout)
