"""What the operators share: reading texts, Arrow batches and the words of a text."""

from __future__ import annotations

import sys
import zipfile
from collections.abc import Callable, Iterator
from functools import cache
from pathlib import Path
from tempfile import TemporaryDirectory

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import fitgrain

#: The white space of the contracts: ``[\x20\x09-\x0D]``, which is also what ``bytes.split()`` splits at.
SPACE = "[\\x20\\x09-\\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


@cache
def _shipped_to(application: str) -> TemporaryDirectory:
    """Python workers import this package from a copy that the driver serves until it ends, as with ``--py-files``."""
    root = Path(fitgrain.__file__).resolve().parent
    folder = TemporaryDirectory()
    target = Path(folder.name) / "fitgrain.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    SparkContext.getOrCreate().addPyFile(str(target))
    sys.path[:] = [p for p in sys.path if not p.endswith("fitgrain.zip")]
    return folder


def shipped(spark: SparkSession) -> SparkSession:
    _shipped_to(spark.sparkContext.applicationId)
    return spark


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the id and the text, as ``doc_id`` and ``text``, and columns named in ``more``; others cannot clash."""
    shipped(df.sparkSession)
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *(F.col(f"`{c}`") for c in more))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else. An ASCII text takes the fast way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The runs without white space, in order; none of a null or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def raw(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


#: What an entry of a worker's cache takes besides its characters and bytes.
ENTRY_BYTES = 220
_kept: dict[object, object] = {}


def kept_in_worker(key: object, make: Callable[[], object]) -> object:
    """A value that lives on in this Python worker from task to task, the only one: that of another operator goes."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def release_worker() -> None:
    """Drop what another operator keeps in this worker."""
    _kept.clear()


class Recent:
    """Values by key in two generations that together take about ``limit`` bytes, besides the keys of one request."""

    def __init__(self, limit: int) -> None:
        self.limit, self.used, self.now, self.older, self.long = limit, 0, {}, {}, []

    def ready(self, keys: Iterable[str], make: Callable[[list[str]], Iterable[bytes]], long: int = 64) -> dict[str, bytes]:
        """The values, all of ``keys`` among them; keys of over ``long`` characters stay until ``forget_long``."""
        if 2 * self.used >= self.limit:
            self.older, self.now, self.used = self.now if self.used <= self.limit else {}, {}, 0
        now, older, new, again = self.now, self.older, [], 0
        for key in keys:
            if key not in now:
                value = older.get(key)
                if value is None:
                    new.append(key)
                else:
                    now[key] = value
                    again += len(key) + len(value) + ENTRY_BYTES
        made = list(make(new))
        now.update(zip(new, made))
        self.used += again + sum(map(len, new)) + sum(map(len, made)) + ENTRY_BYTES * len(new)
        self.long = [key for key in new if len(key) > long]
        return now

    def forget_long(self) -> None:
        for key in self.long:
            self.used -= len(key) + len(self.now.pop(key)) + ENTRY_BYTES
        self.long = []


def per_batch(f: Callable[[pa.RecordBatch], dict[str, object]], schema: pa.Schema):
    """A function for ``mapInArrow`` that turns each batch into columns of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = f(batch)
                yield pa.RecordBatch.from_arrays([pa.array(columns[x.name], x.type) for x in schema], schema=schema)

    return run
