"""A training-data pipeline: documents through five operators, each stage's table read by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitgrain.llm import bpe, decontam, langid, lines, simhash
from fitgrain.llm.catalog import RANK_FILE, table
from fitgrain.session import written

#: SQL cannot express the learned language model, SimHash or byte-pair merges; tests hold the stages against ``run`` and planted rows; no plain-Python version of the whole is written yet.
ORACLE_SQL = None
#: Each stage judges rows by a key of its own, never by ``doc_id``.
ROW = "__row"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an accepted language; ``lang`` stays as it came."""
    return langid.accepted_rows(docs, langid.fit_languages(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one holds; ``n_chars`` follows, a document that lost all its lines goes."""
    marked = lines.apply_bitmaps(docs, lines.line_bitmaps(docs))
    kept = marked.where((F.col("n_dropped") == 0) | (F.col("n_dropped") < F.col("n_lines")))
    changed = F.col("n_dropped") > 0
    return kept.select(*[F.when(changed, F.col("kept_text")).otherwise(F.col(c)).alias(c) if c == "text" else F.when(changed, F.char_length("kept_text").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies. Rows without an id go if their group has one, else they all stay."""
    keyed = _keyed(docs)
    found = simhash.near_duplicates(keyed, row_col=ROW)
    return _rows(keyed, found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(ROW), "left_semi")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    keyed = _keyed(docs)
    found = decontam.contaminated(keyed, table(spark, sf_dir, "benchmark"), id_col=ROW)
    return _rows(keyed, written(found.select(F.col("doc_id").alias(ROW)), "contaminated"), "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, the number of tokens, and digests of the ids and of the bytes they decode to."""
    return bpe.bpe_digests(docs, public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with a key of each row, written so that it stays: ids may be missing or repeated."""
    return written(docs.withColumn(ROW, F.monotonically_increasing_id()), "keyed-rows")


def _rows(keyed: DataFrame, found: DataFrame, how: str) -> DataFrame:
    return keyed.join(found, ROW, how).drop(ROW)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_near),
    ("decontamination", decontaminate),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents below ``sf_dir``; each is written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
