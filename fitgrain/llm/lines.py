"""Line dedup: range-partitioned line hashes, a secondary sort, and a bitmap of kept lines for each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitgrain.llm.common import SPACE_CHARS, ascii_lower, texts
from fitgrain.session import written

MIN_KEY_CHARS = 10
#: A key with more than this share of all lines is hot; fewer than 1 / share keys can be.
HOT_SHARE = 1 / 1000
#: and with more lines than this.
HOT_LINES = 1000


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_hashes(docs: DataFrame, min_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """``(h1, h2, doc_id, pos)`` of each line whose key is long enough: 128 bits of its key."""
    exploded = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.posexplode(split_lines(ascii_lower(F.col("text")))).alias("pos", "line"))
    keyed = exploded.select("doc_id", "pos", F.btrim("line", F.lit(SPACE_CHARS)).alias("key")).where(F.char_length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "pos")


def dropped_lines(lines: DataFrame) -> DataFrame:
    """``(doc_id, pos)`` of each line whose key an earlier document holds.

    Hot keys are few, so their first documents are broadcast and their lines
    stay where they are. All other hashes are range-partitioned, sorted by
    document and position, and the first document runs along.
    """
    per_key = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    total = lines.count()
    hot = written(per_key.where(F.col("n") > F.lit(max(float(HOT_LINES), total * HOT_SHARE))).select("h1", "h2", "first"), "hot-lines")
    hot_lines = lines.join(F.broadcast(hot), ["h1", "h2"])
    by_document = Window.partitionBy("h1", "h2").orderBy("doc_id", "pos")
    cold = (
        lines.join(F.broadcast(hot), ["h1", "h2"], "left_anti")
        .repartitionByRange("h1", "h2")
        .withColumn("first", F.first("doc_id").over(by_document))
    )
    found = hot_lines.select("doc_id", "pos", "first").unionByName(cold.select("doc_id", "pos", "first"))
    return found.where(F.col("doc_id") > F.col("first")).select("doc_id", "pos")


def keep_bitmaps(dropped: DataFrame) -> DataFrame:
    """``(doc_id, keep)``: 64 lines to a word, up to the last word that drops a line.

    Documents that keep all their lines have no row, words past the end are all ones.
    """
    bits = dropped.groupBy("doc_id", F.expr("cast(pos div 64 as int)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pos % 64 as int))")).alias("bits"))
    entries = bits.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("drop"), F.max("word").alias("last"))
    return entries.select("doc_id", F.expr("transform(sequence(0, last), w -> ~coalesce(drop[w], 0L))").alias("keep"))


def line_bitmaps(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """``(doc_id, keep)`` of the documents that lose lines.

    A line's key is the line without white space at its ends, A-Z lower-cased.
    A key of ``min_chars`` code points or more in two documents stays in the
    smallest id only; there, and in no other document, all its lines stay.
    Null and empty texts are one empty line, which has no key. A row without an
    id keeps its lines and takes none from others. Repeated rows are one
    document: both lose the same lines. An empty table gives no bitmaps.
    """
    lines = written(line_hashes(texts(documents, id_col, text_col), min_chars), "lines")
    return keep_bitmaps(dropped_lines(lines))


def kept(lines: str, keep: str) -> Column:
    """The lines that a bitmap keeps; all without one."""
    test = f"(shiftright(coalesce(get({keep}, cast(i div 64 as int)), -1L), cast(i % 64 as int)) & 1L) = 1L"
    return F.expr(f"CASE WHEN {keep} IS NULL THEN {lines} ELSE filter({lines}, (x, i) -> {test}) END")


def apply_bitmaps(documents: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``documents`` with ``kept_text``, ``n_lines`` and ``n_dropped``; one row for each row."""
    marks = bitmaps.select(F.col("doc_id").alias("__id"), F.col("keep").alias("__keep"))
    joined = documents.join(marks, F.col(f"`{id_col}`") == F.col("__id"), "left")
    lined = joined.withColumn("__lines", split_lines(F.col(f"`{text_col}`"))).withColumn("__kept", kept("__lines", "__keep"))
    return (
        lined.withColumn("n_lines", F.size("__lines").cast("long"))
        .withColumn("n_dropped", (F.size("__lines") - F.size("__kept")).cast("long"))
        .withColumn("kept_text", F.when(F.col("__keep").isNull(), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).otherwise(F.array_join("__kept", "\n")))
        .drop("__id", "__keep", "__lines", "__kept")
    )
