"""Table scans and sinks."""

from __future__ import annotations

import itertools
import os
import uuid
from collections.abc import Iterator, Mapping, Sequence
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitgrain import schema


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists, on any file system Spark reads."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def scan(
    spark: SparkSession, path: str, layout: T.StructType | None = None, fmt: str = "csv", hint: str = ""
) -> DataFrame:
    """A CSV or Parquet table; a missing path is an error that names it.

    CSV is read with ``layout``; without one the types are inferred, which
    costs a pass over the data.
    """
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no data at '{path}'. {hint}".strip())
    reader = spark.read if layout is None else spark.read.schema(layout)
    if fmt == "csv":
        reader = reader.option("header", True)
        if layout is None:
            reader = reader.option("inferSchema", True)
        return reader.csv(path)
    return reader.format(fmt).load(path)


def optional_scan(
    spark: SparkSession, path: str, layout: T.StructType | None = None, fmt: str = "csv"
) -> DataFrame | None:
    """Like :func:`scan`, but ``None`` where nothing is there."""
    return scan(spark, path, layout, fmt) if path_exists(spark, path) else None


def write_predictions(scored: DataFrame, path: str, fmt: str = "csv", id_col: str = schema.ID) -> None:
    """``(ID, Prediction)`` with a header; one file per partition, none collected."""
    out = scored.select(id_col, "Prediction").write.mode("overwrite")
    out.option("header", True).csv(path) if fmt == "csv" else out.format(fmt).save(path)


#: Buckets of a new chunk table. A bucket is what one task reads and writes, so a table of n GB wants about n of them.
BUCKETS = 32


def upsert_chunks(chunks: DataFrame, path: str, key: str = "chunk_id", buckets: int = BUCKETS) -> None:
    """Append the chunks whose id is not in the table yet; a second run adds nothing.

    The table is dealt out to buckets by a hash of the id, whose number is
    kept with it. Only ids of buckets that the new chunks touch are read.
    Texts are shuffled once, by bucket; repeated and conflicting ids are told
    apart there. One id for two different chunks is an error, and nothing is
    written: either of them would be lost.
    """
    spark = chunks.sparkSession
    if path_exists(spark, f"{path}/_buckets"):
        buckets = int(read_json_document(spark, f"{path}/_buckets"))
    else:
        write_json_document(spark, f"{path}/_buckets", str(buckets))
    others = [c for c in chunks.columns if c != key]
    content = F.xxhash64(*[c for c in ("chunk_index", "chunk") if c in others] or [F.lit(0)])
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")
    dealt = chunks.select(bucket, key, content.alias("content"), F.struct(*others).alias("row")).repartition("bucket")
    one = dealt.groupBy("bucket", key).agg(F.min("content").alias("low"), F.max("content").alias("high"), F.first("row").alias("row"))
    conflict = F.raise_error(F.concat(F.lit("'"), F.col(key).cast("string"), F.lit("' names two different chunks"))).cast(one.schema["row"].dataType)
    rows = one.select("bucket", key, F.when(F.col("low") == F.col("high"), F.col("row")).otherwise(conflict).alias("row"))
    if path_exists(spark, f"{path}/_SUCCESS"):
        touched = [r[0] for r in chunks.select(bucket).distinct().collect()]
        rows = rows.join(known_ids(spark, path, touched, key), ["bucket", key], "left_anti")
    try:
        rows.select("bucket", key, "row.*").write.mode("append").partitionBy("bucket").parquet(path)
    except PySparkException as e:
        if "names two different chunks" in str(e):
            raise ValueError(str(e)) from None
        raise


def known_ids(spark: SparkSession, path: str, buckets: Sequence[int], key: str = "chunk_id") -> DataFrame:
    """``(bucket, id)`` of the given buckets of a chunk table; other buckets' files are not read."""
    return spark.read.parquet(path).filter(F.col("bucket").isin(*buckets)).select("bucket", key)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """A chunk table as it was given, without its buckets."""
    return spark.read.parquet(path).drop("bucket")


LOG_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("train_rows", T.LongType()),
        T.StructField("val_rows", T.LongType()),
        T.StructField("n_features", T.IntegerType()),
        T.StructField("feature_cols", T.ArrayType(T.StringType())),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("model_path", T.StringType()),
    ]
)


def append_log(
    spark: SparkSession,
    path: str,
    train_rows: int,
    val_rows: int,
    features: Sequence[str],
    metrics: Mapping[str, float],
    model_path: str,
    timestamp: str | None = None,
) -> None:
    """One JSON record per training run."""
    when = timestamp or datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")
    row = (when, train_rows, val_rows, len(features), list(features), dict(metrics), model_path)
    spark.createDataFrame([row], LOG_SCHEMA).coalesce(1).write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).json(path)


def write_json_document(spark: SparkSession, path: str, text: str) -> None:
    """A small document of learned facts, next to the maps it belongs to."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json_document(spark: SparkSession, path: str) -> str:
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no saved model at '{path}': fit and save it first")
    return spark.read.text(path).first()["value"]


def read_pages_as_text(pages: DataFrame, doc: str, page_no: str, text: str) -> DataFrame:
    """Pages of a document joined by line breaks in page order; a null page is empty.

    The pages of one document end up in one row, as the document itself does.
    """
    page = F.struct(F.col(page_no).alias("no"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    ordered = F.transform(F.array_sort(F.collect_list(page)), lambda p: p["t"])
    return pages.groupBy(doc).agg(F.array_join(ordered, "\n").alias("text"))


def scan_text_files(spark: SparkSession, pattern: str) -> DataFrame:
    """``(name, text)`` for each file matching ``pattern``, whole files as rows."""
    return (
        spark.read.text(pattern, wholetext=True)
        .select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), F.col("value").alias("text"))
    )


def write_text_files(rows: DataFrame, path: str, name: str = "name", text: str = "text") -> None:
    """The texts of each name as lines of one file below ``path/name=…``, as Spark's writer of partitioned text lays them out.

    Below a local or mounted path Spark's file system starts a process for the
    rights of each file and folder, which takes far longer than the file: tasks
    write there themselves. Each file is put in place whole.
    """
    spark = rows.sparkSession
    # A file takes far longer than its row: all cores get some, rows of one name the same one.
    dealt = rows.select(F.col(name).cast("string").alias("name"), F.col(text).alias("text"))
    dealt = dealt.repartition(max(4 * spark.sparkContext.defaultParallelism, dealt.rdd.getNumPartitions()), "name")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toUri()
    if uri.getScheme() != "file" or dealt.filter(~F.col("name").rlike(r"\A[\w.-]+\z")).limit(1).count():
        # Tasks put their own files in place; else the driver moves them one by one when all are done.
        dealt.write.partitionBy("name").option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)
        return
    root = uri.getPath()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (pair for b in batches for pair in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        n, last = 0, f"part-{TaskContext.get().partitionId():05d}.txt"
        for folder, pairs in itertools.groupby(found, lambda pair: pair[0]):
            into = f"{root}/name={'__HIVE_DEFAULT_PARTITION__' if folder is None else folder}"
            os.makedirs(into, exist_ok=True)
            with open(unfinished := f"{into}/.{uuid.uuid4().hex}", "wb") as f:
                f.writelines((t or "").encode() + b"\n" for _, t in pairs)
            os.replace(unfinished, f"{into}/{last}")
            n += 1
        yield pa.RecordBatch.from_pydict({"n": [n]})

    os.makedirs(root)
    dealt.sortWithinPartitions("name").mapInArrow(run, "n long").agg(F.sum("n")).first()


def empty_files(spark: SparkSession, pattern: str) -> list[str]:
    """The paths of files without a byte, which Spark's scans leave out."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where) or []
    return [f.getPath().toString() for f in found if f.getLen() == 0 and f.isFile()]


def empty_files_below(spark: SparkSession, folder: str, files: str) -> list[str]:
    """The paths of files of that name without a byte, at any depth below ``folder``."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    where, wanted = hadoop.Path(folder), hadoop.GlobPattern(files)
    found, out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(where, True), []
    while found.hasNext():
        f = found.next()
        if f.getLen() == 0 and wanted.matches(f.getPath().getName()):
            out.append(f.getPath().toString())
    return out


def scan_documents(spark: SparkSession, pattern: str, files: str | None = None) -> DataFrame:
    """``(folder, name, text, status)`` of each file matching ``pattern``, or of those named ``files`` below the folder ``pattern``.

    A file that is not UTF-8 is ``failed`` and has no text, one with white
    space only or without a byte is ``empty``, any other is ``read``; none is
    left out. Files are listed by the driver, as Spark lists what it reads; the
    folders below one folder are listed by tasks.
    """
    text = F.try_validate_utf8(F.col("content").cast("string"))
    reader = spark.read.format("binaryFile")
    if files is None:
        found, empty = reader.load(pattern), empty_files(spark, pattern)
    else:
        found = reader.option("recursiveFileLookup", True).option("pathGlobFilter", files).load(pattern)
        # Without empty ones as many are read as were listed, which is soon known.
        listed = len(found._jdf.inputFiles())
        empty = empty_files_below(spark, pattern, files) if found.select("path").count() < listed else []
    files_read = found.select("path", text.alias("text"))
    nothing = spark.createDataFrame([(path, "") for path in empty], "path string, text string")
    blank = F.btrim(F.col("text"), F.lit(" \t\n\r\x0b\f")) == ""
    status = F.when(F.col("text").isNull(), "failed").when(blank, "empty").otherwise("read")
    parts = F.split("path", "/")
    folder, name = F.regexp_replace(F.element_at(parts, -2), "^[^=]*=", ""), F.element_at(parts, -1)
    return files_read.unionByName(nothing).select(folder.alias("folder"), name.alias("name"), "text", status.alias("status"))


def document_report(files: DataFrame) -> DataFrame:
    """``(status, files, chars)``: how many files were read, are empty or failed, without their texts."""
    return files.groupBy("status").agg(F.count("*").alias("files"), F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("chars"))
