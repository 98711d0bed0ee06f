"""The bucketed chunk table, its stream, and documents as files."""

import pytest
from pyspark.sql import functions as F

from fitgrain.sources import tables as io
from fitgrain.streaming.upsert import upsert_batch, upsert_stream

LAYOUT = "chunk_id string, chunk_index int, chunk string"


def chunks(spark, numbers):
    return spark.createDataFrame([(f"d_{k}", k, f"text {k}") for k in numbers], LAYOUT)


def stored(spark, path):
    return sorted(map(tuple, io.read_chunks(spark, path).select("chunk_id", "chunk_index", "chunk").collect()))


def test_upsert_reads_only_touched_buckets(spark, tmp_path):
    path = f"{tmp_path}/table"
    io.upsert_chunks(chunks(spark, range(300)), path, buckets=16)
    io.upsert_chunks(chunks(spark, [5, 300, 300, 301]), path, buckets=99)  # the table keeps its own number
    want = sorted((f"d_{k}", k, f"text {k}") for k in range(302))
    assert stored(spark, path) == want
    sizes = {r["bucket"]: r["count"] for r in spark.read.parquet(path).groupBy("bucket").count().collect()}
    assert set(sizes) == set(range(16))
    known = io.known_ids(spark, path, [3, 7])
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    assert {f"bucket={b}" for b in (3, 7)} == {r[0].split("/")[-2] for r in known.select(F.input_file_name()).distinct().collect()} and known.count() == sizes[3] + sizes[7]
    io.upsert_chunks(chunks(spark, []), path)
    assert stored(spark, path) == want


def test_conflicts_write_nothing(spark, tmp_path):
    path = f"{tmp_path}/table"
    both = chunks(spark, range(9)).union(spark.createDataFrame([("d_4", 4, "another")], LAYOUT))
    with pytest.raises(ValueError, match="d_4"):
        io.upsert_chunks(both, path)
    io.upsert_chunks(chunks(spark, range(3)), path)
    with pytest.raises(ValueError, match="d_4"):
        io.upsert_chunks(both, path)
    assert len(stored(spark, path)) == 3


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    path = f"{tmp_path}/table"
    assert upsert_batch(chunks(spark, range(20)), 0, path)
    assert not upsert_batch(chunks(spark, range(20, 30)), 0, path)  # this batch is done
    io.upsert_chunks(chunks(spark, range(20, 40)), path)  # batch 1 as if its mark was lost with the driver
    assert upsert_batch(chunks(spark, range(20, 40)), 1, path)
    assert len(stored(spark, path)) == 40


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    source, path, state = f"{tmp_path}/in", f"{tmp_path}/table", f"{tmp_path}/state"
    for numbers in (range(10), range(5, 25)):
        chunks(spark, numbers).write.mode("append").parquet(source)
        stream = spark.readStream.schema(LAYOUT).parquet(source)
        upsert_stream(stream, path, state).awaitTermination()
    assert [k for _, k, _ in sorted(stored(spark, path), key=lambda r: r[1])] == list(range(25))
    assert spark.read.text(f"{path}/_batches/*").count() == 2


def test_document_files_are_counted(spark, tmp_path):
    files = {"a/x.txt": b"Words, some.", "a/y.txt": b" \n\t", "b/z.txt": b"", "b/w.txt": b"caf\xe9", "b/v.txt": "café".encode()}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = io.scan_documents(spark, f"{tmp_path}/*/*.txt")
    rows = {f"{r['folder']}/{r['name']}": (r["status"], r["text"]) for r in found.collect()}
    assert rows == {"a/x.txt": ("read", "Words, some."), "a/y.txt": ("empty", " \n\t"), "b/z.txt": ("empty", ""), "b/w.txt": ("failed", None), "b/v.txt": ("read", "café")}
    report = {r["status"]: (r["files"], r["chars"]) for r in io.document_report(found).collect()}
    assert report == {"read": (2, 16), "empty": (2, 3), "failed": (1, 0)}
