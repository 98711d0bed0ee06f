"""A stream of chunks into the bucketed chunk table, each batch once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from fitgrain.sources.tables import BUCKETS, path_exists, upsert_chunks, write_json_document


def upsert_batch(chunks: DataFrame, batch: int, path: str, key: str = "chunk_id", buckets: int = BUCKETS) -> bool:
    """Upsert one batch; False if it is marked as done.

    The mark is written after the chunks. A batch that is replayed because its
    mark is missing finds its ids in the table and adds nothing.
    """
    spark = chunks.sparkSession
    mark = f"{path}/_batches/{batch}"
    if path_exists(spark, mark):
        return False
    upsert_chunks(chunks, path, key, buckets)
    write_json_document(spark, mark, str(batch))
    return True


def upsert_stream(chunks: DataFrame, path: str, checkpoint: str, key: str = "chunk_id", buckets: int = BUCKETS, available_now: bool = True) -> StreamingQuery:
    """Upsert the chunks of a stream batch by batch; after a restart it goes on from the checkpoint."""
    writer = chunks.writeStream.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.foreachBatch(lambda rows, batch: upsert_batch(rows, batch, path, key, buckets) and None).start()
