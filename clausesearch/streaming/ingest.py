"""Incremental indexing: a stream of chunk files, upserted batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clausesearch.sources.store import ChunkStore


def ingest_stream(spark: SparkSession, source: str, store_folder: str, checkpoint: str, order: list[str], files_per_batch: int = 16) -> DataFrame:
    """Upserts all Parquet files of ``source`` (a folder, or a pattern of files) that were not seen before into the store, and gives its table.

    Restarts continue after the last finished batch; a batch that runs twice leaves the same table.
    """
    store = ChunkStore(spark, store_folder)
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    stream.writeStream.foreachBatch(lambda batch, _: store.upsert(batch, order) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return store.read()
