"""Streaming ingest: new embedding files in a folder are upserted batch by batch. Keys make replays harmless."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import store
from ..schemas import CHIP_EMBEDDINGS


def ingest(spark: SparkSession, drop_folder: str, table_folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Watch ``drop_folder`` for Parquet files of ``schemas.CHIP_EMBEDDINGS``; ``once`` stops when all that is there is loaded."""
    rows = spark.readStream.schema(CHIP_EMBEDDINGS).parquet(drop_folder)

    def load(batch: DataFrame, _id: int) -> None:
        if not batch.isEmpty():
            store.upsert(batch.sparkSession, table_folder, batch)

    writer = rows.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
