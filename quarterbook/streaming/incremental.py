"""Incremental ingestion: new filings go into a store of books, of which a batch replaces only the quarters it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from .bookstore import BookStore


def start(spark: SparkSession, landing: str, schema: StructType, store: BookStore, checkpoint: str, files_per_batch: int = 80) -> StreamingQuery:
    """Takes what is new in the landing folder (a JSON record for each filing, with its rows) and stops; the checkpoint is the cursor.

    A batch that is tried again is known by its number. What it touched is under `touched` of the store, by batch.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        store.ingest(batch, f"stream-{batch_id}").write.mode("overwrite").parquet(f"{store.root}/touched/batch={batch_id}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(landing)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
