"""Continuous intake of documents into the term frequencies of an index (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from siltwork.operators.index import term_frequencies


def documents(spark: SparkSession, path: str, schema: str = "doc_id string, text string, loaded_at timestamp") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def first_deliveries(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """The first delivery of each document within the watermark; state older than ``delay`` is dropped."""
    return stream.withWatermark("loaded_at", delay).dropDuplicatesWithinWatermark(["doc_id"])


def index_stream(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append the term frequencies of each batch under its own folder: a batch that runs again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        term_frequencies(batch.select("doc_id", "text")).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(write).start()
