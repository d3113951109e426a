"""The batch transforms on arriving documents: micro-batches, each written once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from brindle.operators import chunking


def stream_documents(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "json", per_trigger: int | None = None) -> DataFrame:
    """Files that arrive in a folder, as a stream."""
    reader = spark.readStream.schema(schema).format(fmt)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).load(folder)


def write_batches(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Run a batch transform on every micro-batch and write it to its own folder, so that a repeated batch replaces itself."""

    def one(batch: DataFrame, epoch: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def chunk_stream(stream: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Chunking is in-row, so it runs on a stream as it is."""
    return chunking.chunk_documents(stream, doc_id, text)


def counts_by_window(stream: DataFrame, at: str, key: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """``(start, key, n)`` by event time; rows later than ``late`` are dropped with their state."""
    w = stream.withWatermark(at, late).groupBy(F.window(at, window), key).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), key, "n")
