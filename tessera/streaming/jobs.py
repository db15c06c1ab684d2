"""Streams: page extractions that replace their document as they arrive, and windowed counts with late rows. Not part of the batch
engine's parity; they reuse its operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.parsing import structured_chunks
from tessera.sources.files import replace_documents


def ingest_pages(spark: SparkSession, source: str, target: str, checkpoint: str, schema) -> StreamingQuery:
    """Parse new extraction files of a folder into structured chunks, replacing all chunks of the extractions in each batch. Repeating a
    batch gives the same table. Ends when all files there have been read."""

    def write(batch: DataFrame, _: int) -> None:
        replace_documents(structured_chunks(batch), target, "extract_id")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n, total) of a stream of events (ts, event_type, value); rows later than ``late`` are left out."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
