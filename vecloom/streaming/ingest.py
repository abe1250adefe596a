"""An extension: vector chunks arriving as files, ingested once each by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

CHUNKS = "model string, level int, point_id long, vec array<float>, arrived timestamp"


def chunk_stream(spark: SparkSession, path: str) -> DataFrame:
    """Vectors of chunk files, each (model, level, point_id) once within a day's watermark."""
    rows = spark.readStream.schema(CHUNKS).parquet(path)
    return rows.withWatermark("arrived", "1 day").dropDuplicatesWithinWatermark(["model", "level", "point_id"])


def ingest(spark: SparkSession, path: str, store: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append the stream to a store partitioned by model and level; a restart resumes from the checkpoint."""
    w = chunk_stream(spark, path).writeStream.format("parquet").option("path", store).option("checkpointLocation", checkpoint).partitionBy("model", "level").outputMode("append")
    return (w.trigger(availableNow=True) if once else w).start()
