"""New files into a store as they appear. An extension: the engine's own indexing is one batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.operators.store import ChunkStore


def file_stream(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(file, content) of files below ``root``, as they come."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(root)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def index_stream(files: DataFrame, chunks_of: Callable[[DataFrame], DataFrame], store: ChunkStore, checkpoint: str):
    """Start a query that turns each micro-batch of files to chunks and adds those whose id is new."""

    def add(batch: DataFrame, _: int) -> None:
        store.add(chunks_of(batch))

    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n) per tumbling window of ``ts``, with late rows up to the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n")
