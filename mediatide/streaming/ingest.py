"""Incremental ingestion and live counters with Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.progress import counters, windowed
from ..operators.store import ParquetStore


FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def files_as_they_come(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """New files below a folder: path, modification time and length; contents are read only if asked for."""
    return spark.readStream.schema(FILE_SCHEMA).format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)


def merge_into(stream: DataFrame, store: ParquetStore, keys: list[str], order: list[Column], checkpoint: str) -> StreamingQuery:
    """Every batch upserted into the store; the checkpoint is where a stopped run goes on."""

    def merge(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.upsert(batch, keys, order)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_counters(events: DataFrame, by: list[str], name: str) -> StreamingQuery:
    """Job counters that can be read from the in-memory table ``name`` while the stream runs."""
    return counters(events, by).writeStream.outputMode("complete").format("memory").queryName(name).start()


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a data directory as a stream of its files, whether it is one file or a folder of files."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def run_to_end(counts: DataFrame) -> DataFrame:
    """What a stream of counts comes to once all that is there has been read. The result must be small: it is held in memory."""
    name = f"counts_{uuid.uuid4().hex}"
    counts.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return counts.sparkSession.table(name)


def live_windows(events: DataFrame, name: str, width: str = "1 hour", late: str = "10 minutes") -> StreamingQuery:
    """Counts per window, each written once its window is past the watermark."""
    return windowed(events, width, late).writeStream.outputMode("append").format("memory").queryName(name).start()
