"""Streams of reads: row-local decoding, windowed counts, and packets merged batch by batch."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder; where none is set, a temporary one of a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='strandlake-')}"
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def read_stream(spark: SparkSession, like: str, *, per_trigger: int = 16) -> DataFrame:
    """New Parquet files at a path, with the schema of those that are there."""
    schema = spark.read.parquet(like).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{like}*")


def run_to_end(stream: DataFrame, *, mode: str = "append") -> DataFrame:
    """Process all there is and give the result as a table."""
    spark, folder = stream.sparkSession, scratch(stream.sparkSession)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    writer.format("parquet").option("path", f"{folder}/out").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def decode_arriving(reads: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Row-local decoding of a stream: any chain of column expressions or Arrow maps."""
    return step(reads)


def window_counts(events: DataFrame, ts: str, *keys: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts by window and keys; what comes later than ``late`` is left out."""
    timed = events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    counted = timed.groupBy(F.window("_t", width).alias("w"), *keys).count()
    return counted.select(F.col("w.start").alias("start"), *keys, F.col("count").alias("n"))


def merge_batches(stream: DataFrame, store: str, key: list[str]) -> None:
    """Append each batch to a Parquet store, one row for each key of the batch; replays of a batch are overwritten."""

    def merge(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(key).write.mode("overwrite").parquet(f"{store}/batch={number}")

    folder = scratch(stream.sparkSession)
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", folder).trigger(availableNow=True).start().awaitTermination()
