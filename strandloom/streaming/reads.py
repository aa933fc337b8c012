"""Reads that arrive as files in a folder: running counts, duplicates within a watermark, the steps that keep no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.model import Reads, seq

SCHEMA = "read_no long, name string, seq string, qual string, arrived timestamp"


def stream(spark: SparkSession, folder: str, files_per_batch: int = 16) -> Reads:
    """Parquet files of reads that are added to a folder, as a frame that streams; read_no must be unique."""
    df = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return Reads(df.select("read_no", F.struct("name", "seq", "qual").alias("read1"), "arrived"), ("read1",), dense=False)


def without_duplicates(reads: Reads, delay: str = "1 hour") -> Reads:
    """Drops reads whose sequence came within the delay before; the state is bounded by the watermark."""
    keyed = reads.df.withColumn("_key", seq(reads.segments[0])).withWatermark("arrived", delay)
    return reads.with_df(keyed.dropDuplicatesWithinWatermark(["_key"]).drop("_key"))


def counts(reads: Reads, window: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Reads and bases by time of arrival."""
    marked = reads.df.withWatermark("arrived", delay)
    return marked.groupBy(F.window("arrived", window)).agg(F.count("*").alias("reads"), F.sum(F.length(seq(reads.segments[0]))).alias("bases"))


def drain(df: DataFrame, path: str, checkpoint: str) -> None:
    """Writes what has arrived so far under path, and returns; a later call goes on from the checkpoint."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
