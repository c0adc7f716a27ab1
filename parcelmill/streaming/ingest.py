"""Incremental batches: new files are read once, validated, and results are upserted exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.jobs import upsert
from ..sources import files

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, folder: str, delay: str = "1 day") -> DataFrame:
    """Files as they arrive; copies that arrive within ``delay`` of each other are dropped by content, with
    state that the watermark bounds."""
    stream = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", "*.{jpg,jpeg,png,JPG,JPEG,PNG}").load(folder)
    seen = stream.select("path", "modificationTime", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.hex(F.substring("content", 1, 8)).alias("head"))
    return seen.withWatermark("modificationTime", delay).dropDuplicatesWithinWatermark(["sha256"])


def validated(df: DataFrame) -> DataFrame:
    """Header checks; sides are unknown until the image is decoded, so they count as sound here."""
    one = F.lit(1)
    return df.withColumn("error", files.first_error(F.col("size"), F.col("path"), F.col("head"), one, one))


def ingest(spark: SparkSession, folder: str, table: str, checkpoint: str, delay: str = "1 day") -> StreamingQuery:
    """Take what is there and stop.  Each micro-batch is written under its own number, so a batch that is
    tried again after a failure replaces itself; ``latest`` reads the last word on each digest."""

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return validated(file_stream(spark, folder, delay)).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, table: str) -> DataFrame:
    rows = spark.read.parquet(f"{table}/batch=*")
    return upsert(rows.select("sha256", "path", "size", "error", "batch"), ["sha256"], F.struct("batch", "path"))


def circuit(attempts: DataFrame, limit: int = 3) -> DataFrame:
    """Per job, in order: whether a call may be made.  The circuit opens after ``limit`` failures
    with no success before, and stays open."""
    from pyspark.sql import Window as W

    before = W.partitionBy("job_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    failed = F.coalesce(F.sum(F.when(~F.col("ok"), 1).otherwise(0)).over(before), F.lit(0))
    worked = F.coalesce(F.max(F.col("ok").cast("int")).over(before), F.lit(0))
    return attempts.select("job_id", "seq", ((worked == 1) | (failed < limit)).alias("allowed"))


def capped(requests: DataFrame, most: int) -> DataFrame:
    """Per job, in order: the calls that its cap admits (``allowed``); those that the circuit refuses do not count."""
    from pyspark.sql import Window as W

    upto = W.partitionBy("job_id").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)  # a batch's calls
    return requests.withColumn("allowed", F.col("allowed") & (F.sum(F.col("allowed").cast("int")).over(upto) <= most))
