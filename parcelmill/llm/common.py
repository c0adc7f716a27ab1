"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.steps import spread

BATCH_BYTES = 8 << 20


def bounded(spark: SparkSession) -> None:
    """Arrow batches of a few MB: by rows alone, very long texts would make them large."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "64m").lower().rstrip("b")
    scale = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now[-1:], 1)
    if now.lstrip("-").rstrip("kmg").isdigit() and not 0 < int(now.rstrip("kmg")) * scale <= BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, through Spark's reader only."""
    bounded(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only where that is unset and the master is local (tests on
    one machine) a folder of this machine."""
    bounded(spark)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        set_dir = spark.conf.get("spark.checkpoint.dir", None)
        if set_dir is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(set_dir or Path(tempfile.mkdtemp(prefix="parcelmill-")).as_uri())
    return sc.getCheckpointDir()


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, lengthened until no column of the frames has it (in any case)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def key_of(docs: DataFrame) -> Column:
    """The row key that ``with_key`` gives."""
    return F.xxhash64(docs["doc_id"], F.coalesce(docs["text"], F.lit("")))


def cut(df: DataFrame, narrow: bool = False) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the copy.  ``narrow``: rows are few and
    short for each core, so a few parts a core will do, whatever the number of shuffle partitions."""
    shared_dir(df.sparkSession)
    return (df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism) if narrow else df).checkpoint(eager=True)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a folder that was written for a step and is read no more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


BROADCAST_BYTES = 16 << 20


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, marked for broadcast if it has at most ``rows`` rows; it is read for that, so cut it first."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def with_key(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``text`` (null: empty) and ``row_key``, which tells rows that share a doc_id
    apart by their text.  Rows equal in both share the key, and every result computed for them."""
    bounded(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), key_of(docs).alias("row_key"), *more)
