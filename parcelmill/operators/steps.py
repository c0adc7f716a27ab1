"""Steps of jobs that need several: results written to the folder that all machines share, and broadcasts of a checked size."""

from __future__ import annotations

import re
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all machines share.  Only a local master (tests on one machine) may go without that setting."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or Path(tempfile.mkdtemp(prefix="parcelmill-")).as_uri())
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df``, marked for broadcast if it has at most ``rows`` rows; it is read for that, so cut it first."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Bytes of a table that is dealt out anew where its files give fewer parts than there are cores.
SPREAD = (1 << 20, 256 << 20)


def spread(scan: DataFrame) -> DataFrame:
    """A small table in one file of one row group is read by one task, whatever the cores: it is dealt out over them.  Larger tables have parts
    enough, and are never moved for this; columns and filters still reach the scan."""
    execution = scan._jdf.queryExecution()
    size = int(str(execution.optimizedPlan().stats().sizeInBytes()))
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if SPREAD[0] <= size <= SPREAD[1] and execution.toRdd().getNumPartitions() < cores:
        return scan.repartition(cores)
    return scan
