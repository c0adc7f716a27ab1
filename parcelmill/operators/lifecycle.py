"""The batch job as calls: submit, resume, results, cancel; its tables are Parquet folders."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import TERMINAL_STAGES
from . import jobs as J


class BatchTooLarge(ValueError):
    code = "BATCH_TOO_LARGE"


@dataclass
class Jobs:
    """Jobs below a shared folder.  ``process`` turns inputs (one per content) into results."""

    spark: SparkSession
    root: str
    process: Callable[[DataFrame], DataFrame]
    max_batch: int = 500
    batch: int = 0  # contents processed at a time; 0: all

    def _path(self, job: str, name: str) -> str:
        return f"{self.root}/{job}/{name}"

    def _state(self, job: str, stage: str, processed: int = 0, total: int = 0, error: str = "") -> None:
        """One more row of the job's log; the last one holds."""
        now = time.time_ns()
        row = self.spark.createDataFrame([(job, now, stage, processed, total, error)], "job_id string, at long, stage string, processed long, total long, error string")
        row.write.mode("append").parquet(self._path(job, "log"))

    def submit(self, inputs: DataFrame) -> str:
        """``inputs``: pos, filename, sha256.  Returns the job's id when its results are stored; if processing
        fails or is cancelled between batches, what is stored stays and the job can be resumed."""
        n = inputs.limit(self.max_batch + 1).count()
        if not n:
            raise ValueError("no inputs")
        if n > self.max_batch:
            raise BatchTooLarge(f"more than {self.max_batch} inputs")
        job = uuid.uuid4().hex
        stored = inputs.withColumn("stored_name", F.concat(F.expr("replace(uuid(), '-', '')"), F.regexp_extract("filename", r"(\.[^.]*)?\z", 0)))
        stored.write.parquet(self._path(job, "manifest"))
        self._state(job, "QUEUED", total=n)
        self._run(job, self.spark.read.parquet(self._path(job, "manifest")))
        return job

    def _run(self, job: str, inputs: DataFrame) -> None:
        """Process the first of each content, ``batch`` at a time; after each batch its results are stored and counted."""
        first = J.canonical(inputs.select("sha256", "pos", "filename"), "sha256", "pos")
        parts = max(1, -(-first.count() // (self.batch or self.max_batch)))
        total = inputs.count()
        self._state(job, "PROCESSING", self._processed(job), total)
        for k in range(parts):
            if self.get_job(job)["stage"] == "CANCELLED":
                return
            mine = first if parts == 1 else first.where(F.pmod(F.xxhash64("sha256"), F.lit(parts)) == k)
            try:
                self.process(mine).write.mode("append").parquet(self._path(job, "results"))
            except Exception as error:
                self._state(job, "FAILED", self._processed(job), total, type(error).__name__)
                raise
            if self.get_job(job)["stage"] != "CANCELLED":
                self._state(job, "PROCESSING", self._processed(job), total)
        if self.get_job(job)["stage"] != "CANCELLED":
            self._state(job, "COMPLETED", self._processed(job), total)

    def _stored(self, job: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self._path(job, "results"))
        except AnalysisException:
            return None

    def _processed(self, job: str) -> int:
        stored = self._stored(job)
        return 0 if stored is None else stored.select("sha256").distinct().count()

    def get_job(self, job: str) -> dict:
        """Stage and counts as last logged."""
        log = self.spark.read.parquet(self._path(job, "log"))
        last = log.agg(F.max_by(F.struct(*log.columns), "at").alias("r")).first().r
        return last.asDict()

    def is_running(self, job: str) -> bool:
        return self.get_job(job)["stage"] not in TERMINAL_STAGES

    def cancel(self, job: str) -> bool:
        """Stop before the next batch; false if the job has ended already."""
        now = self.get_job(job)
        if now["stage"] in TERMINAL_STAGES:
            return False
        self._state(job, "CANCELLED", now["processed"], now["total"])
        return True

    def resume(self, job: str) -> int:
        """Process what has no result; how many contents that were."""
        inputs = self.spark.read.parquet(self._path(job, "manifest"))
        stored = self._stored(job)
        left = (inputs if stored is None else J.pending(inputs, stored, "sha256")).cache()
        n = left.select("sha256").distinct().count()
        if n:
            self._state(job, "QUEUED")
            self._run(job, left)
        return n

    def results(self, job: str) -> DataFrame:
        """A row for each input, in order: copies get their original's result and say so."""
        inputs = self.spark.read.parquet(self._path(job, "manifest"))
        made = self._stored(job)
        if made is None:
            return inputs.where(F.lit(False)).withColumn("duplicate_of", F.lit(None).cast("long"))
        made = made.drop("pos", "filename").dropDuplicates(["sha256"])
        first = inputs.groupBy("sha256").agg(F.min("pos").alias("first_pos"))
        copy = F.col("pos") > F.col("first_pos")
        return inputs.join(first, "sha256").join(made, "sha256").withColumn("duplicate_of", F.when(copy, F.col("first_pos"))).drop("first_pos").orderBy("pos")


def can_resume(stage, processed, total, running: bool, is_stalled) -> F.Column:
    return (processed < total) & F.lit(not running) & (stage.isin(TERMINAL_STAGES) | is_stalled)
