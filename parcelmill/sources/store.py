"""A keyed table of results: batches are written beside a sorted base, merged when read, and compacted now and then.

    folder/base/gen=G/bucket=B/...      every key once, sorted by job and image within a bucket
    folder/delta/batch=N/bucket=B/...   what batch N wrote, sorted the same way
    folder/_current                     "G N": the current base, and the last batch that is in it

A batch that is tried again replaces its own folder, so nothing is doubled; a later batch's row replaces an earlier one's of the same key.  A look-up
reads one bucket's folders, and in these the row groups whose range of jobs and images holds the key.  Readers take the pointer first, so compaction
changes nothing for them; what it leaves behind is removed by ``vacuum``.  A job of very many images is in several files of its bucket.

Payloads are variants, so records of different versions stand in one column; ``typed`` reads their columns from the data itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.jobs import upsert
from .sinks import listed, point, pointed, removed

SCHEMA = "job_id string, image_id string, original_filename string, sha256 string, payload variant, input_path string, created_at timestamp_ntz, batch long, bucket int"
KEYS = ["job_id", "image_id"]
BUCKETS = 64


class Store:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def _bucket(self, job):
        return F.pmod(F.xxhash64(job.cast("string")), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, path: str) -> None:
        """By bucket, in order of the keys; a bucket is spread over files by ranges of them."""
        rows.repartitionByRange("bucket", *KEYS).sortWithinPartitions("bucket", *KEYS).write.mode("overwrite").partitionBy("bucket").parquet(path)

    def _state(self) -> tuple[int, int]:
        words = pointed(self.spark, self.folder)
        return (int(words[0]), int(words[1])) if words else (-1, -1)

    def _batches(self) -> list[int]:
        return sorted(int(x.removeprefix("batch=")) for x in listed(self.spark, f"{self.folder}/delta") if x.startswith("batch="))

    def save(self, rows: DataFrame, batch: int) -> None:
        """Write a batch of results (the columns of ``SCHEMA`` but ``batch`` and ``bucket``; ``payload`` as JSON or variant).  Of rows with the same
        key the last by ``created_at`` counts, of equals the largest file name.  Numbers of batches grow; an older one that is in the base can't be written again."""
        if batch <= self._state()[1]:
            raise ValueError(f"batch {batch} is compacted already")
        made = rows if dict(rows.dtypes)["payload"] == "variant" else rows.withColumn("payload", F.parse_json("payload"))
        made = made.withColumns({"batch": F.lit(batch).cast("long"), "bucket": self._bucket(F.col("job_id"))})
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        self._write(made.select(*names), f"{self.folder}/delta/batch={batch}")

    def _parts(self, where=None) -> DataFrame:
        generation, upto = self._state()
        paths = [f"{self.folder}/delta/batch={n}" for n in self._batches() if n > upto]
        paths += [f"{self.folder}/base/gen={generation}"] if generation >= 0 else []
        parts = self.spark.createDataFrame([], SCHEMA)
        for path in paths:  # each is read with its own partitions, so that a look-up names one folder in each
            part = self.spark.read.schema(SCHEMA).parquet(path)
            parts = parts.unionByName(part if where is None else part.where(where))
        return parts

    def _merged(self, parts: DataFrame) -> DataFrame:
        return upsert(parts, KEYS, F.struct("batch", "created_at", "original_filename"))

    def rows(self) -> DataFrame:
        """Every key's last row."""
        return self._merged(self._parts()).drop("batch", "bucket")

    def get(self, job_id: str, image_id: str | None = None) -> DataFrame:
        """A job's results in the order they were made, or the one of an image."""
        at = (F.col("bucket") == self._bucket(F.lit(job_id))) & (F.col("job_id") == job_id)
        if image_id is not None:
            at &= F.col("image_id") == image_id
        return self._merged(self._parts(at)).drop("batch", "bucket").orderBy("created_at", "original_filename")

    def compact(self) -> None:
        """Merge base and batches into a new base, then point to it."""
        generation, upto = self._state()
        batches = [n for n in self._batches() if n > upto]
        if not batches:
            return
        self._write(self._merged(self._parts()), f"{self.folder}/base/gen={generation + 1}")
        point(self.spark, self.folder, f"{generation + 1} {batches[-1]}")

    def vacuum(self) -> None:
        """Remove what is in the base, and bases before the last two."""
        generation, upto = self._state()
        for n in self._batches():
            if n <= upto:
                removed(self.spark, f"{self.folder}/delta/batch={n}")
        for name in listed(self.spark, f"{self.folder}/base"):
            if int(name.removeprefix("gen=")) < generation - 1:
                removed(self.spark, f"{self.folder}/base/{name}")


def payload_schema(rows: DataFrame, payload: str = "payload") -> str:
    """The type that holds all payloads: their fields together, each of the type that its values have in common."""
    found = rows.agg(F.schema_of_variant_agg(payload).alias("s")).first().s
    return found.replace("OBJECT<", "STRUCT<")


def typed(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """``rows`` with the payloads' fields as columns, whatever versions they are of; a field that a record has not is null.  The schema comes from the
    data, in one pass before."""
    schema = payload_schema(rows, payload)
    rest = [c for c in rows.columns if c != payload]
    if not schema.startswith("STRUCT<") or schema == "STRUCT<>":
        return rows.select(*rest)
    return rows.withColumn("_fields", F.try_variant_get(payload, "$", schema)).select(*rest, "_fields.*")
