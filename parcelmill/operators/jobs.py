"""Batches: duplicates, resume, upserts, progress, interruption, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.constants import GOOD_STATUSES, TERMINAL_STAGES


def canonical(items: DataFrame, digest: str, pos: str) -> DataFrame:
    """The first item of each content: a maximum with map-side sums, not a window, so hot contents
    (one file uploaded again and again) don't meet in one sort."""
    rest = [c for c in items.columns if c != digest]
    return items.groupBy(digest).agg(F.min_by(F.struct(*rest), F.col(pos)).alias("r")).select(digest, "r.*")


def fan_out(items: DataFrame, digest: str, pos: str) -> DataFrame:
    """A row for each further copy, with the position of its original."""
    first = items.groupBy(digest).agg(F.min(pos).alias("original"))
    return items.join(first, digest).where(F.col(pos) > F.col("original"))


def pending(items: DataFrame, done: DataFrame, digest: str) -> DataFrame:
    return items.join(done.where(F.col(digest) != "").select(digest), digest, "left_anti")


def upsert(rows: DataFrame, keys: list[str], seq: Column) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(*keys, "r.*")


def patched(jobs: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``patch`` has, beside each value, whether it sets it (it may set null)."""
    p = patch.select(F.col(key), *(F.col(c).alias(f"new_{c}") for c in columns), *(F.col(f"set_{c}") for c in columns))
    out = jobs.join(p, key, "left")
    return out.select(*(F.when(F.coalesce(f"set_{c}", F.lit(False)), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in jobs.columns))


def without(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key), key, "left_anti")


def progress_columns() -> list[Column]:
    s = F.col("primary_status")
    return [F.count(F.lit(1)).alias("processed"), F.count_if(s.isin(GOOD_STATUSES)).alias("successful"), F.count_if("requires_review").alias("review"), F.count_if(s == "REJECTED").alias("rejected"), F.count_if(s == "PROCESSING_ERROR").alias("failed"), F.sum("n_warnings").alias("warnings")]


def progress(results: DataFrame) -> DataFrame:
    return results.groupBy("job_id").agg(*progress_columns())


def running_progress(results: DataFrame) -> DataFrame:
    """Counts after each result of a job, in order."""
    w = W.partitionBy("job_id").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    total = F.count(F.lit(1)).over(W.partitionBy("job_id"))
    s = F.col("primary_status")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).over(w)
    return results.select("job_id", "seq", F.count(F.lit(1)).over(w).alias("processed"), one(s.isin(GOOD_STATUSES)).alias("successful"), one(F.col("requires_review")).alias("review"), F.round(F.col("seq") * 100.0 / total, 2).alias("percent"))


def final_stage(warnings: Column) -> Column:
    return F.when(warnings > 0, "COMPLETED_WITH_WARNINGS").otherwise("COMPLETED")


def interrupted(jobs: DataFrame) -> DataFrame:
    """Jobs that a restart met unfinished have failed."""
    return jobs.withColumn("stage", F.when(F.col("stage").isin(TERMINAL_STAGES), F.col("stage")).otherwise("FAILED"))


def expired(name: Column, modified: Column, now: Column, hours: int) -> Column:
    return name.rlike(r"(?i)\A[0-9a-f]{32}\z") & (modified < now - F.make_dt_interval(hours=F.lit(hours)))


def stalled(stage: Column, last: Column, now: Column, seconds: int = 300) -> Column:
    return ~stage.isin(TERMINAL_STAGES) & last.isNotNull() & (F.unix_timestamp(now) - F.unix_timestamp(last) >= seconds)


def split_of(group: Column) -> Column:
    """train below 70 of a hundred, val below 85, then test; by the group's digest."""
    k = F.conv(F.substring(F.sha2(group, 256), 1, 8), 16, 10).cast("long") % 100
    return F.when(k < 70, "train").when(k < 85, "val").otherwise("test")


def with_clones(items: DataFrame, made: DataFrame, digest: str, pos: str, name: str, new_id: Column) -> DataFrame:
    """A result for each item: the first of a content has ``made``'s (image_id, flags, warnings), each further copy a clone of it
    with an id of its own, a flag and a warning that names the original."""
    first = items.groupBy(digest).agg(F.min_by(F.struct(F.col(pos).alias("pos"), F.col(name).alias("name")), pos).alias("o"))
    full = items.join(first, digest).join(made, digest)
    copy = F.col(pos) > F.col("o.pos")
    return full.select(
        *(F.col(c) for c in items.columns),
        F.when(copy, new_id).otherwise(F.col("image_id")).alias("image_id"),
        F.when(copy, F.col("image_id")).alias("duplicate_of_image_id"),
        F.when(copy, F.array_union("flags", F.array(F.lit("DUPLICATE_IMAGE")))).otherwise(F.col("flags")).alias("flags"),
        F.when(copy, F.array_append("warnings", F.concat(F.lit("Duplicate content reused from "), "o.name"))).otherwise(F.col("warnings")).alias("warnings"),
    )


def stored_inputs(uploads: DataFrame, recorded: DataFrame) -> DataFrame:
    """Uploads (path, name, sha256) with what results have recorded of them (path, original_filename, known_sha256)."""
    return uploads.join(recorded, "path", "left").select("path", F.coalesce("original_filename", "name").alias("original_filename"), F.coalesce(F.nullif("known_sha256", F.lit("")), "sha256").alias("sha256"))


def decoded(rows: DataFrame, payload: str, schema: str) -> DataFrame:
    """``rows`` with the JSON of ``payload`` as columns."""
    return rows.withColumn("decoded", F.from_json(payload, schema)).select(*(c for c in rows.columns if c != payload), "decoded.*")


def looked_up(rows: DataFrame, **keys) -> DataFrame:
    """Rows with these key values (pushed to the scan)."""
    for name, value in keys.items():
        rows = rows.where(F.col(name) == F.lit(value))
    return rows


def cache_key(model: Column, prompt: Column, schema: Column, mode: Column, content: Column, crop: Column) -> Column:
    return F.sha2(F.concat_ws("|", model, prompt, schema, mode, content, crop), 256)


def put(cache: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """``cache`` with ``answers``, which replace what is there."""
    both = cache.withColumn("at", F.lit(0)).unionByName(answers.withColumn("at", F.lit(1)))
    return upsert(both, [key], F.col("at")).drop("at")
