"""The result browser: seven filters, and a trigram table that says which files a "contains" search has to read."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files of results that a search reads by name; with more candidates than these all are read.
NAMED = 10_000


@dataclass(frozen=True)
class Filters:
    """What is asked for; an empty list or None asks for nothing.  ``review``: True for those to review, False for clean ones."""

    statuses: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    labels: tuple[str, ...] = ()
    flags: tuple[str, ...] = ()
    review: bool | None = None
    filename: str = ""
    confidence: tuple[float, float] = (0.0, 1.0)


def matching(f: Filters) -> Column:
    """Whether a record is shown.  ``filename`` is a regular expression, found anywhere, in either case; a null name matches none; a missing
    confidence is 0; any of the flags will do."""
    c, yes = F.col, F.lit(True)
    among = lambda name, values: F.coalesce(c(name).isin(*values), F.lit(False)) if values else yes
    flagged = F.coalesce(F.arrays_overlap("flags", F.array(*map(F.lit, f.flags))), F.lit(False)) if f.flags else yes
    review = yes if f.review is None else c("requires_review") == f.review
    named = F.coalesce(c("filename").rlike(f"(?iu){f.filename}"), F.lit(False)) if f.filename else yes
    sure = F.coalesce(c("overall_confidence").cast("double"), F.lit(0.0))
    return among("primary_status", f.statuses) & among("awb_source", f.sources) & among("label_status", f.labels) & flagged & review & named & sure.between(*f.confidence)


def browse(records: DataFrame, f: Filters) -> DataFrame:
    return records.where(matching(f))


def folded(text: Column) -> Column:
    """Lower case, with the letters that match an ASCII letter when case doesn't count."""
    return F.lower(F.translate(text, "ſİıK", "siik"))


def trigrams(text: Column) -> Column:
    """The distinct runs of three letters of a folded text."""
    low = folded(text)
    return F.when(F.length(low) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3)))))


def literals(pattern: str) -> list[str]:
    """Runs of letters that each match of a regular expression holds; none where that can't be told."""
    if re.search(r"[|()\[\]{}\\]", pattern):
        return []
    plain = re.sub(r".[*?]", ".", pattern)  # what may be left out
    return [x for x in re.split(r"[.^$+]", plain) if len(x) >= 3]


def asked_trigrams(pattern: str) -> list[str]:
    out = {x.lower()[k : k + 3] for x in literals(pattern) for k in range(len(x) - 2)}
    return sorted(t for t in out if t.isascii())


class NameIndex:
    """Results in files below ``folder``, and for each trigram of their names the files that have it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.results, self.postings = spark, f"{folder}/results", f"{folder}/trigrams"

    def add(self, records: DataFrame) -> None:
        """Append results.  Names are in order within the files, so that a name's trigrams are in few of them."""
        records.repartitionByRange("filename").sortWithinPartitions("filename").write.mode("append").parquet(self.results)

    def index(self) -> None:
        """The table of trigrams, sorted by them, so that a search reads a few row groups of it."""
        rows = self.spark.read.parquet(self.results).select("filename", F.col("_metadata.file_path").alias("file"))
        pairs = rows.where("filename is not null").select("file", F.explode(trigrams(F.col("filename"))).alias("trigram")).distinct()
        pairs.repartitionByRange("trigram").sortWithinPartitions("trigram").write.mode("overwrite").parquet(self.postings)

    def files(self, pattern: str) -> list[str] | None:
        """Files that may hold a match; None: any may."""
        wanted = asked_trigrams(pattern)
        if not wanted:
            return None
        found = self.spark.read.parquet(self.postings).where(F.col("trigram").isin(*wanted))
        found = found.groupBy("file").agg(F.count_distinct("trigram").alias("n")).where(F.col("n") == len(wanted)).limit(NAMED + 1).collect()
        return None if len(found) > NAMED else [r.file for r in found]

    def search(self, f: Filters) -> DataFrame:
        """What ``browse`` finds, from the candidate files only."""
        files = self.files(f.filename) if f.filename else None
        every = self.spark.read.parquet(self.results)
        if files is None:
            return browse(every, f)
        if not files:
            return every.where("false")
        return browse(self.spark.read.schema(every.schema).parquet(*files), f)
