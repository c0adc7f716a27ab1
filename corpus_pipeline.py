"""Five stages from raw documents to packed sequences.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; all but the last
return the columns of ``documents``.  ``run`` applies them in turn, each stage's result being
written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelmill.llm import op03_toxicity, op06_packing, op07_winnow, op08_setsketch, op09_secrets
from parcelmill.llm.common import cut, dropped, fresh, key_of, shared_dir, small, table

#: Ids and keys (16 bytes) that are broadcast at most; more meet their documents by a shuffle.
IDS = 1_000_000
# SQL can express neither the classifier nor the sketches; tests hold the stages against plain versions.
ORACLE_SQL = None


def _by_key(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """``docs`` joined with the distinct (doc_id, row_key) of ``rows``, whatever other columns ``docs`` has."""
    names = [fresh(c, docs) for c in ("chosen_id", "chosen_key")]
    chosen = small(cut(rows.select("doc_id", "row_key").toDF(*names).distinct()), IDS)
    return docs.join(chosen, docs["doc_id"].eqNullSafe(chosen[names[0]]) & (key_of(docs) == chosen[names[1]]), how)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier does not call toxic.

    Null and empty texts stay unless the bias alone is toxic; rows with a null doc_id are judged like others
    and never trained on; repeated rows stay or go alike; without labels nothing goes; an empty
    table stays empty; all other columns are kept, whatever their names."""
    model = op03_toxicity.train(docs, table(spark, sf_dir, "labels"))
    name = fresh("score", docs)
    return op03_toxicity.score(docs, model, tuple(docs.columns), name).where(F.col(name) < 0.5).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest doc_id, of its rows the one of smallest key.

    Texts without words (null, empty) are duplicates of nothing and all stay; rows equal in id and text
    count as copies, of which one stays; rows that share a doc_id, or have none, are judged by their own
    texts; an empty table stays empty; all other columns are kept, whatever their names."""
    rows = op08_setsketch.classified(docs).where("n_shingles = 0 or row_key = first_key")
    rows = cut(rows.groupBy("doc_id", "row_key").agg(F.max(F.when(F.col("n_shingles") > 0, 1).otherwise(0)).alias("worded"), F.count(F.lit(1)).alias("times")))
    again = (F.col("worded") == 1) & (F.col("times") > 1)
    once = _by_key(docs, rows.where(~again), "left_semi")
    if rows.where(again).isEmpty():
        return once
    return once.unionByName(_by_key(docs, rows.where(again), "left_semi").dropDuplicates(["doc_id", "text"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with a benchmark item.

    Null and empty texts stay; of rows that share a doc_id, or have none, only those go whose own text
    is contaminated; repeated rows stay or go alike; an empty benchmark or table changes nothing; all other columns are kept,
    whatever their names."""
    found = op07_winnow.judged(docs, table(spark, sf_dir, "benchmark"))
    return _by_key(docs, found.where("contaminated"), "left_anti")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every reported span replaced by a mark.

    Null texts stay null; every row is treated by itself, so ids, repeats and other columns don't matter;
    n_chars, where present, follows changed texts; an empty table stays empty."""
    return op09_secrets.redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in packed sequences.

    Null and empty texts are one closing id; repeated rows are packed as often as they occur; rows without an id
    are packed too; an empty table gives an empty result; other columns are left out."""
    return op06_packing.pack(docs, op06_packing.public_vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:  # what the stage has read is read no more
            dropped(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
