"""Reports: quoted CSV with a byte-order mark, full JSON, published in one step."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOM = "﻿"


def flat(df: DataFrame) -> DataFrame:
    """Lists joined by semicolons, absent text empty; all as text, numbers unquoted by none."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        x: Column = F.array_join(f.name, ";") if kind.startswith("array") else F.col(f.name)
        x = F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss") if kind.startswith("timestamp") else x.cast("string")
        out.append(F.coalesce(x, F.lit("")).alias(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of quoted CSV parts."""
    flat(df).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(path)


def csv_text(df: DataFrame, order: list[str]) -> str:
    """One small report as text, with the mark that spreadsheet programs look for.  For a job's batch
    (at most some hundreds of rows), not for a corpus."""
    quoted = F.concat_ws(",", *(F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"')) for c in df.columns))
    head = ",".join(f'"{c}"' for c in df.columns)
    rows = flat(df).orderBy(*order).select(quoted.alias("line")).collect()
    return BOM + "\r\n".join([head, *(r.line for r in rows)]) + "\r\n"


def audit(df: DataFrame) -> DataFrame:
    """Whole records as JSON, nulls kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def audit_text(df: DataFrame, order: list[str], rename: dict[str, str] | None = None) -> str:
    """A job's records as one indented JSON text, nulls and letters of any script kept; ``rename`` gives columns whose paths become
    ``<folder>/<file name>``.  For a batch (at most some hundreds of rows)."""
    for column, folder in (rename or {}).items():
        df = df.withColumn(column, F.when(F.col(column).isNotNull(), F.concat(F.lit(f"{folder}/"), F.regexp_extract(column, r"([^/]*)\z", 1))))
    rows = [json.loads(r.value) for r in audit(df.orderBy(*order)).collect()]
    return json.dumps(rows, indent=2, ensure_ascii=False)


def _file_context(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at.getFileSystem(conf), jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), conf)


def point(spark: SparkSession, path: str, words: str) -> None:
    """Replace the pointer below ``path`` in one rename of a file: readers see the old words or the new ones."""
    jvm, fs, context = _file_context(spark, path)
    hadoop = jvm.org.apache.hadoop.fs.Path
    staged = hadoop(f"{path}/_next-{uuid.uuid4().hex}")
    out = fs.create(staged, True)
    out.write(bytearray(words.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    context.rename(context.makeQualified(staged), context.makeQualified(hadoop(f"{path}/_current")), options)


def removed(spark: SparkSession, path: str) -> None:
    jvm, fs, _ = _file_context(spark, path)
    fs.delete(jvm.org.apache.hadoop.fs.Path(path), True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    jvm, fs, _ = _file_context(spark, path)
    at = jvm.org.apache.hadoop.fs.Path(path)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def publish(df: DataFrame, path: str) -> None:
    """Write a new version below ``path`` and then point to it.
    Readers (``published``) see the old or the new report and nothing between; the version before the old one is removed."""
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    versions = pointed(spark, path)
    point(spark, path, " ".join([version, *versions[:1]]))
    for name in versions[1:2]:
        removed(spark, f"{path}/{name}")


def pointed(spark: SparkSession, path: str) -> list[str]:
    """The pointer's words, none if there is no pointer."""
    jvm, fs, _ = _file_context(spark, path)
    pointer = jvm.org.apache.hadoop.fs.Path(f"{path}/_current")
    if not fs.exists(pointer):
        return []
    stream = fs.open(pointer)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split()
    finally:
        stream.close()


def published(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a published report."""
    if not (versions := pointed(spark, path)):
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/{versions[0]}")


def write_evaluation(metrics: DataFrame, failures: DataFrame, sweep: DataFrame, confusion: DataFrame, path: str) -> None:
    """The four parts of an evaluation: scalars as JSON, failures and sweep as CSV, a CSV of counts for each confusion pair."""
    metrics.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/metrics")
    write_csv(failures, f"{path}/failures")
    write_csv(sweep, f"{path}/threshold_sweep")
    flat(confusion).write.mode("overwrite").partitionBy("pair").option("header", True).option("quoteAll", True).csv(f"{path}/confusion")
