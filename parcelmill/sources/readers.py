"""Text tables: CSV without inference, JSON settings, annotation files."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, fields

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.steps import cut


def csv_strings(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as text; an absent value is the empty string.  A leading byte-order mark is no part of
    the first name."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    read = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("escape", '"').csv(path)
    return read.select(*(F.coalesce(c, F.lit("")).alias(c) for c in columns))


def csv_typed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Declared types; identifiers are declared as text, so leading zeros stay."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def json_setting(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def frozen_calibration(spark: SparkSession, path: str, default: float = 0.90) -> DataFrame:
    """The calibrated threshold, used only where the file says that it is frozen."""
    c = json_setting(spark, path, "version string, awb_clean_threshold double, frozen boolean")
    use = F.coalesce(F.col("frozen"), F.lit(False))
    return c.agg(F.coalesce(F.max(F.when(use, F.col("awb_clean_threshold"))), F.lit(default)).alias("threshold"), F.coalesce(F.max(F.when(use, F.col("version"))), F.lit("default")).alias("version"))


def rule_errors(spark: SparkSession, path: str) -> DataFrame:
    """What is wrong with a carrier-rule file, a row each."""
    text = spark.read.text(path, wholetext=True).select(F.lit(0).alias("key"), F.col("value").alias("text"))
    return rule_text_errors(text).select(F.explode("errors").alias("error"))


def rule_file(spark: SparkSession, path: str) -> list:
    """Carrier rules of a rule file, in order; none where the file is missing."""
    from ..operators.evidence import parsed_rules

    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(conf).exists(at):
        return []
    return parsed_rules(spark.read.option("wholetext", True).text(path).first().value)  # a settings file


def dataset_errors(spark: SparkSession, root: str) -> DataFrame:
    """Stems of ``root``/images without a file in ``root``/labels, and the other way round."""
    stem = F.regexp_extract("path", r"([^/]+)\.[^.]*\z", 1)
    below = lambda name, glob: spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(f"{root}/{name}").select(stem.alias("stem")).distinct()
    images, labels = below("images", "*.{jpg,jpeg,png,JPG,JPEG,PNG}"), below("labels", "*.txt")
    alone = images.join(labels, "stem", "left_anti").withColumn("error", F.lit("image_without_label"))
    return alone.unionByName(labels.join(images, "stem", "left_anti").withColumn("error", F.lit("label_without_image")))


UNREADABLE = "Invalid courier rule file: ValidationError"


def _pattern_errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is wrong with each pattern, null if nothing is."""
    for batch in batches:
        found: list[str | None] = []
        for pattern in batch.column("pattern").to_pylist():
            try:
                re.compile(pattern)
                found.append(None)
            except (re.error, OverflowError, RecursionError) as error:
                found.append(str(error))
        yield pa.RecordBatch.from_arrays([batch.column("pattern"), pa.array(found, pa.string())], ["pattern", "wrong"])


def rule_text_errors(texts: DataFrame) -> DataFrame:
    """``texts`` (key, text) of rule files with ``errors``: in the order of the rules, names that were there before and patterns that don't
    compile; one error for a text that isn't a rule file.

    Texts are parsed as variants, so a number where a name should be is told from a name; different patterns are compiled once, in Arrow
    batches.  A null text is no rule file; keys may repeat."""
    kind = lambda v: F.schema_of_variant(v)
    get = lambda v, path, to: F.try_variant_get(v, path, to)
    v = F.col("v")

    def texts_in(rule: Column, path: str) -> Column:
        """Missing, or a list of texts."""
        raw, values = get(rule, path, "variant"), get(rule, path, "array<string>")
        typed = kind(raw).isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(values, lambda x: x.isNull())
        return raw.isNull() | F.coalesce(typed, F.lit(False))

    def sound(rule: Column) -> Column:
        named = (kind(get(rule, "$.name", "variant")) == "STRING") & (kind(get(rule, "$.pattern", "variant")) == "STRING")
        digit = get(rule, "$.check_digit", "variant")
        return F.coalesce(named, F.lit(False)) & texts_in(rule, "$.prefixes") & texts_in(rule, "$.context_terms") & (digit.isNull() | kind(digit).isin("STRING", "VOID"))

    # The parser stops after the first value; in a list of one and an object of one nothing can follow it unseen.
    lone = F.try_parse_json(F.concat(F.lit("["), "text", F.lit("]")))
    also = F.try_parse_json(F.concat(F.lit('{"v":'), "text", F.lit("}"))).isNotNull()
    first = F.when(also & (F.size(get(lone, "$", "array<variant>")) == 1), get(lone, "$[0]", "variant"))
    parsed = texts.select("key", F.monotonically_increasing_id().alias("row"), first.alias("v"))
    parsed = parsed.withColumn("raw", get(v, "$.rules", "variant")).withColumn("rules", get(v, "$.rules", "array<variant>"))
    version = get(v, "$.version", "variant")
    whole = F.coalesce(F.startswith(kind(v), F.lit("OBJECT")), F.lit(False)) & (version.isNull() | (kind(version) == "STRING"))
    listed = F.col("raw").isNull() | F.coalesce(F.startswith(kind(F.col("raw")), F.lit("ARRAY")) & F.forall("rules", sound), F.lit(False))
    parsed = cut(parsed.withColumn("good", whole & listed).withColumn("rules", F.when(F.col("good"), F.transform("rules", lambda r: F.struct(get(r, "$.name", "string").alias("name"), get(r, "$.pattern", "string").alias("pattern"))))).select("key", "row", "good", "rules"))
    names = F.col("rules.name")
    each = parsed.select("row", F.posexplode("rules").alias("i", "rule"), names.alias("names")).select("row", "i", "rule.name", "rule.pattern", (F.array_position("names", F.col("rule.name")) <= F.col("i")).alias("again"))
    wrong = each.select("pattern").distinct().mapInArrow(_pattern_errors, "pattern string, wrong string").where("wrong is not null")
    told = each.join(wrong, "pattern", "left").where("again or wrong is not null")
    told = told.select("row", "i", F.concat(F.lit("Duplicate rule name: "), "name").alias("a"), F.concat(F.lit("Invalid regex for "), "name", F.lit(": "), "wrong").alias("b"), "again")
    told = told.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("i", F.when(F.col("again"), F.col("a")).alias("a"), "b"))).alias("told"))  # one file's rules
    errors = F.array_compact(F.flatten(F.transform("told", lambda t: F.array(t["a"], t["b"]))))
    none = F.array().cast("array<string>")
    return parsed.select("key", "row", "good").join(told, "row", "left").select("key", F.when(~F.col("good"), F.array(F.lit(UNREADABLE))).otherwise(F.coalesce(errors, none)).alias("errors"))


def annotations(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of all label files below a folder, by the file's stem."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(folder)
    return text.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^.]*\z", 1).alias("stem"), F.col("value").alias("line"))


@dataclass(frozen=True)
class Settings:
    """Limits and thresholds; ``from_env`` reads them from variables of the same name in upper case."""

    max_batch: int = 500
    workers: int = 4
    clean_threshold: float = 0.90
    promote_threshold: float = 0.75
    job_stuck_seconds: int = 300
    retention_hours: int = 24
    vision_enabled: bool = False
    max_label_candidates: int = 5

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ) if env is None else env
        found = {}
        for f in fields(cls):
            raw = env.get(f.name.upper())
            if raw is None:
                continue
            if isinstance(f.default, bool):
                found[f.name] = raw.strip().lower() in ("1", "true", "yes", "on")
            else:
                try:
                    found[f.name] = type(f.default)(raw)
                except ValueError:  # a bad number leaves the default
                    continue
        return cls(**found)


def options(raw: str | None) -> dict[str, object]:
    """Saved options of a job; missing or unreadable ones mean local processing only."""
    safe: dict[str, object] = {"vision_enabled": False, "worker_count": None}
    try:
        read = json.loads(raw or "")
    except ValueError:
        return safe
    return safe | {k: v for k, v in read.items() if k in safe} if isinstance(read, dict) else safe
