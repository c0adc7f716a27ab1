"""Rows of the detailed and of the simple report; schema additions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from .jobs import split_of

# Columns of the detailed report, in order.
DETAILED = [
    "image_id", "filename", "sha256", "processing_status", "primary_status", "status_flags", "requires_review", "review_reasons", "parcel_count",
    "parcel_count_confidence", "parcel_visibility", "label_count", "label_status", "awb_number", "awb_number_excel", "awb_source", "awb_confidence",
    "weight_original", "weight_value", "weight_unit", "weight_grams", "weight_source", "weight_confidence", "length_cm", "width_cm", "height_cm",
    "dimensions_text", "dimensions_source", "dimensions_confidence", "recorded_volume", "recorded_volume_unit", "recorded_volume_source",
    "recorded_volume_confidence", "location", "location_source", "location_confidence", "capture_timestamp", "capture_timestamp_raw",
    "capture_timestamp_source", "capture_timestamp_confidence", "overlay_detected", "barcode_values", "overall_confidence", "detector_version",
    "detector_confidence", "detector_used", "ocr_engines_used", "vision_attempted", "vision_succeeded", "vision_cache_hit", "vision_error_category",
    "vision_request_id", "vision_attempt_count", "vision_duration_ms", "calibration_version", "warnings", "processing_duration_ms", "error_code",
    "error_message",
]
# Columns of the simple report, in order.
SIMPLE = ["File", "Tracking number", "Weight", "Length (cm)", "Width (cm)", "Height (cm)", "Location", "Result", "Needs review", "Notes"]
# Outcomes.
GOOD, CHECK, BAD, BROKEN = "✅ Read successfully", "\U0001f50e Needs a quick check", "\U0001f6ab Not a usable photo", "⚠️ Could not process"


def with_columns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """``df`` with each wanted column it lacks added as null of its type (an additive migration)."""
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in wanted.items() if c not in df.columns})


def detailed(records: DataFrame) -> DataFrame:
    """All 59 columns; what a record lacks is empty, lists are joined, identifiers stay text."""
    has, c = set(records.columns), F.col
    kinds = dict(records.dtypes)
    dims = F.concat(T.short_number(c("length_cm")), F.lit(" x "), T.short_number(c("width_cm")), F.lit(" x "), T.short_number(c("height_cm")), F.lit(" cm"))
    made: dict[str, Column] = {}
    if "awb_number" in has:
        made["awb_number_excel"] = T.excel_text(c("awb_number"))
    if {"length_cm", "width_cm", "height_cm"} <= has:
        made["dimensions_text"] = dims
    if {"weight_value", "weight_unit"} <= has:
        made["weight_original"] = F.concat(T.short_number(c("weight_value")), F.lit(" "), c("weight_unit"))
    out = []
    for name in DETAILED:
        x = made.get(name, c(name) if name in has else F.lit(None).cast("string"))
        if name not in made and kinds.get(name, "").startswith("array"):
            x = F.array_join(x, ";")
        out.append((F.coalesce(x, F.lit("")) if kinds.get(name, "string") in ("string",) or name in made or name not in has else x).alias(name))
    return records.select(*out)


def outcome(c=F.col) -> Column:
    good = c("primary_status").isin(C.GOOD_STATUSES) & ~c("requires_review")
    return F.when(good, GOOD).when(c("primary_status") == "REJECTED", BAD).when(c("primary_status") == "PROCESSING_ERROR", BROKEN).otherwise(CHECK)


def plain_reasons(reasons: Column, flags: Column) -> Column:
    told = F.transform(reasons, lambda x: T.worded(x, C.REASON_TEXT))
    return F.when(F.size(reasons) > 0, told).otherwise(F.transform(flags, lambda x: T.worded(x, C.FLAG_TEXT)))


def simple(records: DataFrame) -> DataFrame:
    c, none = F.col, F.lit("Not found")
    cm = lambda n: F.coalesce(c(n).cast("string"), F.lit(""))
    grams = F.concat(T.short_number(c("weight_grams")), F.lit(" g"))
    stated = F.concat(T.short_number(c("weight_value")), F.lit(" "), F.nullif(c("weight_unit"), F.lit(""))) if {"weight_value", "weight_unit"} <= set(records.columns) else F.lit(None)
    weight = F.coalesce(stated, grams, none)
    made = [c("filename"), F.coalesce("awb_number", none), weight, cm("length_cm"), cm("width_cm"), cm("height_cm"), F.coalesce("location", none), outcome(), c("requires_review"), F.array_join(plain_reasons(c("review_reasons"), c("flags")), "; ")]
    return records.select(*(x.alias(n) for x, n in zip(made, SIMPLE)))


# Columns of the labelling template that a person fills in.
TO_LABEL = ["expected_awb", "expected_weight_grams", "expected_length_cm", "expected_width_cm", "expected_height_cm", "expected_parcel_count", "expected_parcel_visibility", "expected_label_status", "expected_review"]


def template(groups: DataFrame) -> DataFrame:
    """``groups`` (filename, sha256, group_id) as a labelling template; a group is never split."""
    return groups.select("filename", "sha256", "group_id", split_of(F.col("group_id")).alias("split"), *(F.lit("").alias(n) for n in TO_LABEL), F.lit("false").alias("annotated"))
