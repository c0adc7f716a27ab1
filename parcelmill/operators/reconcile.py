"""Candidates -> one value per field, with confidence and conflict; record status and reasons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C


def priority(source: Column) -> Column:
    out = F.lit(0)
    for name, p in C.SOURCE_PRIORITY.items():
        out = F.when(source == name, p).otherwise(out)
    return out


def adjusted(base: Column, agree: Column, repeated: Column, low_quality: Column, conflict: Column) -> Column:
    x = base + F.when(agree, 0.10).otherwise(0.0)
    x = x + F.when(repeated, 0.05).otherwise(0.0)
    x = x - F.when(low_quality, 0.10).otherwise(0.0)
    x = x - F.when(conflict, 0.18).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(0.99), x)), 4)


def groups(candidates: DataFrame) -> DataFrame:
    """One row per image, field and value, with the group's best evidence."""
    known = candidates.where(F.col("normalised_value").isNotNull() & (F.col("normalised_value") != ""))
    key = F.upper(F.trim("normalised_value"))
    best = F.struct(priority(F.col("source")).alias("p"), F.col("confidence").alias("c"), (-F.col("pos")).alias("first"))
    return known.groupBy("image_id", "field_name", key.alias("key")).agg(
        F.count_distinct("source").alias("n_sources"),
        F.max("confidence").alias("top"),
        F.count(F.lit(1)).alias("n"),
        F.min("pos").alias("first_pos"),
        F.max_by("source", best).alias("source"),
        F.max_by("normalised_value", best).alias("value"),
        F.collect_set("source").alias("sources"),
    )


def appended(parts: list[DataFrame]) -> DataFrame:
    """Candidates of several sources, one source after the other; ``pos`` orders them within an image, equal places by
    field, value and confidence."""
    both = reduce(DataFrame.unionByName, (p.withColumn("part", F.lit(k)) for k, p in enumerate(parts)))
    order = Window.partitionBy("image_id").orderBy("part", "pos", "field_name", "normalised_value", "confidence")  # an image has some dozens of candidates
    return both.withColumn("pos", F.row_number().over(order)).drop("part")


def reconcile(candidates: DataFrame, low_quality: DataFrame | None = None) -> DataFrame:
    """The best-supported value of each image and field.

    One shuffle: groups are made by (image, field, value), then the whole ranking is a maximum by
    (sources, confidence, count, first seen); no window has to sort an image's groups.
    """
    g = groups(candidates)
    rank = F.struct("n_sources", "top", "n", (-F.col("first_pos")).alias("first"))
    strong = F.when(F.col("top") >= C.STRONG_ALTERNATIVE, 1).otherwise(0)
    row = F.struct("key", "n_sources", "top", "n", "source", "value", "sources", strong.alias("strong"))
    best = g.groupBy("image_id", "field_name").agg(F.max_by(row, rank).alias("b"), F.sum(strong).alias("n_strong"))
    conflict = F.col("n_strong") - F.col("b.strong") > 0
    if low_quality is not None:
        best = best.join(low_quality.select("image_id", F.col("low_quality").alias("lq")), "image_id", "left")
        lq = F.coalesce("lq", F.lit(False))
    else:
        lq = F.lit(False)
    conf = adjusted(F.col("b.top"), F.col("b.n_sources") >= 2, F.col("b.n") >= 2, lq, conflict)
    return best.select("image_id", "field_name", F.col("b.value").alias("value"), F.col("b.source").alias("source"), conf.alias("confidence"), conflict.alias("conflict"), F.sort_array("b.sources").alias("agreeing"))


def promote(reconciled: DataFrame) -> DataFrame:
    """Below the gate the identifier and its source are withheld; the confidence stays."""
    ok = F.col("confidence") >= C.PROMOTE
    return reconciled.select("image_id", F.when(ok, F.col("value")).alias("awb_number"), F.when(ok, F.col("source")).otherwise("NOT_EXTRACTED").alias("awb_source"), F.col("confidence").alias("awb_confidence"), F.col("conflict"), F.col("agreeing"))


def flag(condition: Column, name: str) -> Column:
    return F.when(condition, F.lit(name))


def assign_status(records: DataFrame, clean: float = C.CLEAN) -> DataFrame:
    """Flags, primary status, review and reasons, in the order the rules are stated."""
    c = F.col
    awb = c("awb_number").isNotNull() & (c("awb_number") != "")
    support = F.coalesce(c("agreeing"), F.array().cast("array<string>"))
    by_label = F.arrays_overlap(support, F.array(F.lit("BARCODE"), F.lit("LABEL_OCR")))
    label = c("label_status")
    evidence = F.array_compact(
        F.array(
            flag(c("parcel_count").isNull(), "PARCEL_DETECTION_UNCERTAIN"),
            flag(c("parcel_count") > 1, "MULTIPLE_PARCELS"),
            flag(c("parcel_visibility") == "PARTIAL", "PARCEL_PARTIALLY_VISIBLE"),
            flag(label == "LABEL_NOT_VISIBLE", "LABEL_NOT_VISIBLE"),
            flag(label == "LABEL_PARTIALLY_VISIBLE", "LABEL_PARTIALLY_VISIBLE"),
            flag(label == "LABEL_BLOCKED_OR_OCCLUDED", "LABEL_BLOCKED"),
            flag(label == "MULTIPLE_LABEL_CANDIDATES", "MULTIPLE_LABEL_CANDIDATES"),
            flag(label.isin("LABEL_VISIBLE_LOW_CONFIDENCE", "LABEL_STATUS_UNCERTAIN"), "LABEL_UNREADABLE"),
            flag(~awb, "AWB_NOT_FOUND"),
            flag(awb & (c("awb_confidence") < clean), "LOW_OCR_CONFIDENCE"),
            flag(c("weight_grams").isNull(), "WEIGHT_NOT_FOUND"),
            flag(c("length_cm").isNull() | c("width_cm").isNull() | c("height_cm").isNull(), "DIMENSIONS_NOT_FOUND"),
            flag(awb & (c("awb_source") == "OVERLAY_OCR") & ~by_label, "AWB_NOT_LABEL_VERIFIED"),
        )
    )
    before = F.coalesce(c("flags"), F.array().cast("array<string>"))
    nothing = (c("parcel_count") == 0) & (c("parcel_visibility") == "NONE")
    flags = F.when(c("error_code").isNotNull(), before).when(nothing, F.sort_array(F.array_distinct(F.array_append(before, F.lit("NO_PARCEL"))))).otherwise(F.sort_array(F.array_distinct(F.concat(before, evidence))))
    done = records.withColumn("flags", flags)
    review = F.array(*(F.lit(x) for x in C.REVIEW_REASONS))
    risky = F.arrays_overlap(c("flags"), review)
    status = (
        F.when(c("error_code").isNotNull(), "PROCESSING_ERROR").when(nothing, "REJECTED").when(risky, "REVIEW_REQUIRED")
        .when(awb & F.array_contains(support, "OVERLAY_OCR") & by_label, "SUCCESS_OVERLAY_AND_LABEL")
        .when(awb & c("awb_source").isin("BARCODE", "LABEL_OCR"), "SUCCESS_LABEL_VERIFIED").otherwise("SUCCESS_PARTIAL_FIELDS")
    )
    done = done.withColumn("primary_status", status)
    needs = c("primary_status").isin("PROCESSING_ERROR", "REVIEW_REQUIRED", "SUCCESS_PARTIAL_FIELDS")
    reason = F.create_map(*(F.lit(v) for kv in C.REVIEW_REASONS.items() for v in kv))
    told = F.transform(F.array_intersect("flags", review), lambda x: F.element_at(reason, x))
    more = F.array_compact(F.array(flag(needs & ~awb, "awb_not_found"), flag(needs & c("vision_attempted") & ~c("vision_succeeded"), "vision_unavailable_local_evidence_insufficient")))
    reasons = F.when(c("error_code").isNotNull(), F.array(F.lit("processing_error"))).when(nothing, F.array().cast("array<string>")).otherwise(F.sort_array(F.array_distinct(F.concat(told, more))))
    return done.withColumn("requires_review", needs).withColumn("review_reasons", reasons)


def dimension_summary(fields: DataFrame) -> DataFrame:
    """Least confidence, most frequent source (ties by priority) and whether all three are there."""
    by = fields.groupBy("image_id", "source").agg(F.count(F.lit(1)).alias("n"), F.min("confidence").alias("low"))
    return by.groupBy("image_id").agg(F.round(F.min("low"), 4).alias("dimensions_confidence"), F.max_by("source", F.struct("n", priority(F.col("source")))).alias("dimensions_source"), (F.sum("n") >= 3).alias("complete"))


def overall_confidence(*parts: str) -> Column:
    """Mean of the positive ones, to four places; 0 if none."""
    kept = F.filter(F.array(*parts), lambda x: x > 0)
    total = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(kept) > 0, F.round(total / F.size(kept), 4)).otherwise(F.lit(0.0))


def wide(reconciled: DataFrame, fields: list[str]) -> DataFrame:
    """One record per image: value, source and confidence of each field as columns."""
    x = F.struct("value", "source", "confidence")
    per = reconciled.groupBy("image_id").pivot("field_name", fields).agg(F.first(x))
    out = [F.col("image_id")]
    for f in fields:
        out += [F.col(f"{f}.value").alias(f), F.coalesce(F.col(f"{f}.source"), F.lit("NOT_EXTRACTED")).alias(f"{f}_source"), F.coalesce(F.col(f"{f}.confidence"), F.lit(0.0)).alias(f"{f}_confidence")]
    return per.select(*out)


def perception_flags(c=F.col) -> Column:
    """Flags from what perception reports, in no order."""
    return F.array_compact(
        F.array(
            flag(c("low_quality"), "LOW_IMAGE_QUALITY"), flag(c("overlay_fields") == 0, "OVERLAY_NOT_FOUND"), flag(c("overlay_fields").between(1, 3), "OVERLAY_PARTIAL"), flag(~c("ocr_available"), "OCR_UNAVAILABLE"),
            flag(~c("detector_available"), "DETECTOR_UNAVAILABLE"), flag(c("barcode_values") > 1, "MULTIPLE_BARCODES"), flag(c("conflict"), "AWB_CONFLICT"), flag(c("vision_failed"), "VISION_API_UNAVAILABLE"),
        )
    )


def parcel_evidence(detector_count: Column, heuristic_count: Column, vision_count: Column, vision_confidence: Column) -> Column:
    """The detector's count, else the heuristic's, else a confident outside answer."""
    return F.coalesce(detector_count, heuristic_count, F.when(vision_confidence >= 0.75, vision_count))


def error_boundary(records: DataFrame) -> DataFrame:
    """Records whose file was refused, or whose processing failed, end as such and nothing else."""
    refused, broke = F.col("input_error").isNotNull(), F.col("error_code").isNotNull()
    return records.withColumns(
        {
            "processing_status": F.when(refused | broke, "FAILED").otherwise("COMPLETED"),
            "primary_status": F.when(refused, "REJECTED").when(broke, "PROCESSING_ERROR").otherwise(F.col("primary_status")),
            "flags": F.when(refused, F.array_union("flags", F.array(F.lit("UNSUPPORTED_IMAGE")))).otherwise(F.col("flags")),
            "requires_review": F.when(refused, False).when(broke, True).otherwise(F.col("requires_review")),
        }
    )


def label_count(readable: Column, proposals: Column) -> Column:
    """Labels that were read; failing that one, if any was proposed."""
    return F.when(readable > 0, readable).when(proposals > 0, 1).otherwise(0)


def label_status(own: Column, detector_used: Column, detector_status: Column) -> Column:
    """The detector's word counts only where it saw the label blocked."""
    return F.when(detector_used & (detector_status == "LABEL_BLOCKED_OR_OCCLUDED"), detector_status).otherwise(own)
