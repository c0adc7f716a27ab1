"""Truth against predictions: join, scalar metrics, coverage, confusion, sweep, calibration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import quantiles
from .steps import cut

THRESHOLDS = (75, 99)


def said_yes(x: Column) -> Column:
    return F.coalesce(F.lower(x.cast("string")).isin("true", "1", "yes"), F.lit(False))


def filled(x: Column) -> Column:
    return F.trim(F.coalesce(x.cast("string"), F.lit(""))) != ""


def ratio(a: Column, b: Column) -> Column:
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), 6)


def unique(df: DataFrame, key: str) -> DataFrame:
    """``df``; a repeated key raises when the plan runs, as a one-to-one join must.  Rows are dealt by the key, as the
    join needs them anyway."""
    rest = [c for c in df.columns if c != key]
    once = df.groupBy(key).agg(F.first(F.struct(*rest)).alias("r"), F.count(F.lit(1)).alias("times"))
    checked = F.assert_true(F.col("times") == 1, f"{key} is not unique")
    return once.where(checked.isNull()).select(key, *(F.col(f"r.{c}").alias(c) for c in rest)).select(*df.columns)


def labelled(truth: DataFrame, predictions: DataFrame, split: str | None = None) -> DataFrame:
    """Annotated truth (of one split) with its predictions, one to one."""
    t = truth.where(said_yes(F.col("annotated"))) if "annotated" in truth.columns else truth
    t = t.where(F.col("split") == split) if split else t
    return unique(t, "filename").join(unique(predictions, "filename"), "filename", "left")


def marked(joined: DataFrame) -> DataFrame:
    """The row-wise marks that all metrics count."""
    c = F.col
    want, got = F.trim(F.coalesce(c("expected_awb"), F.lit(""))), F.trim(F.coalesce(c("awb_number"), F.lit("")))
    clean = ~said_yes(F.coalesce(c("requires_review"), F.lit(True)))
    count_known, sight_known = filled(c("expected_parcel_count")), filled(c("expected_parcel_visibility"))
    count_ok = ~count_known | F.coalesce(c("expected_parcel_count").try_cast("double") == c("parcel_count").cast("double"), F.lit(False))
    sight_ok = ~sight_known | (F.upper("expected_parcel_visibility") == F.upper(F.coalesce("parcel_visibility", F.lit("MISSING"))))
    return joined.withColumns(
        {
            "clean": clean,
            "has": want != "",
            "found": (want != "") & (got != ""),
            "right": (want != "") & (got == want),
            "any": got != "",
            "failed": F.coalesce(c("processing_status"), F.lit("MISSING")) != "COMPLETED",
            "must_review": filled(c("expected_review")) & said_yes(c("expected_review")),
            "parcel_known": count_known | sight_known,
            "parcel_right": count_ok & sight_ok,
        }
    )


def metrics(m: DataFrame) -> DataFrame:
    """All scalars in one aggregation."""
    c = F.col
    n = F.count_if
    s = m.agg(
        F.count(F.lit(1)).alias("labelled_images"), n(c("has")).alias("awb_labelled"), n(c("found")).alias("awb_extracted"), n(c("right")).alias("awb_exact"),
        n(c("clean") & c("found")).alias("clean_awb"), n(c("clean") & c("found") & c("right")).alias("clean_right"), n(c("clean") & c("found") & ~c("right")).alias("false_clean"),
        n(c("clean") & c("has") & ~c("found")).alias("clean_missing"), n(c("must_review")).alias("review_positive"), n(c("must_review") & ~c("clean")).alias("review_hit"),
        n(c("parcel_known")).alias("parcel_labelled"), n(c("parcel_known") & c("parcel_right")).alias("parcel_hit"), n(c("clean")).alias("clean_records"), n(c("failed")).alias("failed_records"),
    )
    return s.select(
        "labelled_images", "awb_labelled", "awb_extracted", "awb_exact", ratio(c("awb_exact"), c("awb_extracted")).alias("awb_precision"), ratio(c("awb_exact"), c("awb_labelled")).alias("awb_recall"),
        "clean_awb", ratio(c("clean_right"), c("clean_awb")).alias("clean_precision"), "false_clean", "clean_missing", "review_positive", ratio(c("review_hit"), c("review_positive")).alias("review_recall"),
        (c("review_positive") - c("review_hit")).alias("review_missed"), "parcel_labelled", ratio(c("parcel_hit"), c("parcel_labelled")).alias("parcel_accuracy"), "clean_records",
        F.coalesce(ratio(c("labelled_images") - c("clean_records"), c("labelled_images")), F.lit(0.0)).alias("review_rate"), F.coalesce(ratio(c("failed_records"), c("labelled_images")), F.lit(0.0)).alias("failed_rate"),
    )


def all_metrics(m: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Every scalar of an evaluation in one aggregation: counts, ratios, coverage over ``fields``, durations."""
    c, n = F.col, F.count_if
    known = {k: (filled(c(a)), filled(c(b))) for k, (a, b) in fields.items()}
    total = lambda marks: reduce(lambda a, b: a + b, (n(x) for x in marks))
    s = m.agg(
        F.count(F.lit(1)).alias("labelled_images"), n(c("has")).alias("awb_labelled_images"), n(c("found")).alias("awb_extracted_images"), n(c("right")).alias("awb_exact_matches"),
        n(c("clean") & c("found")).alias("clean_awb_records"), n(c("clean") & c("found") & c("right")).alias("clean_right"), n(c("clean") & c("found") & ~c("right")).alias("false_clean_awb_count"),
        n(c("clean") & c("has") & ~c("found")).alias("clean_missing_awb_count"), n(filled(c("expected_review"))).alias("review_labelled_images"), n(c("must_review")).alias("review_positive_images"),
        n(c("must_review") & ~c("clean")).alias("review_hit"), n(c("parcel_known")).alias("parcel_condition_labelled_images"), n(c("parcel_known") & c("parcel_right")).alias("parcel_hit"),
        n(c("clean")).alias("clean_records"), n(c("failed")).alias("failed_records"), total(w for w, _ in known.values()).alias("want"), total(w & g for w, g in known.values()).alias("got"),
    )
    took = latency(m, "processing_duration_ms").select(F.lit(0).alias("one"), F.col("median_ms").alias("median_processing_ms"), F.col("p95_ms").alias("p95_processing_ms"))
    s = s.withColumn("one", F.lit(0)).join(F.broadcast(took), "one", "left")  # one row each
    recall = ratio(c("awb_exact_matches"), c("awb_labelled_images"))
    share = lambda x: F.coalesce(ratio(x, c("labelled_images")), F.lit(0.0))
    return s.select(
        "labelled_images", "awb_labelled_images", "awb_extracted_images", "awb_exact_matches", ratio(c("awb_exact_matches"), c("awb_extracted_images")).alias("awb_exact_match_precision"), recall.alias("awb_exact_match_recall"),
        "clean_awb_records", ratio(c("clean_right"), c("clean_awb_records")).alias("clean_awb_precision"), "false_clean_awb_count", "clean_missing_awb_count", "review_labelled_images", "review_positive_images",
        ratio(c("review_hit"), c("review_positive_images")).alias("review_recall"), (c("review_positive_images") - c("review_hit")).alias("review_false_negatives"), "parcel_condition_labelled_images",
        ratio(c("parcel_hit"), c("parcel_condition_labelled_images")).alias("parcel_condition_accuracy"), ratio(c("got"), c("want")).alias("overall_field_coverage"), "clean_records", recall.alias("awb_extraction_recall"),
        share(c("labelled_images") - c("clean_records")).alias("review_rate"), share(c("failed_records")).alias("failed_rate"), c("false_clean_awb_count").alias("wrong_clean_awbs"), "median_processing_ms", "p95_processing_ms",
    )


def latency(rows: DataFrame, duration: str) -> DataFrame:
    """Exact median and interpolated 95th percentile (no row without durations)."""
    return quantiles(cut(rows.select(duration)), duration, {"median_ms": 0.5, "p95_ms": 0.95}).select("median_ms", "p95_ms")


def acceptance(m: DataFrame) -> DataFrame:
    x = metrics(m)
    return x.select(
        F.coalesce(F.col("clean_precision") >= 0.99, F.lit(False)).alias("clean_precision_ok"), (F.col("false_clean") == 0).alias("no_false_clean"),
        (F.col("review_rate") <= 0.35).alias("review_rate_ok"), (F.col("failed_rate") < 0.01).alias("failed_rate_ok"),
    )


def coverage(joined: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Filled predictions among filled truth, by field and over all."""
    each = F.array(*(F.struct(F.lit(k).alias("field"), filled(F.col(a)).alias("want"), filled(F.col(b)).alias("got")) for k, (a, b) in pairs.items()))
    s = joined.select(F.explode(each).alias("f")).select("f.*").rollup("field").agg(F.count_if("want").alias("labelled"), F.count_if(F.col("want") & F.col("got")).alias("extracted"))
    return s.select(F.coalesce("field", F.lit("overall")).alias("field"), "labelled", "extracted", ratio(F.col("extracted"), F.col("labelled")).alias("coverage"))


def confusion(joined: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    each = F.array(*(F.struct(F.lit(k).alias("pair"), filled(F.col(a)).alias("known"), F.col(a).cast("string").alias("expected"), F.coalesce(F.col(b).cast("string"), F.lit("MISSING")).alias("predicted")) for k, (a, b) in pairs.items()))
    return joined.select(F.inline(each)).where("known").groupBy("pair", "expected", "predicted").agg(F.count(F.lit(1)).alias("n"))


def macro_f1(counts: DataFrame) -> DataFrame:
    """Mean F1 over the labels of either side, from confusion counts (labels trimmed, upper-case)."""
    t = counts.select("pair", F.upper(F.trim("expected")).alias("e"), F.upper(F.trim("predicted")).alias("p"), "n")
    side = F.array(F.struct(F.col("e").alias("label"), F.lit(1).alias("is_e")), F.struct(F.col("p").alias("label"), F.lit(0).alias("is_e")))
    each = t.select("pair", "n", (F.col("e") == F.col("p")).alias("hit"), F.explode(side).alias("s")).select("pair", "n", "hit", "s.label", "s.is_e")
    s = each.groupBy("pair", "label").agg(F.sum(F.when(F.col("hit") & (F.col("is_e") == 1), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("is_e") == 1, F.col("n")).otherwise(0)).alias("want"), F.sum(F.when(F.col("is_e") == 0, F.col("n")).otherwise(0)).alias("got"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("want") + F.col("got")), F.lit(0.0))
    return s.groupBy("pair").agg(F.round(F.avg(f1), 6).alias("macro_f1"))


def sweep(m: DataFrame) -> DataFrame:
    """Accepted, precision and review rate at each threshold.  Rows are first counted by the highest
    threshold they pass, so the 25 sums read a few counts and not the rows 25 times."""
    low, high = THRESHOLDS
    conf = F.coalesce(F.col("awb_confidence"), F.lit(0.0))
    passed = F.size(F.filter(F.sequence(F.lit(low), F.lit(high)), lambda t: conf >= t / 100))
    level = F.when(F.col("any"), passed).otherwise(0)
    by = m.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.count_if("right").alias("ok"))
    steps = by.select("n", "ok", "level", F.explode(F.sequence(F.lit(1), F.lit(high - low + 1))).alias("k"))
    on = F.col("level") >= F.col("k")
    s = steps.groupBy("k").agg(F.sum(F.when(on, F.col("n")).otherwise(0)).alias("accepted"), F.sum(F.when(on, F.col("ok")).otherwise(0)).alias("right"), F.sum("n").alias("total"))
    return s.select(
        ((F.col("k") + (low - 1)).cast("double") / 100).alias("threshold"), "accepted", F.round(F.coalesce(F.try_divide(F.col("right").cast("double"), F.col("accepted").cast("double")), F.lit(0.0)), 6).alias("precision"),
        F.round(1 - F.try_divide(F.col("accepted").cast("double"), F.col("total").cast("double")), 6).alias("review_rate"),
    )


def calibrate(table: DataFrame, least: float) -> DataFrame:
    """The threshold of least review among those precise enough; if there is none, the plan raises when it runs."""
    best = table.where((F.col("accepted") > 0) & (F.col("precision") >= least)).agg(F.min_by(F.struct(*table.columns), F.struct("review_rate", "threshold")).alias("best"))
    found = F.assert_true(F.col("best").isNotNull(), f"no threshold reaches a precision of {least}")
    return best.where(found.isNull()).select("best.*")
