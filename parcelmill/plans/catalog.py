"""Registered queries of the shipment operators, each with the SQL it is held against."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from ..operators import browse as B
from ..operators import evaluate as E
from ..operators import evidence as V
from ..operators import hamming as H
from ..operators import jobs as J
from ..operators import perception
from ..operators import reconcile as R
from ..operators import report
from ..operators.quantiles import quantiles
from ..operators.steps import cut, spread
from .adapters import view, with_views

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str = ""):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = with_views(sql)
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/{name}.parquet"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- reconciliation -------------------------------------------------------------------------------

GROUPS = """
k AS (SELECT image_id, upper(trim(normalised_value)) AS key, source, confidence, pos, normalised_value,
             CASE source WHEN 'BARCODE' THEN 4 WHEN 'OVERLAY_OCR' THEN 3 WHEN 'LABEL_OCR' THEN 2 WHEN 'VISION_FALLBACK' THEN 1 ELSE 0 END AS pr
      FROM v_candidates WHERE normalised_value IS NOT NULL AND normalised_value <> ''),
g AS (SELECT image_id, key, count(DISTINCT source) AS n_src, max(confidence) AS top, count(*) AS n, min(pos) AS fp FROM k GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n_src DESC, top DESC, n DESC, fp) AS rk FROM g),
c AS (SELECT image_id, coalesce(bool_or(rk > 1 AND top >= 0.72), false) AS conflict FROM r GROUP BY 1),
rep AS (SELECT k.image_id, k.normalised_value AS value, k.source, row_number() OVER (PARTITION BY k.image_id ORDER BY pr DESC, confidence DESC, pos) AS rn
        FROM k JOIN r ON k.image_id = r.image_id AND k.key = r.key AND r.rk = 1),
agr AS (SELECT k.image_id, string_agg(DISTINCT k.source, ';' ORDER BY k.source) AS agreeing FROM k JOIN r ON k.image_id = r.image_id AND k.key = r.key AND r.rk = 1 GROUP BY 1),
rec AS (SELECT r.image_id, rep.value, rep.source,
               round(greatest(0.0, least(0.99, r.top + CASE WHEN n_src >= 2 THEN 0.10 ELSE 0.0 END + CASE WHEN n >= 2 THEN 0.05 ELSE 0.0 END
                 - CASE WHEN coalesce(i.low_quality, false) THEN 0.10 ELSE 0.0 END - CASE WHEN c.conflict THEN 0.18 ELSE 0.0 END))::DOUBLE, 4) AS confidence,
               c.conflict, agr.agreeing
        FROM r JOIN c USING (image_id) JOIN rep ON rep.image_id = r.image_id AND rep.rn = 1 JOIN agr ON agr.image_id = r.image_id LEFT JOIN v_images i ON i.image_id = r.image_id WHERE r.rk = 1),
gate AS (SELECT image_id, CASE WHEN confidence >= 0.75 THEN value END AS awb_number, CASE WHEN confidence >= 0.75 THEN source ELSE 'NOT_EXTRACTED' END AS awb_source, confidence AS awb_confidence, conflict, agreeing FROM rec)"""


def _reconciled(spark: SparkSession, d: str) -> DataFrame:
    return R.reconcile(view(spark, d, "v_candidates"), view(spark, d, "v_images"))


@query(f"WITH {GROUPS} SELECT image_id, value, source, confidence, conflict, agreeing FROM rec")
def reconcile_awb(spark, d):
    return _reconciled(spark, d).select("image_id", "value", "source", "confidence", "conflict", F.array_join("agreeing", ";").alias("agreeing"))


@query(f"WITH {GROUPS} SELECT image_id, awb_number, awb_source, awb_confidence, conflict FROM gate")
def awb_promotion_gate(spark, d):
    return R.promote(_reconciled(spark, d)).drop("agreeing")


def _records(spark: SparkSession, d: str) -> DataFrame:
    awb = R.promote(_reconciled(spark, d))
    full = view(spark, d, "v_images").join(awb, "image_id", "left")
    flags = F.array_compact(F.array(R.flag(F.coalesce("conflict", F.lit(False)), "AWB_CONFLICT"), R.flag(F.col("low_quality"), "LOW_IMAGE_QUALITY")))
    return R.assign_status(full.withColumn("flags", flags))


STATUS = (
    GROUPS
    + """,
b AS (SELECT i.*, g.awb_number, g.awb_source, coalesce(g.awb_confidence, 0) AS awb_confidence, coalesce(g.conflict, false) AS conflict, coalesce(g.agreeing, '') AS agreeing,
             coalesce(g.awb_number, '') <> '' AS has_awb, (coalesce(g.agreeing, '') LIKE '%BARCODE%' OR coalesce(g.agreeing, '') LIKE '%LABEL_OCR%') AS by_label,
             coalesce(parcel_count = 0 AND parcel_visibility = 'NONE', false) AS nothing
      FROM v_images i LEFT JOIN gate g USING (image_id)),
fl AS (SELECT image_id, unnest(['LOW_IMAGE_QUALITY', 'AWB_CONFLICT', 'NO_PARCEL', 'PARCEL_DETECTION_UNCERTAIN', 'MULTIPLE_PARCELS', 'PARCEL_PARTIALLY_VISIBLE', 'LABEL_NOT_VISIBLE', 'LABEL_PARTIALLY_VISIBLE', 'LABEL_BLOCKED',
                              'MULTIPLE_LABEL_CANDIDATES', 'LABEL_UNREADABLE', 'AWB_NOT_FOUND', 'LOW_OCR_CONFIDENCE', 'WEIGHT_NOT_FOUND', 'DIMENSIONS_NOT_FOUND', 'AWB_NOT_LABEL_VERIFIED']) AS flag,
             unnest([low_quality, conflict, error_code IS NULL AND nothing, ev AND parcel_count IS NULL, ev AND coalesce(parcel_count > 1, false), ev AND parcel_visibility = 'PARTIAL', ev AND label_status = 'LABEL_NOT_VISIBLE',
                     ev AND label_status = 'LABEL_PARTIALLY_VISIBLE', ev AND label_status = 'LABEL_BLOCKED_OR_OCCLUDED', ev AND label_status = 'MULTIPLE_LABEL_CANDIDATES', ev AND label_status = 'LABEL_STATUS_UNCERTAIN',
                     ev AND NOT has_awb, ev AND has_awb AND awb_confidence < 0.9, ev AND weight_grams IS NULL, ev AND (length_cm IS NULL OR width_cm IS NULL OR height_cm IS NULL),
                     ev AND has_awb AND awb_source = 'OVERLAY_OCR' AND NOT by_label]) AS on_
       FROM (SELECT *, error_code IS NULL AND NOT nothing AS ev FROM b)),
rv AS (SELECT * FROM (VALUES ('MULTIPLE_PARCELS', 'multiple_parcels'), ('PARCEL_PARTIALLY_VISIBLE', 'parcel_partially_visible'), ('PARCEL_DETECTION_UNCERTAIN', 'parcel_detection_uncertain'), ('LABEL_BLOCKED', 'label_blocked'),
       ('LABEL_UNREADABLE', 'label_unreadable'), ('LABEL_PARTIALLY_VISIBLE', 'label_partially_visible'), ('MULTIPLE_LABEL_CANDIDATES', 'multiple_label_candidates'), ('AWB_CONFLICT', 'awb_conflict'),
       ('AWB_NOT_LABEL_VERIFIED', 'awb_not_label_verified'), ('LOW_OCR_CONFIDENCE', 'awb_below_clean_threshold')) t(flag, reason)),
fa AS (SELECT image_id, string_agg(flag, ';' ORDER BY flag) AS flags, bool_or(rv.reason IS NOT NULL) AS risky FROM fl LEFT JOIN rv USING (flag) WHERE on_ GROUP BY 1),
st AS (SELECT b.*, coalesce(fa.flags, '') AS flags,
              CASE WHEN error_code IS NOT NULL THEN 'PROCESSING_ERROR' WHEN nothing THEN 'REJECTED' WHEN coalesce(risky, false) THEN 'REVIEW_REQUIRED' WHEN has_awb AND agreeing LIKE '%OVERLAY_OCR%' AND by_label THEN 'SUCCESS_OVERLAY_AND_LABEL'
                   WHEN has_awb AND awb_source IN ('BARCODE', 'LABEL_OCR') THEN 'SUCCESS_LABEL_VERIFIED' ELSE 'SUCCESS_PARTIAL_FIELDS' END AS primary_status
       FROM b LEFT JOIN fa USING (image_id)),
sr AS (SELECT *, primary_status IN ('PROCESSING_ERROR', 'REVIEW_REQUIRED', 'SUCCESS_PARTIAL_FIELDS') AS requires_review FROM st),
rs AS (SELECT image_id, reason FROM fl JOIN rv USING (flag) JOIN sr USING (image_id) WHERE on_ AND error_code IS NULL AND NOT nothing
       UNION SELECT image_id, 'awb_not_found' FROM sr WHERE requires_review AND NOT has_awb AND error_code IS NULL
       UNION SELECT image_id, 'vision_unavailable_local_evidence_insufficient' FROM sr WHERE requires_review AND vision_attempted AND NOT vision_succeeded AND error_code IS NULL
       UNION SELECT image_id, 'processing_error' FROM sr WHERE error_code IS NOT NULL),
ra AS (SELECT image_id, string_agg(reason, ';' ORDER BY reason) AS reasons FROM rs GROUP BY 1),
res AS (SELECT sr.*, coalesce(ra.reasons, '') AS reasons FROM sr LEFT JOIN ra USING (image_id))"""
)


@query(f"WITH {STATUS} SELECT image_id, flags, primary_status, requires_review, reasons FROM res")
def status_engine(spark, d):
    return _records(spark, d).select("image_id", F.array_join("flags", ";").alias("flags"), "primary_status", "requires_review", F.array_join("review_reasons", ";").alias("reasons"))


@query(f"WITH {STATUS} SELECT primary_status, requires_review, count(*) AS n, round(avg(awb_confidence), 6) AS mean_confidence FROM res GROUP BY 1, 2")
def status_summary(spark, d):
    return _records(spark, d).groupBy("primary_status", "requires_review").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce("awb_confidence", F.lit(0.0))), 6).alias("mean_confidence"))


@query(f"WITH {STATUS} SELECT u.reason, count(*) AS n FROM res, (SELECT image_id, unnest(string_split(reasons, ';')) AS reason FROM res) u WHERE res.image_id = u.image_id AND u.reason <> '' GROUP BY 1")
def review_reason_counts(spark, d):
    return _records(spark, d).select(F.explode("review_reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {STATUS} SELECT image_id, awb_number, primary_status, reasons FROM res WHERE requires_review")
def review_queue(spark, d):
    return _records(spark, d).where("requires_review").select("image_id", "awb_number", "primary_status", F.array_join("review_reasons", ";").alias("reasons"))


OVERALL = "round(coalesce(list_avg(list_filter([awb_confidence, weight_confidence, location_confidence], lambda x: x > 0)), 0.0), 4)"
BROWSED = f"""SELECT image_id, filename, primary_status, awb_source, label_status, requires_review, {OVERALL} AS overall_confidence FROM res WHERE primary_status IN ('REVIEW_REQUIRED', 'SUCCESS_LABEL_VERIFIED', 'SUCCESS_PARTIAL_FIELDS')
 AND awb_source IN ('BARCODE', 'OVERLAY_OCR') AND label_status IN ('LABEL_VISIBLE_READABLE', 'LABEL_STATUS_UNCERTAIN', 'LABEL_NOT_VISIBLE', 'LABEL_PARTIALLY_VISIBLE') AND list_has_any(string_split(flags, ';'), ['WEIGHT_NOT_FOUND', 'LOW_IMAGE_QUALITY', 'MULTIPLE_PARCELS'])
 AND requires_review AND regexp_matches(filename, '(?i)img_.*[05]') AND {OVERALL} BETWEEN 0.4 AND 0.95"""
ASKED = B.Filters(
    statuses=("REVIEW_REQUIRED", "SUCCESS_LABEL_VERIFIED", "SUCCESS_PARTIAL_FIELDS"), sources=("BARCODE", "OVERLAY_OCR"), labels=("LABEL_VISIBLE_READABLE", "LABEL_STATUS_UNCERTAIN", "LABEL_NOT_VISIBLE", "LABEL_PARTIALLY_VISIBLE"),
    flags=("WEIGHT_NOT_FOUND", "LOW_IMAGE_QUALITY", "MULTIPLE_PARCELS"), review=True, filename="img_.*[05]", confidence=(0.4, 0.95),
)


def _browsable(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d).withColumn("sure", F.coalesce("awb_confidence", F.lit(0.0)))
    return r.withColumn("overall_confidence", R.overall_confidence("sure", "weight_confidence", "location_confidence"))


@query(f"WITH {STATUS} {BROWSED}")
def browse_filter(spark, d):
    """All seven filters of the browser."""
    return B.browse(_browsable(spark, d), ASKED).select("image_id", "filename", "primary_status", "awb_source", "label_status", "requires_review", "overall_confidence")


@query(f"WITH {STATUS} SELECT CASE WHEN requires_review THEN 'review' ELSE 'clean' END AS shown, count(*) AS n FROM res GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM res")
def browse_review_states(spark, d):
    """What each of the three settings of the review filter shows."""
    r = _browsable(spark, d).select("requires_review", "overall_confidence")
    each = F.array(*(F.when(B.matching(B.Filters(review=state)), F.lit(name)) for name, state in (("all", None), ("review", True), ("clean", False))))
    return r.select(F.explode(F.array_compact(each)).alias("shown")).groupBy("shown").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {STATUS} SELECT count(*) AS total, count(*) FILTER (primary_status IN ('SUCCESS_LABEL_VERIFIED', 'SUCCESS_OVERLAY_AND_LABEL', 'SUCCESS_OVERLAY_ONLY', 'SUCCESS_PARTIAL_FIELDS')) AS ok, count(*) FILTER (requires_review) AS review, count(*) FILTER (primary_status = 'REJECTED') AS rejected, count(*) FILTER (has_awb) AS with_awb, count(*) FILTER (has_awb AND NOT requires_review) AS ready FROM res")
def batch_summary(spark, d):
    c, n = F.col, F.count_if
    return _records(spark, d).agg(F.count(F.lit(1)).alias("total"), n(c("primary_status").isin(C.GOOD_STATUSES)).alias("ok"), n("requires_review").alias("review"), n(c("primary_status") == "REJECTED").alias("rejected"), n(c("awb_number").isNotNull()).alias("with_awb"), n(c("awb_number").isNotNull() & ~c("requires_review")).alias("ready"))


@query(f"WITH {STATUS} SELECT count(*) AS processed, count(*) FILTER (NOT requires_review) AS clean, count(*) FILTER (requires_review) AS review, count(*) FILTER (has_awb) AS awb_extracted, round(count(*) FILTER (requires_review) / count(*), 6) AS review_rate, median(duration_ms)::DOUBLE AS median_ms, (list_sort(list(duration_ms)))[(least(count(*) - 1, floor(count(*) * 0.95)::BIGINT) + 1)::INT] AS p95_ms FROM res")
def baseline_summary(spark, d):
    """Totals, the exact median and the duration at the nearest rank of 95 %; places are found in narrowing histograms."""
    r = cut(_records(spark, d).select(F.col("duration_ms"), F.col("requires_review").alias("review"), F.col("awb_number").isNotNull().alias("awb")))
    s = r.agg(F.count(F.lit(1)).alias("processed"), F.count_if("review").alias("review"), F.count_if("awb").alias("awb_extracted")).withColumn("one", F.lit(0))
    took = quantiles(r, "duration_ms", {"median_ms": 0.5}, {"p95_ms": 0.95}).select(F.lit(0).alias("one"), "median_ms", F.col("p95_ms").cast(r.schema["duration_ms"].dataType).alias("p95_ms"))
    n = F.col("processed")
    s = s.join(F.broadcast(took), "one", "left")  # one row each
    return s.select("processed", (n - F.col("review")).alias("clean"), "review", "awb_extracted", E.ratio(F.col("review"), n).alias("review_rate"), "median_ms", "p95_ms")


@query(f"WITH {STATUS} SELECT flag, count(*) AS n FROM (SELECT unnest(string_split(flags, ';')) AS flag FROM res) WHERE flag <> '' GROUP BY 1")
def flag_frequency(spark, d):
    joined = _records(spark, d).select(F.array_join("flags", ";").alias("flags"))
    return joined.select(F.explode(F.split("flags", ";")).alias("flag")).where("flag <> ''").groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {STATUS} SELECT image_id, CASE WHEN regexp_full_match(awb_number, '[A-Z0-9-]{{1,40}}') THEN '=\"' || awb_number || '\"' ELSE '' END AS awb_number_excel, coalesce(awb_number, '') AS awb_number, flags AS status_flags, reasons AS review_reasons, weight_grams, parcel_count, parcel_visibility, label_status, filename, coalesce(error_code, '') AS error_code FROM res")
def csv_report_rows(spark, d):
    r = _records(spark, d)
    return r.select("image_id", F.coalesce(T.excel_text(F.col("awb_number")), F.lit("")).alias("awb_number_excel"), F.coalesce("awb_number", F.lit("")).alias("awb_number"), F.array_join("flags", ";").alias("status_flags"), F.array_join("review_reasons", ";").alias("review_reasons"), "weight_grams", "parcel_count", "parcel_visibility", "label_status", "filename", F.coalesce("error_code", F.lit("")).alias("error_code"))


def _outcome(c=F.col):
    good = c("primary_status").isin(C.GOOD_STATUSES) & ~c("requires_review")
    return F.when(good, "Read successfully").when(c("primary_status") == "REJECTED", "Not a usable photo").when(c("primary_status") == "PROCESSING_ERROR", "Could not process").otherwise("Needs a quick check")


@query(f"WITH {STATUS} SELECT filename, CASE WHEN primary_status LIKE 'SUCCESS%' AND NOT requires_review THEN 'Read successfully' WHEN primary_status = 'REJECTED' THEN 'Not a usable photo' WHEN primary_status = 'PROCESSING_ERROR' THEN 'Could not process' ELSE 'Needs a quick check' END AS outcome, coalesce(awb_number, 'Not found') AS awb, CASE WHEN weight_grams IS NULL THEN 'Not found' ELSE weight_grams::BIGINT || ' g' END AS weight, CASE WHEN length_cm IS NULL THEN 'Not found' ELSE length_cm::BIGINT || ' x ' || width_cm::BIGINT || ' x ' || height_cm::BIGINT || ' cm' END AS size FROM res")
def simple_report_rows(spark, d):
    n = T.short_number
    size = F.concat(n(F.col("length_cm")), F.lit(" x "), n(F.col("width_cm")), F.lit(" x "), n(F.col("height_cm")), F.lit(" cm"))
    return _records(spark, d).select("filename", _outcome().alias("outcome"), F.coalesce("awb_number", F.lit("Not found")).alias("awb"), F.coalesce(F.concat(n(F.col("weight_grams")), F.lit(" g")), F.lit("Not found")).alias("weight"), F.coalesce(size, F.lit("Not found")).alias("size"))


_WORDS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.FLAG_TEXT.items())


@query(f"WITH {STATUS} SELECT DISTINCT flag, CASE flag {_WORDS} END AS wording FROM (SELECT unnest(string_split(flags, ';')) AS flag FROM res) WHERE flag <> ''")
def flag_plain_text(spark, d):
    return _records(spark, d).select(F.explode("flags").alias("flag")).distinct().select("flag", T.worded(F.col("flag"), C.FLAG_TEXT).alias("wording"))


@query(f"WITH {STATUS} SELECT image_id, round(coalesce(list_avg(list_filter([awb_confidence, weight_confidence, location_confidence], lambda x: x > 0)), 0.0), 4) AS overall FROM res")
def overall_confidence(spark, d):
    r = _records(spark, d).withColumn("awb_confidence", F.coalesce("awb_confidence", F.lit(0.0)))
    return r.select("image_id", R.overall_confidence("awb_confidence", "weight_confidence", "location_confidence").alias("overall"))


@query("""WITH f AS (SELECT image_id, source, count(*) AS n, min(confidence) AS low, CASE source WHEN 'BARCODE' THEN 4 WHEN 'OVERLAY_OCR' THEN 3 ELSE 2 END AS pr FROM v_candidates WHERE pos <= 3 GROUP BY 1, 2)
SELECT image_id, round(min(low), 4) AS dimensions_confidence, arg_max(source, n * 10 + pr) AS dimensions_source, sum(n) >= 3 AS complete FROM f GROUP BY 1""")
def dimension_summary(spark, d):
    return R.dimension_summary(view(spark, d, "v_candidates").where("pos <= 3"))


@query(f"WITH {STATUS} SELECT image_id, parcel_count IS NULL OR label_status IN ('LABEL_STATUS_UNCERTAIN', 'LABEL_VISIBLE_LOW_CONFIDENCE') OR agreeing = '' AS ask FROM res")
def vision_gate(spark, d):
    return _records(spark, d).select("image_id", (F.col("parcel_count").isNull() | F.col("label_status").isin("LABEL_STATUS_UNCERTAIN", "LABEL_VISIBLE_LOW_CONFIDENCE") | F.col("agreeing").isNull()).alias("ask"))


@query("SELECT count(*) FILTER (vision_attempted) AS attempts, count(*) FILTER (vision_attempted AND vision_succeeded) AS successes, count(*) FILTER (vision_attempted) - count(*) FILTER (vision_attempted AND vision_succeeded) AS failures, max(least(0.74, weight_confidence)) AS capped FROM v_images")
def vision_usage(spark, d):
    a = F.count_if("vision_attempted")
    b = F.count_if(F.col("vision_attempted") & F.col("vision_succeeded"))
    return view(spark, d, "v_images").agg(a.alias("attempts"), b.alias("successes"), (a - b).alias("failures"), F.max(F.least(F.lit(0.74), F.col("weight_confidence"))).alias("capped"))


# --- parsing --------------------------------------------------------------------------------------

LINE = "coalesce(nullif(regexp_extract(text, '(?i){a}[ :.-]*([^\\n]*)', 1), ''), nullif(regexp_extract(text, '(?i){a}[ :.-]*\\n([^\\n]*)', 1), ''))"
AWB_LINE = LINE.replace("{a}", r"\bAW[8B][ ]*(?:No|Number)?\.?\b")


def _line(name: str) -> str:
    return LINE.replace("{a}", rf"\b{name}\b")


@query(r"""SELECT image_id, CASE WHEN length(v) BETWEEN 8 AND 30 AND length(regexp_replace(v, '[^0-9]', '', 'g')) >= 6 THEN v END AS awb
FROM (SELECT image_id, regexp_replace(regexp_replace(upper(trim(coalesce(normalised_value, ' ab-12 ') || CASE WHEN pos % 3 = 0 THEN '-x#' ELSE ' ' END)), '[^A-Z0-9 -]', '', 'g'), '[\s-]+', '', 'g') AS v FROM v_candidates)""")
def normalise_awb(spark, d):
    raw = F.concat(F.coalesce("normalised_value", F.lit(" ab-12 ")), F.when(F.col("pos") % 3 == 0, "-x#").otherwise(" "))
    return view(spark, d, "v_candidates").select("image_id", T.normalise_awb(raw).alias("awb"))


@query(f"SELECT image_id, translate(raw, 'OoQIl|S', '0001115') AS fixed, translate(raw, 'OoQIl|S', '0001115') <> raw AS changed FROM (SELECT image_id, {_line('Height')} AS raw FROM v_ocr)")
def ocr_numeric_correction(spark, d):
    raw = view(spark, d, "v_ocr").select("image_id", T.once(T.field_line(F.col("text"), "height_cm")).alias("raw"))
    return raw.select("image_id", T.corrected(F.col("raw")).alias("fixed"), (T.corrected(F.col("raw")) != F.col("raw")).alias("changed"))


_ANCHOR_SQL = " + ".join(f"regexp_matches(text, '(?i){a}')::INT" for a in C.ANCHORS.values())


@query(f"SELECT image_id, {_ANCHOR_SQL} AS anchors FROM v_ocr")
def anchor_counts(spark, d):
    return view(spark, d, "v_ocr").select("image_id", T.anchor_count(F.col("text")).alias("anchors"))


@query(rf"""WITH a AS (SELECT image_id, conf, nullif(trim(regexp_extract({AWB_LINE}, '[A-Za-z0-9][A-Za-z0-9 -]{{6,34}}', 0)), '') AS token FROM v_ocr),
b AS (SELECT *, CASE WHEN regexp_matches(upper(token), '[A-HJ-NP-RT-Z]') THEN token ELSE translate(token, 'OoQIl|S', '0001115') END AS fixed FROM a),
n AS (SELECT *, regexp_replace(regexp_replace(upper(fixed), '[^A-Z0-9 -]', '', 'g'), '[\s-]+', '', 'g') AS v FROM b)
SELECT image_id, token, v AS awb, greatest(0.0, least(0.99, conf + 0.05 - 0.15 * (fixed <> token)::INT))::DOUBLE AS confidence FROM n WHERE length(v) BETWEEN 8 AND 30 AND length(regexp_replace(v, '[^0-9]', '', 'g')) >= 6""")
def parse_awb(spark, d):
    c = F.col
    a = view(spark, d, "v_ocr").select("image_id", "conf", T.once(T.awb_token(T.field_line(c("text"), "awb_number"))).alias("token")).withColumn("fixed", T.awb_fixed(c("token")))
    a = a.select("*", T.once(T.normalise_awb(c("fixed"))).alias("awb")).where("awb is not null")
    return a.select("image_id", "token", "awb", T.confidence(c("conf"), (c("fixed") != c("token")).cast("int")).alias("confidence"))


_DIMENSIONS = {"length_cm": "Length", "width_cm": r"W[ ]*idth", "height_cm": "Height"}
_DIM_SQL = " UNION ALL ".join(f"SELECT image_id, conf, '{f}' AS field, {_line(a)} AS raw FROM v_ocr" for f, a in _DIMENSIONS.items())


@query(rf"""WITH r AS ({_DIM_SQL}), n AS (SELECT *, try_cast(replace(regexp_extract(translate(raw, 'OoQIl|S', '0001115'), '[-+]?\d+(?:[.,]\d+)?', 0), ',', '.') AS DOUBLE) AS v, nullif(lower(regexp_extract(raw, '(?i)\b(mm|cm|m|in|inch|inches)\b', 1)), '') AS u, (translate(raw, 'OoQIl|S', '0001115') <> raw)::INT AS w FROM r)
SELECT image_id, field, v AS value, coalesce(u, 'cm') AS unit, round(CASE u WHEN 'mm' THEN v / 10 WHEN 'm' THEN v * 100 WHEN 'in' THEN v * 2.54 ELSE v END, 4) AS cm, greatest(0.0, least(0.99, conf + 0.05 - 0.15 * w))::DOUBLE AS confidence FROM n WHERE v IS NOT NULL""")
def parse_dimensions(spark, d):
    c = F.col
    raws = F.array(*(F.struct(F.lit(f).alias("field"), T.field_line(c("text"), f, c("lines")).alias("raw")) for f in _DIMENSIONS))
    r = view(spark, d, "v_ocr").select("image_id", "conf", "text", T.once(T.lines(c("text"))).alias("lines")).select("image_id", "conf", F.inline(raws))
    r = r.select("*", T.once(T.number(c("raw"))).alias("value")).where("value is not null")
    u = F.coalesce(T.unit(c("raw"), "mm|cm|m|in|inch|inches"), F.lit("cm"))
    return r.select("image_id", "field", "value", u.alias("unit"), T.centimetres(c("value"), u).alias("cm"), T.confidence(c("conf"), T.warned(c("raw"))).alias("confidence"))


@query(rf"""WITH n AS (SELECT image_id, try_cast(replace(regexp_extract(translate(raw, 'OoQIl|S', '0001115'), '[-+]?\d+(?:[.,]\d+)?', 0), ',', '.') AS DOUBLE) AS v, nullif(lower(regexp_extract(raw, '(?i)\b(kg|kgs|g|gm|gms|gram|grams)\b', 1)), '') AS u FROM (SELECT image_id, {_line('W[ ]*eight')} AS raw FROM v_ocr))
SELECT image_id, v AS value, CASE WHEN u IN ('kg', 'kgs') THEN 'kg' ELSE 'g' END AS unit, round(CASE WHEN u IN ('kg', 'kgs') THEN v * 1000 ELSE v END, 4) AS grams FROM n WHERE v IS NOT NULL AND u IS NOT NULL""")
def parse_weight(spark, d):
    c = F.col
    r = view(spark, d, "v_ocr").select("image_id", T.once(T.field_line(c("text"), "weight")).alias("raw"))
    r = r.select("image_id", T.number(c("raw")).alias("value"), T.unit(c("raw"), "kg|kgs|g|gm|gms|gram|grams").alias("u")).where("value is not null and u is not null")
    kilos = c("u").isin("kg", "kgs")
    return r.select("image_id", "value", F.when(kilos, "kg").otherwise("g").alias("unit"), F.round(F.when(kilos, c("value") * 1000).otherwise(c("value")), 4).alias("grams"))


@query(rf"SELECT image_id, try_cast(regexp_extract(translate({_line('R[.]?[ ]*Vol')}, 'OoQIl|S', '0001115'), '[-+]?\d+', 0) AS DOUBLE) AS volume FROM v_ocr")
def parse_volume(spark, d):
    return view(spark, d, "v_ocr").select("image_id", T.once(T.field_line(F.col("text"), "recorded_volume")).alias("raw")).select("image_id", T.number(F.col("raw")).alias("volume"))


@query(rf"""WITH r AS (SELECT image_id, {_line('Location')} AS raw FROM v_ocr), f AS (SELECT image_id, raw, contains(raw, '_') OR (upper(raw) = raw AND lower(raw) <> raw) AS shout FROM r)
SELECT image_id, CASE WHEN shout THEN replace(regexp_replace(raw, '\s+', '_', 'g'), '_(', ' (') ELSE raw END AS location FROM f""")
def parse_location(spark, d):
    return view(spark, d, "v_ocr").select("image_id", T.once(T.field_line(F.col("text"), "location")).alias("raw")).select("image_id", T.location(F.col("raw")).alias("location"))


@query(rf"SELECT image_id, coalesce(try_strptime(raw, '%m/%d/%Y %I:%M:%S %p'), try_strptime(raw, '%Y-%m-%d %H:%M:%S')) AS taken FROM (SELECT image_id, {_line('Time')} AS raw FROM v_ocr)")
def parse_timestamp(spark, d):
    return view(spark, d, "v_ocr").select("image_id", T.once(T.field_line(F.col("text"), "capture_timestamp")).alias("raw")).select("image_id", T.timestamp(F.col("raw")).alias("taken"))


@query(rf"""SELECT field, count(*) AS n FROM (
SELECT 'location' AS field FROM v_ocr WHERE {_line('Location')} IS NOT NULL UNION ALL SELECT 'awb_line' FROM v_ocr WHERE {AWB_LINE} IS NOT NULL UNION ALL
SELECT 'recorded_volume' FROM v_ocr WHERE {_line('R[.]?[ ]*Vol')} IS NOT NULL UNION ALL SELECT 'capture_timestamp' FROM v_ocr WHERE {_line('Time')} IS NOT NULL) GROUP BY 1""")
def parse_fields_long(spark, d):
    """All fields of all images as rows, counted by field."""
    fields = {"location": "location", "awb_line": "awb_number", "recorded_volume": "recorded_volume", "capture_timestamp": "capture_timestamp"}
    each = F.array(*(F.struct(F.lit(k).alias("field"), T.field_line(F.col("text"), f).alias("raw")) for k, f in fields.items()))
    return view(spark, d, "v_ocr").select(F.inline(each)).where("raw is not null").groupBy("field").agg(F.count(F.lit(1)).alias("n"))


# --- perception, relational part -------------------------------------------------------------------


@query("""SELECT l_orderkey AS image_id, arg_min(pass_no, -score * 1000 + pass_no / 1000.0)::INT AS pass_no, round(max(score), 6) AS score FROM
(SELECT l_orderkey, l_linenumber AS pass_no, max(l_suppkey % 8) * 20 + max(l_partkey % 6) * 25 + max(l_partkey % 100) / 100 * 20 AS score FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def best_ocr_pass(spark, d):
    li = table(spark, d, "lineitem")
    p = li.groupBy(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("pass_no")).agg(F.max(F.col("l_suppkey") % 8).alias("anchors"), F.max(F.col("l_partkey") % 6).alias("fields"), (F.max(F.col("l_partkey") % 100) / 100).alias("conf"))
    return V.best_pass(p)


@query("""WITH t AS (SELECT conv_id AS page, turn, unnest(string_split(text, ' ')) AS token, generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM conversations),
k AS (SELECT page, turn AS block, i // 8 AS line, i % 8 AS left_, token, CASE WHEN i % 5 = 4 THEN -1 ELSE 40 + i % 60 END AS conf FROM t),
l AS (SELECT page, block, line, string_agg(token, ' ' ORDER BY left_, token) AS text FROM k GROUP BY 1, 2, 3),
p AS (SELECT page, string_agg(text, chr(10) ORDER BY block, line) AS text FROM l GROUP BY 1)
SELECT p.page, sha256(p.text) AS text_sha, c.confidence FROM p JOIN (SELECT page, round(avg(CASE WHEN conf >= 0 THEN conf END) / 100, 6) AS confidence FROM k GROUP BY 1) c USING (page)""")
def ocr_token_lines(spark, d):
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("page"), "turn", F.posexplode(F.split("text", " ")).alias("i", "token"))
    k = t.select("page", F.col("turn").alias("block"), F.floor(F.col("i") / 8).alias("line"), (F.col("i") % 8).alias("left"), "token", F.when(F.col("i") % 5 == 4, -1).otherwise(40 + F.col("i") % 60).alias("conf"))
    return V.token_lines(k).select("page", F.sha2("text", 256).alias("text_sha"), "confidence")


@query("SELECT image_id, string_agg(value, ';' ORDER BY top DESC, value DESC) AS texts FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY top DESC, value DESC) AS rk FROM (SELECT image_id, value, max(evidence_level) AS top FROM v_barcodes GROUP BY 1, 2)) WHERE rk <= 5 GROUP BY 1")
def label_texts_topk(spark, d):
    """The five best distinct texts of an image (distinct first, with map-side sums)."""
    b = view(spark, d, "v_barcodes").groupBy("image_id", "value").agg(F.max("evidence_level").alias("top"))
    best = F.slice(F.reverse(F.sort_array(F.collect_list(F.struct("top", "value")))), 1, 5)
    return b.groupBy("image_id").agg(best.alias("b")).select("image_id", F.array_join(F.transform("b", lambda x: x["value"]), ";").alias("texts"))


@query("SELECT image_id, field_name, normalised_value, source, min(pos) AS pos FROM v_candidates WHERE normalised_value IS NOT NULL GROUP BY 1, 2, 3, 4")
def label_candidate_dedup(spark, d):
    return view(spark, d, "v_candidates").where("normalised_value is not null").groupBy("image_id", "field_name", "normalised_value", "source").agg(F.min("pos").alias("pos"))


EVIDENCE = """ev AS (SELECT b.image_id, b.value, b.source_crop, n.n, round(least(0.95, max(b.evidence_level) + least(0.12, (n.n - 1) * 0.04))::DOUBLE, 6) AS evidence_level
FROM v_barcodes b JOIN (SELECT image_id, value, count(*) AS n FROM v_barcodes GROUP BY 1, 2) n USING (image_id, value) GROUP BY 1, 2, 3, 4)"""


@query(f"WITH {EVIDENCE} SELECT * FROM ev")
def barcode_evidence(spark, d):
    return V.barcode_evidence(view(spark, d, "v_barcodes"))


@query(f"""WITH {EVIDENCE}, kn AS (SELECT DISTINCT image_id, value AS awb FROM v_barcodes WHERE pos = 1 AND image_id % 2 = 0),
m AS (SELECT image_id, count(DISTINCT value) > 1 AS several FROM ev GROUP BY 1)
SELECT ev.image_id, ev.value AS awb, source_crop, kn.awb IS NOT NULL AS agrees, round(CASE WHEN kn.awb IS NULL AND several THEN least(0.73, evidence_level) WHEN kn.awb IS NOT NULL THEN least(0.97, evidence_level + 0.08) ELSE least(0.84, evidence_level) END::DOUBLE, 6) AS confidence
FROM ev JOIN m USING (image_id) LEFT JOIN kn ON kn.image_id = ev.image_id AND kn.awb = ev.value""")
def barcode_candidates(spark, d):
    b = view(spark, d, "v_barcodes")
    known = b.where("pos = 1 and image_id % 2 = 0").select("image_id", F.col("value").alias("awb"))
    return V.barcode_candidates(V.barcode_evidence(b), known)


@query("SELECT image_id, string_agg(DISTINCT value, ';' ORDER BY value) AS barcode_values, count(DISTINCT value) > 1 AS several FROM v_barcodes GROUP BY 1")
def barcode_values(spark, d):
    s = view(spark, d, "v_barcodes").groupBy("image_id").agg(F.sort_array(F.collect_set("value")).alias("v"))
    return s.select("image_id", F.array_join("v", ";").alias("barcode_values"), (F.size("v") > 1).alias("several"))


@query("""WITH c AS (SELECT image_id, pos, normalised_value AS v, CASE pos % 3 WHEN 0 THEN '' WHEN 1 THEN 'Explicit AWB anchor' ELSE 'Shipment no' END AS ctx, source, confidence FROM v_candidates WHERE normalised_value IS NOT NULL),
m AS (SELECT *, concat_ws(';', CASE WHEN regexp_full_match(v, '[0-9]{14}') AND (ctx = '' OR regexp_matches(lower(ctx), 'awb|waybill|tracking|consignment')) THEN 'numeric_14' END,
  CASE WHEN regexp_full_match(v, '[A-Z0-9]{8,30}') AND (ctx = '' OR regexp_matches(lower(ctx), 'awb|waybill|tracking|shipment|consignment')) THEN 'generic_alphanumeric' END) AS rules FROM c)
SELECT image_id, pos, rules, CASE WHEN source = 'BARCODE' AND rules = '' THEN least(confidence, 0.69) ELSE confidence END AS confidence FROM m""")
def courier_rule_match(spark, d):
    context = F.when(F.col("pos") % 3 == 0, "").when(F.col("pos") % 3 == 1, "Explicit AWB anchor").otherwise("Shipment no")
    c = view(spark, d, "v_candidates").where("normalised_value is not null").withColumn("rules", F.array_join(V.matching_rules(F.col("normalised_value"), context), ";"))
    return c.select("image_id", "pos", "rules", F.when((F.col("source") == "BARCODE") & (F.col("rules") == ""), F.least(F.col("confidence"), F.lit(0.69))).otherwise(F.col("confidence")).alias("confidence"))


@query("""WITH s AS (SELECT image_id, count(*) FILTER (score >= 0.8) AS readable, bool_or(class_name = 'parcel_full') AS barcode, max(score) FILTER (class_name = 'label_region') AS best FROM v_boxes GROUP BY 1)
SELECT image_id, CASE WHEN readable > 1 THEN 'MULTIPLE_LABEL_CANDIDATES' WHEN readable >= 1 THEN 'LABEL_VISIBLE_READABLE' WHEN barcode THEN 'LABEL_VISIBLE_BARCODE_ONLY' WHEN best >= 0.55 THEN 'LABEL_VISIBLE_LOW_CONFIDENCE' WHEN best IS NOT NULL THEN 'LABEL_STATUS_UNCERTAIN' ELSE 'LABEL_NOT_VISIBLE' END AS label_status FROM s""")
def label_status(spark, d):
    c = F.col
    s = view(spark, d, "v_boxes").groupBy("image_id").agg(F.count_if(c("score") >= 0.8).alias("readable"), F.bool_or(c("class_name") == "parcel_full").alias("barcode"), F.max(F.when(c("class_name") == "label_region", c("score"))).alias("best"))
    status = F.when(c("readable") > 1, "MULTIPLE_LABEL_CANDIDATES").when(c("readable") >= 1, "LABEL_VISIBLE_READABLE").when(c("barcode"), "LABEL_VISIBLE_BARCODE_ONLY").when(c("best") >= 0.55, "LABEL_VISIBLE_LOW_CONFIDENCE").when(c("best").isNotNull(), "LABEL_STATUS_UNCERTAIN").otherwise("LABEL_NOT_VISIBLE")
    return s.select("image_id", status.alias("label_status"))


IOU = "(greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)))"
IOU = f"({IOU}::DOUBLE / greatest(1, a.w * a.h + b.w * b.h - {IOU}))"


@query(f"SELECT a.image_id, a.box_id, coalesce(bool_or(b.box_id IS NOT NULL AND {IOU} > 0.08), false) AS blocked, round(coalesce(max(CASE WHEN b.box_id IS NOT NULL THEN {IOU} END), 0), 6) AS overlap FROM v_boxes a LEFT JOIN v_boxes b ON a.image_id = b.image_id AND b.class_name = 'hand_occlusion' WHERE a.class_name = 'label_region' GROUP BY 1, 2")
def box_iou_pairs(spark, d):
    boxes = view(spark, d, "v_boxes")
    a, b = boxes.where("class_name = 'label_region'").alias("a"), boxes.where("class_name = 'hand_occlusion'").alias("b")
    x = V.iou(V.box("a"), V.box("b"))
    j = a.join(b, F.col("a.image_id") == F.col("b.image_id"), "left").select("a.image_id", "a.box_id", F.when(F.col("b.box_id").isNotNull(), x).alias("o"))
    return j.groupBy("image_id", "box_id").agg(F.coalesce(F.bool_or(F.col("o") > 0.08), F.lit(False)).alias("blocked"), F.round(F.coalesce(F.max("o"), F.lit(0.0)), 6).alias("overlap"))


@query("SELECT a.image_id, a.box_id FROM v_boxes a WHERE a.class_name = 'label_region' AND NOT EXISTS (SELECT 1 FROM v_boxes b WHERE b.image_id = a.image_id AND b.class_name = 'parcel_full' AND abs(a.x - b.x) <= greatest(8, 0.1 * b.w) AND abs(a.y - b.y) <= greatest(8, 0.1 * b.h))")
def box_far_antijoin(spark, d):
    boxes = view(spark, d, "v_boxes")
    a, b = boxes.where("class_name = 'label_region'").alias("a"), boxes.where("class_name = 'parcel_full'").alias("b")
    near = lambda k, s: F.abs(F.col(f"a.{k}") - F.col(f"b.{k}")) <= F.greatest(F.lit(8.0), 0.1 * F.col(f"b.{s}"))
    return a.join(b, (F.col("a.image_id") == F.col("b.image_id")) & near("x", "w") & near("y", "h"), "left_anti").select("image_id", "box_id")


@query(f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, box_id) AS rk FROM v_boxes),
f AS (SELECT image_id, rk, [struct_pack(box_id := box_id, x := x, y := y, w := w, h := h, score := score)] AS kept FROM o WHERE rk = 1
UNION ALL SELECT f.image_id, b.rk, CASE WHEN len(list_filter(f.kept, lambda a: {IOU} >= 0.55)) > 0 THEN f.kept ELSE list_append(f.kept, struct_pack(box_id := b.box_id, x := b.x, y := b.y, w := b.w, h := b.h, score := b.score)) END FROM f JOIN o b ON b.image_id = f.image_id AND b.rk = f.rk + 1)
SELECT image_id, k.box_id AS box_id, k.score AS score FROM (SELECT image_id, unnest(kept) AS k FROM (SELECT image_id, arg_max(kept, rk) AS kept FROM f GROUP BY 1))""")
def nms_greedy(spark, d):
    return V.nms(view(spark, d, "v_boxes"))


@query("SELECT image_id, max(score) AS confidence, nullif(count(*) FILTER (class_name IN ('parcel_full', 'parcel_partial')), 0) AS parcel_count, bool_or(class_name = 'parcel_partial') AS partial, bool_or(class_name = 'label_region') AS label_seen FROM v_boxes GROUP BY 1")
def detector_rollup(spark, d):
    return V.detector_rollup(view(spark, d, "v_boxes"))


@query("""SELECT image_id, box_id, round(score_, 6) AS label_score FROM (SELECT image_id, box_id, 0.27 * (score) + 0.20 * least(1.0, 1.8 * (x / 60)) + 0.18 * least(1.0, 8 * (y / 600)) + 0.20 * least(1.0, 10 * (w / 600)) + 0.10 * least(1.0, (w * h / 40000) / 0.08) + 0.05 * greatest(0.0, 1 - abs(ln(greatest(w / h, 0.01))) / 2.2) AS score_ FROM v_boxes) WHERE score_ >= 0.34""")
def label_score(spark, d):
    c = F.col
    f = view(spark, d, "v_boxes").select("image_id", "box_id", c("score").alias("rect"), (c("x") / 60).alias("bright"), (c("y") / 600).alias("edge"), (c("w") / 600).alias("vert"), F.least(F.lit(1.0), (c("w") * c("h") / 40000) / 0.08).alias("area"), F.greatest(F.lit(0.0), 1 - F.abs(F.ln(F.greatest(c("w") / c("h"), F.lit(0.01)))) / 2.2).alias("aspect"))
    s = f.withColumn("s", V.label_score()).where("s >= 0.34")
    return s.select("image_id", "box_id", F.round("s", 6).alias("label_score"))


@query("""WITH r AS (SELECT image_id, w * h / 10000.0 AS ra, x, y, w, h, row_number() OVER (PARTITION BY image_id ORDER BY w * h DESC, box_id) AS rk FROM v_boxes),
p AS (SELECT a.image_id, a.ra, a.x <= 3 OR a.y <= 3 OR a.x + a.w >= 97 OR a.y + a.h >= 97 AS touches, CASE WHEN b.ra >= greatest(0.07, a.ra * 0.38) THEN 2 ELSE 1 END AS n FROM r a LEFT JOIN r b ON b.image_id = a.image_id AND b.rk = 2 WHERE a.rk = 1)
SELECT image_id, n AS parcel_count, round(CASE WHEN n > 1 THEN least(0.78, 0.92, 0.55 + least(ra, 0.35)) ELSE least(0.92, 0.55 + least(ra, 0.35)) END::DOUBLE, 3) AS confidence, CASE WHEN touches THEN 'PARTIAL' ELSE 'FULL' END AS visibility FROM p""")
def parcel_evidence(spark, d):
    c = F.col
    b = view(spark, d, "v_boxes").withColumn("ra", c("w") * c("h") / 10000.0)
    top = b.groupBy("image_id").agg(F.slice(F.reverse(F.sort_array(F.collect_list(F.struct("ra", (-c("box_id")).alias("k"), "x", "y", "w", "h")))), 1, 2).alias("t"))
    p, q = F.get("t", F.lit(0)), F.get("t", F.lit(1))
    two = F.coalesce(q["ra"] >= F.greatest(F.lit(0.07), p["ra"] * 0.38), F.lit(False))
    conf = F.least(F.lit(0.92), 0.55 + F.least(p["ra"], F.lit(0.35)))
    touches = (p["x"] <= 3) | (p["y"] <= 3) | (p["x"] + p["w"] >= 97) | (p["y"] + p["h"] >= 97)
    return top.select("image_id", F.when(two, 2).otherwise(1).alias("parcel_count"), F.round(F.when(two, F.least(conf, F.lit(0.78))).otherwise(conf), 3).alias("confidence"), F.when(touches, "PARTIAL").otherwise("FULL").alias("visibility"))


@query("SELECT image_id, coalesce(weight_grams / 10 < 60, false) OR width_cm < 18 OR height_cm * 5 > 82 OR coalesce(length_cm, 0) > 35 AS low_quality FROM v_images")
def quality_flags(spark, d):
    c = F.col
    return view(spark, d, "v_images").select("image_id", (F.coalesce(c("weight_grams") / 10 < 60, F.lit(False)) | (c("width_cm") < 18) | (c("height_cm") * 5 > 82) | (F.coalesce("length_cm", F.lit(0.0)) > 35)).alias("low_quality"))


@query("""WITH d AS (SELECT image_id, box_id, class_name, greatest(0, round_even((x * 8 - w * 4 - 10) / 0.8, 0)::INT) AS px, greatest(0, round_even((y * 8 - h * 4 - 6) / 0.8, 0)::INT) AS py, round_even(w * 8 / 0.8, 0)::INT AS pw, round_even(h * 8 / 0.8, 0)::INT AS ph FROM v_boxes),
e AS (SELECT image_id, box_id, class_name, px, py, least(pw, 640 - px) AS pw, least(ph, 480 - py) AS ph FROM d)
SELECT image_id, box_id, px, py, pw, ph, CASE WHEN class_name = 'parcel_full' AND (px <= 4 OR py <= 4 OR px + pw >= 636 OR py + ph >= 476) THEN 'parcel_partial' ELSE class_name END AS class_name FROM e WHERE pw > 1 AND ph > 1""")
def detector_box_decode(spark, d):
    """Letterboxed centre boxes back to image pixels (scale 0.8, margins 10 and 6, image 640 x 480)."""
    c, z = F.col, F.lit(0)
    r = lambda x: F.rint(x / 0.8).cast("int")
    b = view(spark, d, "v_boxes").select("image_id", "box_id", "class_name", F.greatest(z, r(c("x") * 8 - c("w") * 4 - 10)).alias("px"), F.greatest(z, r(c("y") * 8 - c("h") * 4 - 6)).alias("py"), r(c("w") * 8).alias("pw"), r(c("h") * 8).alias("ph"))
    b = b.withColumn("pw", F.least(c("pw"), 640 - c("px"))).withColumn("ph", F.least(c("ph"), 480 - c("py"))).where("pw > 1 and ph > 1")
    edge = (c("px") <= 4) | (c("py") <= 4) | (c("px") + c("pw") >= 636) | (c("py") + c("ph") >= 476)
    return b.select("image_id", "box_id", "px", "py", "pw", "ph", F.when((c("class_name") == "parcel_full") & edge, "parcel_partial").otherwise(c("class_name")).alias("class_name"))


@query("""WITH p AS (SELECT *, CASE WHEN class_name = 'label_region' THEN greatest(4, (least(w, h) * 0.06)::DOUBLE) ELSE greatest(12, w * 0.55) END AS dx, CASE WHEN class_name = 'label_region' THEN greatest(4, (least(w, h) * 0.06)::DOUBLE) ELSE greatest(12, h * 2.0) END AS dy FROM v_boxes)
SELECT image_id, box_id, greatest(0, x - floor(dx)::INT) AS x1, greatest(0, y - floor(dy)::INT) AS y1, least(100, x + w + floor(dx)::INT) AS x2, least(100, y + h + floor(dy)::INT) AS y2 FROM p""")
def crop_expand(spark, d):
    c = F.col
    own = c("class_name") == "label_region"
    pad = lambda least, share: F.floor(F.greatest(F.lit(float(least)), share)).cast("int")
    small = F.least("w", "h") * 0.06
    dx, dy = F.when(own, pad(4, small)).otherwise(pad(12, c("w") * 0.55)), F.when(own, pad(4, small)).otherwise(pad(12, c("h") * 2.0))
    z = F.lit(0)
    return view(spark, d, "v_boxes").select("image_id", "box_id", F.greatest(z, c("x") - dx).alias("x1"), F.greatest(z, c("y") - dy).alias("y1"), F.least(F.lit(100), c("x") + c("w") + dx).alias("x2"), F.least(F.lit(100), c("y") + c("h") + dy).alias("y2"))


# --- evaluation -----------------------------------------------------------------------------------

JOINED = "j AS (SELECT t.*, p.awb_number, p.awb_confidence, p.weight_grams, p.parcel_count, p.parcel_visibility, p.requires_review, p.processing_status, p.status_flags, p.processing_duration_ms FROM v_truth t LEFT JOIN v_pred p USING (filename) WHERE lower(annotated) IN ('true', '1', 'yes'))"
MARKED = JOINED + """,
m AS (SELECT *, NOT coalesce(requires_review, true) AS clean, trim(coalesce(expected_awb, '')) <> '' AS has, trim(coalesce(expected_awb, '')) <> '' AND coalesce(awb_number, '') <> '' AS found, coalesce(awb_number = expected_awb, false) AS ok, coalesce(awb_number, '') <> '' AS any_,
  coalesce(processing_status, 'MISSING') <> 'COMPLETED' AS failed, expected_review = 'true' AS must, coalesce(expected_parcel_count::DOUBLE = parcel_count, false) AND upper(expected_parcel_visibility) = upper(coalesce(parcel_visibility, 'MISSING')) AS parcel_ok FROM j)"""
METRICS = MARKED + """,
s AS (SELECT count(*) AS labelled_images, count(*) FILTER (has) AS awb_labelled, count(*) FILTER (found) AS awb_extracted, count(*) FILTER (ok) AS awb_exact, count(*) FILTER (clean AND found) AS clean_awb, count(*) FILTER (clean AND found AND ok) AS clean_right,
  count(*) FILTER (clean AND found AND NOT ok) AS false_clean, count(*) FILTER (clean AND has AND NOT found) AS clean_missing, count(*) FILTER (must) AS review_positive, count(*) FILTER (must AND NOT clean) AS review_hit, count(*) AS parcel_labelled, count(*) FILTER (parcel_ok) AS parcel_hit, count(*) FILTER (clean) AS clean_records, count(*) FILTER (failed) AS failed_records FROM m),
x AS (SELECT labelled_images, awb_labelled, awb_extracted, awb_exact, round(awb_exact / nullif(awb_extracted, 0), 6) AS awb_precision, round(awb_exact / nullif(awb_labelled, 0), 6) AS awb_recall, clean_awb, round(clean_right / nullif(clean_awb, 0), 6) AS clean_precision, false_clean, clean_missing, review_positive,
  round(review_hit / nullif(review_positive, 0), 6) AS review_recall, review_positive - review_hit AS review_missed, parcel_labelled, round(parcel_hit / nullif(parcel_labelled, 0), 6) AS parcel_accuracy, clean_records, coalesce(round((labelled_images - clean_records) / nullif(labelled_images, 0), 6), 0) AS review_rate, coalesce(round(failed_records / nullif(labelled_images, 0), 6), 0) AS failed_rate FROM s)"""


def _joined(spark: SparkSession, d: str) -> DataFrame:
    return E.labelled(view(spark, d, "v_truth"), view(spark, d, "v_pred"))


@query(f"WITH {JOINED} SELECT filename, expected_awb, awb_number, awb_confidence, requires_review FROM j")
def eval_join(spark, d):
    return _joined(spark, d).select("filename", "expected_awb", "awb_number", "awb_confidence", "requires_review")


@query(f"WITH {METRICS} SELECT * FROM x")
def eval_metrics(spark, d):
    return E.metrics(E.marked(_joined(spark, d)))


@query(f"WITH {METRICS} SELECT coalesce(clean_precision >= 0.99, false) AS clean_precision_ok, false_clean = 0 AS no_false_clean, review_rate <= 0.35 AS review_rate_ok, failed_rate < 0.01 AS failed_rate_ok FROM x")
def eval_acceptance(spark, d):
    return E.acceptance(E.marked(_joined(spark, d)))


_COVERED = {"awb": ("expected_awb", "awb_number"), "weight": ("expected_weight_grams", "weight_grams")}


@query(f"""WITH {JOINED}, f AS (SELECT 'awb' AS field, trim(coalesce(expected_awb, '')) <> '' AS want, trim(coalesce(awb_number, '')) <> '' AS got FROM j UNION ALL SELECT 'weight', trim(expected_weight_grams) <> '', weight_grams IS NOT NULL FROM j),
r AS (SELECT field, count(*) FILTER (want) AS labelled, count(*) FILTER (want AND got) AS extracted FROM f GROUP BY ROLLUP (field)) SELECT coalesce(field, 'overall') AS field, labelled, extracted, round(extracted / nullif(labelled, 0), 6) AS coverage FROM r""")
def eval_field_coverage(spark, d):
    return E.coverage(_joined(spark, d), _COVERED)


_PAIRS = {"visibility": ("expected_parcel_visibility", "parcel_visibility"), "review": ("expected_review", "requires_review"), "count": ("expected_parcel_count", "parcel_count")}
CONFUSION = JOINED + """,
c AS (SELECT pair, expected, predicted, count(*) AS n FROM (SELECT 'visibility' AS pair, expected_parcel_visibility AS expected, coalesce(parcel_visibility, 'MISSING') AS predicted FROM j UNION ALL SELECT 'review', expected_review, coalesce(requires_review::VARCHAR, 'MISSING') FROM j
  UNION ALL SELECT 'count', expected_parcel_count, coalesce(parcel_count::VARCHAR, 'MISSING') FROM j) GROUP BY 1, 2, 3)"""


@query(f"WITH {CONFUSION} SELECT * FROM c")
def eval_confusion(spark, d):
    return E.confusion(_joined(spark, d), _PAIRS)


@query(f"""WITH {CONFUSION}, u AS (SELECT pair, upper(expected) AS e, upper(predicted) AS p, n FROM c), l AS (SELECT pair, e AS label FROM u UNION SELECT pair, p FROM u),
f AS (SELECT l.pair, l.label, coalesce(sum(n) FILTER (e = label AND p = label), 0) AS tp, coalesce(sum(n) FILTER (e = label), 0) AS want, coalesce(sum(n) FILTER (p = label), 0) AS got FROM l JOIN u USING (pair) GROUP BY 1, 2)
SELECT pair, round(avg(CASE WHEN want + got > 0 THEN 2.0 * tp / (want + got) ELSE 0 END), 6) AS macro_f1 FROM f GROUP BY 1""")
def eval_macro_f1(spark, d):
    return E.macro_f1(E.confusion(_joined(spark, d), _PAIRS))


SWEEP = MARKED + """,
w AS (SELECT t / 100 AS threshold, count(*) FILTER (any_ AND coalesce(awb_confidence, 0) >= t / 100) AS accepted, count(*) FILTER (any_ AND ok AND coalesce(awb_confidence, 0) >= t / 100) AS right_, count(*) AS total FROM m, range(75, 100) r(t) GROUP BY 1),
sw AS (SELECT threshold, accepted, round(coalesce(right_ / nullif(accepted, 0), 0.0), 6) AS "precision", round(1 - accepted / total, 6) AS review_rate FROM w)"""


@query(f"WITH {SWEEP} SELECT * FROM sw")
def eval_threshold_sweep(spark, d):
    return E.sweep(E.marked(_joined(spark, d)))


@query(f'WITH {SWEEP} SELECT * FROM sw WHERE accepted > 0 AND "precision" >= 0.85 ORDER BY review_rate, threshold LIMIT 1')
def eval_calibrate(spark, d):
    return E.calibrate(E.sweep(E.marked(_joined(spark, d))), 0.85)


@query(f"WITH {MARKED} SELECT filename, expected_awb, awb_number, processing_status FROM m WHERE (clean AND found AND NOT ok) OR failed")
def eval_failures(spark, d):
    c = F.col
    return E.marked(_joined(spark, d)).where((c("clean") & c("found") & ~c("right")) | c("failed")).select("filename", "expected_awb", "awb_number", "processing_status")


@query(f"WITH {JOINED} SELECT median(processing_duration_ms)::DOUBLE AS median_ms, quantile_cont(processing_duration_ms::DOUBLE, 0.95) AS p95_ms FROM j")
def eval_latency(spark, d):
    return E.latency(_joined(spark, d), "processing_duration_ms")


@query("""WITH s AS (SELECT p_brand AS c, avg(p_size) / 50 AS p, avg(p_retailprice) / 3000 AS r FROM part GROUP BY 1), f AS (SELECT c, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM s) SELECT count(*) AS classes, round(avg(f1), 6) AS macro_f1 FROM f""")
def detector_f1(spark, d):
    s = table(spark, d, "part").groupBy("p_brand").agg((F.avg("p_size") / 50).alias("p"), (F.avg("p_retailprice") / 3000).alias("r"))
    f1 = F.round(F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)), 6)
    return s.agg(F.count(F.lit(1)).alias("classes"), F.round(F.avg(f1), 6).alias("macro_f1"))


# --- jobs and files -------------------------------------------------------------------------------


@query("SELECT sha, min(file_id) AS file_id FROM (SELECT sha256(content) AS sha, file_id FROM v_files) GROUP BY 1")
def dedupe_canonical(spark, d):
    f = view(spark, d, "v_files").select(F.sha2("content", 256).alias("sha"), "file_id")
    return J.canonical(f, "sha", "file_id")


@query("SELECT f.file_id, m.original FROM v_files f JOIN (SELECT sha256(content) AS sha, min(file_id) AS original FROM v_files GROUP BY 1) m ON sha256(f.content) = m.sha WHERE f.file_id > m.original")
def duplicate_fanout(spark, d):
    f = view(spark, d, "v_files").select(F.sha2("content", 256).alias("sha"), "file_id")
    return J.fan_out(f, "sha", "file_id").select("file_id", "original")


@query("SELECT file_id FROM v_files WHERE sha256(content) NOT IN (SELECT sha256(content) FROM v_files WHERE file_id % 3 = 0)")
def resume_pending(spark, d):
    f = view(spark, d, "v_files").select("file_id", F.sha2("content", 256).alias("sha"))
    return J.pending(f, f.where("file_id % 3 = 0"), "sha").select("file_id")


@query("SELECT job_id, arg_max(primary_status, seq) AS primary_status, max(seq) AS seq FROM v_jobs GROUP BY 1")
def upsert_latest(spark, d):
    return J.upsert(view(spark, d, "v_jobs").select("job_id", "primary_status", "seq"), ["job_id"], F.col("seq"))


@query("""SELECT job_id, seq, count(*) OVER w AS processed, sum((primary_status IN ('SUCCESS_LABEL_VERIFIED', 'SUCCESS_PARTIAL_FIELDS'))::INT) OVER w::BIGINT AS successful, sum(requires_review::INT) OVER w::BIGINT AS review, round(seq * 100.0 / count(*) OVER (PARTITION BY job_id), 2)::DOUBLE AS percent FROM v_jobs WINDOW w AS (PARTITION BY job_id ORDER BY seq ROWS UNBOUNDED PRECEDING)""")
def job_running_progress(spark, d):
    r = J.running_progress(view(spark, d, "v_jobs"))
    return r.withColumn("percent", F.col("percent").cast("double"))


@query("SELECT job_id, count(*) AS processed, count(*) FILTER (primary_status LIKE 'SUCCESS%') AS successful, count(*) FILTER (requires_review) AS review, count(*) FILTER (primary_status = 'REJECTED') AS rejected, count(*) FILTER (primary_status = 'PROCESSING_ERROR') AS failed, sum(n_warnings)::BIGINT AS warnings, CASE WHEN sum(n_warnings) > 0 THEN 'COMPLETED_WITH_WARNINGS' ELSE 'COMPLETED' END AS stage FROM v_jobs GROUP BY 1")
def job_progress(spark, d):
    p = J.progress(view(spark, d, "v_jobs"))
    return p.withColumn("stage", J.final_stage(F.col("warnings")))


JOB = "jb AS (SELECT user_id AS job_id, max(ts) AS last_at, CASE user_id % 4 WHEN 0 THEN 'PROCESSING' WHEN 1 THEN 'COMPLETED' WHEN 2 THEN 'QUEUED' ELSE 'CANCELLED' END AS stage FROM events GROUP BY 1)"


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("user_id") % 4
    stage = F.when(k == 0, "PROCESSING").when(k == 1, "COMPLETED").when(k == 2, "QUEUED").otherwise("CANCELLED")
    return table(spark, d, "events").groupBy(F.col("user_id").alias("job_id"), stage.alias("stage")).agg(F.max("ts").alias("last_at")).select("job_id", "last_at", "stage")


@query(f"WITH {JOB} SELECT job_id, CASE WHEN stage IN ('COMPLETED', 'COMPLETED_WITH_WARNINGS', 'FAILED', 'CANCELLED') THEN stage ELSE 'FAILED' END AS stage FROM jb")
def interrupted_jobs(spark, d):
    return J.interrupted(_jobs(spark, d)).select("job_id", "stage")


@query(f"WITH {JOB} SELECT job_id, stage NOT IN ('COMPLETED', 'COMPLETED_WITH_WARNINGS', 'FAILED', 'CANCELLED') AND epoch((SELECT max(ts) FROM events)) - epoch(last_at) >= 300 AS stalled FROM jb")
def stalled_jobs(spark, d):
    now = table(spark, d, "events").agg(F.max("ts").alias("now"))
    j = _jobs(spark, d).join(F.broadcast(now), F.lit(True))  # one row
    return j.select("job_id", J.stalled(F.col("stage"), F.col("last_at"), F.col("now")).alias("stalled"))


@query("""SELECT event_id, regexp_full_match(name, '(?i)[0-9a-f]{32}') AND ts < (SELECT max(ts) FROM events) - INTERVAL 24 HOUR AS expired FROM (SELECT event_id, ts, CASE WHEN event_id % 2 = 0 THEN md5(event_id::VARCHAR) ELSE 'job_' || event_id END AS name FROM events)""")
def retention_expired(spark, d):
    e = table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))
    name = F.when(F.col("event_id") % 2 == 0, F.md5(F.col("event_id").cast("string"))).otherwise(F.concat(F.lit("job_"), F.col("event_id").cast("string")))
    return e.join(F.broadcast(now), F.lit(True)).select("event_id", J.expired(name, F.col("ts"), F.col("now"), 24).alias("expired"))


@query("SELECT file_id, CASE WHEN k < 70 THEN 'train' WHEN k < 85 THEN 'val' ELSE 'test' END AS split FROM (SELECT file_id, ('0x' || substr(sha256(file_id::VARCHAR), 1, 8))::BIGINT % 100 AS k FROM v_files)")
def split_assignment(spark, d):
    return view(spark, d, "v_files").select("file_id", J.split_of(F.col("file_id").cast("string")).alias("split"))


HASHES = "h AS (SELECT vec_id, list_sum(list_transform(range(0, 64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN (1::HUGEINT << i) ELSE 0::HUGEINT END))::UBIGINT AS bits FROM embeddings)"


def _hashes(spark: SparkSession, d: str) -> DataFrame:
    """Sign bits of all 64 entries; the 64th is the sign of the BIGINT."""
    bit = lambda i: F.when(F.get(F.col("embedding"), F.lit(i)) > 0, F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long"))
    bits = functools.reduce(lambda a, b: a.bitwiseOR(b), (bit(i) for i in range(64)))
    return table(spark, d, "embeddings").select("vec_id", bits.alias("bits"))


COPIED = HASHES + """, hc AS (SELECT vec_id, bits FROM h UNION ALL SELECT vec_id + 1000000000, xor(bits, (1::UBIGINT << (vec_id % 61)) | (1::UBIGINT << (vec_id * 7 % 61)) | (1::UBIGINT << (vec_id * 11 % 64))) FROM h WHERE vec_id % 4 = 0)"""


CLASSED = COPIED + ", cl AS (SELECT bits, min(vec_id) AS class_id, count(*) AS n FROM hc GROUP BY 1)"


@query(f"WITH {CLASSED} SELECT least(x.class_id, y.class_id) AS a, greatest(x.class_id, y.class_id) AS b, bit_count(xor(x.bits, y.bits))::INT AS distance, CASE WHEN x.class_id < y.class_id THEN x.n ELSE y.n END AS n_a, CASE WHEN x.class_id < y.class_id THEN y.n ELSE x.n END AS n_b FROM cl x JOIN cl y ON x.bits < y.bits AND bit_count(xor(x.bits, y.bits)) <= 6 UNION ALL SELECT class_id, vec_id, 0, n, n FROM hc JOIN cl USING (bits) WHERE vec_id <> class_id")
def hamming_pairs(spark, d):
    """Links within six of 64 bits among hashes and re-encoded copies of some of them (up to three bits off): a row for each
    two different hashes, and one of distance 0 for each further row of a hash."""
    return H.near_links(with_copies(spark, d), "vec_id", 6)


@query(f"WITH {CLASSED} SELECT vec_id, class_id, n FROM hc JOIN cl USING (bits)")
def hash_classes(spark, d):
    return H.membership(with_copies(spark, d), "vec_id")


def with_copies(spark: SparkSession, d: str) -> DataFrame:
    h = _hashes(spark, d)
    one = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.cast("int"))
    v = F.col("vec_id")
    off = one(v % 61).bitwiseOR(one(v * 7 % 61)).bitwiseOR(one(v * 11 % 64))
    copies = h.where("vec_id % 4 = 0").select((v + 1000000000).alias("vec_id"), F.col("bits").bitwiseXOR(off).alias("bits"))
    return h.unionByName(copies)


@query(f"""WITH RECURSIVE {HASHES}, o AS (SELECT vec_id % 10 AS set_id, vec_id AS pos, bits, row_number() OVER (PARTITION BY vec_id % 10 ORDER BY vec_id) AS rk FROM h),
f AS (SELECT set_id, rk, pos, pos AS leader, [struct_pack(pos := pos, bits := bits)] AS lead FROM o WHERE rk = 1
UNION ALL SELECT f.set_id, o.rk, o.pos, coalesce(list_filter(f.lead, lambda k: bit_count(xor(k.bits, o.bits)) <= 6)[1].pos, o.pos), CASE WHEN len(list_filter(f.lead, lambda k: bit_count(xor(k.bits, o.bits)) <= 6)) > 0 THEN f.lead ELSE list_append(f.lead, struct_pack(pos := o.pos, bits := o.bits)) END FROM f JOIN o ON o.set_id = f.set_id AND o.rk = f.rk + 1)
SELECT set_id, pos, leader FROM f""")
def leader_groups(spark, d):
    return H.leaders(_hashes(spark, d).select((F.col("vec_id") % 10).alias("set_id"), F.col("vec_id").alias("pos"), "bits"))


ANNOTATED = "an AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '1 0.5 0.5 0.5' WHEN 1 THEN '99 0.5 0.5 0.5 0.5' WHEN 2 THEN 'x 0.5 0.5 0.5 0.5' WHEN 3 THEN '2 1.5 0.5 0.5 0.001' ELSE '0 0.5 0.5 0.25 0.25' END AS line FROM events)"


@query(f"""WITH {ANNOTATED}, p AS (SELECT event_id, string_split(line, ' ') AS f FROM an), q AS (SELECT event_id, len(f) AS n, try_cast(f[1] AS INT) AS c, list_transform(f[2:], lambda x: try_cast(x AS DOUBLE)) AS v FROM p)
SELECT event_id, 'invalid_columns' AS error FROM q WHERE n <> 5 UNION ALL SELECT event_id, 'invalid_number' FROM q WHERE n = 5 AND c IS NULL UNION ALL SELECT event_id, 'invalid_class:' || c FROM q WHERE n = 5 AND c NOT BETWEEN 0 AND 4
UNION ALL SELECT event_id, 'out_of_range' FROM q WHERE n = 5 AND c IS NOT NULL AND (v[1] > 1 OR v[2] > 1 OR v[3] > 1 OR v[4] > 1) UNION ALL SELECT event_id, 'tiny_box' FROM q WHERE n = 5 AND c IS NOT NULL AND (v[3] * 640 < 4 OR v[4] * 480 < 4)""")
def annotation_line_errors(spark, d):
    k = F.col("event_id") % 5
    line = F.when(k == 0, "1 0.5 0.5 0.5").when(k == 1, "99 0.5 0.5 0.5 0.5").when(k == 2, "x 0.5 0.5 0.5 0.5").when(k == 3, "2 1.5 0.5 0.5 0.001").otherwise("0 0.5 0.5 0.25 0.25")
    return table(spark, d, "events").select("event_id", F.explode(perception.line_errors(line)).alias("error"))


@query("SELECT o_orderkey AS k, 'image_without_label' AS error FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION SELECT l_orderkey, 'label_without_image' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 50 <> 0)")
def annotation_key_diff(spark, d):
    images, labels = table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")).distinct()
    a = images.join(labels, "k", "left_anti").select("k", F.lit("image_without_label").alias("error"))
    return a.unionByName(labels.join(images.where("k % 50 <> 0"), "k", "left_anti").select("k", F.lit("label_without_image").alias("error")))


@query("SELECT sha256(content) AS sha, file_id FROM v_files WHERE sha256(content) IN (SELECT sha256(content) FROM v_files GROUP BY 1 HAVING count(*) > 1)")
def duplicate_digests(spark, d):
    """Files whose content is there more than once, a row each, so a hot content is no single row."""
    f = view(spark, d, "v_files").select(F.sha2("content", 256).alias("sha"), "file_id")
    twice = f.groupBy("sha").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sha")
    return f.join(twice, "sha", "left_semi")


@query("SELECT sha, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM (SELECT sha256(content) AS sha, CASE file_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM v_files) GROUP BY 1 HAVING count(DISTINCT split) > 1")
def split_leakage(spark, d):
    k = F.col("file_id") % 3
    g = view(spark, d, "v_files").groupBy(F.sha2("content", 256).alias("sha")).agg(F.sort_array(F.collect_set(F.when(k == 0, "train").when(k == 1, "val").otherwise("test"))).alias("s"))
    return g.where(F.size("s") > 1).select("sha", F.array_join("s", ",").alias("splits"))


_EXT = r"lower(regexp_extract(path, '\.([A-Za-z]+)$', 1))"


@query(f"""SELECT file_id, CASE WHEN size = 0 THEN 'EMPTY_FILE' WHEN size > 200000 THEN 'FILE_TOO_LARGE' WHEN {_EXT} NOT IN ('jpg', 'jpeg', 'png') THEN 'UNSUPPORTED_IMAGE'
WHEN NOT ((head LIKE 'FFD8FF%' AND {_EXT} IN ('jpg', 'jpeg')) OR (head LIKE '89504E470D0A1A0A%' AND {_EXT} = 'png')) THEN 'BAD_SIGNATURE' WHEN width IS NULL OR height IS NULL THEN 'CORRUPT_IMAGE' WHEN width > 12000 OR height > 12000 OR width::BIGINT * height > 50000000 THEN 'IMAGE_TOO_LARGE' END AS error FROM v_files""")
def file_validation(spark, d):
    from ..sources import files

    v = view(spark, d, "v_files")
    return v.select("file_id", files.first_error(F.col("size"), F.col("path"), F.col("head"), F.col("width"), F.col("height"), max_bytes=200_000).alias("error"))


@query(r"""SELECT file_id, coalesce(nullif(left(regexp_replace(regexp_replace(regexp_extract(path, '([^/\\]*)$', 1), '[^A-Za-z0-9._() -]+', '_', 'g'), '^[ .]+|[ .]+$', '', 'g'), 180), ''), 'unnamed-image') AS name FROM v_files""")
def safe_names(spark, d):
    return view(spark, d, "v_files").select("file_id", T.safe_name(F.col("path")).alias("name"))


@query("SELECT file_id, sha256(content) AS sha FROM v_files")
def content_hash(spark, d):
    return view(spark, d, "v_files").select("file_id", F.sha2("content", 256).alias("sha"))


@query("SELECT f.file_id, c.answer, c.answer IS NOT NULL AS hit FROM v_files f LEFT JOIN (SELECT sha256('model|prompt|' || content) AS key, min(file_id) AS answer FROM v_files WHERE file_id % 2 = 0 GROUP BY 1) c ON c.key = sha256('model|prompt|' || f.content)")
def cache_lookup(spark, d):
    f = view(spark, d, "v_files").select("file_id", F.sha2(F.concat(F.lit("model|prompt|"), "content"), 256).alias("key"))
    cache = f.where("file_id % 2 = 0").groupBy("key").agg(F.min("file_id").alias("answer"))
    return f.join(cache, "key", "left").select("file_id", "answer", F.col("answer").isNotNull().alias("hit"))


@query("""SELECT event_id, CASE WHEN k = 'rate' OR s = 429 THEN 'rate_limit' WHEN k = 'timeout' THEN 'timeout' WHEN k = 'connection' THEN 'network' WHEN s IN (401, 403) THEN 'authentication' WHEN s IN (400, 404, 409, 422) THEN 'invalid_request' WHEN s >= 500 THEN 'server_error' WHEN s IS NOT NULL THEN 'api_error' WHEN k = 'parse' THEN 'malformed_response' ELSE 'unexpected' END AS category,
 coalesce(k IN ('rate', 'timeout', 'connection') OR s = 429 OR s >= 500, false) AS retryable FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'timeout' WHEN 1 THEN 'connection' WHEN 2 THEN 'parse' WHEN 3 THEN 'other' ELSE 'status' END AS k, CASE WHEN event_id % 6 >= 4 THEN [400, 401, 403, 404, 418, 422, 429, 500, 503][(event_id % 9 + 1)::INT] END AS s FROM events)""")
def vision_error_category(spark, d):
    from ..functions import errors

    m = F.col("event_id") % 6
    kind = F.when(m == 0, "timeout").when(m == 1, "connection").when(m == 2, "parse").when(m == 3, "other").otherwise("status")
    status = F.when(m >= 4, F.get(F.array(*(F.lit(x) for x in (400, 401, 403, 404, 418, 422, 429, 500, 503))), (F.col("event_id") % 9).cast("int")))
    return table(spark, d, "events").select("event_id", errors.category(kind, status).alias("category"), errors.retryable(kind, status).alias("retryable"))


@query("SELECT event_id, lower(trim(raw)) IN ('1', 'true', 'yes', 'on') AS flag, coalesce(try_cast(raw AS INT), 7) AS n FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN ' TRUE' WHEN 1 THEN 'on ' WHEN 2 THEN '12' WHEN 3 THEN 'no' ELSE '1' END AS raw FROM events)")
def env_coercion(spark, d):
    k = F.col("event_id") % 5
    e = table(spark, d, "events").select("event_id", F.when(k == 0, " TRUE").when(k == 1, "on ").when(k == 2, "12").when(k == 3, "no").otherwise("1").alias("raw"))
    return e.select("event_id", T.truthy(F.col("raw")).alias("flag"), F.coalesce(F.col("raw").try_cast("int"), F.lit(7)).alias("n"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, floor(epoch((SELECT max(ts) FROM events)))::BIGINT - floor(epoch(ts))::BIGINT AS elapsed FROM events")
def elapsed_iso(spark, d):
    e = table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))
    return e.join(F.broadcast(now), F.lit(True)).select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), (F.unix_timestamp("now") - F.unix_timestamp("ts")).alias("elapsed"))


@query("SELECT f.file_id, coalesce(r.event_id, -1) AS record FROM v_files f LEFT JOIN events r ON r.event_id = f.file_id AND r.event_id % 3 = 0")
def job_inputs(spark, d):
    f = view(spark, d, "v_files").select("file_id")
    r = table(spark, d, "events").where("event_id % 3 = 0").select(F.col("event_id").alias("record"))
    return f.join(r, F.col("file_id") == F.col("record"), "left").select("file_id", F.coalesce("record", F.lit(-1).cast("long")).alias("record"))


@query("SELECT filename, expected_awb, '' AS expected_weight, split FROM v_truth WHERE lower(annotated) NOT IN ('true', '1', 'yes')")
def truth_template(spark, d):
    return view(spark, d, "v_truth").where(~E.said_yes(F.col("annotated"))).select("filename", "expected_awb", F.lit("").alias("expected_weight"), "split")


@query(f"WITH {JOB} SELECT job_id, CASE WHEN job_id % 5 = 0 THEN 'QUEUED' ELSE stage END AS stage, CASE WHEN job_id % 5 = 0 THEN NULL ELSE last_at END AS last_at FROM jb")
def job_patch(spark, d):
    j = _jobs(spark, d)
    patch = j.where("job_id % 5 = 0").select("job_id", F.lit("QUEUED").alias("stage"), F.lit(True).alias("set_stage"), F.lit(None).cast("timestamp").alias("last_at"), F.lit(True).alias("set_last_at"))
    return J.patched(j, patch, "job_id", ["stage", "last_at"]).select("job_id", "stage", F.col("last_at").cast("timestamp_ntz").alias("last_at"))


@query("SELECT event_id, job_id FROM v_jobs WHERE job_id % 7 <> 0")
def job_delete(spark, d):
    j = view(spark, d, "v_jobs").select("event_id", "job_id")
    return J.without(j, j.where("job_id % 7 = 0").select("job_id").distinct(), "job_id").select("event_id", "job_id")


# --- further reports and perception --------------------------------------------------------------


@query(f"WITH {STATUS} SELECT image_id, primary_status, flags AS status_flags, coalesce(awb_number, '') AS awb_number, CASE WHEN length_cm IS NULL THEN '' ELSE length_cm::BIGINT || ' x ' || width_cm::BIGINT || ' x ' || height_cm::BIGINT || ' cm' END AS dimensions_text, 59 AS n_columns FROM res")
def detailed_report(spark, d):
    r = report.detailed(_records(spark, d).withColumnRenamed("flags", "status_flags"))
    return r.select("image_id", "primary_status", "status_flags", "awb_number", "dimensions_text", F.lit(len(r.columns)).alias("n_columns"))


_REASONS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.REASON_TEXT.items())


@query(f"""WITH {STATUS}, q AS (SELECT image_id, string_agg(CASE r {_REASONS} END, '; ' ORDER BY r) AS notes FROM (SELECT image_id, unnest(string_split(reasons, ';')) AS r FROM res WHERE reasons <> '') GROUP BY 1),
f AS (SELECT image_id, string_agg(CASE r {_WORDS} END, '; ' ORDER BY r) AS notes FROM (SELECT image_id, unnest(string_split(flags, ';')) AS r FROM res WHERE reasons = '' AND flags <> '') GROUP BY 1)
SELECT filename AS file, requires_review AS needs_review, coalesce(q.notes, f.notes, '') AS notes FROM res LEFT JOIN q USING (image_id) LEFT JOIN f USING (image_id)""")
def simple_report(spark, d):
    r = report.simple(_records(spark, d).withColumn("location", F.lit(None).cast("string")))
    return r.select(F.col("File").alias("file"), F.col("Needs review").alias("needs_review"), F.col("Notes").alias("notes"))


@query(f"WITH {GROUPS} SELECT image_id, value AS awb_number, source AS awb_number_source, confidence AS awb_number_confidence, NULL::VARCHAR AS weight, 'NOT_EXTRACTED' AS weight_source, 0.0::DOUBLE AS weight_confidence FROM rec")
def wide_fields(spark, d):
    return R.wide(_reconciled(spark, d), ["awb_number", "weight"])


@query("""WITH p AS (SELECT l_orderkey AS image_id, l_linenumber AS pass_no, max(60 + l_partkey % 40) / 100 AS awb_confidence FROM lineitem GROUP BY 1, 2), s AS (SELECT image_id, min(pass_no) FILTER (awb_confidence >= 0.86) AS stop FROM p GROUP BY 1)
SELECT p.image_id, pass_no, awb_confidence FROM p JOIN s USING (image_id) WHERE stop IS NULL OR pass_no <= stop""")
def ocr_pass_schedule(spark, d):
    p = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("pass_no")).agg((F.max(60 + F.col("l_partkey") % 40) / 100).alias("awb_confidence"))
    return perception.until_strong(p)


_CLASS_NAMES = [*perception.ALIASES, *perception.CLASSES]
_CLASS_SQL = " ".join(f"WHEN '{n.replace('_', ' ')}' THEN '{c}'" for n, c in [*perception.ALIASES.items(), *((c, c) for c in perception.CLASSES)])
_STYLED = f"""SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN n WHEN 1 THEN upper(n) WHEN 2 THEN '  ' || replace(n, ' ', '_') || ' ' WHEN 3 THEN replace(n, '_', ' ') WHEN 4 THEN n || ' ' || p_size ELSE p_name END AS raw
 FROM (SELECT p_partkey, p_size, p_name, [{', '.join(f"'{n}'" for n in _CLASS_NAMES)}][(p_partkey % {len(_CLASS_NAMES)} + 1)::INT] AS n FROM part)"""


@query(f"SELECT p_partkey AS k, raw, CASE lower(replace(trim(raw), '_', ' ')) {_CLASS_SQL} END AS class_name FROM ({_STYLED})")
def class_aliases(spark, d):
    """Every class and alias in several spellings, names with something added, and names of parts."""
    c = F.col
    n = F.get(F.array(*(F.lit(x) for x in _CLASS_NAMES)), (c("p_partkey") % len(_CLASS_NAMES)).cast("int"))
    k = c("p_size") % 6
    raw = F.when(k == 0, n).when(k == 1, F.upper(n)).when(k == 2, F.concat(F.lit("  "), F.replace(n, F.lit(" "), F.lit("_")), F.lit(" "))).when(k == 3, F.replace(n, F.lit("_"), F.lit(" "))).when(k == 4, F.concat_ws(" ", n, c("p_size"))).otherwise(c("p_name"))
    return table(spark, d, "part").select(c("p_partkey").alias("k"), raw.alias("raw")).select("k", "raw", perception.internal_class(c("raw")).alias("class_name"))


@query("""WITH RECURSIVE t AS (SELECT image_id AS page, y + h / 2 AS center, x::DOUBLE AS lft, h::DOUBLE AS height, 't' || box_id AS token, row_number() OVER (PARTITION BY image_id ORDER BY y + h / 2, x, h, 't' || box_id) AS rk FROM v_boxes),
f AS (SELECT page, rk, lft, token, 1 AS line, center AS s, 1 AS n, height AS tall FROM t WHERE rk = 1
UNION ALL SELECT t.page, t.rk, t.lft, t.token, CASE WHEN abs(t.center - f.s / f.n) <= greatest(t.height, f.tall) * 0.62 THEN f.line ELSE f.line + 1 END, CASE WHEN abs(t.center - f.s / f.n) <= greatest(t.height, f.tall) * 0.62 THEN f.s + t.center ELSE t.center END,
 CASE WHEN abs(t.center - f.s / f.n) <= greatest(t.height, f.tall) * 0.62 THEN f.n + 1 ELSE 1 END, CASE WHEN abs(t.center - f.s / f.n) <= greatest(t.height, f.tall) * 0.62 THEN greatest(t.height, f.tall) ELSE t.height END FROM f JOIN t ON t.page = f.page AND t.rk = f.rk + 1),
l AS (SELECT page, line, string_agg(token, ' ' ORDER BY lft, token) AS text FROM f GROUP BY 1, 2) SELECT page, string_agg(text, chr(10) ORDER BY line) AS text FROM l GROUP BY 1""")
def line_clusters(spark, d):
    b = view(spark, d, "v_boxes").select(F.col("image_id").alias("page"), (F.col("y") + F.col("h") / 2).alias("center"), F.col("x").cast("double").alias("left"), F.col("h").cast("double").alias("height"), F.concat(F.lit("t"), F.col("box_id").cast("string")).alias("token"))
    return perception.line_clusters(b)


@query("WITH t AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY w * h DESC, x DESC, y DESC, w DESC, h DESC) AS rk FROM v_boxes) SELECT image_id, min(x) AS x, min(y) AS y, max(x + w) AS x2, max(y + h) AS y2 FROM t WHERE rk <= 12 GROUP BY 1")
def overlay_union(spark, d):
    return perception.union_box(view(spark, d, "v_boxes").withColumn("pixels", F.col("w") * F.col("h")))


@query("SELECT image_id, (rk - 1)::INT AS rank, box_id FROM (SELECT image_id, box_id, row_number() OVER (PARTITION BY image_id ORDER BY class_name <> 'label_region', score DESC, box_id) AS rk FROM v_boxes) WHERE rk <= 5")
def label_topk(spark, d):
    return perception.short_list(view(spark, d, "v_boxes").withColumn("by_detector", F.col("class_name") == "label_region"))


from . import extended  # noqa: E402,F401  registers its queries here
