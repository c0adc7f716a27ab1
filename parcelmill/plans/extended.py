"""Further registered queries: whole reports, whole evaluation, evidence of all sources, ordered folds."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import errors
from ..functions import text as T
from ..operators import evaluate as E
from ..operators import evidence as V
from ..operators import hamming as H
from ..operators import jobs as J
from ..operators import perception
from ..operators import reconcile as R
from ..operators import report
from ..operators.steps import shared_folder
from ..sources import store
from ..streaming import guard
from .adapters import view
from .catalog import COPIED, IOU, query, table, with_copies

# --- evaluation, all fields ------------------------------------------------------------------------

FIELDS = {"awb": ("expected_awb", "awb_number"), "weight": ("expected_weight_grams", "weight_grams"), "length": ("expected_length_cm", "length_cm"), "width": ("expected_width_cm", "width_cm"), "height": ("expected_height_cm", "height_cm")}
PAIRS = {"parcel_count": "expected_parcel_count", "parcel_visibility": "expected_parcel_visibility", "label_status": "expected_label_status", "requires_review": "expected_review"}
_HAS = "(trim(coalesce({}::VARCHAR, '')) <> '')"
FULL = """j AS (SELECT t.*, p.* EXCLUDE (filename) FROM v_full_truth t LEFT JOIN v_full_pred p USING (filename) WHERE lower(annotated) IN ('true', '1', 'yes'))"""
FULL_MARKS = (
    FULL
    + """,
m AS (SELECT *, NOT coalesce(requires_review, true) AS clean, trim(coalesce(expected_awb, '')) <> '' AS has, trim(coalesce(expected_awb, '')) <> '' AND coalesce(awb_number, '') <> '' AS found, coalesce(awb_number = expected_awb, false) AS rt,
  coalesce(processing_status, 'MISSING') <> 'COMPLETED' AS failed, trim(coalesce(expected_review, '')) <> '' AS rl, lower(coalesce(expected_review, '')) IN ('true', '1', 'yes') AS must,
  trim(coalesce(expected_parcel_count, '')) <> '' AS ck, trim(coalesce(expected_parcel_visibility, '')) <> '' AS sk,
  (trim(coalesce(expected_parcel_count, '')) = '' OR coalesce(try_cast(expected_parcel_count AS DOUBLE) = parcel_count, false)) AND (trim(coalesce(expected_parcel_visibility, '')) = '' OR upper(expected_parcel_visibility) = upper(coalesce(parcel_visibility, 'MISSING'))) AS pk FROM j)"""
)
_WANT = " + ".join(f"count(*) FILTER ({_HAS.format(a)})" for a, _ in FIELDS.values())
_GOT = " + ".join(f"count(*) FILTER ({_HAS.format(a)} AND {_HAS.format(b)})" for a, b in FIELDS.values())


def _full(spark, d) -> DataFrame:
    return E.labelled(view(spark, d, "v_full_truth"), view(spark, d, "v_full_pred"))


@query(f"""WITH {FULL_MARKS}, s AS (SELECT count(*) AS labelled_images, count(*) FILTER (has) AS awb_labelled_images, count(*) FILTER (found) AS awb_extracted_images, count(*) FILTER (rt) AS awb_exact_matches,
  count(*) FILTER (clean AND found) AS clean_awb_records, count(*) FILTER (clean AND found AND rt) AS cr, count(*) FILTER (clean AND found AND NOT rt) AS false_clean_awb_count, count(*) FILTER (clean AND has AND NOT found) AS clean_missing_awb_count,
  count(*) FILTER (rl) AS review_labelled_images, count(*) FILTER (rl AND must) AS review_positive_images, count(*) FILTER (rl AND must AND NOT clean) AS rh, count(*) FILTER (ck OR sk) AS parcel_condition_labelled_images, count(*) FILTER ((ck OR sk) AND pk) AS ph,
  count(*) FILTER (clean) AS clean_records, count(*) FILTER (failed) AS fr, {_WANT} AS want, {_GOT} AS got, median(processing_duration_ms)::DOUBLE AS median_processing_ms, quantile_cont(processing_duration_ms::DOUBLE, 0.95) AS p95_processing_ms FROM m)
SELECT labelled_images, awb_labelled_images, awb_extracted_images, awb_exact_matches, round(awb_exact_matches / nullif(awb_extracted_images, 0), 6) AS awb_exact_match_precision, round(awb_exact_matches / nullif(awb_labelled_images, 0), 6) AS awb_exact_match_recall,
  clean_awb_records, round(cr / nullif(clean_awb_records, 0), 6) AS clean_awb_precision, false_clean_awb_count, clean_missing_awb_count, review_labelled_images, review_positive_images, round(rh / nullif(review_positive_images, 0), 6) AS review_recall, review_positive_images - rh AS review_false_negatives,
  parcel_condition_labelled_images, round(ph / nullif(parcel_condition_labelled_images, 0), 6) AS parcel_condition_accuracy, round(got / nullif(want, 0), 6) AS overall_field_coverage, clean_records, round(awb_exact_matches / nullif(awb_labelled_images, 0), 6) AS awb_extraction_recall,
  coalesce(round((labelled_images - clean_records) / nullif(labelled_images, 0), 6), 0) AS review_rate, coalesce(round(fr / nullif(labelled_images, 0), 6), 0) AS failed_rate, false_clean_awb_count AS wrong_clean_awbs, median_processing_ms, p95_processing_ms FROM s""")
def eval_metrics_full(spark, d):
    """Every scalar of the evaluation, in one aggregation."""
    return E.all_metrics(E.marked(_full(spark, d)), FIELDS)


_FIELD_ROWS = " UNION ALL ".join(f"SELECT '{k}' AS field, {_HAS.format(a)} AS want, {_HAS.format(b)} AS got FROM j" for k, (a, b) in FIELDS.items())


@query(f"WITH {FULL}, f AS ({_FIELD_ROWS}), r AS (SELECT field, count(*) FILTER (want) AS labelled, count(*) FILTER (want AND got) AS extracted FROM f GROUP BY ROLLUP (field)) SELECT coalesce(field, 'overall') AS field, labelled, extracted, round(extracted / nullif(labelled, 0), 6) AS coverage FROM r")
def eval_field_coverage_full(spark, d):
    return E.coverage(_full(spark, d), FIELDS)


_PAIR_ROWS = " UNION ALL ".join(f"SELECT '{b}' AS pair, {a}::VARCHAR AS expected, coalesce({b}::VARCHAR, 'MISSING') AS predicted FROM j WHERE {_HAS.format(a)}" for b, a in PAIRS.items())
FULL_CONFUSION = f"{FULL}, c AS (SELECT pair, expected, predicted, count(*) AS n FROM ({_PAIR_ROWS}) GROUP BY 1, 2, 3)"


def _confusion(spark, d) -> DataFrame:
    return E.confusion(_full(spark, d), {b: (a, b) for b, a in PAIRS.items()})


@query(f"WITH {FULL_CONFUSION} SELECT * FROM c")
def eval_confusion_full(spark, d):
    return _confusion(spark, d)


@query(f"""WITH {FULL_CONFUSION}, u AS (SELECT pair, upper(trim(expected)) AS e, upper(trim(predicted)) AS p, n FROM c), l AS (SELECT pair, e AS label FROM u UNION SELECT pair, p FROM u),
f AS (SELECT l.pair, l.label, coalesce(sum(n) FILTER (e = label AND p = label), 0) AS tp, coalesce(sum(n) FILTER (e = label), 0) AS want, coalesce(sum(n) FILTER (p = label), 0) AS got FROM l JOIN u USING (pair) GROUP BY 1, 2)
SELECT pair, round(avg(CASE WHEN want + got > 0 THEN 2.0 * tp / (want + got) ELSE 0 END), 6) AS macro_f1 FROM f GROUP BY 1""")
def eval_macro_f1_full(spark, d):
    return E.macro_f1(_confusion(spark, d))


@query(f"WITH {FULL_MARKS} SELECT * EXCLUDE (clean, has, found, rt, failed, rl, must, ck, sk, pk) FROM m WHERE (clean AND found AND NOT rt) OR failed")
def eval_failures_full(spark, d):
    """All columns of the joined rows that are wrong though clean, or failed."""
    joined = _full(spark, d)
    c = F.col
    return E.marked(joined).where((c("clean") & c("found") & ~c("right")) | c("failed")).select(*joined.columns)


# --- reports, all columns --------------------------------------------------------------------------

_LISTS = ["status_flags", "review_reasons", "barcode_values", "ocr_engines_used", "warnings"]
_TEXTS = ["weight_unit", "recorded_volume_unit", "location", "capture_timestamp", "capture_timestamp_raw", "detector_version", "vision_error_category", "vision_request_id", "error_code", "error_message", "awb_number"]


def _g(x: str) -> str:
    """Shortest form of a number, for values of few digits."""
    return f"(CASE WHEN {x} = floor({x}) THEN {x}::BIGINT::VARCHAR ELSE {x}::VARCHAR END)"


def _records(spark, d) -> DataFrame:
    split = {c: F.filter(F.split(F.col(c), ";"), lambda x: x != "") for c in _LISTS}
    return view(spark, d, "v_records").withColumns(split)


_SIZE = f"{_g('length_cm')} || ' x ' || {_g('width_cm')} || ' x ' || {_g('height_cm')} || ' cm'"
_EXCEL = "coalesce(CASE WHEN regexp_full_match(awb_number, '[A-Z0-9-]{1,40}') THEN '=\"' || awb_number || '\"' END, '')"


@query(f"""SELECT * REPLACE ({', '.join(f"coalesce({c}, '') AS {c}" for c in _TEXTS)}), {_EXCEL} AS awb_number_excel, coalesce({_g('weight_value')} || ' ' || weight_unit, '') AS weight_original, coalesce({_SIZE}, '') AS dimensions_text FROM v_records""")
def detailed_report_full(spark, d):
    """All 59 columns of the detailed report."""
    return report.detailed(_records(spark, d))


_REASON_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.REASON_TEXT.items())
_FLAG_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.FLAG_TEXT.items())


@query(f"""SELECT filename AS "File", coalesce(awb_number, 'Not found') AS "Tracking number", coalesce({_g('weight_value')} || ' ' || weight_unit, {_g('weight_grams')} || ' g', 'Not found') AS "Weight",
 coalesce(length_cm::VARCHAR, '') AS "Length (cm)", coalesce(width_cm::VARCHAR, '') AS "Width (cm)", coalesce(height_cm::VARCHAR, '') AS "Height (cm)", coalesce(location, 'Not found') AS "Location",
 CASE WHEN primary_status LIKE 'SUCCESS%' AND NOT requires_review THEN '{report.GOOD}' WHEN primary_status = 'REJECTED' THEN '{report.BAD}' WHEN primary_status = 'PROCESSING_ERROR' THEN '{report.BROKEN}' ELSE '{report.CHECK}' END AS "Result", requires_review AS "Needs review",
 array_to_string(list_transform(list_filter(string_split(CASE WHEN review_reasons <> '' THEN review_reasons ELSE status_flags END, ';'), lambda x: x <> ''), lambda x: CASE WHEN review_reasons <> '' THEN CASE x {_REASON_CASE} END ELSE CASE x {_FLAG_CASE} END END), '; ') AS "Notes" FROM v_records""")
def simple_report_full(spark, d):
    """All ten columns of the simple report."""
    return report.simple(_records(spark, d).withColumnRenamed("status_flags", "flags"))


@query("""SELECT path AS filename, sha256(content) AS sha256, left(sha256(content), 12) AS group_id, CASE WHEN k < 70 THEN 'train' WHEN k < 85 THEN 'val' ELSE 'test' END AS split, '' AS expected_awb, '' AS expected_weight_grams, '' AS expected_length_cm, '' AS expected_width_cm, '' AS expected_height_cm,
 '' AS expected_parcel_count, '' AS expected_parcel_visibility, '' AS expected_label_status, '' AS expected_review, 'false' AS annotated FROM (SELECT *, ('0x' || substr(sha256(left(sha256(content), 12)), 1, 8))::BIGINT % 100 AS k FROM v_files)""")
def truth_template_full(spark, d):
    """The labelling template, all 14 columns; groups by content here (by look in ``leader_groups``)."""
    f = view(spark, d, "v_files").select(F.col("path").alias("filename"), F.sha2("content", 256).alias("sha256"))
    return report.template(f.withColumn("group_id", F.left("sha256", F.lit(12))))


@query("SELECT CASE WHEN k < 70 THEN 'train' WHEN k < 85 THEN 'val' ELSE 'test' END AS split, count(*) AS n FROM (SELECT ('0x' || substr(sha256(left(sha256(content), 12)), 1, 8))::BIGINT % 100 AS k FROM v_files) GROUP BY 1")
def split_sizes(spark, d):
    return truth_template_full(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


# --- evidence of four sources, eight fields --------------------------------------------------------

SOURCES = {"v_overlay": "OVERLAY_OCR", "v_label": "LABEL_OCR", "v_scanned": "BARCODE", "v_seen": "VISION_FALLBACK"}
RECONCILED = ["awb_number", "weight", "length_cm", "width_cm", "height_cm", "recorded_volume", "location", "capture_timestamp"]
_UNION = " UNION ALL ".join(f"SELECT {k} AS part, '{s}' AS source, * FROM {v}" for k, (v, s) in enumerate(SOURCES.items()))
APPENDED = f"a AS (SELECT image_id, field_name, normalised_value, source, confidence, row_number() OVER (PARTITION BY image_id ORDER BY part, pos, field_name, normalised_value NULLS FIRST, confidence) AS pos FROM ({_UNION}))"
FIELD_GROUPS = (
    APPENDED
    + """,
k AS (SELECT image_id, field_name, upper(trim(normalised_value)) AS key, source, confidence, pos, normalised_value, CASE source WHEN 'BARCODE' THEN 4 WHEN 'OVERLAY_OCR' THEN 3 WHEN 'LABEL_OCR' THEN 2 WHEN 'VISION_FALLBACK' THEN 1 ELSE 0 END AS pr FROM a WHERE coalesce(normalised_value, '') <> ''),
g AS (SELECT image_id, field_name, key, count(DISTINCT source) AS n_src, max(confidence) AS top, count(*) AS n, min(pos) AS fp FROM k GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id, field_name ORDER BY n_src DESC, top DESC, n DESC, fp) AS rk FROM g),
c AS (SELECT image_id, field_name, coalesce(bool_or(rk > 1 AND top >= 0.72), false) AS conflict FROM r GROUP BY 1, 2),
rep AS (SELECT k.image_id, k.field_name, k.normalised_value AS value, k.source, row_number() OVER (PARTITION BY k.image_id, k.field_name ORDER BY pr DESC, confidence DESC, pos) AS rn FROM k JOIN r ON k.image_id = r.image_id AND k.field_name = r.field_name AND k.key = r.key AND r.rk = 1),
rec AS (SELECT r.image_id, r.field_name, rep.value, rep.source, c.conflict, round(greatest(0.0, least(0.99, r.top + CASE WHEN n_src >= 2 THEN 0.10 ELSE 0.0 END + CASE WHEN n >= 2 THEN 0.05 ELSE 0.0 END - CASE WHEN c.conflict THEN 0.18 ELSE 0.0 END))::DOUBLE, 4) AS confidence
  FROM r JOIN c ON c.image_id = r.image_id AND c.field_name = r.field_name JOIN rep ON rep.image_id = r.image_id AND rep.field_name = r.field_name AND rep.rn = 1 WHERE r.rk = 1)"""
)


def _evidence(spark, d) -> DataFrame:
    return R.appended([view(spark, d, v).withColumn("source", F.lit(s)) for v, s in SOURCES.items()])


def _fields(spark, d) -> DataFrame:
    return R.reconcile(_evidence(spark, d))


@query(f"WITH {APPENDED} SELECT * FROM a")
def evidence_union(spark, d):
    """Candidates of all sources end to end, in the order in which they are asked."""
    return _evidence(spark, d).select("image_id", "field_name", "normalised_value", "source", "confidence", F.col("pos").cast("long").alias("pos"))


@query(f"WITH {FIELD_GROUPS} SELECT image_id, field_name, value, source, confidence, conflict FROM rec")
def reconcile_fields(spark, d):
    return _fields(spark, d).select("image_id", "field_name", "value", "source", "confidence", "conflict")


_WIDE = ", ".join(f"max(value) FILTER (field_name = '{f}') AS {f}, coalesce(max(source) FILTER (field_name = '{f}'), 'NOT_EXTRACTED') AS {f}_source, coalesce(max(confidence) FILTER (field_name = '{f}'), 0.0) AS {f}_confidence" for f in RECONCILED)


@query(f"WITH {FIELD_GROUPS} SELECT image_id, {_WIDE} FROM rec GROUP BY 1")
def record_fields(spark, d):
    """The eight reconciled fields of a record, each with source and confidence."""
    return R.wide(_fields(spark, d), RECONCILED)


DIMENSIONS = ["length_cm", "width_cm", "height_cm"]
_DIMS = "field_name IN ('length_cm', 'width_cm', 'height_cm')"


@query(f"""WITH {FIELD_GROUPS}, s AS (SELECT image_id, source, count(*) AS n, min(confidence) AS low, CASE source WHEN 'BARCODE' THEN 4 WHEN 'OVERLAY_OCR' THEN 3 WHEN 'LABEL_OCR' THEN 2 ELSE 1 END AS pr FROM rec WHERE {_DIMS} GROUP BY 1, 2),
t AS (SELECT image_id, max(value) FILTER (field_name = 'length_cm') AS l, max(value) FILTER (field_name = 'width_cm') AS w, max(value) FILTER (field_name = 'height_cm') AS h FROM rec GROUP BY 1)
SELECT s.image_id, round(min(low), 4) AS dimensions_confidence, arg_max(source, n * 10 + pr) AS dimensions_source, any_value(CASE WHEN l IS NOT NULL AND w IS NOT NULL AND h IS NOT NULL THEN l || ' x ' || w || ' x ' || h || ' cm' END) AS dimensions_text FROM s JOIN t USING (image_id) GROUP BY 1""")
def dimension_text(spark, d):
    """Least confidence, most frequent source and, where all three are known, the text."""
    f = _fields(spark, d)
    three = F.concat(*(x for k, f_ in enumerate(DIMENSIONS) for x in ([F.lit(" x ")] if k else []) + [T.short_number(F.col(f_).cast("double"))]), F.lit(" cm"))
    texts = R.wide(f.where(F.col("field_name").isin(DIMENSIONS)), DIMENSIONS).select("image_id", three.alias("dimensions_text"))
    return R.dimension_summary(f.where(F.col("field_name").isin(DIMENSIONS))).drop("complete").join(texts, "image_id")


@query(f"""WITH {FIELD_GROUPS}, w AS (SELECT image_id, max(confidence) FILTER (field_name = 'awb_number' AND confidence >= 0.75) AS a, max(confidence) FILTER (field_name = 'weight') AS b, min(confidence) FILTER ({_DIMS}) AS dc, bool_or(field_name = 'length_cm') AS has_l, max(confidence) FILTER (field_name = 'location') AS l, max(confidence) FILTER (field_name = 'capture_timestamp') AS t FROM rec GROUP BY 1)
SELECT image_id, round(coalesce(list_avg(list_filter([coalesce(a, 0), coalesce(b, 0), CASE WHEN has_l THEN dc ELSE 0 END, coalesce(l, 0), coalesce(t, 0)], lambda x: x > 0)), 0.0), 4) AS overall FROM w""")
def overall_confidence_full(spark, d):
    """Mean of the positive ones of five confidences, each only where its field is there."""
    c = F.col
    w = R.wide(_fields(spark, d), RECONCILED)
    dims = F.array_min(F.filter(F.array(*(F.when(c(f).isNotNull(), c(f"{f}_confidence")) for f in DIMENSIONS)), lambda x: x.isNotNull()))
    parts = {"p_awb": F.when(c("awb_number_confidence") >= C.PROMOTE, c("awb_number_confidence")), "p_weight": c("weight_confidence"), "p_dims": F.when(c("length_cm").isNotNull(), dims), "p_place": c("location_confidence"), "p_time": c("capture_timestamp_confidence")}
    return w.withColumns({k: F.coalesce(v, F.lit(0.0)) for k, v in parts.items()}).select("image_id", R.overall_confidence(*parts).alias("overall"))


# --- carrier rules ---------------------------------------------------------------------------------

RULES_JSON = '{"rules": [{"name": "numeric_14", "pattern": "^[0-9]{14}$", "context_terms": ["awb", "waybill"]}, {"name": "generic", "pattern": "^[A-Z0-9]{8,30}$", "context_terms": ["AWB", "shipment"]}, {"name": "north", "pattern": "[A-Z]{2}[0-9]+", "prefixes": ["nh", "ab"]}, {"name": "even", "pattern": "[0-9]+", "prefixes": ["00", "77"]}]}'
RULE_ROWS = """v AS (SELECT image_id, pos, source, confidence, image_id % 5 = 0 AS agrees, CASE pos % 4 WHEN 0 THEN '' WHEN 1 THEN 'Explicit AWB anchor' WHEN 2 THEN 'Shipment no' ELSE NULL END AS ctx, CASE image_id % 3 WHEN 0 THEN 'ab' || normalised_value WHEN 1 THEN normalised_value ELSE 'x-' || normalised_value END AS raw FROM v_candidates WHERE normalised_value IS NOT NULL)"""


@query(f"""WITH {RULE_ROWS}, m AS (SELECT *, concat_ws(';', CASE WHEN regexp_full_match(upper(raw), '[0-9]{{14}}') AND (coalesce(ctx, '') = '' OR contains(lower(ctx), 'awb') OR contains(lower(ctx), 'waybill')) THEN 'numeric_14' END, CASE WHEN regexp_full_match(upper(raw), '[A-Z0-9]{{8,30}}') AND (coalesce(ctx, '') = '' OR contains(lower(ctx), 'awb') OR contains(lower(ctx), 'shipment')) THEN 'generic' END,
 CASE WHEN (starts_with(upper(raw), 'NH') OR starts_with(upper(raw), 'AB')) AND regexp_full_match(upper(raw), '[A-Z]{{2}}[0-9]+') THEN 'north' END, CASE WHEN (starts_with(raw, '00') OR starts_with(raw, '77')) AND regexp_full_match(raw, '[0-9]+') THEN 'even' END) AS rules FROM v)
SELECT image_id, pos, rules, CASE WHEN source = 'BARCODE' AND rules = '' AND NOT agrees THEN least(confidence, 0.69) ELSE confidence END AS confidence, CASE WHEN source = 'BARCODE' AND rules = '' AND NOT agrees THEN '{V.UNMATCHED}' END AS warning FROM m""")
def carrier_rules(spark, d):
    """Rules of a rule file, with prefixes, on upper-cased values; the penalty spares what text bears out."""
    c = F.col
    ctx = F.when(c("pos") % 4 == 0, "").when(c("pos") % 4 == 1, "Explicit AWB anchor").when(c("pos") % 4 == 2, "Shipment no")
    raw = F.when(c("image_id") % 3 == 0, F.concat(F.lit("ab"), "normalised_value")).when(c("image_id") % 3 == 1, c("normalised_value")).otherwise(F.concat(F.lit("x-"), "normalised_value"))
    v = view(spark, d, "v_candidates").where("normalised_value is not null").withColumn("rules", V.matching_rules(raw, ctx, V.parsed_rules(RULES_JSON)))
    confidence, warning = V.rule_penalty(c("source"), c("rules"), c("image_id") % 5 == 0, c("confidence"))
    return v.select("image_id", "pos", F.array_join("rules", ";").alias("rules"), confidence.alias("confidence"), warning.alias("warning"))


# --- boxes -----------------------------------------------------------------------------------------

_RELATED = """((greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) / greatest(1, least(a.h, b.h)) >= 0.28 AND greatest(0, greatest(a.x, b.x) - least(a.x + a.w, b.x + b.w)) <= 4.5)
 OR (greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) / greatest(1, least(a.w, b.w)) >= 0.28 AND greatest(0, greatest(a.y, b.y) - least(a.y + a.h, b.y + b.h)) <= 4.5))"""
_ALL_PAIRS = ", ".join(f"struct_pack(i := {i}, j := {j})" for i in range(1, 7) for j in range(i + 1, 7))


_PAIR = _RELATED.replace("a.", "bs[p.i].").replace("b.", "bs[p.j].")
_HULL = "struct_pack(x := least(bs[f.i].x, bs[f.j].x), y := least(bs[f.i].y, bs[f.j].y), w := greatest(bs[f.i].x + bs[f.i].w, bs[f.j].x + bs[f.j].w) - least(bs[f.i].x, bs[f.j].x), h := greatest(bs[f.i].y + bs[f.i].h, bs[f.j].y + bs[f.j].h) - least(bs[f.i].y, bs[f.j].y))"
MERGE = f"""boxed AS (SELECT image_id, box_id, x, y, w, h // 2 + 8 AS h FROM v_boxes),
top AS (SELECT image_id, list(struct_pack(x := x, y := y, w := w, h := h) ORDER BY rk) AS bs FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY w * h DESC, box_id) AS rk FROM boxed WHERE w * h / 10000.0 >= 0.055) WHERE rk <= 6 GROUP BY 1),
mg AS (SELECT image_id, 0 AS k, bs FROM top UNION ALL SELECT image_id, k + 1, list_transform(list_filter(range(1, len(bs) + 1), lambda t: t <> f.j), lambda t: CASE WHEN t = f.i THEN {_HULL} ELSE bs[t] END)
  FROM (SELECT *, list_filter([{_ALL_PAIRS}], lambda p: p.j <= len(bs) AND {_PAIR})[1] AS f FROM mg) WHERE f IS NOT NULL),
fin AS (SELECT image_id, arg_max(bs, k) AS bs FROM mg GROUP BY 1),
mb AS (SELECT image_id, (row_number() OVER (PARTITION BY image_id ORDER BY b.w * b.h DESC, i) - 1)::INT AS rank, b.x AS x, b.y AS y, b.w AS w, b.h AS h, b.w * b.h / 10000.0 AS area FROM (SELECT image_id, unnest(bs) AS b, generate_subscripts(bs, 1) AS i FROM fin))"""


def _flattened(spark, d) -> DataFrame:
    return view(spark, d, "v_boxes").select("image_id", "box_id", "x", "y", "w", (F.floor(F.col("h") / 2) + 8).cast("int").alias("h"))


@query(f"WITH RECURSIVE {MERGE} SELECT image_id, rank, x, y, w, h, round(area::DOUBLE, 6) AS area FROM mb WHERE rank < 4")
def parcel_box_merge(spark, d):
    """Top six above the gate, merged to a fix-point, then the top four."""
    return V.merged_boxes(_flattened(spark, d), 100, 100).withColumn("area", F.round("area", 6))


@query(f"""WITH RECURSIVE {MERGE}, p AS (SELECT o_orderkey AS image_id, CASE WHEN o_custkey % 3 = 0 THEN 0.01 ELSE 0.2 END AS occupancy, o_custkey % 2 = 0 AS evidence FROM orders),
a AS (SELECT p.image_id, m1.area AS ra, m2.area AS rb, m1.x <= 3 OR m1.y <= 3 OR m1.x + m1.w >= 97 OR m1.y + m1.h >= 97 AS touches, occupancy < 0.015 AND NOT evidence AS empty FROM p LEFT JOIN mb m1 ON m1.image_id = p.image_id AND m1.rank = 0 LEFT JOIN mb m2 ON m2.image_id = p.image_id AND m2.rank = 1),
b AS (SELECT *, coalesce(rb >= greatest(0.07, ra * 0.38), false) AS two FROM a)
SELECT image_id, CASE WHEN ra IS NULL THEN CASE WHEN empty THEN 0 END WHEN two THEN 2 ELSE 1 END AS parcel_count, CASE WHEN ra IS NULL THEN CASE WHEN empty THEN 0.88 ELSE 0.28 END ELSE round(CASE WHEN two THEN least(0.78, 0.92, 0.55 + least(ra, 0.35)) ELSE least(0.92, 0.55 + least(ra, 0.35)) END::DOUBLE, 3) END::DOUBLE AS confidence,
 CASE WHEN ra IS NULL THEN CASE WHEN empty THEN 'NONE' ELSE 'UNCERTAIN' END WHEN touches THEN 'PARTIAL' ELSE 'FULL' END AS visibility FROM b""")
def parcel_detection(spark, d):
    """Count, confidence and visibility from merged boxes; nothing in an empty picture."""
    images = table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"), F.when(F.col("o_custkey") % 3 == 0, 0.01).otherwise(0.2).alias("occupancy"), (F.col("o_custkey") % 2 == 0).alias("evidence"))
    return V.parcels(V.merged_boxes(_flattened(spark, d), 100, 100), images, 100, 100)


DETECTED = "db AS (SELECT image_id, box_id, x, y, w, h, score, CASE WHEN class_name = 'hand_occlusion' THEN 'hand_or_obstruction' WHEN class_name = 'parcel_full' AND x <= 4 THEN 'parcel_partial' WHEN class_name = 'label_region' THEN CASE WHEN box_id % 5 = 0 THEN 'shipping_label_blocked' ELSE 'shipping_label_visible' END ELSE class_name END AS class_name FROM v_boxes)"


@query(f"""WITH {DETECTED}, cv AS (SELECT DISTINCT a.image_id FROM db a JOIN db b ON a.image_id = b.image_id AND a.class_name LIKE 'shipping_label_%' AND b.class_name = 'hand_or_obstruction' AND {IOU} > 0.08)
SELECT db.image_id, round(max(score), 4) AS confidence, nullif(count(*) FILTER (class_name LIKE 'parcel_%'), 0) AS parcel_count, CASE WHEN NOT bool_or(class_name LIKE 'parcel_%') THEN 'UNCERTAIN' WHEN bool_or(class_name = 'parcel_partial') THEN 'PARTIAL' ELSE 'FULL' END AS parcel_visibility,
 CASE WHEN bool_or(class_name = 'shipping_label_blocked') OR bool_or(cv.image_id IS NOT NULL) THEN 'LABEL_BLOCKED_OR_OCCLUDED' WHEN bool_or(class_name LIKE 'shipping_label_%') THEN 'LABEL_VISIBLE_LOW_CONFIDENCE' ELSE 'LABEL_STATUS_UNCERTAIN' END AS label_status FROM db LEFT JOIN cv USING (image_id) GROUP BY 1""")
def detector_evidence(spark, d):
    c = F.col
    name = F.when(c("class_name") == "hand_occlusion", "hand_or_obstruction").when((c("class_name") == "parcel_full") & (c("x") <= 4), "parcel_partial").when(c("class_name") == "label_region", F.when(c("box_id") % 5 == 0, "shipping_label_blocked").otherwise("shipping_label_visible")).otherwise(c("class_name"))
    return V.detector_evidence(view(spark, d, "v_boxes").withColumn("class_name", name))


NMS = f"""o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, box_id) AS rk FROM v_boxes),
f AS (SELECT image_id, rk, [struct_pack(box_id := box_id, x := x, y := y, w := w, h := h, score := score)] AS kept FROM o WHERE rk = 1
UNION ALL SELECT f.image_id, b.rk, CASE WHEN len(list_filter(f.kept, lambda a: {IOU} >= 0.55)) > 0 THEN f.kept ELSE list_append(f.kept, struct_pack(box_id := b.box_id, x := b.x, y := b.y, w := b.w, h := b.h, score := b.score)) END FROM f JOIN o b ON b.image_id = f.image_id AND b.rk = f.rk + 1),
n5 AS (SELECT image_id, unnest(kept[1:5]) AS k, generate_subscripts(kept[1:5], 1) AS rank FROM (SELECT image_id, arg_max(kept, rk) AS kept FROM f GROUP BY 1))"""


def _five(spark, d) -> DataFrame:
    return perception.short_list(V.nms(view(spark, d, "v_boxes")).withColumn("by_detector", F.lit(False)))


@query(f"WITH RECURSIVE {NMS} SELECT image_id, (rank - 1)::INT AS rank, k.box_id AS box_id FROM n5")
def label_candidates_top5(spark, d):
    """The five best label candidates that greedy suppression leaves."""
    return _five(spark, d)


@query(f"WITH RECURSIVE {NMS} SELECT image_id, (rank - 1)::INT AS rank, k.box_id AS box_id FROM n5 WHERE rank <= 1")
def recognised_candidates(spark, d):
    """Of those, the ones that text recognition reads (one by default)."""
    return perception.to_recognise(_five(spark, d))


@query("""SELECT image_id, blur, contrast, under_pct, over_pct, coalesce(blur < 60, false) OR coalesce(contrast < 18, false) OR coalesce(under_pct > 82, false) OR coalesce(over_pct > 35, false) AS low_quality FROM
(SELECT o_orderkey AS image_id, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_orderkey * 7 % 400)::DOUBLE END AS blur, (o_custkey % 90)::DOUBLE AS contrast, (o_orderkey * 3 % 101)::DOUBLE AS under_pct, CASE WHEN o_custkey % 13 = 0 THEN NULL ELSE (o_custkey * 3 % 101)::DOUBLE END AS over_pct FROM orders)""")
def low_quality(spark, d):
    """The four measures of every image; a measure that is not known condemns nothing."""
    c = F.col
    m = table(spark, d, "orders").select(
        c("o_orderkey").alias("image_id"), F.when(c("o_orderkey") % 11 != 0, (c("o_orderkey") * 7 % 400).cast("double")).alias("blur"), (c("o_custkey") % 90).cast("double").alias("contrast"), (c("o_orderkey") * 3 % 101).cast("double").alias("under_pct"),
        F.when(c("o_custkey") % 13 != 0, (c("o_custkey") * 3 % 101).cast("double")).alias("over_pct"),
    )
    return m.withColumn("low_quality", perception.low_quality())


# --- recognition schedules -------------------------------------------------------------------------


@query("""WITH p AS (SELECT l_orderkey AS image_id, l_linenumber AS pass_no, max(60 + l_partkey % 40) / 100 AS awb_confidence, max((l_orderkey % 3 = 0)::INT) = 1 AS overlay_awb FROM lineitem GROUP BY 1, 2), s AS (SELECT image_id, min(pass_no) FILTER (awb_confidence >= 0.86) AS stop FROM p GROUP BY 1)
SELECT p.image_id, pass_no, awb_confidence FROM p JOIN s USING (image_id) WHERE (stop IS NULL OR pass_no <= stop) AND pass_no <= CASE WHEN overlay_awb THEN 2 ELSE 6 END""")
def label_pass_limit(spark, d):
    """Six passes at most, two where the overlay gave an identifier, none after a strong one."""
    p = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("pass_no")).agg((F.max(60 + F.col("l_partkey") % 40) / 100).alias("awb_confidence"))
    return perception.limited(perception.until_strong(p), F.col("image_id") % 3 == 0)


@query("SELECT event_id, least(4.0, 0.5 * pow(2, event_id % 6))::DOUBLE AS seconds FROM events")
def retry_backoff(spark, d):
    return table(spark, d, "events").select("event_id", errors.backoff(F.col("event_id") % 6 + 1).alias("seconds"))


LABELLED = "c6 AS (SELECT l_orderkey AS image_id, 'awb_number' AS field_name, lpad(CAST(l_partkey % 5 AS VARCHAR), 8, '1') AS normalised_value, CASE WHEN l_suppkey % 2 = 0 THEN 'tesseract' ELSE 'rapid' END AS ocr_engine, 'v' || l_linenumber % 2 AS variant, (l_quantity::INT % 2) * 90 AS rotation, 6 AS psm, l_linenumber * 1000000 + l_partkey AS pos FROM lineitem)"


@query(f"WITH {LABELLED} SELECT image_id, field_name, normalised_value, ocr_engine, variant, rotation, psm, min(pos)::BIGINT AS pos FROM c6 GROUP BY ALL")
def label_evidence_dedup(spark, d):
    """Label candidates with their provenance; of the same value from the same engine, variant, rotation and page mode the first."""
    c = F.col
    k = table(spark, d, "lineitem").select(
        c("l_orderkey").alias("image_id"), F.lit("awb_number").alias("field_name"), F.lpad((c("l_partkey") % 5).cast("string"), 8, "1").alias("normalised_value"), F.when(c("l_suppkey") % 2 == 0, "tesseract").otherwise("rapid").alias("ocr_engine"),
        F.concat(F.lit("v"), (c("l_linenumber") % 2).cast("string")).alias("variant"), (c("l_quantity").cast("int") % 2 * 90).alias("rotation"), F.lit(6).alias("psm"), (c("l_linenumber") * 1000000 + c("l_partkey")).cast("long").alias("pos"),
    )
    return perception.first_emissions(k)


# --- ordered folds ---------------------------------------------------------------------------------

@query(f"""WITH RECURSIVE {COPIED}, o AS (SELECT vec_id % 10 AS set_id, vec_id AS pos, bits, row_number() OVER (PARTITION BY vec_id % 10 ORDER BY vec_id) AS rk FROM hc),
f AS (SELECT set_id, rk, pos, pos AS leader, [struct_pack(pos := pos, bits := bits)] AS lead FROM o WHERE rk = 1
UNION ALL SELECT f.set_id, o.rk, o.pos, coalesce(list_filter(f.lead, lambda k: bit_count(xor(k.bits, o.bits)) <= 6)[1].pos, o.pos), CASE WHEN len(list_filter(f.lead, lambda k: bit_count(xor(k.bits, o.bits)) <= 6)) > 0 THEN f.lead ELSE list_append(f.lead, struct_pack(pos := o.pos, bits := o.bits)) END FROM f JOIN o ON o.set_id = f.set_id AND o.rk = f.rk + 1)
SELECT set_id, pos, leader FROM f""")
def leader_groups_of_copies(spark, d):
    """Leader clustering where re-encoded copies join their originals."""
    return H.leaders(with_copies(spark, d).select((F.col("vec_id") % 10).alias("set_id"), F.col("vec_id").alias("pos"), "bits"))


# --- jobs ------------------------------------------------------------------------------------------

CLONES = "fc AS (SELECT file_id, path, sha256(content) AS sha FROM v_files), fo AS (SELECT sha, min(file_id) AS original FROM fc GROUP BY 1)"


@query(f"""WITH {CLONES} SELECT md5(CASE WHEN c.file_id = original THEN 'image|' || c.sha ELSE 'copy|' || c.file_id END) AS image_id, c.path AS filename, c.sha, CASE WHEN c.file_id > original THEN md5('image|' || c.sha) END AS duplicate_of_image_id,
 CASE WHEN c.file_id > original THEN 'DUPLICATE_IMAGE;LOW_IMAGE_QUALITY' ELSE 'LOW_IMAGE_QUALITY' END AS flags, CASE WHEN c.file_id > original THEN 'Duplicate content reused from ' || o.path ELSE '' END AS warnings FROM fc c JOIN fo USING (sha) JOIN fc o ON o.file_id = original""")
def duplicate_results(spark, d):
    """A result for every input: copies are clones of their original's with a new id, flag and warning."""
    f = view(spark, d, "v_files").select("file_id", "path", F.sha2("content", 256).alias("sha"))
    made = J.canonical(f, "sha", "file_id").select("sha", F.md5(F.concat(F.lit("image|"), "sha")).alias("image_id"), F.array(F.lit("LOW_IMAGE_QUALITY")).alias("flags"), F.array().cast("array<string>").alias("warnings"))
    out = J.with_clones(f, made, "sha", "file_id", "path", F.md5(F.concat(F.lit("copy|"), F.col("file_id").cast("string"))))
    return out.select("image_id", F.col("path").alias("filename"), "sha", "duplicate_of_image_id", F.array_join(F.sort_array("flags"), ";").alias("flags"), F.array_join("warnings", ";").alias("warnings"))


@query("""WITH up AS (SELECT path, regexp_extract(path, '([^/]*)$', 1) AS name, sha256(content) AS sha FROM v_files), rec AS (SELECT path, 'known ' || min(file_id) AS original_filename, CASE WHEN min(file_id) % 4 = 0 THEN '' ELSE sha256('recorded' || path) END AS sha FROM v_files WHERE file_id % 2 = 0 GROUP BY 1)
SELECT up.path, coalesce(rec.original_filename, up.name) AS original_filename, coalesce(nullif(rec.sha, ''), up.sha) AS sha256 FROM up LEFT JOIN rec USING (path)""")
def stored_inputs(spark, d):
    """Uploads with what earlier results recorded of them; the rest by file name and content."""
    f = view(spark, d, "v_files")
    up = f.select("path", F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.sha2("content", 256).alias("sha256"))
    rec = f.where("file_id % 2 = 0").groupBy("path").agg(F.min("file_id").alias("k"))
    rec = rec.select("path", F.concat(F.lit("known "), F.col("k").cast("string")).alias("original_filename"), F.when(F.col("k") % 4 == 0, "").otherwise(F.sha2(F.concat(F.lit("recorded"), "path"), 256)).alias("known_sha256"))
    return J.stored_inputs(up, rec)


@query("""SELECT job_id, seq, event_id, json_extract_string(payload, '$.status') AS status, json_extract_string(payload, '$.n')::INT AS n FROM (SELECT *, '{"status": "' || primary_status || '", "n": ' || n_warnings || '}' AS payload FROM v_jobs) WHERE job_id % 50 = 1 ORDER BY job_id, seq""")
def ordered_results(spark, d):
    """Results of chosen jobs in the order they were stored, payloads read from JSON."""
    payload = F.concat(F.lit('{"status": "'), "primary_status", F.lit('", "n": '), F.col("n_warnings").cast("string"), F.lit("}"))
    rows = view(spark, d, "v_jobs").where("job_id % 50 = 1").select("job_id", "seq", "event_id", payload.alias("payload"))
    return J.decoded(rows, "payload", "status string, n int").orderBy("job_id", "seq").select("job_id", "seq", "event_id", "status", "n")


@query("SELECT job_id, event_id, primary_status FROM v_jobs WHERE job_id = 7 AND event_id = (SELECT min(event_id) FROM v_jobs WHERE job_id = 7)")
def result_lookup(spark, d):
    """One result by job and image."""
    j = view(spark, d, "v_jobs").where("job_id = 7")
    return J.looked_up(j, job_id=7).groupBy("job_id").agg(F.min_by(F.struct("event_id", "primary_status"), "event_id").alias("r")).select("job_id", "r.event_id", "r.primary_status")


_KEY = "sha256('model|prompt|schema|' || CASE WHEN file_id % 2 = 0 THEN 'full' ELSE 'crop' END || '|' || content || '|' || (file_id % 3))"


@query(f"""WITH k AS (SELECT file_id, {_KEY} AS key FROM v_files), old AS (SELECT key, min(file_id) AS answer, 0 AS turn FROM k WHERE file_id % 3 = 0 GROUP BY 1), new AS (SELECT key, max(file_id) AS answer, 1 AS turn FROM k WHERE file_id % 5 = 0 GROUP BY 1),
c AS (SELECT key, arg_max(answer, turn) AS answer FROM (SELECT * FROM old UNION ALL SELECT * FROM new) GROUP BY 1) SELECT k.file_id, c.answer FROM k LEFT JOIN c USING (key)""")
def cache_put_get(spark, d):
    """Answers put under the whole key (model, prompt, schema, mode, bytes, crop), later ones replacing earlier, and read back."""
    mode = F.when(F.col("file_id") % 2 == 0, "full").otherwise("crop")
    k = view(spark, d, "v_files").select("file_id", J.cache_key(F.lit("model"), F.lit("prompt"), F.lit("schema"), mode, F.col("content"), (F.col("file_id") % 3).cast("string")).alias("key"))
    old = k.where("file_id % 3 = 0").groupBy("key").agg(F.min("file_id").alias("answer"))
    new = k.where("file_id % 5 = 0").groupBy("key").agg(F.max("file_id").alias("answer"))
    return k.join(J.put(old, new, "key"), "key", "left").select("file_id", "answer")


@query("""SELECT image_id, concat_ws(';', CASE WHEN overlay_fields = 0 THEN 'OVERLAY_NOT_FOUND' END, CASE WHEN overlay_fields BETWEEN 1 AND 3 THEN 'OVERLAY_PARTIAL' END, CASE WHEN vision_failed THEN 'VISION_API_UNAVAILABLE' END, CASE WHEN low THEN 'LOW_IMAGE_QUALITY' END, CASE WHEN NOT ocr THEN 'OCR_UNAVAILABLE' END, CASE WHEN NOT det THEN 'DETECTOR_UNAVAILABLE' END, CASE WHEN codes > 1 THEN 'MULTIPLE_BARCODES' END, CASE WHEN conflict THEN 'AWB_CONFLICT' END) AS flags
FROM (SELECT o_orderkey AS image_id, o_orderkey % 6 AS overlay_fields, o_orderkey % 13 = 0 AND o_orderkey % 26 <> 0 AS vision_failed, o_orderkey % 5 = 0 AS low, o_custkey % 4 > 0 AS ocr, o_custkey % 3 > 0 AS det, o_custkey % 3 AS codes, o_custkey % 11 = 0 AS conflict FROM orders)""")
def perception_flags(spark, d):
    c = F.col
    o = table(spark, d, "orders").select(
        c("o_orderkey").alias("image_id"), (c("o_orderkey") % 6).alias("overlay_fields"), ((c("o_orderkey") % 13 == 0) & (c("o_orderkey") % 26 != 0)).alias("vision_failed"), (c("o_orderkey") % 5 == 0).alias("low_quality"),
        (c("o_custkey") % 4 > 0).alias("ocr_available"), (c("o_custkey") % 3 > 0).alias("detector_available"), (c("o_custkey") % 3).alias("barcode_values"), (c("o_custkey") % 11 == 0).alias("conflict"),
    )
    order = ["OVERLAY_NOT_FOUND", "OVERLAY_PARTIAL", "VISION_API_UNAVAILABLE", "LOW_IMAGE_QUALITY", "OCR_UNAVAILABLE", "DETECTOR_UNAVAILABLE", "MULTIPLE_BARCODES", "AWB_CONFLICT"]
    wanted = F.array(*(F.lit(x) for x in order))
    return o.select("image_id", F.array_join(F.array_intersect(wanted, R.perception_flags()), ";").alias("flags"))


@query("""SELECT image_id, CASE WHEN readable > 0 THEN readable WHEN proposals > 0 THEN 1 ELSE 0 END AS label_count, CASE WHEN used AND dstatus = 'LABEL_BLOCKED_OR_OCCLUDED' THEN dstatus ELSE lstatus END AS label_status,
 coalesce(CASE WHEN used THEN dcount END, hcount, CASE WHEN vconf >= 0.75 THEN vcount END) AS parcel_count FROM (SELECT o_orderkey AS image_id, o_orderkey % 3 AS readable, o_orderkey % 2 AS proposals, o_custkey % 3 > 0 AS used, CASE WHEN o_custkey % 2 = 0 THEN 'LABEL_BLOCKED_OR_OCCLUDED' ELSE 'LABEL_VISIBLE_LOW_CONFIDENCE' END AS dstatus,
 'LABEL_VISIBLE_READABLE' AS lstatus, CASE WHEN o_custkey % 5 > 0 THEN 1 END AS dcount, CASE WHEN o_custkey % 7 > 3 THEN 2 END AS hcount, 3 AS vcount, (o_custkey % 100) / 100 AS vconf FROM orders)""")
def label_and_parcel(spark, d):
    """Label count, the detector's veto on the label's status, and whose parcel count holds."""
    c = F.col
    o = table(spark, d, "orders")
    used = c("o_custkey") % 3 > 0
    blocked = F.when(c("o_custkey") % 2 == 0, "LABEL_BLOCKED_OR_OCCLUDED").otherwise("LABEL_VISIBLE_LOW_CONFIDENCE")
    count = R.parcel_evidence(F.when(used & (c("o_custkey") % 5 > 0), 1), F.when(c("o_custkey") % 7 > 3, 2), F.lit(3), (c("o_custkey") % 100) / 100)
    return o.select(c("o_orderkey").alias("image_id"), R.label_count(c("o_orderkey") % 3, c("o_orderkey") % 2).cast("long").alias("label_count"), R.label_status(F.lit("LABEL_VISIBLE_READABLE"), used, blocked).alias("label_status"), count.alias("parcel_count"))


@query("""SELECT image_id, CASE WHEN refused OR broke THEN 'FAILED' ELSE 'COMPLETED' END AS processing_status, CASE WHEN refused THEN 'REJECTED' WHEN broke THEN 'PROCESSING_ERROR' ELSE 'SUCCESS_LABEL_VERIFIED' END AS primary_status, CASE WHEN refused THEN 'LOW_IMAGE_QUALITY;UNSUPPORTED_IMAGE' ELSE 'LOW_IMAGE_QUALITY' END AS flags, NOT refused AND broke AS requires_review
FROM (SELECT o_orderkey AS image_id, o_custkey % 9 = 0 AS refused, o_custkey % 4 = 0 AS broke FROM orders)""")
def record_errors(spark, d):
    """A refused file is rejected without review; a failure of processing is reviewed."""
    c = F.col
    o = table(spark, d, "orders").select(c("o_orderkey").alias("image_id"), F.when(c("o_custkey") % 9 == 0, "CORRUPT_IMAGE").alias("input_error"), F.when(c("o_custkey") % 4 == 0, "PROCESSING_EXCEPTION").alias("error_code"), F.lit("SUCCESS_LABEL_VERIFIED").alias("primary_status"), F.array(F.lit("LOW_IMAGE_QUALITY")).alias("flags"), F.lit(False).alias("requires_review"))
    return R.error_boundary(o).select("image_id", "processing_status", "primary_status", F.array_join("flags", ";").alias("flags"), "requires_review")


_RULE_TEXTS = """rt AS (SELECT p_partkey AS key, CASE p_partkey % 9
 WHEN 0 THEN '{"version": "2", "rules": [{"name": "' || p_brand || '", "pattern": "[A-Z]{2}' || p_size || '[0-9]+"}, {"name": "' || p_type || '", "pattern": ".*", "prefixes": ["' || p_brand || '"], "check_digit": null}]}'
 WHEN 1 THEN '{"rules": [{"name": "' || p_brand || '", "pattern": "x"}, {"name": "b' || p_size || '", "pattern": "' || p_partkey || '("}, {"name": "' || p_brand || '", "pattern": "y"}, {"name": "b' || p_size || '", "pattern": "["}]}'
 WHEN 2 THEN '{"rules": [{"name": ' || p_size || ', "pattern": "x"}]}' WHEN 3 THEN '{"rules": [{"name": "' || p_brand || '"}]}' WHEN 4 THEN '{"rules": [{"name": "' || p_brand || '", "pattern": "' || p_name
 WHEN 5 THEN '{"rules": [{"name": "' || p_brand || '", "pattern": "x", "prefixes": ["a", ' || CASE WHEN p_size % 2 = 0 THEN '"b"' ELSE '7' END || ']}]}' WHEN 6 THEN '["' || p_name || '"]'
 WHEN 7 THEN '{"rules": [], "version": ' || CASE WHEN p_size % 2 = 0 THEN '"3"' ELSE '3' END || '}' ELSE '{"other": "' || p_name || '"}' END AS text FROM part)"""
_LIST = "(json_type({0}) IS NULL OR (json_type({0}) = 'ARRAY' AND len(list_filter(json_extract({0}, '$[*]'), lambda x: json_type(x) <> 'VARCHAR')) = 0))"


@query(f"""WITH {_RULE_TEXTS}, v AS (SELECT key, CASE WHEN json_valid(text) THEN text::JSON END AS j FROM rt),
w AS (SELECT key, j, coalesce(json_type(j) = 'OBJECT' AND coalesce(json_type(j, '$.version') = 'VARCHAR', true) AND coalesce(json_type(j, '$.rules') = 'ARRAY', true), false) AS whole FROM v),
r AS (SELECT key, unnest(range(0, json_array_length(j, '$.rules')::BIGINT)) AS i, j FROM w WHERE whole AND json_type(j, '$.rules') = 'ARRAY'), e AS (SELECT key, i, json_extract(j, '$.rules[' || i || ']') AS o FROM r),
k AS (SELECT key, i, json_extract_string(o, '$.name') AS name, json_extract_string(o, '$.pattern') AS pattern, coalesce(json_type(o, '$.name') = 'VARCHAR' AND json_type(o, '$.pattern') = 'VARCHAR', false) AND {_LIST.format("json_extract(o, '$.prefixes')")} AND {_LIST.format("json_extract(o, '$.context_terms')")} AS ok FROM e),
bad AS (SELECT key FROM w WHERE NOT whole UNION SELECT key FROM k WHERE NOT ok),
t AS (SELECT key, i, CASE WHEN EXISTS (SELECT 1 FROM k p WHERE p.key = k.key AND p.name = k.name AND p.i < k.i) THEN 'Duplicate rule name: ' || name END AS a,
 'Invalid regex for ' || name || ': ' || CASE WHEN pattern = '[' THEN 'unterminated character set at position 0' WHEN pattern LIKE '%(' THEN 'missing ), unterminated subpattern at position ' || (length(pattern) - 1) END AS b FROM k WHERE key NOT IN (SELECT key FROM bad)),
s AS (SELECT key, string_agg(x, ';' ORDER BY i, o) AS errors FROM (SELECT key, i, 0 AS o, a AS x FROM t UNION ALL SELECT key, i, 1, b FROM t) WHERE x IS NOT NULL GROUP BY 1)
SELECT rt.key, CASE WHEN rt.key IN (SELECT key FROM bad) THEN 'Invalid courier rule file: ValidationError' ELSE coalesce(s.errors, '') END AS errors FROM rt LEFT JOIN s USING (key)""")
def rule_file_errors(spark, d):
    """What is wrong with rule files, one for each part: sound ones, names again, patterns that don't compile, and texts that are no rule files."""
    from ..sources import readers

    texts = table(spark, d, "part").selectExpr("p_partkey AS key", _RULE_TEXTS[_RULE_TEXTS.index("CASE p_partkey") : _RULE_TEXTS.rindex(" FROM part")])
    return readers.rule_text_errors(texts).select("key", F.array_join("errors", ";").alias("errors"))


# --- inputs of many values -------------------------------------------------------------------------

_STAMPS = """CASE o_orderkey % 4 WHEN 0 THEN lpad((1 + o_orderkey % 12)::VARCHAR, 2, '0') || '/' || lpad((1 + o_orderkey % 28)::VARCHAR, 2, '0') || '/2024 ' || lpad((1 + o_orderkey % 12)::VARCHAR, 2, '0') || ':' || lpad((o_orderkey % 60)::VARCHAR, 2, '0') || ':07 ' || CASE WHEN o_orderkey % 3 = 0 THEN 'am' ELSE 'PM' END
 WHEN 1 THEN '2023-' || lpad((1 + o_orderkey % 12)::VARCHAR, 2, '0') || '-' || lpad((1 + o_orderkey % 28)::VARCHAR, 2, '0') || '  ' || lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':' || lpad((o_orderkey % 60)::VARCHAR, 2, '0') || ':09' WHEN 2 THEN '2023-13-40 99:00:00' ELSE 'soon' END"""


@query(f"SELECT image_id, coalesce(try_strptime(upper(raw), '%m/%d/%Y %I:%M:%S %p'), try_strptime(regexp_replace(raw, '\\s+', ' ', 'g'), '%Y-%m-%d %H:%M:%S')) AS taken FROM (SELECT o_orderkey AS image_id, {_STAMPS} AS raw FROM orders)")
def parse_timestamps(spark, d):
    """Times of day, month first or ISO, with spare blanks, small letters and impossible ones."""
    k = F.col("o_orderkey")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    american = F.concat(two(1 + k % 12), F.lit("/"), two(1 + k % 28), F.lit("/2024 "), two(1 + k % 12), F.lit(":"), two(k % 60), F.lit(":07 "), F.when(k % 3 == 0, "am").otherwise("PM"))
    iso = F.concat(F.lit("2023-"), two(1 + k % 12), F.lit("-"), two(1 + k % 28), F.lit("  "), two(k % 24), F.lit(":"), two(k % 60), F.lit(":09"))
    raw = F.when(k % 4 == 0, american).when(k % 4 == 1, iso).when(k % 4 == 2, "2023-13-40 99:00:00").otherwise("soon")
    return table(spark, d, "orders").select(k.alias("image_id"), T.timestamp(raw).alias("taken"))


_CLASS, _BOX = "(l_orderkey % 7)", "(l_partkey % 21) / 16.0, (l_suppkey % 11) / 10.0, (l_quantity::INT % 9) / 10.0, (l_linenumber % 4) / 100.0"


@query(f"""WITH b AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n, {_CLASS} AS c, [{_BOX}] AS v, l_partkey, l_suppkey, l_quantity FROM lineitem)
SELECT k, n, v[1] AS x, v[2] AS y, v[3] AS w, v[4] AS h, 'invalid_class:' || c AS error FROM b WHERE c NOT BETWEEN 0 AND 4 UNION SELECT k, n, v[1], v[2], v[3], v[4], 'out_of_range' FROM b WHERE v[1] > 1 OR v[2] > 1 OR v[3] > 1 OR v[4] > 1 UNION SELECT k, n, v[1], v[2], v[3], v[4], 'tiny_box' FROM b WHERE v[3] * 640 < 4 OR v[4] * 480 < 4""")
def annotation_boxes(spark, d):
    """Errors of annotation lines whose class and box come from the rows."""
    c = F.col
    box = [(c("l_partkey") % 21) / 16.0, (c("l_suppkey") % 11) / 10.0, (c("l_quantity").cast("int") % 9) / 10.0, (c("l_linenumber") % 4) / 100.0]
    b = table(spark, d, "lineitem").select(c("l_orderkey").alias("k"), c("l_linenumber").alias("n"), (c("l_orderkey") % 7).alias("cls"), *(v.cast("double").alias(a) for v, a in zip(box, "xywh")))
    line = F.concat_ws(" ", c("cls").cast("string"), *(c(a).cast("string") for a in "xywh"))
    return b.select("k", "n", "x", "y", "w", "h", F.explode(perception.line_errors(line)).alias("error")).distinct()


@query("SELECT k, lower(trim(raw)) IN ('1', 'true', 'yes', 'on') AS flag, coalesce(try_cast(trim(raw) AS INT), 7) AS n FROM (SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN ' ' || p_size || ' ' WHEN 1 THEN upper(left(p_brand, 3)) WHEN 2 THEN 'Yes' WHEN 3 THEN (p_partkey % 3)::VARCHAR WHEN 4 THEN ' ON' ELSE '' END AS raw FROM part)")
def setting_values(spark, d):
    k = F.col("p_partkey")
    raw = F.when(k % 6 == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" "))).when(k % 6 == 1, F.upper(F.left("p_brand", F.lit(3)))).when(k % 6 == 2, "Yes").when(k % 6 == 3, (k % 3).cast("string")).when(k % 6 == 4, " ON").otherwise("")
    return table(spark, d, "part").select(k.alias("k"), T.truthy(raw).alias("flag"), F.coalesce(F.trim(raw).try_cast("int"), F.lit(7)).alias("n"))


CALLS = """ev AS (SELECT user_id AS job_id, event_id AS seq, ts, CASE event_type WHEN 'view' THEN 'request' WHEN 'click' THEN 'request' WHEN 'signup' THEN 'image' ELSE 'answer' END AS kind,
 event_type = 'view' AND event_id % 11 = 0 AND user_id % 3 <> 0 AS cached, event_type = 'purchase' AND user_id % 3 <> 0 AS ok, 5 + user_id % 4 AS total FROM events)"""


@query(f"""WITH {CALLS}, s AS (SELECT *, coalesce(bool_or((kind = 'request' AND cached) OR (kind = 'answer' AND ok)) OVER b, false) AS verified, count(*) FILTER (kind = 'answer' AND NOT ok) OVER b AS bad, count(*) FILTER (kind = 'answer' AND NOT ok) OVER u AS failures,
 count(*) FILTER (kind = 'image') OVER u AS done FROM ev WINDOW b AS (PARTITION BY job_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), u AS (PARTITION BY job_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
a AS (SELECT *, NOT verified AND bad >= 3 AS shut FROM s), n AS (SELECT *, count(*) FILTER (kind = 'request' AND NOT cached AND NOT shut) OVER (PARTITION BY job_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS asked FROM a)
SELECT job_id, seq, ts AS "at", kind, CASE WHEN kind <> 'request' THEN 'recorded' WHEN cached THEN 'cached' WHEN shut THEN 'circuit_open' WHEN asked > 4 THEN 'job_limit' ELSE 'call' END AS decision, least(asked, 4) AS used, failures, done,
 CASE WHEN done > 0 THEN round(least(100.0::DOUBLE, 100.0::DOUBLE * done / total), 2) END AS percent FROM n""")
def call_guard(spark, d):
    """What each job's cap and circuit breaker decide, event by event, with its progress; the stream keeps the same counts as state."""
    c, kind = F.col, F.col("event_type")
    what = F.when(kind.isin("view", "click"), "request").when(kind == "signup", "image").otherwise("answer")
    cached = (kind == "view") & (c("event_id") % 11 == 0) & (c("user_id") % 3 != 0)
    ok = (kind == "purchase") & (c("user_id") % 3 != 0)
    e = table(spark, d, "events").select(c("user_id").alias("job_id"), c("event_id").alias("seq"), c("ts").alias("at"), what.alias("kind"), cached.alias("cached"), ok.alias("ok"), (5 + c("user_id") % 4).alias("total"))
    return guard.decided(e, 4)


# --- text that is torn over lines, and all forms of times -------------------------------------------

_TORN = """SELECT o_orderkey AS image_id, CASE o_orderkey % 6
 WHEN 0 THEN 'note ' || o_custkey || chr(10) || 'R.' || chr(10) || 'Vol : ' || (1000 + o_orderkey % 700) || ' cm3' || chr(10) || 'W' || chr(10) || 'idth 4' || o_orderkey % 10 || ' cm W' || chr(10) || 'eight ' || o_orderkey % 40 || ' kg'
 WHEN 1 THEN 'W' || chr(10) || chr(10) || '  eight - ' || o_orderkey % 30 || ' kg  Time 9:00 R' || chr(10) || 'Vol' || chr(10) || o_custkey || chr(10) || 'W  idth: ' || o_custkey % 90
 WHEN 2 THEN 'W eight ' || o_orderkey % 50 || ' kg' || chr(10) || 'R Vol' || chr(10) || 'W idth 7 cm'
 WHEN 3 THEN 'R.Vol ' || o_orderkey || chr(10) || 'x W' || chr(10) || 'eight' || chr(10) || 'Length 3 cm W' || chr(10) || 'idth Height 9'
 WHEN 4 THEN 'width' || chr(10) || 'WEIGHT' ELSE 'no anchors, order ' || o_orderkey END AS text FROM orders"""
_TORN_FIELDS = {"recorded_volume": r"\bR\.?\s*Vol\.?\b", "width_cm": r"\bW\s*idth\b", "weight": r"\bW\s*eight\b"}
_ANY_ANCHOR = "|".join(C.ANCHORS.values())
_TORN_SQL = " UNION ALL ".join(
    rf"""SELECT image_id, '{f}' AS field, coalesce(list_filter(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN regexp_matches(l[i], '(?i){a}') THEN coalesce(nullif(regexp_replace(regexp_replace(l[i], '(?i)^.*?{a}', ''), '^[ :.-]+', ''), ''), l[i + 1]) END), lambda x: x IS NOT NULL)[1],
 CASE WHEN regexp_matches(flat, '(?i){a}') THEN nullif(trim(regexp_replace(regexp_replace(regexp_replace(flat, '(?i)^.*?{a}', ''), '^[ :.-]+', ''), '(?is)({_ANY_ANCHOR}).*$', '')), '') END) AS raw FROM s"""
    for f, a in _TORN_FIELDS.items()
)


@query(rf"""WITH t AS ({_TORN}), s AS (SELECT image_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS l, regexp_replace(text, '\s+', ' ', 'g') AS flat FROM t)
{_TORN_SQL}""")
def torn_fields(spark, d):
    """Fields whose anchors are torn over lines: only the flattened text has them, up to the next anchor."""
    c = F.col
    t = table(spark, d, "orders").selectExpr("o_orderkey AS image_id", _TORN[_TORN.index("CASE o_orderkey") : _TORN.rindex(" FROM orders")])
    t = t.select("image_id", "text", T.once(T.lines(c("text"))).alias("lines"))
    return t.select("image_id", F.inline(F.array(*(F.struct(F.lit(f).alias("field"), T.field_line(c("text"), f, c("lines")).alias("raw")) for f in _TORN_FIELDS))))


_TIMES = """SELECT o_orderkey AS image_id, CASE o_orderkey % 11
 WHEN 0 THEN m || '/' || big || '/2024 ' || h || ':' || mi || ':07 PM' WHEN 1 THEN big || '/' || m || '/2024 ' || h || ':' || mi || ':08 am' WHEN 2 THEN m || '/' || d || '/2023 ' || hh || ':' || mi || ':09' WHEN 3 THEN big || '/' || m || '/2023 ' || hh || ':' || mi || ':10'
 WHEN 4 THEN d || '-' || m || '-2022 ' || hh || ':' || mi || ':11' WHEN 5 THEN m || '-' || big || '-2022  ' || hh || ':' || mi || ':12' WHEN 6 THEN '2021-' || m || '-' || d || ' ' || hh || ':' || mi || ':13'
 WHEN 7 THEN m || '/' || big || '/2025' || h || ':' || mi || ':14PM' WHEN 8 THEN ' ' || d || '/' || m || '/2020' || chr(9) || h || ':' || mi || ':15am ' WHEN 9 THEN big || '-' || big || '-2022 ' || hh || ':' || mi || ':16' ELSE o_orderkey || ' ' || hh || ':' || mi END AS raw
 FROM (SELECT o_orderkey, 1 + o_orderkey % 12 AS m, 1 + o_custkey % 12 AS d, 13 + o_custkey % 15 AS big, 1 + o_orderkey % 9 AS h, lpad(CAST(o_custkey % 24 AS STRING), 2, '0') AS hh, lpad(CAST(o_orderkey % 60 AS STRING), 2, '0') AS mi FROM orders)"""


@query(rf"""WITH t AS ({_TIMES}), c AS (SELECT image_id, upper(regexp_replace(regexp_replace(regexp_replace(trim(raw, ' ' || chr(9)), '\s+', ' ', 'g'), '(\d{{4}})(\d{{1,2}}:\d{{2}}:\d{{2}})', '\1 \2'), '(?i)(\d)([AP]M)$', '\1 \2')) AS x FROM t)
SELECT image_id, coalesce(try_strptime(x, '%m/%d/%Y %I:%M:%S %p'), try_strptime(x, '%d/%m/%Y %I:%M:%S %p'), try_strptime(x, '%m/%d/%Y %H:%M:%S'), try_strptime(x, '%d/%m/%Y %H:%M:%S'), try_strptime(x, '%d-%m-%Y %H:%M:%S'), try_strptime(x, '%m-%d-%Y %H:%M:%S'), try_strptime(x, '%Y-%m-%d %H:%M:%S')) AS taken FROM c""")
def parse_time_forms(spark, d):
    """All seven forms of times, month or day first, run together with the year or the half of the day, and impossible ones."""
    t = table(spark, d, "orders").selectExpr("o_orderkey", "1 + o_orderkey % 12 AS m", "1 + o_custkey % 12 AS d", "13 + o_custkey % 15 AS big", "1 + o_orderkey % 9 AS h", "lpad(CAST(o_custkey % 24 AS STRING), 2, '0') AS hh", "lpad(CAST(o_orderkey % 60 AS STRING), 2, '0') AS mi")
    raw = t.selectExpr("o_orderkey AS image_id", _TIMES[_TIMES.index("CASE o_orderkey") : _TIMES.index("\n FROM (SELECT")])
    return raw.select("image_id", T.timestamp(F.col("raw")).alias("taken"))


# --- the keyed store -------------------------------------------------------------------------------

_STORED = """SELECT CAST(job_id AS STRING) AS job_id, 'i' || event_id % 7 AS image_id, 'f' || lpad(CAST(event_id AS STRING), 12, '0') || '.jpg' AS original_filename, md5(CAST(event_id AS STRING)) AS sha256,
 CASE WHEN event_id % 2 = 0 THEN '{"status": "' || primary_status || '", "n": ' || n_warnings || '}' ELSE '{"status": "' || primary_status || '", "n": ' || n_warnings || '.5, "flags": ["a", "b' || event_id % 5 || '"], "size": {"w": ' || event_id || '}}' END AS payload,
 CAST(NULL AS STRING) AS input_path, ts AS created_at, seq % 3 AS batch FROM v_jobs"""


def _stored(spark, d):
    """Results in three batches, of which the first two are compacted."""
    rows = _results(spark, d)
    made = store.Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", 16)
    for n in range(3):
        made.save(rows.where(F.col("batch") == n).drop("batch"), n)
        if n == 1:
            made.compact()
    return made


def _results(spark, d):
    c = F.col
    event = c("event_id").cast("string")
    old = F.concat(F.lit('{"status": "'), c("primary_status"), F.lit('", "n": '), c("n_warnings").cast("string"))
    new = F.concat(old, F.lit('.5, "flags": ["a", "b'), (c("event_id") % 5).cast("string"), F.lit('"], "size": {"w": '), event, F.lit("}}"))
    return view(spark, d, "v_jobs").select(
        c("job_id").cast("string").alias("job_id"), F.concat(F.lit("i"), (c("event_id") % 7).cast("string")).alias("image_id"), F.concat(F.lit("f"), F.lpad(event, 12, "0"), F.lit(".jpg")).alias("original_filename"), F.md5(event).alias("sha256"),
        F.when(c("event_id") % 2 == 0, F.concat(old, F.lit("}"))).otherwise(new).alias("payload"), F.lit(None).cast("string").alias("input_path"), c("ts").cast("timestamp_ntz").alias("created_at"), (c("seq") % 3).alias("batch"),
    )


_LAST = f"r AS ({_STORED}), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, image_id ORDER BY batch DESC, created_at DESC, original_filename DESC) AS k FROM r) WHERE k = 1)"


@query(f"WITH {_LAST} SELECT job_id, image_id, original_filename, sha256, json_extract_string(payload, '$.status') AS status, json_extract(payload, '$.n')::DOUBLE AS n, CASE WHEN json_type(payload, '$.flags') IS NOT NULL THEN array_to_string(json_extract_string(payload, '$.flags[*]'), ';') END AS flags, json_extract(payload, '$.size.w')::BIGINT AS w FROM l")
def stored_results(spark, d):
    """Every key's last result, from a base and a batch beside it; the payloads' fields come from the data, old and new records together."""
    out = store.typed(_stored(spark, d).rows())
    return out.select("job_id", "image_id", "original_filename", "sha256", "status", F.col("n").cast("double").alias("n"), F.array_join("flags", ";").alias("flags"), F.col("size.w").cast("long").alias("w"))


@query(f"WITH {_LAST} SELECT job_id, image_id, original_filename FROM l WHERE job_id = (SELECT min(job_id) FROM r)")
def stored_lookup(spark, d):
    """One job's results by a look-up that reads its bucket only."""
    made = _stored(spark, d)
    job = _results(spark, d).agg(F.min("job_id")).first()[0]
    return made.get(job or "").select("job_id", "image_id", "original_filename")

