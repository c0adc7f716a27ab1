"""Views that shape the fixed tables into shipment evidence, in SQL that Spark and DuckDB read alike.

Each adapter is one SELECT; ``VIEWS`` maps its name to it, and later ones may use earlier ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.steps import spread

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

VIEWS: dict[str, str] = {
    # Recognised text of one image: eight anchored lines, some misread, some in other units.
    "v_ocr": r"""
SELECT o_orderkey AS image_id,
       CAST(50 + o_custkey % 50 AS DOUBLE) / 100 AS conf,
       concat_ws(chr(10),
         'Location: ' || CASE WHEN o_orderkey % 3 = 0 THEN 'Hub_' || CAST(o_custkey % 97 AS STRING) || '_GW (North)'
                              WHEN o_orderkey % 3 = 1 THEN 'NORTH HUB ' || CAST(o_custkey % 97 AS STRING)
                              ELSE 'Hub street ' || CAST(o_custkey % 97 AS STRING) END,
         CASE WHEN o_orderkey % 4 = 1 THEN 'AW8 No. ' ELSE 'AWB No: ' END || CASE WHEN o_orderkey % 7 = 0 THEN chr(10) ELSE '' END ||
           CASE WHEN o_orderkey % 5 = 0 THEN replace(lpad(CAST(o_orderkey * 37 AS STRING), 14, '3'), '0', 'O')
                WHEN o_orderkey % 5 = 1 THEN 'AB' || lpad(CAST(o_orderkey AS STRING), 10, '4')
                WHEN o_orderkey % 5 = 2 THEN '12-' || CAST(o_orderkey % 100 AS STRING)
                ELSE lpad(CAST(o_orderkey * 31 AS STRING), 14, '2') END,
         'Length ' || CAST(10 + o_orderkey % 90 AS STRING) || CASE WHEN o_orderkey % 4 = 0 THEN ' mm' WHEN o_orderkey % 4 = 1 THEN ' cm' WHEN o_orderkey % 4 = 2 THEN ' in' ELSE '' END,
         'W idth: ' || CAST(5 + o_orderkey % 40 AS STRING) || '.5 cm',
         CASE WHEN o_orderkey % 6 = 0 THEN 'Height l2 cm' ELSE 'Height ' || CAST(1 + o_orderkey % 9 AS STRING) || ',25 m' END,
         'R Vol ' || CAST(1000 + o_orderkey % 8000 AS STRING) || ' cm3',
         CASE WHEN o_orderkey % 8 = 0 THEN 'W eight ' || CAST(1 + o_orderkey % 30 AS STRING) || '.25'
              WHEN o_orderkey % 2 = 0 THEN 'W eight ' || CAST(1 + o_orderkey % 30 AS STRING) || '.25 kg'
              ELSE 'Weight: ' || CAST(100 + o_orderkey % 900 AS STRING) || ' gms' END,
         'Time ' || CASE WHEN o_orderkey % 3 = 0 THEN CAST(1 + o_orderkey % 12 AS STRING) || '/' || CAST(13 + o_orderkey % 15 AS STRING) || '/2025 ' || CAST(1 + o_orderkey % 12 AS STRING) || ':05:09 PM'
                         WHEN o_orderkey % 3 = 1 THEN '2025-' || CAST(1 + o_orderkey % 12 AS STRING) || '-' || CAST(1 + o_orderkey % 28 AS STRING) || ' ' || CAST(o_orderkey % 24 AS STRING) || ':05:09'
                         ELSE 'unknown' END) AS text
FROM orders""",
    # Competing candidates for an image's identifier.
    "v_candidates": r"""
SELECT l_orderkey AS image_id, 'awb_number' AS field_name,
       CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE lpad(CAST(l_orderkey * 37 + CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 0 END AS STRING), 14, '0') END AS normalised_value,
       CASE l_returnflag WHEN 'A' THEN 'BARCODE' WHEN 'N' THEN 'OVERLAY_OCR' ELSE 'LABEL_OCR' END AS source,
       CAST(70 + CAST(round(l_discount * 100) AS INT) * 2 AS DOUBLE) / 100 AS confidence,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS pos
FROM lineitem""",
    "v_barcodes": r"""
SELECT l_orderkey AS image_id, lpad(CAST(l_partkey AS STRING), 12, '7') AS value, 'label_' || CAST(l_linenumber % 3 AS STRING) AS source_crop,
       CAST(60 + CAST(round(l_tax * 100) AS INT) * 3 AS DOUBLE) / 100 AS evidence_level,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS pos
FROM lineitem""",
    # What the image showed besides its candidates.
    "v_images": r"""
SELECT o_orderkey AS image_id, 'img_' || CAST(o_orderkey AS STRING) || '.jpg' AS filename,
       CASE WHEN o_custkey % 10 = 0 THEN NULL WHEN o_custkey % 10 = 1 THEN 0 WHEN o_custkey % 10 = 2 THEN 2 ELSE 1 END AS parcel_count,
       CASE WHEN o_custkey % 10 = 1 THEN 'NONE' WHEN o_custkey % 7 = 0 THEN 'PARTIAL' ELSE 'FULL' END AS parcel_visibility,
       CASE o_orderkey % 8 WHEN 0 THEN 'LABEL_NOT_VISIBLE' WHEN 1 THEN 'LABEL_PARTIALLY_VISIBLE' WHEN 2 THEN 'LABEL_BLOCKED_OR_OCCLUDED' WHEN 3 THEN 'MULTIPLE_LABEL_CANDIDATES' WHEN 4 THEN 'LABEL_STATUS_UNCERTAIN' ELSE 'LABEL_VISIBLE_READABLE' END AS label_status,
       CASE WHEN o_custkey % 37 = 0 THEN 'PROCESSING_EXCEPTION' END AS error_code,
       CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(100 + o_orderkey % 900 AS DOUBLE) END AS weight_grams,
       CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(10 + o_orderkey % 90 AS DOUBLE) END AS length_cm,
       CAST(5 + o_orderkey % 40 AS DOUBLE) AS width_cm, CAST(1 + o_orderkey % 20 AS DOUBLE) AS height_cm,
       o_orderkey % 13 = 0 AS vision_attempted, o_orderkey % 26 = 0 AS vision_succeeded,
       o_orderkey % 5 = 0 AS low_quality, CAST(o_orderkey % 5000 + 100 AS BIGINT) AS duration_ms,
       CAST(40 + o_custkey % 60 AS DOUBLE) / 100 AS weight_confidence, CAST(30 + o_custkey % 70 AS DOUBLE) / 100 AS location_confidence
FROM orders""",
    "v_truth": r"""
SELECT 'img_' || CAST(o_orderkey AS STRING) || '.jpg' AS filename,
       lpad(CAST(o_orderkey * 37 AS STRING), 14, '0') AS expected_awb,
       CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE CAST(100 + o_orderkey % 900 AS STRING) END AS expected_weight_grams,
       CASE WHEN o_custkey % 10 IN (1, 2) THEN '0' ELSE '1' END AS expected_parcel_count,
       CASE WHEN o_custkey % 10 = 1 THEN 'NONE' WHEN o_custkey % 14 = 0 THEN 'PARTIAL' ELSE 'FULL' END AS expected_parcel_visibility,
       CASE WHEN o_orderkey % 3 = 0 THEN 'true' ELSE 'false' END AS expected_review,
       CASE o_custkey % 4 WHEN 0 THEN 'True' WHEN 1 THEN '1' WHEN 2 THEN 'yes' ELSE 'no' END AS annotated,
       CASE o_orderkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split
FROM orders""",
    "v_pred": r"""
SELECT 'img_' || CAST(o_orderkey AS STRING) || '.jpg' AS filename,
       CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN '99999999' ELSE lpad(CAST(o_orderkey * 37 AS STRING), 14, '0') END AS awb_number,
       CAST(70 + o_custkey % 30 AS DOUBLE) / 100 AS awb_confidence,
       CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(100 + o_orderkey % 900 AS DOUBLE) END AS weight_grams,
       CASE WHEN o_custkey % 10 = 0 THEN NULL WHEN o_custkey % 10 = 1 THEN 0 ELSE 1 END AS parcel_count,
       CASE WHEN o_custkey % 10 = 1 THEN 'NONE' WHEN o_custkey % 7 = 0 THEN 'PARTIAL' ELSE 'FULL' END AS parcel_visibility,
       o_orderkey % 4 = 0 AS requires_review,
       CASE WHEN o_custkey % 41 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS processing_status,
       CASE WHEN o_orderkey % 4 = 0 THEN 'AWB_CONFLICT;LOW_IMAGE_QUALITY' WHEN o_orderkey % 4 = 1 THEN 'WEIGHT_NOT_FOUND' ELSE '' END AS status_flags,
       CAST(o_orderkey % 5000 + 100 AS BIGINT) AS processing_duration_ms
FROM orders WHERE o_orderkey % 17 <> 0""",
    # Truth and predictions with every field that is evaluated.
    "v_full_truth": r"""
SELECT 'img_' || CAST(o_orderkey AS STRING) || '.jpg' AS filename,
       CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE lpad(CAST(o_orderkey * 37 AS STRING), 14, '0') END AS expected_awb,
       CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE CAST(100 + o_orderkey % 900 AS STRING) END AS expected_weight_grams,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(10 + o_orderkey % 90 AS STRING) END AS expected_length_cm,
       CASE WHEN o_orderkey % 8 = 0 THEN ' ' ELSE CAST(5 + o_orderkey % 40 AS STRING) END AS expected_width_cm,
       CAST(1 + o_orderkey % 20 AS STRING) AS expected_height_cm,
       CASE WHEN o_custkey % 10 IN (1, 2) THEN '0' WHEN o_custkey % 10 = 3 THEN '' ELSE '1' END AS expected_parcel_count,
       CASE WHEN o_custkey % 10 = 1 THEN 'NONE' WHEN o_custkey % 14 = 0 THEN 'partial' WHEN o_custkey % 10 = 3 THEN NULL ELSE 'FULL' END AS expected_parcel_visibility,
       CASE o_orderkey % 4 WHEN 0 THEN 'LABEL_VISIBLE_READABLE' WHEN 1 THEN 'LABEL_NOT_VISIBLE' WHEN 2 THEN '' ELSE 'LABEL_STATUS_UNCERTAIN' END AS expected_label_status,
       CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'true' WHEN 2 THEN 'Yes' ELSE 'false' END AS expected_review,
       CASE o_custkey % 4 WHEN 0 THEN 'True' WHEN 1 THEN '1' WHEN 2 THEN 'yes' ELSE 'no' END AS annotated,
       CASE o_orderkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split
FROM orders""",
    "v_full_pred": r"""
SELECT 'img_' || CAST(o_orderkey AS STRING) || '.jpg' AS filename,
       CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN '99999999' ELSE lpad(CAST(o_orderkey * 37 AS STRING), 14, '0') END AS awb_number,
       CAST(70 + o_custkey % 30 AS DOUBLE) / 100 AS awb_confidence,
       CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(100 + o_orderkey % 900 AS DOUBLE) END AS weight_grams,
       CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(10 + o_orderkey % 90 AS DOUBLE) END AS length_cm,
       CAST(5 + o_orderkey % 40 AS DOUBLE) AS width_cm,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(1 + o_orderkey % 20 AS DOUBLE) END AS height_cm,
       CASE WHEN o_custkey % 10 = 0 THEN NULL WHEN o_custkey % 10 = 1 THEN 0 ELSE 1 END AS parcel_count,
       CASE WHEN o_custkey % 10 = 1 THEN 'NONE' WHEN o_custkey % 7 = 0 THEN 'PARTIAL' ELSE 'FULL' END AS parcel_visibility,
       CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'LABEL_NOT_VISIBLE' WHEN 2 THEN 'label_visible_readable' ELSE 'LABEL_VISIBLE_READABLE' END AS label_status,
       o_orderkey % 4 = 0 AS requires_review,
       CASE WHEN o_custkey % 41 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS processing_status,
       CASE WHEN o_orderkey % 4 = 0 THEN 'AWB_CONFLICT;LOW_IMAGE_QUALITY' WHEN o_orderkey % 4 = 1 THEN 'WEIGHT_NOT_FOUND' ELSE '' END AS status_flags,
       CAST(o_orderkey % 5000 + 100 AS BIGINT) AS processing_duration_ms
FROM orders WHERE o_orderkey % 17 <> 0""",
    # Evidence of four sources for the eight reconciled fields; ``pos`` orders it within its source.
    "v_overlay": r"""
SELECT l_orderkey AS image_id, CASE (l_orderkey + l_linenumber) % 8 WHEN 0 THEN 'awb_number' WHEN 1 THEN 'weight' WHEN 2 THEN 'length_cm' WHEN 3 THEN 'width_cm' WHEN 4 THEN 'height_cm' WHEN 5 THEN 'recorded_volume' WHEN 6 THEN 'location' ELSE 'capture_timestamp' END AS field_name,
       CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE CAST(10 + l_orderkey % 90 AS STRING) END AS normalised_value,
       CAST(70 + CAST(round(l_discount * 100) AS INT) * 2 AS DOUBLE) / 100 AS confidence, l_partkey * 100 + l_linenumber AS pos
FROM lineitem WHERE l_returnflag = 'N'""",
    "v_label": r"""
SELECT l_orderkey AS image_id, CASE (l_orderkey + l_linenumber * 3) % 8 WHEN 0 THEN 'awb_number' WHEN 1 THEN 'weight' WHEN 2 THEN 'length_cm' WHEN 3 THEN 'width_cm' WHEN 4 THEN 'height_cm' WHEN 5 THEN 'recorded_volume' WHEN 6 THEN 'location' ELSE 'capture_timestamp' END AS field_name,
       CAST(10 + (l_orderkey + l_linenumber % 2) % 90 AS STRING) AS normalised_value,
       CAST(60 + CAST(round(l_tax * 100) AS INT) * 4 AS DOUBLE) / 100 AS confidence, l_suppkey * 100 + l_linenumber AS pos
FROM lineitem WHERE l_linenumber <= 4""",
    "v_scanned": r"""
SELECT l_orderkey AS image_id, 'awb_number' AS field_name, CAST(10 + l_orderkey % 90 AS STRING) AS normalised_value, CAST(80 + l_linenumber AS DOUBLE) / 100 AS confidence, l_partkey * 100 + l_linenumber AS pos
FROM lineitem WHERE l_returnflag = 'A'""",
    "v_seen": r"""
SELECT o_orderkey AS image_id, CASE WHEN o_custkey % 2 = 0 THEN 'weight' ELSE 'location' END AS field_name, CAST(10 + o_orderkey % 90 AS STRING) AS normalised_value, 0.74 AS confidence, o_custkey AS pos
FROM orders WHERE o_custkey % 3 = 0""",
    # Whole records: every column of the detailed report that is not derived; lists are joined by semicolons.
    "v_records": r"""
SELECT md5(CAST(o_orderkey AS STRING)) AS image_id, 'img_' || CAST(o_orderkey AS STRING) || '.jpg' AS filename, md5(CAST(o_orderkey AS STRING)) || md5(CAST(o_orderkey + 1 AS STRING)) AS sha256,
       CASE WHEN o_custkey % 37 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS processing_status,
       CASE o_orderkey % 5 WHEN 0 THEN 'REVIEW_REQUIRED' WHEN 1 THEN 'SUCCESS_LABEL_VERIFIED' WHEN 2 THEN 'REJECTED' WHEN 3 THEN 'PROCESSING_ERROR' ELSE 'SUCCESS_OVERLAY_AND_LABEL' END AS primary_status,
       CASE o_orderkey % 4 WHEN 0 THEN 'AWB_CONFLICT;LOW_IMAGE_QUALITY' WHEN 1 THEN 'WEIGHT_NOT_FOUND' ELSE '' END AS status_flags, o_orderkey % 5 IN (0, 3) AS requires_review,
       CASE o_orderkey % 6 WHEN 0 THEN 'awb_conflict;multiple_parcels' WHEN 1 THEN 'awb_not_found' ELSE '' END AS review_reasons,
       CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE CAST(o_custkey % 3 AS INT) END AS parcel_count, CAST(o_custkey % 50 AS DOUBLE) / 64 AS parcel_count_confidence,
       CASE WHEN o_custkey % 7 = 0 THEN 'PARTIAL' ELSE 'FULL' END AS parcel_visibility, CAST(o_orderkey % 3 AS INT) AS label_count, 'LABEL_VISIBLE_READABLE' AS label_status,
       CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 9 = 1 THEN 'a b"c' ELSE lpad(CAST(o_orderkey * 37 AS STRING), 14, '0') END AS awb_number, 'BARCODE' AS awb_source, CAST(o_custkey % 60 AS DOUBLE) / 64 AS awb_confidence,
       CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderkey % 40 AS DOUBLE) / 4 END AS weight_value, CASE WHEN o_orderkey % 12 = 1 THEN NULL ELSE 'kg' END AS weight_unit,
       CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderkey % 40 AS DOUBLE) * 250 END AS weight_grams, 'LABEL_OCR' AS weight_source, 0.5 AS weight_confidence,
       CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(10 + o_orderkey % 90 AS DOUBLE) END AS length_cm, CAST(5 + o_orderkey % 40 AS DOUBLE) / 2 AS width_cm, CAST(1 + o_orderkey % 20 AS DOUBLE) AS height_cm,
       'OVERLAY_OCR' AS dimensions_source, CAST(o_orderkey % 16 AS DOUBLE) / 16 AS dimensions_confidence,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(1000 + o_orderkey % 900 AS DOUBLE) END AS recorded_volume, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'cm3' END AS recorded_volume_unit, 'OVERLAY_OCR' AS recorded_volume_source, 0.25 AS recorded_volume_confidence,
       CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE 'HUB_' || CAST(o_custkey % 97 AS STRING) END AS location, 'OVERLAY_OCR' AS location_source, 0.75 AS location_confidence,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE '2025-06-01T10:' || lpad(CAST(o_orderkey % 60 AS STRING), 2, '0') || ':00' END AS capture_timestamp, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'raw ' || CAST(o_orderkey AS STRING) END AS capture_timestamp_raw,
       'OVERLAY_OCR' AS capture_timestamp_source, 0.5 AS capture_timestamp_confidence, o_orderkey % 2 = 0 AS overlay_detected, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN '111' ELSE '111;222' END AS barcode_values,
       CAST(o_orderkey % 64 AS DOUBLE) / 64 AS overall_confidence, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 'v1' END AS detector_version, 0.5 AS detector_confidence, o_orderkey % 2 = 1 AS detector_used, 'tesseract;rapid' AS ocr_engines_used,
       o_orderkey % 13 = 0 AS vision_attempted, o_orderkey % 26 = 0 AS vision_succeeded, false AS vision_cache_hit, CASE WHEN o_orderkey % 39 = 0 THEN 'timeout' END AS vision_error_category, CASE WHEN o_orderkey % 26 = 0 THEN 'req' END AS vision_request_id,
       CAST(o_orderkey % 3 AS INT) AS vision_attempt_count, CAST(o_orderkey % 700 AS BIGINT) AS vision_duration_ms, 'uncalibrated' AS calibration_version, CASE WHEN o_orderkey % 4 = 3 THEN 'slow;dark' ELSE '' END AS warnings,
       CAST(o_orderkey % 5000 + 100 AS BIGINT) AS processing_duration_ms, CASE WHEN o_orderkey % 5 = 3 THEN 'PROCESSING_EXCEPTION' END AS error_code, CASE WHEN o_orderkey % 5 = 3 THEN 'it "broke"' END AS error_message
FROM orders""",
    # Words of a dialogue as recognised tokens of a page.
    "v_boxes": r"""
SELECT l_orderkey AS image_id,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS box_id,
       CASE WHEN l_linenumber % 2 = 0 THEN 'hand_occlusion' WHEN l_linenumber % 3 = 0 THEN 'parcel_full' ELSE 'label_region' END AS class_name,
       CAST(l_partkey % 60 AS INT) AS x, CAST(l_suppkey % 60 AS INT) AS y,
       CAST(20 + l_partkey % 30 AS INT) AS w, CAST(20 + l_suppkey % 25 AS INT) AS h,
       CAST(30 + (l_partkey + l_suppkey) % 70 AS DOUBLE) / 100 AS score
FROM lineitem""",
    "v_jobs": r"""
SELECT user_id AS job_id, event_id, ts,
       row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
       CASE event_type WHEN 'purchase' THEN 'SUCCESS_LABEL_VERIFIED' WHEN 'signup' THEN 'SUCCESS_PARTIAL_FIELDS' WHEN 'error' THEN 'PROCESSING_ERROR' WHEN 'click' THEN 'REVIEW_REQUIRED' ELSE 'REJECTED' END AS primary_status,
       event_type IN ('click', 'error') AS requires_review,
       CAST(event_id % 3 AS BIGINT) AS n_warnings
FROM events""",
    "v_files": r"""
SELECT doc_id AS file_id, source || '/' || CASE WHEN doc_id % 6 = 0 THEN '../we ird*' || lang || '.JPG' WHEN doc_id % 6 = 1 THEN 'scan#' || CAST(doc_id AS STRING) || '.png' WHEN doc_id % 6 = 2 THEN ' .' ELSE 'photo ' || CAST(doc_id AS STRING) || '.txt' END AS path,
       text AS content, length(text) * 37 AS size,
       CASE doc_id % 4 WHEN 0 THEN 'FFD8FFE0' WHEN 1 THEN '89504E470D0A1A0A' ELSE '47494638' END AS head,
       CASE WHEN doc_id % 9 = 0 THEN NULL ELSE CAST(doc_id * 13 % 14000 AS INT) END AS width, CAST(doc_id * 7 % 9000 AS INT) AS height
FROM documents""",
}


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Make the tables and the adapters temporary views."""
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    for name in names or VIEWS:
        spark.sql(VIEWS[name]).createOrReplaceTempView(name)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One adapter over one folder, without temporary names."""
    sql = VIEWS[name]
    used = {t: spread(spark.read.parquet(f"{sf_dir}/{t}.parquet")) for t in TABLES if f"FROM {t}" in sql}
    for t in used:
        sql = sql.replace(f"FROM {t}", "FROM {" + t + "}")
    return spark.sql(sql, **used)


def with_views(sql: str) -> str:
    """Oracle SQL with the adapters it names put before it."""
    found = [n for n in VIEWS if n in sql]
    head = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in found)
    if not found:
        return sql
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {head},\n{body[15:].strip()}"
    return f"WITH {head},\n{body[4:].strip()}" if body[:5].upper() == "WITH " else f"WITH {head}\n{body}"
