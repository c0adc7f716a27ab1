"""Golden and property tests of the shipment operators."""

import datetime as dt
import io
import json
import zipfile

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parcelmill.functions import constants as C
from parcelmill.functions import errors, pixels
from parcelmill.functions import text as T
from parcelmill.operators import evaluate as E
from parcelmill.operators import evidence as V
from parcelmill.operators import hamming as H
from parcelmill.operators import jobs as J
from parcelmill.operators import reconcile as R
from parcelmill.operators.lifecycle import BatchTooLarge, Jobs
from parcelmill.sources import files, readers, sinks
from parcelmill.streaming import ingest

OCR = "\n".join(["Location: Bangalore_Hoskote_GW (Karnataka)", "AW8 No. 55556666777788", "Length 570 mm", "Width 13.307 in", "Height 0.424 m", "R Vol 81691 cm3", "W eight 7.02 kg", "Time 2025-07-13 17:53:26"])


def value(spark, column, **inputs):
    names = list(inputs) or ["x"]
    row = tuple(inputs.values()) or (1,)
    kinds = {str: "string", int: "long", float: "double", bool: "boolean"}
    schema = ", ".join(f"{n} {kinds.get(type(v), 'string')}" for n, v in zip(names, row))
    return spark.createDataFrame([row], schema).select(column.alias("v")).first().v


def test_parse_golden_text(spark):
    line = lambda f: T.field_line(F.col("t"), f)
    assert value(spark, T.location(line("location")), t=OCR) == "Bangalore_Hoskote_GW (Karnataka)"
    assert value(spark, T.normalise_awb(T.awb_fixed(T.awb_token(line("awb_number")))), t=OCR) == "55556666777788"
    cm = lambda f: T.centimetres(T.number(line(f)), F.coalesce(T.unit(line(f), "mm|cm|m|in|inch|inches"), F.lit("cm")))
    assert value(spark, cm("length_cm"), t=OCR) == 57.0
    assert abs(value(spark, cm("width_cm"), t=OCR) - 33.8) < 0.01
    assert value(spark, cm("height_cm"), t=OCR) == 42.4
    assert value(spark, T.number(line("weight")) * 1000, t=OCR) == 7020.0
    assert value(spark, T.timestamp(line("capture_timestamp")), t=OCR) == dt.datetime(2025, 7, 13, 17, 53, 26)
    assert value(spark, T.anchor_count(F.col("t")), t=OCR) == 8


@pytest.mark.parametrize("raw, want", [("1111-2222-333344", "11112222333344"), ("123", None), ("TRACKING", None), (" ab 123456-7 ", "AB1234567")])
def test_identifiers(spark, raw, want):
    assert value(spark, T.normalise_awb(F.col("x")), x=raw) == want


@pytest.mark.parametrize("raw, want", [("7/17/20256:11:38PM", dt.datetime(2025, 7, 17, 18, 11, 38)), ("13/2/2025 9:05:01", dt.datetime(2025, 2, 13, 9, 5, 1)), ("20-03-2025 10:00:00", dt.datetime(2025, 3, 20, 10)), ("soon", None), ("7/17/202512:11:38PM", None)])
def test_timestamps(spark, raw, want):
    assert value(spark, T.timestamp(F.col("x")), x=raw) == want


def test_field_line_falls_back(spark):
    line = T.field_line(F.col("x"), "awb_number")
    assert value(spark, line, x="AWB No\n12345678901234\nLength 3") == "12345678901234"
    assert value(spark, line, x="nothing here") is None
    assert value(spark, T.field_line(F.col("x"), "weight"), x="W\neight 3 kg Time 2025") == "3 kg"


@pytest.mark.parametrize("x, want", [(1.5, "1.5"), (10.0, "10"), (0.25, "0.25"), (500.0, "500"), (33.79978, "33.7998")])
def test_short_numbers(spark, x, want):
    assert value(spark, T.short_number(F.col("x")), x=x) == want


@pytest.mark.parametrize("x, want", [("a/b/../we ird*.JPG", "we ird_.JPG"), (" . ", "unnamed-image"), ("", "unnamed-image"), ("C:\\x\\ok (1).png", "ok (1).png")])
def test_safe_names(spark, x, want):
    assert value(spark, T.safe_name(F.col("x")), x=x) == want


def test_excel_text_and_words(spark):
    assert value(spark, T.excel_text(F.col("x")), x="12345678901234567890") == '="12345678901234567890"'
    assert value(spark, T.excel_text(F.col("x")), x="=cmd") == ""
    for k, v in C.FLAG_TEXT.items():
        assert value(spark, T.worded(F.col("x"), C.FLAG_TEXT), x=k) == v
    assert value(spark, T.worded(F.col("x"), C.FLAG_TEXT), x="NEW_FLAG") == "New flag"


def candidates(spark, *rows):
    return spark.createDataFrame([(1, "awb_number", *r, k) for k, r in enumerate(rows)], "image_id int, field_name string, normalised_value string, source string, confidence double, pos long")


def test_agreement_raises_confidence(spark):
    r = R.reconcile(candidates(spark, ("12345678", "OVERLAY_OCR", 0.85), ("12345678", "BARCODE", 0.88))).first()
    assert r.confidence >= 0.95 and not r.conflict and r.source == "BARCODE" and r.agreeing == ["BARCODE", "OVERLAY_OCR"]


def test_conflict_lowers_confidence(spark):
    r = R.reconcile(candidates(spark, ("12345678", "OVERLAY_OCR", 0.94), ("87654321", "BARCODE", 0.93))).first()
    assert r.conflict and r.confidence < 0.9 and r.value == "12345678"


def test_first_seen_wins_ties(spark):
    r = R.reconcile(candidates(spark, ("bbb", "BARCODE", 0.5), ("aaa", "BARCODE", 0.5), (None, "BARCODE", 0.9), ("", "BARCODE", 0.9))).first()
    assert r.value == "bbb"


def record(spark, **over):
    base = dict(parcel_count=1, parcel_visibility="FULL", label_status="LABEL_VISIBLE_READABLE", error_code=None, awb_number="11112222333344", awb_source="BARCODE", awb_confidence=0.98, agreeing=["BARCODE"], weight_grams=1.0, length_cm=1.0, width_cm=1.0, height_cm=1.0, vision_attempted=False, vision_succeeded=False, flags=[])
    schema = "parcel_count int, parcel_visibility string, label_status string, error_code string, awb_number string, awb_source string, awb_confidence double, agreeing array<string>, weight_grams double, length_cm double, width_cm double, height_cm double, vision_attempted boolean, vision_succeeded boolean, flags array<string>"
    return R.assign_status(spark.createDataFrame([tuple((base | over).values())], schema)).first()


def test_status_rules(spark):
    assert record(spark).primary_status == "SUCCESS_LABEL_VERIFIED"
    both = record(spark, awb_source="OVERLAY_OCR", agreeing=["LABEL_OCR", "OVERLAY_OCR"])
    assert both.primary_status == "SUCCESS_OVERLAY_AND_LABEL" and not both.requires_review
    only = record(spark, awb_source="OVERLAY_OCR", agreeing=["OVERLAY_OCR"], label_status="LABEL_NOT_VISIBLE")
    assert only.primary_status == "REVIEW_REQUIRED" and "AWB_NOT_LABEL_VERIFIED" in only.flags
    part = record(spark, parcel_visibility="PARTIAL", awb_number=None, awb_source="NOT_EXTRACTED", agreeing=None)
    assert {"parcel_partially_visible", "awb_not_found"} <= set(part.review_reasons)
    none = record(spark, parcel_count=0, parcel_visibility="NONE", awb_number=None)
    assert none.primary_status == "REJECTED" and none.flags == ["NO_PARCEL"] and not none.requires_review and none.review_reasons == []
    broke = record(spark, error_code="PROCESSING_EXCEPTION", flags=["Z", "A"])
    assert broke.primary_status == "PROCESSING_ERROR" and broke.flags == ["Z", "A"] and broke.review_reasons == ["processing_error"]
    assert record(spark, awb_number=None, awb_source="NOT_EXTRACTED", agreeing=None).primary_status == "SUCCESS_PARTIAL_FIELDS"
    asked = record(spark, awb_number=None, agreeing=None, vision_attempted=True)
    assert "vision_unavailable_local_evidence_insufficient" in asked.review_reasons


def test_record_boundary_and_fields(spark):
    rec = spark.createDataFrame([(1, "weight", "5", "OVERLAY_OCR", 0.9)], "image_id int, field_name string, value string, source string, confidence double")
    w = R.wide(rec, ["weight", "location"]).first()
    assert (w.weight, w.weight_source, w.location, w.location_source, w.location_confidence) == ("5", "OVERLAY_OCR", None, "NOT_EXTRACTED", 0.0)
    r = spark.createDataFrame([("BAD_SIGNATURE", None, "X", ["A"], True), (None, "E", "X", ["A"], False)], "input_error string, error_code string, primary_status string, flags array<string>, requires_review boolean")
    a, b = R.error_boundary(r).collect()
    assert (a.primary_status, a.flags, a.requires_review) == ("REJECTED", ["A", "UNSUPPORTED_IMAGE"], False)
    assert (b.primary_status, b.processing_status, b.requires_review) == ("PROCESSING_ERROR", "FAILED", True)


TRUTH = "filename string, expected_awb string, expected_weight_grams string, expected_parcel_count string, expected_parcel_visibility string, expected_review string, annotated string, split string"
PRED = "filename string, awb_number string, awb_confidence double, weight_grams double, parcel_count int, parcel_visibility string, requires_review boolean, processing_status string"


def test_metrics_of_two_images(spark):
    truth = spark.createDataFrame([("a", "11112222333344", "500", "1", "FULL", "false", "true", "test"), ("b", "55556666777788", "700", "1", "PARTIAL", "true", "true", "test")], TRUTH)
    pred = spark.createDataFrame([("a", "11112222333344", 0.98, 500.0, 1, "FULL", False, "COMPLETED"), ("b", "55556666777788", 0.7, None, 1, "PARTIAL", True, "COMPLETED")], PRED)
    joined = E.labelled(truth, pred, "test")
    m = E.metrics(E.marked(joined)).first()
    assert (m.clean_precision, m.false_clean, m.review_recall, m.parcel_accuracy, m.review_rate) == (1.0, 0, 1.0, 1.0, 0.5)
    cover = {r.field: r.coverage for r in E.coverage(joined, {"awb": ("expected_awb", "awb_number"), "weight": ("expected_weight_grams", "weight_grams")}).collect()}
    assert cover == {"awb": 1.0, "weight": 0.5, "overall": 0.75}
    assert E.sweep(E.marked(joined)).count() == 25


def test_join_is_one_to_one(spark):
    truth = spark.createDataFrame([("a", "1", "", "1", "FULL", "", "yes", "x")] * 2, TRUTH)
    with pytest.raises(Exception, match="not unique"):
        E.labelled(truth, spark.createDataFrame([], PRED)).collect()


def test_resume_upsert_and_copies(spark):
    items = spark.createDataFrame([(0, "a.jpg", "s1"), (1, "b.jpg", "s2"), (2, "c.jpg", "s1")], "pos long, filename string, sha256 string")
    assert sorted(r.pos for r in J.canonical(items, "sha256", "pos").collect()) == [0, 1]
    assert [(r.pos, r.original) for r in J.fan_out(items, "sha256", "pos").collect()] == [(2, 0)]
    done = spark.createDataFrame([("s1",), ("",)], "sha256 string")
    assert [r.pos for r in J.pending(items, done, "sha256").collect()] == [1]
    seen = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "k int, v string, seq int")
    assert J.upsert(seen, ["k"], F.col("seq")).first().v == "y"


def test_job_lifecycle(spark, tmp_path):
    seen = []

    def process(df):
        n = df.count()
        seen.append(n)
        return (df.limit(1) if len(seen) == 1 else df).withColumn("status", F.lit("ok"))

    jobs = Jobs(spark, str(tmp_path), process, max_batch=4)
    items = spark.createDataFrame([(0, "a", "s1"), (1, "b", "s2"), (2, "c", "s1")], "pos long, filename string, sha256 string")
    job = jobs.submit(items)
    assert jobs.resume(job) == 1 and jobs.resume(job) == 0
    out = {r.pos: r for r in jobs.results(job).collect()}
    assert len(out) == 3 and out[2].duplicate_of == 0 and out[0].duplicate_of is None
    with pytest.raises(ValueError):
        jobs.submit(items.limit(0))
    with pytest.raises(BatchTooLarge):
        jobs.submit(spark.range(5).selectExpr("id as pos", "'x' as filename", "string(id) as sha256"))


def test_job_is_cancelled_between_batches_and_resumed(spark, tmp_path):
    box = {}

    def process(df):
        box["n"] = box.get("n", 0) + 1
        if box["n"] == 1:
            box["job"] = next(p.name for p in tmp_path.iterdir())
            assert box["jobs"].is_running(box["job"]) and box["jobs"].cancel(box["job"])
        return df.withColumn("status", F.lit("ok"))

    jobs = box["jobs"] = Jobs(spark, str(tmp_path), process, batch=2)
    items = spark.createDataFrame([(k, f"{k}.png", f"s{k}") for k in range(8)], "pos long, filename string, sha256 string")
    job = jobs.submit(items)
    state = jobs.get_job(job)
    assert state["stage"] == "CANCELLED" and 0 < jobs.results(job).count() < 8 and not jobs.cancel(job)
    jobs.resume(job)
    assert jobs.get_job(job)["stage"] == "COMPLETED" and not jobs.is_running(job)
    out = jobs.results(job).collect()
    assert [r.pos for r in out] == list(range(8)) and all(r.stored_name.endswith(".png") and len(r.stored_name) == 36 for r in out)


def test_failed_job_keeps_what_it_has(spark, tmp_path):
    def process(df):
        raise RuntimeError("broke")

    jobs = Jobs(spark, str(tmp_path), process)
    with pytest.raises(RuntimeError):
        jobs.submit(spark.createDataFrame([(0, "a", "s")], "pos long, filename string, sha256 string"))
    job = next(p.name for p in tmp_path.iterdir())
    assert jobs.get_job(job)["stage"] == "FAILED" and jobs.get_job(job)["error"] == "RuntimeError" and jobs.results(job).count() == 0


def test_imaging(spark):
    from parcelmill.operators import imaging, perception

    rng = np.random.default_rng(3)
    noise = rng.integers(0, 255, (40, 60, 3)).astype(np.uint8)
    patch = np.zeros((40, 60, 3), np.uint8)
    patch[8:16, 8:24] = (0, 220, 250)
    patch[30, 50] = (0, 220, 250)
    rows = [("noise", 60, 40, bytearray(noise.tobytes())), ("patch", 60, 40, bytearray(patch.tobytes())), ("bad", None, None, None)]
    images = spark.createDataFrame(rows, "origin string, width int, height int, pixels binary")
    m = {r.origin: r for r in imaging.measured(images).collect()}
    assert m["noise"].blur > 1000 and not m["noise"].low_quality and m["patch"].low_quality and m["bad"].blur is None and not m["bad"].low_quality
    assert 0 < m["patch"].edge_density < m["noise"].edge_density
    bits = {r.origin: r.bits for r in imaging.hashed(images).collect()}
    assert bits["noise"] == pixels.difference_hash(noise) and bits["bad"] is None
    parts = imaging.overlay_parts(images.where("origin = 'patch'"))
    assert [(r.pixels, r.x, r.y, r.w, r.h) for r in parts.collect()] == [(128, 4, 6, 24, 12)]  # joined by a rectangle of 5 x 3, twice
    assert perception.union_box(parts).first().x2 == 28
    gone = imaging.without_region(images.withColumn("region", F.expr("if(origin = 'patch', struct(8 as x, 8 as y, 16 as w, 8 as h), null)")))
    assert {r.origin: sum(r.pixels) for r in gone.where("origin = 'patch'").collect()} == {"patch": 470}
    exif = b"\xff\xd8\xff\xe1" + (34).to_bytes(2, "big") + b"Exif\0\0" + b"II*\0" + (8).to_bytes(4, "little") + (1).to_bytes(2, "little") + (0x0112).to_bytes(2, "little") + (3).to_bytes(2, "little") + (1).to_bytes(4, "little") + (6).to_bytes(4, "little") + bytes(4)
    assert pixels.exif_orientation(exif) == 6 and pixels.exif_orientation(b"") == 1 and pixels.exif_orientation(b"\xff\xd8\xff") == 1
    turned = {r.origin: r for r in imaging.upright(images.withColumn("content", F.lit(exif)), 30).collect()}
    assert (turned["noise"].width, turned["noise"].height, len(turned["noise"].pixels)) == (20, 30, 1800) and turned["bad"].pixels is None
    boxes = images.withColumn("boxes", F.expr("array(struct(2 as x, 2 as y, 9 as w, 9 as h))")).withColumn("requires_review", F.lit(True))
    seen = {r.origin: r for r in imaging.previews(boxes).collect()}
    assert seen["noise"].preview[:4] == b"\x89PNG" and seen["bad"].preview is None
    assert pixels.opened(np.pad(np.eye(4, dtype=bool), 2)).sum() == 0 and pixels.opened(np.ones((3, 3), bool)).all()


def png_of(w, h):
    return pixels.png(np.random.default_rng(w).integers(0, 255, (h, w, 3)).astype(np.uint8))


def test_inputs_of_any_kind(spark, tmp_path):
    good, jpeg = png_of(9, 7), b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x05\x00\x06\x03" + bytes(12)
    assert files.image_size(good) == (9, 7) and files.image_size(jpeg) == (6, 5) and files.image_size(b"\xff\xd8\xff") is None
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "b.png").write_bytes(good)
    (folder / "a.jpg").write_bytes(jpeg)
    (folder / "notes.txt").write_text("x")
    found = files.inputs(spark, str(folder)).collect()
    assert [r.path.rsplit("/", 1)[1] for r in found] == ["a.jpg", "b.png"] and found[1].width == 9
    assert files.inputs(spark, str(folder / "b.png")).count() == 1
    with pytest.raises(files.InvalidInput, match="BATCH_TOO_LARGE"):
        files.inputs(spark, str(folder), max_batch=1)
    (folder / "c.png").write_bytes(good[:20])
    with pytest.raises(files.InvalidInput, match="CORRUPT_IMAGE.*c.png"):
        files.inputs(spark, str(folder))
    (tmp_path / "x.zip").write_bytes(archive(**{"one.png": good, "bad.png": b"nothing", "sub/inner.zip": b"PK", "read.me": b"x"}))
    rows = {r.name: r for r in files.inputs(spark, str(tmp_path / "x.zip")).collect()}
    assert rows["one.png"].warning is None and bytes(rows["one.png"].content) == good
    assert "BAD_SIGNATURE" in rows["bad.png"].warning and rows["sub/inner.zip"].warning and rows["read.me"].content is None
    (tmp_path / "y.zip").write_bytes(archive(**{"bad.png": b"nothing"}))
    with pytest.raises(files.InvalidInput, match="EMPTY_ZIP"):
        files.inputs(spark, str(tmp_path / "y.zip"))
    (tmp_path / "z.zip").write_bytes(archive(**{"../up.png": good}))
    with pytest.raises(files.InvalidInput, match="ZIP_PATH_TRAVERSAL"):
        files.inputs(spark, str(tmp_path / "z.zip"))


def test_rule_file_and_dataset(spark, tmp_path):
    (tmp_path / "rules.json").write_text('{"rules": [{"name": "a", "pattern": "x", "prefixes": ["p"]}]}')
    assert readers.rule_file(spark, str(tmp_path / "rules.json")) == [V.CarrierRule("a", "x", ("p",))] and readers.rule_file(spark, str(tmp_path / "none")) == []
    for name in ("images/a/one.png", "images/two.JPG", "labels/a/one.txt", "labels/three.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("0 0.5 0.5 0.1 0.1")
    assert {tuple(r) for r in readers.dataset_errors(spark, str(tmp_path)).collect()} == {("two", "image_without_label"), ("three", "label_without_image")}


def test_lanczos():
    flat = np.full((30, 50), 77, np.uint8)
    assert (pixels.resized(flat, 9, 8) == 77).all() and pixels.resized(flat, 50, 30) is not None
    ramp = np.tile(np.arange(0, 250, 5, dtype=np.uint8), (30, 1))
    small = pixels.resized(ramp, 9, 8).astype(int)
    assert (np.diff(small, axis=1) > 0).all() and pixels.difference_hash(np.dstack([ramp] * 3)) == -1


def test_leaders_in_chains(spark):
    """Chains in which whether one leads depends on many before it; copies; two sets."""
    rng = np.random.default_rng(7)
    rows = []
    for s in (0, 1):
        x = 0
        for pos in range(60):
            x ^= sum(1 << int(k) for k in rng.integers(0, 63, 3))
            rows += [(s, 3 * pos, x), (s, 3 * pos + 1, x if pos % 5 == 0 else int(rng.integers(0, 2**62)))]
    want, lead = {}, {0: [], 1: []}
    for s, pos, bits in sorted(rows):
        want[s, pos] = next((p for p, b in lead[s] if (b ^ bits).bit_count() <= 6), pos)
        if want[s, pos] == pos:
            lead[s].append((pos, bits))
    out = H.leaders(spark.createDataFrame(rows, "set_id int, pos long, bits long"))
    assert {(r.set_id, r.pos): r.leader for r in out.collect()} == want
    assert 0 < sum(p != l for (_, p), l in want.items()) < len(want)


def test_carrier_rules_of_a_file(spark):
    rules = V.parsed_rules('{"rules": [{"name": "p", "pattern": "[A-Z]{2}[0-9]+", "prefixes": ["nh"]}, {"name": "c", "pattern": ".*", "context_terms": ["AWB"]}]}')
    ask = lambda v, ctx: value(spark, F.array_join(V.matching_rules(F.col("x"), F.lit(ctx), rules), ";"), x=v)
    assert ask("nh12", "") == "p;c" and ask("xx12", "the awb no") == "c" and ask("NH1", "other") == "p" and ask("zz", "other") == ""
    assert V.parsed_rules("{}") == [] and value(spark, F.size(V.matching_rules(F.col("x"), F.lit(""), [])), x="a") == 0


def test_calibration_without_a_threshold_raises(spark):
    from parcelmill.operators import evaluate

    table = spark.createDataFrame([(0.8, 5, 0.5, 0.1)], "threshold double, accepted long, precision double, review_rate double")
    assert evaluate.calibrate(table, 0.4).first().threshold == 0.8
    with pytest.raises(Exception, match="no threshold"):
        evaluate.calibrate(table, 0.9).collect()


def test_evaluation_files(spark, tmp_path):
    one = spark.createDataFrame([(1, None)], "n int, missing double")
    pairs = spark.createDataFrame([("a", "x", "y", 2)], "pair string, expected string, predicted string, n long")
    sinks.write_evaluation(one, one, one, pairs, str(tmp_path))
    assert '"missing":null' in next((tmp_path / "metrics").glob("part-*")).read_text()
    assert (tmp_path / "confusion" / "pair=a").is_dir() and (tmp_path / "failures").is_dir()


def test_patch_can_set_null(spark):
    jobs = spark.createDataFrame([(1, "RUN", 5), (2, "RUN", 6)], "job int, stage string, n int")
    patch = spark.createDataFrame([(1, None, True, 9, False)], "job int, stage string, set_stage boolean, n int, set_n boolean")
    assert {tuple(r) for r in J.patched(jobs, patch, "job", ["stage", "n"]).collect()} == {(1, None, 5), (2, "RUN", 6)}


JPEG, PNG = bytes.fromhex("FFD8FFE000104A46"), bytes.fromhex("89504E470D0A1A0A")


def archive(**entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()


def test_scan_and_validate(spark, tmp_path):
    (tmp_path / "ok.jpg").write_bytes(JPEG)
    (tmp_path / "fake.jpg").write_bytes(b"not an image")
    (tmp_path / "wrong.png").write_bytes(JPEG)
    (tmp_path / "empty.jpg").write_bytes(b"")
    (tmp_path / "notes.txt").write_bytes(b"x")
    f = files.scan(spark, str(tmp_path)).select(F.element_at(F.split("path", "/"), -1).alias("n"), files.first_error(F.col("size"), F.col("path"), F.col("head"), F.lit(1), F.lit(1)).alias("e"))
    assert {r.n: r.e for r in f.collect()} == {"ok.jpg": None, "fake.jpg": "BAD_SIGNATURE", "wrong.png": "BAD_SIGNATURE", "empty.jpg": "EMPTY_FILE", "notes.txt": "UNSUPPORTED_IMAGE"}


def test_streaming_ingest_is_exactly_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jpg").write_bytes(JPEG)
    (tmp_path / "in" / "b.jpg").write_bytes(JPEG)
    (tmp_path / "in" / "c.png").write_bytes(PNG)
    ingest.ingest(spark, src, out, ck).awaitTermination()
    assert ingest.latest(spark, out).count() == 2
    (tmp_path / "in" / "d.jpg").write_bytes(JPEG + b"more")
    ingest.ingest(spark, src, out, ck).awaitTermination()
    assert ingest.latest(spark, out).count() == 3 and ingest.latest(spark, out).where("error is not null").count() == 0


def test_circuit_opens(spark):
    rows = [(1, k, k == 9) for k in range(10)] + [(2, 0, True)] + [(2, k, False) for k in range(1, 6)]
    out = {(r.job_id, r.seq): r.allowed for r in ingest.circuit(spark.createDataFrame(rows, "job_id int, seq int, ok boolean")).collect()}
    assert [out[1, k] for k in range(6)] == [True, True, True, False, False, False] and all(out[2, k] for k in range(6))


def test_calls_are_capped(spark):
    rows = [(1, k, k != 1) for k in range(6)]
    out = ingest.capped(spark.createDataFrame(rows, "job_id int, seq int, allowed boolean"), 3).orderBy("seq").collect()
    assert [r.allowed for r in out] == [True, False, True, True, False, False]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, '0012"3', ["a", "b"], None, dt.datetime(2025, 1, 2, 3, 4, 5))], "id int, awb string, flags array<string>, w double, t timestamp_ntz")
    text = sinks.csv_text(df, ["id"])
    assert text.startswith("\ufeff\"id\"") and '"0012""3","a;b","","2025-01-02T03:04:05"' in text
    assert json.loads(sinks.audit(df).first().value)["w"] is None
    sinks.publish(df, str(tmp_path / "r"))
    sinks.publish(df.union(df), str(tmp_path / "r"))
    assert sinks.published(spark, str(tmp_path / "r")).count() == 2
    sinks.publish(df, str(tmp_path / "r"))
    assert sinks.published(spark, str(tmp_path / "r")).count() == 1
    assert sum(p.name.startswith("v-") for p in (tmp_path / "r").iterdir()) == 2
    with pytest.raises(FileNotFoundError):
        sinks.published(spark, str(tmp_path / "none"))
    paths = df.select("id", F.lit("/a/b/é.png").alias("annotated"), F.lit(None).cast("string").alias("nothing"))
    assert json.loads(sinks.audit_text(paths, ["id"], {"annotated": "annotations"})) == [{"id": 1, "annotated": "annotations/é.png", "nothing": None}]
    assert "é" in sinks.audit_text(paths, ["id"]) and "\n  " in sinks.audit_text(paths, ["id"])
    sinks.write_csv(df, str(tmp_path / "c"))
    back = readers.csv_strings(spark, str(tmp_path / "c"), ["id", "awb", "flags", "w", "t"]).first()
    assert back.awb.startswith("0012") and back.w == ""


def test_settings_and_rules(spark, tmp_path):
    assert readers.Settings.from_env({"WORKERS": "x", "MAX_BATCH": "7", "VISION_ENABLED": " Yes "}) == readers.Settings(max_batch=7, vision_enabled=True)
    assert readers.options("{broken") == {"vision_enabled": False, "worker_count": None} and readers.options('{"worker_count": 3}')["worker_count"] == 3
    (tmp_path / "cal.json").write_text(json.dumps({"version": "v2", "awb_clean_threshold": 0.97, "frozen": False}))
    assert readers.frozen_calibration(spark, str(tmp_path / "cal.json")).first().threshold == 0.90
    (tmp_path / "cal2.json").write_text(json.dumps({"version": "v2", "awb_clean_threshold": 0.97, "frozen": True}))
    assert tuple(readers.frozen_calibration(spark, str(tmp_path / "cal2.json")).first()) == (0.97, "v2")
    (tmp_path / "rules.json").write_text(json.dumps({"version": "1", "rules": [{"name": "a", "pattern": "["}, {"name": "a", "pattern": "x"}]}))
    assert {r.error for r in readers.rule_errors(spark, str(tmp_path / "rules.json")).collect()} == {"Duplicate rule name: a", "Invalid regex for a: unterminated character set at position 0"}
    assert value(spark, F.array_join(V.matching_rules(F.col("x"), F.lit("Explicit AWB anchor")), ";"), x="11112222333344") == "numeric_14;generic_alphanumeric"
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "p1.txt").write_text("0 0.5 0.5 0.1 0.1\n1 2")
    assert {r.stem for r in readers.annotations(spark, str(tmp_path / "l")).collect()} == {"p1"}


@pytest.mark.parametrize("kind, status, want, again", [("status", 401, "authentication", False), ("status", 429, "rate_limit", True), ("connection", None, "network", True), ("status", 503, "server_error", True), ("parse", None, "malformed_response", False), ("odd", None, "unexpected", False)])
def test_call_errors(spark, kind, status, want, again):
    row = spark.createDataFrame([(kind, status)], "k string, s int").select(errors.category(F.col("k"), F.col("s")), errors.retryable(F.col("k"), F.col("s"))).first()
    assert tuple(row) == (want, again)


def test_backoff(spark):
    assert [value(spark, errors.backoff(F.col("x")), x=k) for k in (1, 2, 3, 9)] == [0.5, 1.0, 2.0, 4.0]


def test_pixels():
    rng = np.random.default_rng(0)
    noise = rng.integers(0, 255, (40, 60, 3)).astype(np.uint8)
    flat = np.full((40, 60, 3), 128, np.uint8)
    assert pixels.quality(noise)["blur"] > 1000 and pixels.low_quality(pixels.quality(flat)) and not pixels.low_quality(pixels.quality(noise))
    assert pixels.difference_hash(noise) == pixels.difference_hash(noise) != pixels.difference_hash(noise[:, ::-1])
    patch = flat.copy()
    patch[:5, :5] = (0, 220, 255)
    assert pixels.yellow(patch).sum() == 25 and pixels.suppressed(patch, 0, 0, 5, 5)[:5, :5].sum() == 0
    assert pixels.rotated(noise, 90).shape == (60, 40, 3) and (pixels.rotated(pixels.rotated(noise, 180), 180) == noise).all()
    assert pixels.fitted(8192, 4096) == (4096, 2048) and pixels.orientation(3, 2) == "LANDSCAPE"
    assert pixels.merged_boxes([(0, 0, 10, 10), (12, 0, 10, 10), (90, 90, 5, 5)], 100, 100) == [(0, 0, 22, 10), (90, 90, 5, 5)]
    assert pixels.detection_rows(np.zeros((9, 10)), 5).shape == (10, 9) and pixels.detection_rows(np.zeros((24, 8400)), 20).shape == (8400, 24)
    assert pixels.resolve(None, {"rapidocr": True}).name == "rapidocr" and not pixels.resolve("tesseract", {}).available
    assert not pixels.detector("/none.onnx").available and pixels.letterbox(1280, 960) == (0.5, 0, 80)


def test_nms_and_leaders(spark):
    b = spark.createDataFrame([(1, 1, 0, 0, 10, 10, 0.9), (1, 2, 1, 1, 10, 10, 0.8), (1, 3, 50, 50, 10, 10, 0.7)], "image_id int, box_id long, x int, y int, w int, h int, score double")
    assert sorted(r.box_id for r in V.nms(b).collect()) == [1, 3]
    h = spark.createDataFrame([(1, 0, 0), (1, 1, 0b111), (1, 2, (1 << 40) - 1), (1, 3, (1 << 40) - 2)], "set_id int, pos long, bits long")
    assert {r.pos: r.leader for r in H.leaders(h).collect()} == {0: 0, 1: 0, 2: 2, 3: 2}


@given(st.integers(0, 2**62))
def test_splits_are_shares(n):
    import hashlib

    k = int(hashlib.sha256(str(n).encode()).hexdigest()[:8], 16) % 100
    assert 0 <= k < 100


def test_splits(spark):
    out = spark.range(2000).select(J.split_of(F.col("id").cast("string")).alias("s")).groupBy("s").count().collect()
    share = {r.s: r["count"] / 2000 for r in out}
    assert abs(share["train"] - 0.7) < 0.05 and abs(share["val"] - 0.15) < 0.04


def test_class_names(spark):
    from parcelmill.operators import perception as P

    one = lambda x: value(spark, P.class_list(F.col("x")), x=x)
    assert one("{0: 'barcode', 2: 'person', 1: 'cardboard box'}") == ["barcode", "cardboard box", "person"]
    assert one("['a', 'b']") == ["a", "b"] and one("broken") == P.CLASSES
    assert [value(spark, P.internal_class(F.col("x")), x=n) for n in ("barcode", "cardboard box", "person")] == ["barcode_region", "parcel_full", None]


def test_line_clusters_and_observations(spark):
    from parcelmill.operators import perception as P

    t = spark.createDataFrame([(1, 10.0, 5.0, 10.0, "b"), (1, 11.0, 0.0, 10.0, "a"), (1, 40.0, 0.0, 10.0, "c"), (1, 41.0, 9.0, 10.0, "")], "page int, center double, left double, height double, token string")
    assert P.line_clusters(t).first().text == "a b\nc"
    kinds = {"filename": "string", "width": "int", "height": "int", "orientation": "string", "blur_score": "double", "brightness": "double", "contrast": "double", "underexposure_pct": "double", "overexposure_pct": "double", "edge_density": "double", "overlay": "struct<x:int,y:int,width:int,height:int>", "overlay_ocr_confidence": "double", "parsed_field_count": "int"}
    from parcelmill.operators import report

    o = P.observations(report.with_columns(spark.range(1), kinds).withColumn("overlay", F.expr("named_struct('x', 1, 'y', 2, 'width', 3, 'height', 4)")))
    assert len(o.columns) == 14 and o.first().overlay_bbox == "1,2,3,4" and o.first().overlay_detected


def test_reports_have_all_columns(spark):
    from parcelmill.operators import report

    r = spark.createDataFrame([("1", None, ["a", "b"], 1.5, "kg", "SUCCESS_PARTIAL_FIELDS", True, [], ["NEW_FLAG"])], "image_id string, awb_number string, warnings array<string>, weight_value double, weight_unit string, primary_status string, requires_review boolean, review_reasons array<string>, flags array<string>")
    row = report.detailed(r).first()
    assert len(row) == 59 and (row.awb_number, row.awb_number_excel, row.warnings, row.weight_original) == ("", "", "a;b", "1.5 kg")
    full = report.with_columns(r, {"filename": "string", "weight_grams": "double", "length_cm": "double", "width_cm": "double", "height_cm": "double", "location": "string"})
    s = report.simple(full).first()
    assert (s["Tracking number"], s["Result"], s["Notes"]) == ("Not found", report.CHECK, "New flag")


def test_decoding(spark, tmp_path):
    import struct
    import zlib

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\x00" + bytes([255, 0, 0] * 3) for _ in range(2))
    png = PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    (tmp_path / "ok.png").write_bytes(png)
    (tmp_path / "bad.png").write_bytes(PNG + b"broken")
    out = {r.origin.rsplit("/", 1)[1]: r for r in files.decoded(spark, str(tmp_path)).collect()}
    assert (out["ok.png"].width, out["ok.png"].height, out["ok.png"].orientation) == (3, 2, "LANDSCAPE")
    assert bytes(out["ok.png"].pixels[:3]) == b"\x00\x00\xff" and out["bad.png"].corrupt and out["bad.png"].width is None


def test_previews_and_fixtures():
    image = np.full((40, 60, 3), 120, np.uint8)
    marked = pixels.boxed(image, [(5, 5, 20, 20)])
    assert (marked[5, 10] == (0, 200, 0)).all() and (marked[15, 15] == 120).all() and (image == 120).all()
    worse = pixels.adverse(image)
    assert set(worse) == {"blur", "dark", "bright", "turned", "cut", "covered", "empty", "combined", "over"} and worse["turned"].shape == (60, 40, 3)
    kinds = pixels.adverse_files(b"0123456789", b"other")
    assert kinds["duplicate"][0] == kinds["duplicate"][1] and kinds["conflict"][0] != kinds["conflict"][1] and len(kinds["corrupt"][0]) == 3
