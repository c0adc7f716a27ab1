"""The browser's filters against a plain walk, and searches that read candidate files only."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parcelmill.operators import browse as B

SCHEMA = "pos long, filename string, primary_status string, awb_source string, label_status string, flags array<string>, requires_review boolean, overall_confidence double"


def records(n=400, seed=1):
    rng = random.Random(seed)
    names = [None, "IMG_0001.jpg", "ſcan-İstanbul.PNG", "KelvinK.jpg", "parcel (3).jpg"]
    name = lambda k: rng.choice(names) if k % 4 == 0 else f"{rng.choice(['img', 'IMG', 'Scan', 'photo'])}_{rng.randrange(2000):04d}_{rng.choice('abc')}.jpg"
    pick = lambda *x: rng.choice(x)
    return [(k, name(k), pick("OK", "REVIEW", None), pick("BARCODE", "OCR", None), pick("SEEN", "UNSURE", None), pick([], ["A"], ["A", "B"], ["C"], None), pick(True, False), pick(None, 0.0, 0.3, 0.75, 1.0)) for k in range(n)]


def shown(rows, f):
    out = []
    for pos, name, status, source, label, flags, review, sure in rows:
        good = (not f.statuses or status in f.statuses) and (not f.sources or source in f.sources) and (not f.labels or label in f.labels)
        good &= not f.flags or bool(set(flags or ()) & set(f.flags))
        good &= f.review is None or review == f.review
        good &= not f.filename or (name is not None and re.search(f.filename, name, re.I) is not None)
        if good and f.confidence[0] <= (sure or 0.0) <= f.confidence[1]:
            out.append(pos)
    return out


FILTERS = [
    B.Filters(),
    B.Filters(statuses=("OK",)),
    B.Filters(sources=("BARCODE", "OCR"), review=False),
    B.Filters(labels=("UNSURE",), flags=("B", "C")),
    B.Filters(review=True, confidence=(0.3, 0.75)),
    B.Filters(filename="img_1"),
    B.Filters(filename="SCAN"),
    B.Filters(filename="scan.*_a"),
    B.Filters(filename="istanbul"),
    B.Filters(filename="kelvink"),
    B.Filters(filename=r"parcel \(\d\)"),
    B.Filters(filename="nothing like it"),
    B.Filters(statuses=("OK", "REVIEW"), sources=("OCR",), labels=("SEEN",), flags=("A",), review=True, filename="_0[0-9]+_b", confidence=(0.0, 0.9)),
]


@pytest.mark.parametrize("f", FILTERS, ids=str)
def test_filters(spark, f):
    rows = records()
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.pos for r in B.browse(df, f).collect()) == shown(rows, f)


def test_searches_read_candidate_files_only(spark, tmp_path):
    rows = records(3000)
    index = B.NameIndex(spark, str(tmp_path))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for part in (rows[:1500], rows[1500:]):
            index.add(spark.createDataFrame(part, SCHEMA))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    index.index()
    every = {r.file for r in spark.read.parquet(index.results).selectExpr("_metadata.file_path as file").distinct().collect()}
    assert len(every) >= 6
    for f in FILTERS:
        found = index.search(f)
        assert sorted(r.pos for r in found.collect()) == shown(rows, f)
        read = set(found.inputFiles())
        if f.filename == "SCAN":
            assert 0 < len(read) < len(every)
        if f.filename == "nothing like it":
            assert index.files(f.filename) == []
        if not B.asked_trigrams(f.filename):
            assert index.files(f.filename) is None


@given(st.text("abAB.*?+^$", min_size=1, max_size=9), st.text("abAB", max_size=14))
@settings(max_examples=500, deadline=None)
def test_every_match_holds_the_asked_trigrams(pattern, text):
    try:
        found = re.search(pattern, text, re.I)
    except re.error:
        return
    if found:
        assert all(t in text.lower() for t in B.asked_trigrams(pattern))
