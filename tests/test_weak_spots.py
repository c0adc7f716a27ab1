"""Queries must feel what they are about: each falls apart without one form of a time, or without the flattened text."""

import pytest

from parcelmill.functions import constants as C
from parcelmill.functions import text as T
from parcelmill.plans import catalog

FOLDER = "/root/testdata/sf0.001"


def rows(spark, name):
    return sorted(map(repr, catalog.queries()[name](spark, FOLDER).collect()))


@pytest.fixture(scope="module")
def whole(spark):
    return {name: rows(spark, name) for name in ("parse_time_forms", "torn_fields", "class_aliases")}


@pytest.mark.parametrize("k", range(len(C.TIME_FORMATS)))
def test_every_form_of_time_is_needed(spark, whole, monkeypatch, k):
    monkeypatch.setattr(T, "TIME_FORMATS", C.TIME_FORMATS[:k] + C.TIME_FORMATS[k + 1 :])
    assert rows(spark, "parse_time_forms") != whole["parse_time_forms"]


def test_the_flattened_text_is_needed(spark, whole, monkeypatch):
    line = T.field_line
    monkeypatch.setattr(T, "field_line", lambda text, field, own=None: line(T.F.lit(""), field, own))
    assert rows(spark, "torn_fields") != whole["torn_fields"]


def test_every_class_and_alias_is_asked_for(spark):
    out = catalog.queries()["class_aliases"](spark, "/root/testdata/sf0.01").collect()
    found = {r.raw.strip().lower().replace("_", " ") for r in out if r.class_name}
    from parcelmill.operators.perception import ALIASES, CLASSES

    assert found == {x.replace("_", " ") for x in [*ALIASES, *CLASSES]}
    assert sum(r.class_name is None for r in out) > 100 and len({r.raw for r in out}) > 150
