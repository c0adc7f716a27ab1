"""Rule files as rows: what is wrong with each, against a plain check of the parsed text."""

import json
import random
import re

import pytest

from parcelmill.sources import readers

GOOD = {"name": "a", "pattern": "[0-9]+"}


def plain(text):
    try:
        data = json.loads(text)
        assert isinstance(data, dict) and isinstance(data.get("version", ""), str) and isinstance(data.get("rules", []), list)
        for r in data.get("rules", []):
            assert isinstance(r, dict) and isinstance(r["name"], str) and isinstance(r["pattern"], str) and isinstance(r.get("check_digit"), str | None)
            for k in ("prefixes", "context_terms"):
                assert isinstance(r.get(k, []), list) and all(isinstance(x, str) for x in r.get(k, []))
    except (ValueError, TypeError, KeyError, AssertionError):
        return [readers.UNREADABLE]
    errors, names = [], set()
    for r in data.get("rules", []):
        if r["name"] in names:
            errors.append(f"Duplicate rule name: {r['name']}")
        names.add(r["name"])
        try:
            re.compile(r["pattern"])
        except re.error as error:
            errors.append(f"Invalid regex for {r['name']}: {error}")
    return errors


def texts():
    out = [None, "", "{", "[]", "7", '"x"', "null", "{}", '{"rules": null}', '{"rules": {}}', '{"rules": [null]}', '{"rules": [[]]}', '{"version": 2}', '{"version": "2", "rules": []}', '{"rules": []} trailing', '{"rules": []},{}', '{"rules": []}],[{}', '{}},{"v":{}']
    for change in ({"name": 5}, {"name": None}, {"pattern": ["x"]}, {"prefixes": "AB"}, {"prefixes": [1]}, {"prefixes": ["a", None]}, {"prefixes": []}, {"prefixes": None}, {"context_terms": ["x", "y"]}, {"check_digit": 3}, {"check_digit": None}, {"check_digit": "mod"}, {"more": {"x": 1}}, {"name": ""}):
        out.append(json.dumps({"rules": [GOOD, GOOD | {"name": "z"} | change]}))
    for key in GOOD:
        out.append(json.dumps({"rules": [{k: v for k, v in GOOD.items() if k != key}]}))
    rng = random.Random(1)
    patterns = ["x", "(", "[", "a{2,1}", "*a", "(?P<n>a)(?P<n>b)", "[0-9]{14}", "é+", "\\", "(?<!a+)b"]
    for _ in range(80):
        out.append(json.dumps({"rules": [{"name": rng.choice("abcd"), "pattern": rng.choice(patterns)} for _ in range(rng.randrange(6))]}))
    return out


def test_rule_errors(spark):
    rows = [(k, t) for k, t in enumerate(texts())]
    out = readers.rule_text_errors(spark.createDataFrame(rows + rows[-3:], "key long, text string").repartition(4)).collect()
    assert len(out) == len(rows) + 3
    want = {k: plain(t) if t is not None else [readers.UNREADABLE] for k, t in rows}
    for r in out:
        assert r.errors == want[r.key], rows[r.key]
    kinds = {e.split(":")[0].split(" for")[0] for es in want.values() for e in es}
    assert kinds == {"Duplicate rule name", "Invalid regex", "Invalid courier rule file"}


def test_no_files(spark):
    assert readers.rule_text_errors(spark.createDataFrame([], "key long, text string")).count() == 0


@pytest.mark.parametrize("n", [50_000])
def test_patterns_are_compiled_once(spark, n):
    """Many files share few patterns, so the join is on the patterns' distinct ones."""
    df = spark.range(n).selectExpr("id as key", """concat('{"rules": [{"name": "r', id, '", "pattern": "p', id % 7, '("}]}') as text""")
    out = readers.rule_text_errors(df)
    assert out.where("size(errors) = 1 and errors[0] like 'Invalid regex for r%: missing ), unterminated subpattern at position 2'").count() == n
