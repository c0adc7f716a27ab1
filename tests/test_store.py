"""The keyed store: retries, replaced rows, compaction, look-ups that read few files, payloads of several versions."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from parcelmill.sources.store import Store, payload_schema, typed

ROW = "job_id string, image_id string, original_filename string, sha256 string, payload string, input_path string, created_at timestamp_ntz"


def results(seed, n, jobs=12):
    rng = random.Random(seed)
    out = {}
    for k in range(n):
        key = (f"job{rng.randrange(jobs) if rng.random() < 0.6 else 0}", f"i{rng.randrange(60)}")
        payload = {"status": rng.choice("ab"), "n": k} if seed % 2 else {"status": rng.choice("ab"), "n": k + 0.5, "flags": ["x", "é"], "size": {"w": k}}
        out[key] = (*key, f"f{k}.jpg", f"{seed}-{k}", json.dumps(payload), None if k % 5 == 0 else f"/in/{k}", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(500)))
    return list(out.values())


def plain(rows):
    return sorted(((*r[:4], json.loads(r[4]), *r[5:]) for r in rows), key=repr)


def seen(df):
    rows = df.withColumn("payload", F.to_json("payload")).select(*(c.split()[0] for c in ROW.split(", "))).collect()
    return plain(rows)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), 8)


def test_batches_retries_and_compaction(spark, store):
    want = {}
    assert seen(store.rows()) == [] and store.get("job0").count() == 0
    for n in range(5):
        rows = results(n, 150)
        store.save(spark.createDataFrame(results(n + 50, 40), ROW), n)  # a try that fails half way and
        store.save(spark.createDataFrame(rows, ROW).repartition(3), n)  # is made again replaces itself
        want |= {r[:2]: r for r in rows}
        assert seen(store.rows()) == plain(want.values())
        if n in (1, 3):
            before = seen(store.rows())
            reader = store.rows()  # planned on the old base
            store.compact()
            assert seen(store.rows()) == before == seen(reader)
            with pytest.raises(ValueError, match="compacted"):
                store.save(spark.createDataFrame(rows, ROW), n)
    store.vacuum()
    store.compact()
    store.vacuum()
    assert seen(store.rows()) == plain(want.values())
    assert store._batches() == []
    store.compact()  # nothing to do
    assert seen(store.rows()) == plain(want.values())


def test_of_one_batchs_rows_the_last_counts(spark, store):
    at = dt.datetime(2024, 1, 1)
    rows = [("j", "i", name, "s", "{}", None, when) for name, when in (("b", at), ("a", at + dt.timedelta(seconds=1)), ("c", at))]
    store.save(spark.createDataFrame(rows, ROW), 0)
    assert [r.original_filename for r in store.rows().collect()] == ["a"]


def test_look_ups(spark, store):
    want = {}
    for n in range(3):
        rows = results(n, 200)
        store.save(spark.createDataFrame(rows, ROW), n)
        want |= {r[:2]: r for r in rows}
        if n == 1:
            store.compact()
    for job in ("job0", "job7", "none"):
        own = [r for k, r in want.items() if k[0] == job]
        got = store.get(job)
        assert [r.original_filename for r in got.collect()] == [r[2] for r in sorted(own, key=lambda r: (r[6], r[2]))]
        some = own[0][1] if own else "i1"
        assert seen(store.get(job, some)) == plain([want[job, some]] if own else [])


def test_a_look_up_reads_few_files(spark, store):
    for n in range(2):
        store.save(spark.createDataFrame(results(n, 400, jobs=40), ROW), n)
    store.compact()
    store.save(spark.createDataFrame(results(5, 400, jobs=40), ROW), 5)
    every = set(store.rows().inputFiles())
    found = store.get("job7", "i3")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(job_id,job7)" in plan and "EqualTo(image_id,i3)" in plan
    read = [m for m in _scanned(found)]
    assert len(every) >= 12 and 0 < sum(read) <= len(every) // 3


def _scanned(df):
    """Files that each scan of a plan read."""
    df.collect()

    def walk(node):
        if node.nodeName().startswith("Scan parquet"):
            yield node.metrics().apply("numFiles").value()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            yield from walk(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            yield from walk(node.plan())
        else:
            kids = node.children()
            for k in range(kids.size()):
                yield from walk(kids.apply(k))

    return list(walk(df._jdf.queryExecution().executedPlan()))


def test_payloads_of_several_versions(spark, store):
    old = [("j", f"i{k}", f"{k}", "s", json.dumps({"status": "ok", "n": k}), None, dt.datetime(2024, 1, 1)) for k in range(4)]
    new = [("j", f"i{k}", f"{k}", "s", json.dumps({"status": None if k == 4 else "bad", "n": k + 0.25, "flags": ["a", "b"], "size": {"w": k}}), None, dt.datetime(2024, 1, 2)) for k in range(4, 7)]
    odd = [("j", "i9", "9", "s", json.dumps({"n": "many", "more": {"deep": [1]}}), None, dt.datetime(2024, 1, 3))]
    store.save(spark.createDataFrame(old, ROW), 0)
    assert typed(store.rows()).columns[-2:] == ["n", "status"]
    store.save(spark.createDataFrame(new, ROW), 1)
    store.compact()
    out = {r.image_id: r for r in typed(store.rows()).collect()}
    assert out["i1"].status == "ok" and out["i1"].n == 1 and out["i1"].flags is None and out["i1"]["size"] is None
    assert out["i4"].status is None and float(out["i5"].n) == 5.25 and out["i6"].flags == ["a", "b"] and out["i6"]["size"].w == 6
    store.save(spark.createDataFrame(odd, ROW), 2)
    both = typed(store.rows())
    assert dict(both.dtypes)["n"] == "variant"  # numbers and a text have nothing else in common
    assert {r.image_id: r.n for r in both.select("image_id", F.to_json("n").alias("n")).collect()}["i9"] == '"many"'
    assert typed(store.rows().where("false")).count() == 0 and payload_schema(store.rows().where("false")) == "VOID"
