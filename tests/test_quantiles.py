"""Places found in narrowing histograms, against sorted lists."""

import math
import random

import pytest
from pyspark.sql import functions as F

from parcelmill.operators import quantiles as Q


def plain(values, share):
    values = sorted(values)
    at = (len(values) - 1) * share
    low = math.floor(at)
    a, b = values[low], values[min(len(values) - 1, low + 1)]
    return a if a == b else (b - a) * (at - low) + a


def ranked(values, share):
    values = sorted(values)
    return values[min(len(values) - 1, int(len(values) * share))]


def made(spark, rows):
    return spark.createDataFrame(rows, "g string, v double").repartition(5)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    groups = {
        "spread": [rng.uniform(-1e6, 1e6) for _ in range(4000)],
        "steep": [10 ** rng.uniform(-300, 300) * rng.choice([1, -1]) for _ in range(300)],
        "ties": [float(rng.choice([1, 2, 2, 2, 5])) for _ in range(1000)],
        "one": [7.5],
        "two": [1.0, 4.0],
        "wide": [-1.7e308, 1.7e308, 0.0, 1.0, 2.0],
        None: [float(k) for k in range(97)],
    }
    return [(g, v) for g, vs in groups.items() for v in vs]


def test_places_by_group(spark, rows):
    more = [("none", None), ("one", None), ("two", float("nan"))]
    shares = {"a": 0.5, "b": 0.95, "c": 0.0, "d": 1.0}
    out = Q.quantiles(made(spark, rows + more), "v", shares, {"r": 0.95, "s": 0.3}, by=("g",)).collect()
    by = {}
    for g, v in rows:
        by.setdefault(g, []).append(v)
    assert {r.g: r.n for r in out} == {g: len(vs) for g, vs in by.items()}
    for r in out:
        assert (r.r, r.s) == (ranked(by[r.g], 0.95), ranked(by[r.g], 0.3))
        for name, share in shares.items():
            assert r[name] == pytest.approx(plain(by[r.g], share), rel=1e-12)


def test_few_cells_and_no_groups(spark, rows):
    values = [v for _, v in rows]
    n = F.col("n")
    wanted = {f"p{k}": F.lit(k).cast("long") for k in range(0, len(values), 400)}
    out = Q.places(made(spark, rows), "v", wanted | {"last": (n - 1).cast("long")}, cells=4).collect()
    assert len(out) == 1 and out[0].n == len(values)
    assert [out[0][f"p{k}"] for k in range(0, len(values), 400)] == sorted(values)[::400] and out[0]["last"] == max(values)


def test_same_as_the_built_in_ones(spark, rows):
    df = made(spark, [(g, v) for g, v in rows if g in ("spread", "ties")])
    got = Q.quantiles(df, "v", {"a": 0.5, "b": 0.95}).first()
    want = df.agg(F.median("v").alias("a"), F.percentile("v", 0.95).alias("b")).first()
    assert (got.a, got.b) == pytest.approx((want.a, want.b), rel=1e-12)


def test_infinite_and_equal_values(spark):
    inf = float("inf")
    rows = [("i", -inf), ("i", 1.0), ("i", 2.0), ("i", inf), ("i", inf), ("e", inf), ("e", inf)]
    n = F.col("n")
    out = {r.g: [r[f"p{k}"] for k in range(5)] for r in Q.places(made(spark, rows), "v", {f"p{k}": F.least(F.lit(k), n - 1).cast("long") for k in range(5)}, by=("g",)).collect()}
    assert out == {"i": [-inf, 1.0, 2.0, inf, inf], "e": [inf] * 5}


def test_nothing(spark):
    assert Q.quantiles(made(spark, []), "v", {"a": 0.5}).count() == 0
    assert Q.quantiles(made(spark, [("x", None)]), "v", {"a": 0.5}, by=("g",)).count() == 0


def test_no_row_holds_many_values(spark):
    """A pass returns a number of rows that the cells bound, and no plan collects values."""
    df = spark.range(300_000).select((F.xxhash64("id") % 10**9).cast("double").alias("v"))
    out = Q.quantiles(df, "v", {"a": 0.5})
    plan = out._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "percentile" not in plan
    values = sorted(r.v for r in df.collect())
    assert out.first().a == (values[149_999] + values[150_000]) / 2
