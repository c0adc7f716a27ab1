"""The tiered search against the scoring of every document."""

import random

import brute
import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parcelmill.llm import op12_tiers as T


def same(docs, items, **more):
    got = sorted((tuple(r) for r in T.search(docs, items, **more).collect()), key=repr)
    pairs = [[tuple(r) for r in df.select(*c).collect()] for df, c in ((docs, ("doc_id", "text")), (items, ("item_id", "text")))]
    assert got == sorted(brute.ranked(*pairs, best=more.get("best", T.BEST)), key=repr)
    return got


@pytest.fixture(scope="module")
def corpus(spark):
    """Words of very unequal frequency, long and short documents, copies, and documents that hold an item."""
    rng = random.Random(8)
    words = [f"W{k}" for k in range(600)]
    prose = lambda n: " ".join(words[min(599, int(rng.paretovariate(0.4)) - 1)] for _ in range(n))
    items = [(k, prose(rng.choice([1, 3, 12, 40]))) for k in range(40)]
    docs = [(k, prose(rng.choice([3, 30, 80, 300]))) for k in range(900)]
    docs += [(1000 + k, f"{prose(30)}, {items[k % 40][1].lower()}; {prose(30)}") for k in range(70)]
    docs += [(2000 + k, docs[5][1]) for k in range(60)]
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(6), spark.createDataFrame(items, "item_id long, text string")


def test_search(corpus):
    report = []
    same(*corpus, report=report)
    assert sum(report[0]) == 40 and sum(report[0][:-1]) > 0  # some are proven before the last tier
    same(*corpus, best=1)
    same(*corpus, best=70)


def test_items_in_slices(corpus):
    report = []
    same(*corpus, terms=100, report=report)
    assert len(report) > 2


def test_small_blocks_and_steps(corpus, monkeypatch):
    monkeypatch.setattr(T, "STEP", 500)
    same(*corpus)


def test_operator_fixtures(docs, items, awkward):
    same(docs, items)
    same(awkward, items.union(items))
    same(docs, items.withColumns({c: F.lit("x") for c in ("item", "term", "times", "row", "rank", "score")}).unionByName(items, allowMissingColumns=True).select("item_id", "text", "item", "rank"))


def test_nothing_to_find(spark, docs, items, empty):
    assert T.search(empty, items).count() == 0
    assert T.search(docs, items.limit(0)).count() == 0
    none = spark.createDataFrame([(1, None), (2, " - "), (3, "neverseenword")], "item_id long, text string")
    assert T.search(docs, none).count() == 0
    blank = spark.createDataFrame([(1, None), (2, " .,;")], "doc_id long, text string")
    assert T.search(blank, items).count() == 0


def test_equal_scores_by_id(spark):
    rows = [(k, "same words here") for k in (9, 3, None, 7, 7)] + [(k, "other text entirely") for k in range(20, 40)]
    out = same(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, "Same WORDS, here")], "item_id long, text string"))
    assert [r[2] for r in sorted(out, key=lambda r: r[1])] == [3, 7, 7, 9, None]


def test_long_document(spark, items):
    rows = [(1, "the quick brown fox " * 200_000), (2, "quick"), (3, "x" * 2_000_000), (4, "a dog rests at last ÀÉ")]
    same(spark.createDataFrame(rows, "doc_id long, text string"), items)


def test_blocks_split_by_documents_and_postings(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 9, 3000)
    terms = [rng.choice(50, s, replace=False).astype(np.int32) for s in sizes]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(3000)), pa.array([None if k % 7 == 0 else k for k in range(3000)], pa.int64()), pa.array(np.full(3000, 10)), pa.array([t.tobytes() for t in terms]), pa.array([np.ones(len(t), np.int64).tobytes() for t in terms])], ["row", "doc_id", "n", "terms", "times"])
    weights = T.Weights(rng.integers(0, 900, 50), 3000, 30000)
    for most in (T.POSTINGS, 700):
        monkeypatch.setattr(T, "POSTINGS", most)
        found = {}
        for block in T._blocked(weights)([batch]):
            row = np.frombuffer(block.column("rows")[0].as_py(), np.int64)
            assert len(row) <= T.DOCS and block.column("docs")[0].as_py() == len(row)
            for t, name in enumerate(T.TIER):
                term, place, gain = T.unpacked(block.column(name)[0].as_py())
                assert (gain >= weights.floors()[t]).all() and (t == 0 or (gain < weights.floors()[t - 1]).all())
                found |= {(int(row[p]), int(x)): int(g) for x, p, g in zip(term, place, gain)}
        want = {(k, int(x)): int(weights.gains(np.array([x]), np.array([1]), np.array([10]))[0]) for k, t in enumerate(terms) for x in t}
        assert found == {k: g for k, g in want.items() if g}


def test_sql(docs, items):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    con.register("benchmark", pd.DataFrame([tuple(r) for r in items.collect()], columns=["item_id", "text"]).convert_dtypes())
    got = sorted((tuple(r) for r in T.search(docs, items).collect()), key=repr)
    assert sorted(con.execute(T.SQL).fetchall(), key=repr) == got
