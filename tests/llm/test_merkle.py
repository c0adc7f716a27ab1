"""The manifest against a plain tree, and exact ranks of hot and awkward keys."""

import random

import brute
import duckdb
import pytest
from pyspark.sql import functions as F

from parcelmill.llm import op13_merkle

FIELDS = list(op13_merkle.FIELDS)


def plain(df):
    return sorted(brute.manifest([tuple(r) for r in df.select(*FIELDS).collect()]), key=repr)


def got(df):
    return sorted((tuple(r) for r in op13_merkle.manifest(df).collect()), key=repr)


def made(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)


def test_manifest(docs, awkward):
    assert got(docs) == plain(docs)
    assert got(awkward) == plain(awkward)


def test_columns_whose_names_the_operator_uses(docs):
    more = docs.withColumns({n: F.lit("x") for n in ("tree", "hash", "changed", "row", "rank", "n", "bucket", "way", "kids", "up", "root", "leaf")})
    assert got(more) == plain(docs)


def test_many_sources_of_many_sizes(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, -5, 2**40, k, k]), rng.choice([None, "", "é", "A", "a", "hot", "hot", "hot", f"s{k}"]), "en", k, rng.choice([None, "", "Some TEXT", f"T{k}"])) for k in range(700)]
    rows += [rows[0], rows[0], (7, "lone", None, None, "Only One"), (10, "hot", "en", None, "x" * 300_000 + "Y")]
    df = made(spark, rows)
    assert got(df) == plain(df)


@pytest.mark.parametrize("n", [1, 15, 16, 17, 256, 257])
def test_sizes_around_whole_runs(spark, n):
    df = made(spark, [(k * 3, "only", "en", 1, f"Text {k}") for k in range(n)])
    assert got(df) == plain(df)


def test_tampering_shows(spark):
    df = made(spark, [(k, "s", "en", 1, "Upper" if k % 2 else "lower") for k in range(60)])
    for r in op13_merkle.manifest(df).withColumn("chosen", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).collect():
        assert r.verified == (not (r.chosen and r.doc_id % 2))


def test_empty(empty):
    assert op13_merkle.manifest(empty).count() == 0


@pytest.mark.parametrize("bucket, digits", [(1, 1), (3, 2), (512, 3)])
def test_exact_ranks(spark, bucket, digits):
    rng = random.Random(1)
    keys = {f"{rng.choice(['00000', '0001', 'ff', ''])}{rng.randrange(16 ** 4):x}" for _ in range(400)}
    rows = [(t, k) for t in ("a", "b", "") for k in keys if t != "b" or k < "01"]
    out = op13_merkle.ranked(spark.createDataFrame(rows, "tree string, key string"), bucket, digits).collect()
    want = {(t, k): i for t in ("a", "b", "") for i, k in enumerate(sorted(k for s, k in rows if s == t))}
    assert {(r.tree, r.key): r["rank"] for r in out} == want
    assert all(r.n == sum(t == r.tree for t, _ in rows) for r in out)


def test_sql(docs, awkward):
    for df in (docs, awkward):
        documents = df.select(*FIELDS).toPandas().convert_dtypes()
        con = duckdb.connect()
        con.register("documents", documents)
        assert sorted(con.execute(op13_merkle.SQL).fetchall(), key=repr) == plain(df)
