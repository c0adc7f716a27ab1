"""Every registered shipment query against its SQL, on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from parcelmill.plans import catalog
from parcelmill.plans.adapters import TABLES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame):
    def plain(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return None
        if isinstance(x, (bool, np.bool_, str)) or not hasattr(x, "dtype") and not isinstance(x, (int, float)):
            return str(x)
        return str(round(float(x), 6))

    return sorted(tuple(str(plain(v)) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, FOLDER).toPandas()
    want = duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) and rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_leader_groups_read_all_64_signs(spark, duck):
    vectors = duck.execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    leaders, want = {}, {}
    for pos, e in vectors:
        assert len(e) == 64
        bits = sum(1 << i for i, x in enumerate(e) if x > 0)
        own = leaders.setdefault(pos % 10, [])
        want[pos] = next((p for p, b in own if (b ^ bits).bit_count() <= 6), None)
        if want[pos] is None:
            want[pos] = pos
            own.append((pos, bits))
    assert {r.pos: r.leader for r in catalog.queries()["leader_groups"](spark, FOLDER).collect()} == want


def test_best_pass_of_scores_that_differ_in_the_last_bit(spark, tmp_path):
    scores = {}
    for s in range(8):
        for p in range(300):
            scores.setdefault(100 * s + 125 * (p % 6) + p % 100, {})[s * 20 + p % 6 * 25 + p % 100 / 100 * 20] = (s, p)
    made, k = [], 0
    for same in scores.values():
        if len(same) > 1:
            k += 1
            made += [(k, same[x][1], same[x][0], line) for line, x in enumerate(sorted(same), 3)]
    first = k
    assert first > 5
    made += [(k + 1, 7, None, 1), (k + 1, 8, 1, 2), (k + 2, None, 3, 1), (k + 3, 5, 3, None), (k + 3, 4, 0, 6), (k + 4, 5, 5, 2), (k + 4, 5, 5, 1)]
    spark.createDataFrame(made, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalog.queries()["best_ocr_pass"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert rows(got) == rows(con.execute(catalog.oracle_sql()["best_ocr_pass"]).df())
    assert {r.pass_no for r in got.itertuples() if r.image_id <= first} == {3}


def test_hamming_pairs_hold_every_link(spark, tmp_path):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 64))
    near = base[rng.integers(0, 12, 40)] * np.where(rng.random((40, 64)) < 0.04, -1, 1)
    same = base[[0] * 9 + [1, 2, 2]] * rng.random((12, 64))  # other vectors of the same signs
    made = [(i, [float(x) for x in e]) for i, e in enumerate(np.concatenate([base, near, same]))]
    spark.createDataFrame(made, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = catalog.queries()["hamming_pairs"](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(con.execute(catalog.oracle_sql()["hamming_pairs"]).df())
    keys = [v for v, _ in con.execute(f"WITH {catalog.COPIED} SELECT vec_id, bits FROM hc").fetchall()]
    own = {r.b: r.a for r in got.itertuples() if r.distance == 0}
    classed = {(r.a, r.b): r.distance for r in got.itertuples() if r.distance}
    links = {}
    for a in keys:
        for b in keys:
            x, y = own.get(a, a), own.get(b, b)
            if a < b and (x == y or (min(x, y), max(x, y)) in classed):
                links[a, b] = 0 if x == y else classed[min(x, y), max(x, y)]
    every = con.execute(f"WITH {catalog.COPIED} SELECT a.vec_id, b.vec_id, bit_count(xor(a.bits, b.bits)) FROM hc a JOIN hc b ON a.vec_id < b.vec_id AND bit_count(xor(a.bits, b.bits)) <= 6").fetchall()
    assert links == {(a, b): n for a, b, n in every} and sum(n == 0 for n in links.values()) >= 49
    assert all(r.n_a == r.n_b for r in got.itertuples() if r.distance == 0)
